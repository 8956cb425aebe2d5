"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
import pytest
from llm_brute import WORD, fingerprint
from pyspark.sql import functions as F

from tonearm.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def families(seed=3):
    """Texts with few to many words replaced, around the limit of 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(12):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([4, 12, 60, 200, 700]))]
        for share in (0, 0, 0.005, 0.015, 0.02, 0.025, 0.03, 0.06):
            out.append(" ".join(f"x{rnd.randint(0, 5000)}" if rnd.random() < share else w for w in words))
    return out


def test_stage_drops_near_copies(spark, sf_dir):
    texts = families() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j]):
                far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > simhash.RADIUS
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert far > 10  # links that op8's three bits do not see
    out = corpus_pipeline.near_duplicates(spark, d, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(set(root))
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    assert corpus_pipeline.near_duplicates(spark, d.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize(("members", "dealt", "block"), [(3, 1024, 256), (0, 2, 3)])
def test_large_components_are_dealt_out(spark, monkeypatch, members, dealt, block):
    """All candidate components as large ones, in tasks and blocks of a few sets."""
    monkeypatch.setattr(jaccard, "DEALT", dealt)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rnd = random.Random(11)
    texts = families(5)
    # a chain: each text is like the next one, the ends are not alike
    words = [f"c{i}" for i in range(120)]
    for k in range(25):
        texts.append(" ".join(words))
        words = words[4:] + [f"d{k}_{j}" for j in range(4)]
    # a large group around one text
    base = [f"g{i}" for i in range(200)]
    for _ in range(60):
        copy = list(base)
        for at in rnd.sample(range(200), rnd.randint(0, 5)):
            copy[at] = f"h{rnd.randint(0, 99999)}"
        texts.append(" ".join(copy))
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and alike(a, sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("jaccard_row", "whole", "key")}).repartition(3)
    out = jaccard.keep_one(d, members=members)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(root))


def test_null_and_shared_ids_never_merge_groups(spark):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in ("a", "b", "c", "d", "e")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (8, texts[4])]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA), None).collect()
    assert sorted(r["text"].lower() for r in out) == texts
    assert {r["doc_id"] for r in out if r["text"] == texts[4]} == {8}
