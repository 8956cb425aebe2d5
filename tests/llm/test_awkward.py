"""Empty tables, clashing names, rows without ids, repeated rows and long texts, for operators and stages."""

import random
import time

import corpus_pipeline
import pytest
from llm_brute import base_sha256, base_spans, fingerprint
from pyspark.sql import functions as F

from tonearm.llm import _common, crf_quality, html_density, jaccard, language_id, packing, pii, rans_tokens, simhash, source_mix, token_rollups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "k_doc_id", "l_doc_id", "l_quality", "m_doc_id", "m_words", "m_taken", "mix_doc_id", "mix_words", "mix_copy", "pii_spans", "jaccard_row", "key", "fp", "size", "at", "cell", "bucket", "start", "end", "quality",
    "label", "whole", "root", "pack_group", "copy", "taken", "target", "component_id", "same", "n_0", "kind", "doc_id_", "words", "weight", "level",
)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without ids, repeated rows, a hot source, ties; and all clashing names."""
    text = "The quick brown fox jumps over the lazy dog and runs into the wide green forest of the north. "
    rows = [(None, text * 3, "en", "a", 1)] * 5 + [(7, text, "en", "a", 1)] * 4 + [(i, f"{text} number {i} " * (i % 5), None if i % 4 else "en", None if i % 9 == 0 else "a", None) for i in range(20, 60)]
    rows += [(100, None, None, None, None), (101, "", "en", "b", 0), (None, None, None, None, None), (102, "word " * 30_000, "en", "a", 0), (103, "12 34, " * 20_000, "en", "a", 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(4)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, "unused")
    if name != "packing":
        assert out.columns == odd.columns
        assert {r["k_doc_id"] for r in out.select("k_doc_id").collect()} == {"clash"}
    n = out.count()
    assert n > 0
    if name == "pii":
        assert n == odd.count()
        without = stage(spark, odd.drop("n_chars"), "unused")
        assert "n_chars" not in without.columns
        assert without.count() == n
    if name == "simhash_near_dedup":
        assert out.where("doc_id = 7").count() <= 1
    assert stage(spark, odd.limit(0), "unused").count() == 0


def test_operators(spark, odd):
    n, empty = odd.count(), odd.limit(0)
    for got in (
        crf_quality.judge(odd, None), language_id.identify(odd, language_id.train(odd)), simhash.near_duplicates(odd), source_mix.mix(odd),
        pii.add_spans(odd, name="found"),
    ):
        assert got.count() == n
    for got in (crf_quality.judge(empty, None), simhash.near_duplicates(empty), source_mix.mix(empty), pii.add_spans(empty, name="found"), packing.pack_documents(empty), source_mix.mixed_rows(empty), jaccard.keep_one(empty)):
        assert got.count() == 0
    with pytest.raises(ValueError, match="pii_spans"):
        pii.add_spans(odd)
    found = simhash.near_duplicates(odd).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in by_text.values())
    path = _common.new_path(spark, "test-tokens")
    rans_tokens.write_tokens(odd, path, _common.tokenizer_path())
    assert rans_tokens.read_tokens(spark, path).count() == n
    assert token_rollups.maintained(odd, _common.new_path(spark, "test-rollup")).totals().agg(F.sum("n_docs")).first()[0] == 2 * odd.select("text").where("text IS NOT NULL").distinct().count() + 2 * odd.where("text IS NULL").count()


def test_pages(spark):
    rows = [(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (None, None, None), (2, None, "<p>" + "long text " * 200_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "density_sum": F.lit(2)})
    out = html_density.extract(d)
    assert sorted(((r["page_id"], r["n_chars"]) for r in out.collect()), key=repr) == sorted([(1, 3), (1, 3), (None, 0), (2, 1_999_999)], key=repr)
    assert html_density.extract(d.limit(0)).count() == 0


def test_rows_without_ids_fill_many_groups(spark):
    """Neither equal ids nor equal rows meet in one packing group."""
    d = spark.createDataFrame([(None, "one two three")] * 4000 + [(5, f"text {i}") for i in range(4000)], "doc_id long, text string")
    pieces = packing.pieces_of(d, _common.tokenizer_path())
    out = packing.pack(pieces, 8000, pieces_a_group=200)
    per = [r["n"] for r in out.withColumn("g", F.col("sequence_id") % 40).groupBy("g").agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 8000
    assert max(per) < 400


def test_hot_fingerprint_and_large_buckets(spark, monkeypatch):
    """A third of all rows is one text; buckets of a few rows are cut into parts."""
    monkeypatch.setattr(simhash, "PART", 3)
    monkeypatch.setattr(simhash, "DEPTH", 0)
    rnd = random.Random(6)
    texts = ["same text over and over again"] * 100 + [" ".join(f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(3, 9))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(d, bucket=8).collect()}
    from llm_brute import groups

    assert out == groups({i: fingerprint(t) for i, t in enumerate(texts)})


def test_personal_data_in_a_long_text(spark):
    """Numbers, addresses and cards by the thousand in one text, in seconds."""
    rnd = random.Random(4)
    parts = [str(rnd.randrange(10**9)) for _ in range(200_000)] + [f"10.{i % 256}.{i // 256 % 256}.7" for i in range(25_000)] + [f"user{i}@mail.example.org" for i in range(25_000)] + ["4433 6680 4113 3334"] * 2000 + ["+1 438 555 7372"] * 2000
    rnd.shuffle(parts)
    text = ", ".join(parts)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.perf_counter()
    r = pii.add_spans(d).select("pii_spans", pii.redacted(F.col("text"), F.col("pii_spans")).alias("clean")).first()
    assert time.perf_counter() - begin < 90
    base = [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["pii_spans"] if s["kind_no"] < 4]
    assert base_sha256(base) == base_sha256(base_spans(text))
    out, at = [], 0
    for s in r["pii_spans"]:
        if s["start"] >= at:
            out.append(text[at : s["start"]] + f"[{s['kind'].upper()}]")
        at = max(at, s["end"])
    assert r["clean"] == "".join(out) + text[at:]


def test_context_of_close_matches(spark):
    """Context words are looked for in the 40 code points before a span, across other matches."""
    rnd = random.Random(12)
    pool = ["card", "server", "call", "123-45-6789", "ssn", "1.2.3.4", "a@b.co", "+1 438 555 7372", "4433668041133335", "é", "x", ", ", " and ", "taxpayer "]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import re

    for r in pii.add_spans(d).collect():
        text = texts[r["doc_id"]]
        for s in r["pii_spans"]:
            before = text[max(0, s["start"] - pii.NEAR) : s["start"]].lower()
            want = pii.SCORE[s["kind"]] + pii.LIFT * bool(re.search(pii.CONTEXT[s["kind"]], before))
            assert s["score"] == pytest.approx(min(1.0, want)), (text, s)


def test_tables_for_a_stage_go(spark, odd):
    with _common.cleared(spark):
        kept = _common.stage(odd.select("doc_id"), "test-cleared")
        path = _common._MADE[-1][0]
        assert kept.count() == odd.count()
    assert not _common.path_exists(spark, path)


def test_components_of_stars_and_chains(spark):
    """A hub of most edges, chains and rings, against a plain union of sets."""
    rnd = random.Random(9)
    edges = [(0, k) for k in range(1, 400)] + [(5000 - k, 5001 - k) for k in range(60)] + [(rnd.randint(6000, 6300), rnd.randint(6000, 6300)) for _ in range(200)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(root)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
