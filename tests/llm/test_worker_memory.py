"""What Python workers hold: within a task, and from one stage to the next."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tonearm.llm import _common, jaccard, language_id, tokens

WORDS = 60_000


@pytest.fixture(scope="module")
def models():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choices("abcdefghij", k=rnd.randint(4, 9))) for _ in range(3000)})
    counts = np.random.default_rng(4).integers(0, 4, (len(words), 4)).astype("f8")
    return language_id.fit_models(words, counts, ["de", "en", "es", "fr"])


def test_many_new_words_are_scored_in_blocks(models):
    rnd = random.Random(5)
    words = list(dict.fromkeys("".join(rnd.choices("abcdefghijkl", k=8)) for _ in range(WORDS)))
    scorer = language_id.Scorer(models)
    tracemalloc.start()
    try:
        scorer.learn(words)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most - kept < 64e6  # all at once: over 100 MB
    bits, n = models.score(words)
    rows = scorer.table[[scorer.row[w] for w in words]]
    assert (rows[:, :-1] == bits).all() and (rows[:, -1] == n).all()


@pytest.mark.parametrize("operator", ["keep_accepted", "identify", "sketches"])
def test_token_memos_go_when_another_stage_runs(spark, monkeypatch, models, operator):
    docs = spark.createDataFrame([(1, "abc def ghi abc")], "doc_id long, text string")
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    if operator == "sketches":
        jaccard._sketches(docs)
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "key": [5], "text": ["abc def ghi abc"]})
    else:
        getattr(language_id, operator)(docs, models)
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["abc def ghi abc"]})
    tokens.word_ids(_common.tokenizer_path()).encode("some words")
    assert sum(b.num_rows for b in found[0](iter([batch]))) == 1
    assert tokens.word_ids.cache_info().currsize == 0
