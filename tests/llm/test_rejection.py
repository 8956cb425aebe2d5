"""Texts of a language that was not learned are rejected; those of learned ones stay."""

import os

import pytest
from pyspark.sql import functions as F

from tonearm.llm import language_id


@pytest.mark.parametrize("out", ["de", "fr"])
def test_left_out_language(spark, sf_dir, out):
    d = spark.read.parquet(f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.01/documents.parquet").where("lang IS NOT NULL")
    learned = d.where(F.col("lang") != out)
    models = language_id.train(learned)
    assert out not in models.languages
    found = language_id.identify(d.where("length(text) >= 300"), models).join(d.select("doc_id", "lang"), "doc_id")
    rate = {r["foreign"]: r["rate"] for r in found.groupBy((F.col("lang") == out).alias("foreign")).agg(F.avg(F.col("rejected").cast("int")).alias("rate")).collect()}
    assert rate[True] > 0.9
    assert rate[False] < 0.01


def test_noise(spark, sf_dir):
    import random

    rnd = random.Random(3)
    d = spark.read.parquet(f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.01/documents.parquet")
    models = language_id.train(d)
    noise = [(i, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.choice([20, 60, 300])))) for i in range(60)]
    out = language_id.identify(spark.createDataFrame(noise, "doc_id long, text string"), models).collect()
    assert all(r["rejected"] for r in out)


def test_rare_language_is_learned(spark):
    """A language of two documents is fitted on both."""
    words = {"aa": "alpha anna arama lasa masala", "oo": "tolomo rondo fosso gogo morto"}
    rows = [(i, "aa", " ".join(words["aa"].split() * 8)) for i in range(300)] + [(i, "oo", " ".join(words["oo"].split() * 8)) for i in (1000, 1001, 1002)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").where(language_id.remainder_of() != 0)
    models = language_id.train(d)
    assert models.languages == ["aa", "oo"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, models).collect()}
    assert all(got[r["doc_id"]] == r["lang"] for r in d.collect())
