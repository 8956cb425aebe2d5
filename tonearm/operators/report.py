"""What a change of key does to a column: rows that differ, which step did it, groups that move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import match_form

STEPS = ("parens", "articles", "punctuation", "disambiguator")


def keyed(rows: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """``id, name, baseline`` (match form), the three identity forms, and a flag for each step."""
    base = rows.select(F.col(id_column).alias("id"), F.col(name_column).alias("name")).withColumn("baseline", match_form(F.col("name")))
    b = F.col("baseline")
    parens = identity.strip_parens(b)
    base = base.withColumn("_p", parens)
    base = base.withColumn("_a", identity.drop_articles(F.col("_p")))
    base = base.withColumn("identity", identity.collapse_space(F.col("_a")))
    base = base.withColumn("punctuation", identity.collapse_space(identity.collapse_punctuation(F.col("_a"))))
    base = base.withColumn("disambiguator", identity.strip_disambiguator(F.col("identity")))
    flags = {
        "step_parens": F.col("_p") != F.col("baseline"),
        "step_articles": F.col("_a") != F.col("_p"),
        "step_punctuation": F.col("punctuation") != F.col("identity"),
        "step_disambiguator": F.col("disambiguator") != F.col("identity"),
    }
    return base.withColumns(flags).drop("_p", "_a")


def diff(rows: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Rows where any identity form is not the match form."""
    k = keyed(rows, id_column, name_column)
    return k.where((F.col("identity") != F.col("baseline")) | (F.col("punctuation") != F.col("baseline")) | (F.col("disambiguator") != F.col("baseline")))


def impact(rows: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """``step, n_rows``: rows that one step alone changes, and those that several change."""
    d = diff(rows, id_column, name_column)
    n = sum((F.col(f"step_{s}").cast("int") for s in STEPS), F.lit(0))
    sums = d.agg(*[F.count_if(F.col(f"step_{s}") & (n == 1)).alias(s) for s in STEPS], F.count_if(n > 1).alias("multiple"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("n_rows")) for c in (*STEPS, "multiple")])).alias("x")).select("x.*")


def shift(rows: DataFrame, id_column: str, name_column: str, form: str = "identity") -> DataFrame:
    """One row: distinct keys before and after, rows whose key changed, rows that lost or gained
    a group of their own, in numbers and in percent."""
    k = keyed(rows, id_column, name_column).select("baseline", F.col(form).alias("key"))
    # sizes by key first: a hot key is a row in these tables
    both = k.groupBy("baseline", "key").agg(F.count("*").alias("n"))
    old = both.withColumn("n_old", F.sum("n").over(Window.partitionBy("baseline")))
    new = old.withColumn("n_new", F.sum("n").over(Window.partitionBy("key")))
    lost, gained = (F.col("n_old") == 1) & (F.col("n_new") > 1), (F.col("n_old") > 1) & (F.col("n_new") == 1)
    total = F.sum("n")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    percent = lambda c: F.coalesce(F.round(c / total * 10000) / 100, F.lit(0.0))
    changed = part(F.col("baseline") != F.col("key"))
    return new.agg(
        F.coalesce(total, F.lit(0)).alias("n_rows"),
        F.count_distinct("baseline").alias("distinct_baseline"),
        F.count_distinct("key").alias("distinct_key"),
        changed.alias("changed"),
        part(lost).alias("lost"),
        part(gained).alias("gained"),
        percent(part(lost | gained)).alias("shift_percent"),
    )


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "review").when(confidence.isNotNull(), "low")


def gate(shift_percent: Column) -> Column:
    return F.when(shift_percent <= 2, "green").when(shift_percent <= 5, "review").otherwise("refine")
