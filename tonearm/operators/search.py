"""Full-text search as an inverted index table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfd


def terms(x: Column) -> Column:
    """Distinct terms: letters and numbers in lower case, without marks."""
    plain = F.regexp_replace(nfd(F.lower(x)), "\\p{M}+", "")
    return F.array_distinct(F.filter(F.split(plain, "[^\\p{L}\\p{N}\\p{Co}]+"), lambda t: t != ""))


def build_index(rows: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """``term, field, rowid``. Partition or bucket it by ``term`` where it is kept."""
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])).alias("f")
    return rows.select(F.col(id_column).alias("rowid"), every).select("rowid", "f.field", F.explode(terms(F.col("f.text"))).alias("term")).select("term", "field", "rowid")


def match(index: DataFrame, term: str, field: str | None = None) -> DataFrame:
    """``rowid`` of rows that have the term, in one field or in any."""
    found = index.where(F.array_contains(terms(F.lit(term)), F.col("term")))
    return (found.where(F.col("field") == field) if field else found).select("rowid").distinct()


def find(rows: DataFrame, id_column: str, columns: Sequence[str], term: str) -> DataFrame:
    """``rowid`` of rows that have the term in any of the columns: one search without an index."""
    wanted = terms(F.lit(term))
    has = F.lit(False)
    for c in columns:
        has = has | F.coalesce(F.arrays_overlap(terms(F.col(c).cast("string")), wanted), F.lit(False))
    return rows.where(has).select(F.col(id_column).alias("rowid")).distinct()
