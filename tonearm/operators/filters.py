"""Filters by a set of names: existence joins on the match form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.artists import trim_white
from ..functions.text import let, match_form

ALIASES = "artist_id string, alias_ref string, alias_name string"


def name_set(names: DataFrame, column: str = "value") -> DataFrame:
    """``key``: distinct match forms of non-blank names."""
    name = trim_white(F.col(column))
    return names.where(name != "").select(match_form(name).alias("key")).distinct()


def load_names(spark: SparkSession, path: str) -> DataFrame:
    """A name a line."""
    return name_set(spark.read.text(path))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``artist_id, key`` from the first and third column of a CSV with a header.

    An id that is no number is 0; blank aliases go.
    """
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(ALIASES).csv(path)
    return rows.select(F.coalesce(F.expr("try_cast(artist_id AS BIGINT)"), F.lit(0)).alias("artist_id"), match_form(F.col("alias_name")).alias("key")).where("key IS NOT NULL AND key <> ''")


def flag(rows: DataFrame, key: Column, names: DataFrame, out: str) -> DataFrame:
    """``rows`` with a boolean: is ``key`` in the set? One join, no row added or lost."""
    hit = names.select(F.col("key").alias("_set_key")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.withColumn("_key", key).join(hit, F.col("_key") == F.col("_set_key"), "left")
    return joined.withColumn(out, F.col("_hit").isNotNull()).drop("_key", "_set_key", "_hit")


def filter_artists(rows: DataFrame, column: str, names: DataFrame, out: str = "matches") -> DataFrame:
    return flag(rows, match_form(F.col(column)), names, out)


def matches_any(rows: DataFrame, id_column: str, column: str, names: DataFrame, out: str = "matches") -> DataFrame:
    """``id, matches``: does any name of the id match?"""
    return filter_artists(rows, column, names, out).groupBy(id_column).agg(F.bool_or(out).alias(out))


def matches_any_with_aliases(rows: DataFrame, id_column: str, artist_id: str, column: str, names: DataFrame, aliases: DataFrame, out: str = "matches") -> DataFrame:
    """``id, matches``: does any name of the id, or any alias of its artists, match?"""
    known = aliases.join(names, "key", "left_semi").select(F.col("artist_id").alias("_alias_id")).distinct().withColumn("_alias", F.lit(True))
    direct = filter_artists(rows, column, names, "_direct")
    joined = direct.join(known, F.col(artist_id).cast("long") == F.col("_alias_id"), "left")
    return joined.groupBy(id_column).agg(F.bool_or(F.col("_direct") | F.col("_alias").isNotNull()).alias(out))


def title_keys(title: Column) -> Column:
    """The title's match form, and that of what precedes its last ``[``."""

    def keys(whole: Column) -> Column:
        before = F.regexp_replace(F.regexp_replace(whole, "(?s)\\[[^\\[]*\\z", ""), "\\p{IsWhite_Space}+\\z", "")
        cut = F.when(F.contains(whole, F.lit("[")), F.nullif(before, F.lit("")))
        return F.array_distinct(F.filter(F.array(whole, cut), lambda k: k.isNotNull()))

    return let(match_form(title), keys)


def filter_titles(rows: DataFrame, id_column: str, column: str, titles: DataFrame, out: str = "matches") -> DataFrame:
    keyed = rows.select(F.col(id_column), F.explode_outer(title_keys(F.col(column))).alias("_k"))
    return flag(keyed, F.col("_k"), titles, out).groupBy(id_column).agg(F.bool_or(out).alias(out))


def describe(names: DataFrame, aliases: DataFrame | None = None) -> dict[str, int | bool]:
    n = names.count()
    return {"len": n, "is_empty": n == 0, "has_aliases": aliases is not None and not aliases.isEmpty()}
