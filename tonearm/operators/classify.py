"""Releases against a library: keep, prune or review.

A release is scored only against library entries that share a token with it; every join is an
equi-join on a token, an artist or a pair, so Spark deals it out and splits skewed tokens itself.
Rows decided by an exact match skip scoring. Distinct (artist, title) pairs are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import SPLIT, jaro_winkler, token_ratios
from ..functions.text import match_form, or_empty

SEPARATOR = "|||"


@dataclass(frozen=True)
class ClassifyConfig:
    token_set_threshold: float = 0.8
    token_sort_threshold: float = 0.8
    two_stage_threshold: float = 0.8
    artist_threshold: float = 0.7
    prune_ceiling: float = 0.4


def token_array(x: Column) -> Column:
    """Distinct tokens in lower case; the separator is none."""
    return F.array_distinct(F.filter(F.split(F.lower(x), SPLIT), lambda t: (t != "") & (t != SEPARATOR)))


def combined(artist: Column, title: Column) -> Column:
    return F.concat(artist, F.lit(f" {SEPARATOR} "), title)


@dataclass(frozen=True)
class LibraryIndex:
    """Library tables in match form; cache them to classify several tables against one library."""

    pairs: DataFrame  # artist, title; distinct
    texts: DataFrame  # text: "artist ||| title"; distinct
    artists: DataFrame  # artist; distinct

    @classmethod
    def from_pairs(cls, pairs: DataFrame, artist: str = "artist", title: str = "title") -> LibraryIndex:
        rows = pairs.select(match_form(F.col(artist)).alias("artist"), match_form(F.col(title)).alias("title")).distinct()
        return cls(rows, rows.select(combined(F.col("artist"), F.col("title")).alias("text")).distinct(), rows.select("artist").distinct())


def token_index(entries: DataFrame, column: str) -> DataFrame:
    """``token, column``: one row for each entry and token."""
    return entries.select(F.explode(token_array(F.col(column))).alias("token"), column)


def candidates(queries: DataFrame, query: str, entries: DataFrame, entry: str) -> DataFrame:
    """Distinct (query, entry) that share a token."""
    left = queries.select(query).distinct().select(F.explode(token_array(F.col(query))).alias("token"), query)
    return left.join(token_index(entries, entry), "token").select(query, entry).distinct()


def score_exact(releases: DataFrame, index: LibraryIndex) -> DataFrame:
    """``artist, title`` of ``releases`` (in match form) with ``exact``: 1.0 or 0.0."""
    hit = index.pairs.withColumn("exact", F.lit(1.0))
    return releases.join(hit, ["artist", "title"], "left").withColumn("exact", F.coalesce("exact", F.lit(0.0)))


def score_tokens(releases: DataFrame, index: LibraryIndex) -> DataFrame:
    """``artist, title, ts, tr``: best token-set and token-sort ratios, 0 without a candidate."""
    queries = releases.select("artist", "title").distinct().withColumn("q", combined(F.col("artist"), F.col("title")))
    near = candidates(queries, "q", index.texts, "text").withColumn("s", token_ratios(F.col("q"), F.col("text")))
    best = near.groupBy("q").agg(F.max("s.token_set").alias("ts"), F.max("s.token_sort").alias("tr"))
    return queries.join(best, "q", "left").select("artist", "title", F.coalesce("ts", F.lit(0.0)).alias("ts"), F.coalesce("tr", F.lit(0.0)).alias("tr"))


def score_two_stage(releases: DataFrame, index: LibraryIndex, artist_threshold: float = 0.7) -> DataFrame:
    """``artist, title, tw``: root of best artist score times that artist's best title score."""
    queries = releases.select("artist", "title").distinct()
    names = index.artists.select(F.col("artist").alias("lib_artist"))
    near = candidates(queries, "artist", names, "lib_artist").withColumn("a", jaro_winkler(F.col("artist"), F.col("lib_artist")))
    # the highest score; of equal ones the first artist in order
    first = Window.partitionBy("artist").orderBy(F.desc("a"), "lib_artist")
    best = near.where("a > 0").withColumn("n", F.row_number().over(first)).where("n = 1").where(F.col("a") >= artist_threshold).drop("n")
    titles = index.pairs.select(F.col("artist").alias("lib_artist"), F.col("title").alias("lib_title"))
    scored = queries.join(best, "artist").join(titles, "lib_artist").withColumn("t", jaro_winkler(F.col("title"), F.col("lib_title")))
    top = scored.groupBy("artist", "title").agg(F.max("t").alias("t"), F.max("a").alias("a"))
    return queries.join(top, ["artist", "title"], "left").select("artist", "title", F.coalesce(F.sqrt(F.col("a") * F.col("t")), F.lit(0.0)).alias("tw"))


def decision(exact: Column, ts: Column, tr: Column, tw: Column, c: ClassifyConfig) -> Column:
    between = lambda x, thr: (x >= c.prune_ceiling) & (x < thr)
    high = (ts >= c.token_set_threshold) & (tr >= c.token_sort_threshold) & (tw >= c.two_stage_threshold)
    low = (ts < c.prune_ceiling) & (tr < c.prune_ceiling) & (tw < c.prune_ceiling)
    return (
        F.when(exact == 1.0, "keep")
        .when(between(ts, c.token_set_threshold), "review")
        .when(between(tr, c.token_sort_threshold), "review")
        .when(high, "keep")
        .when(low, "prune")
        .otherwise("review")
    )


def classify(releases: DataFrame, index: LibraryIndex, config: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """``artist, title, exact, ts, tr, tw, classification`` for distinct pairs in match form."""
    pairs = score_exact(releases.select("artist", "title").distinct(), index)
    open_ = pairs.where("exact = 0").select("artist", "title")
    scored = score_tokens(open_, index).join(score_two_stage(open_, index, config.artist_threshold), ["artist", "title"])
    every = pairs.join(scored, ["artist", "title"], "left")
    ts, tr, tw = (F.coalesce(c, F.lit(0.0)) for c in ("ts", "tr", "tw"))
    return every.select("artist", "title", "exact", "ts", "tr", "tw", decision(F.col("exact"), ts, tr, tw, config).alias("classification"))


def batch_classify(releases: DataFrame, library: DataFrame | LibraryIndex, artist: str = "artist", title: str = "title", config: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """All columns of ``releases`` and ``classification``; any casing and spelling of the input.

    A NULL artist or title counts as the empty text. A column ``classification`` is replaced.
    """
    index = library if isinstance(library, LibraryIndex) else LibraryIndex.from_pairs(library)
    rows = releases.drop("classification") if "classification" not in (artist, title) else releases
    a, t = (_free(n, rows.columns) for n in ("match_artist", "match_title"))
    keyed = rows.withColumns({a: or_empty(match_form, F.col(artist)), t: or_empty(match_form, F.col(title))})
    found = classify(keyed.select(F.col(a).alias("artist"), F.col(t).alias("title")), index, config)
    found = found.select(F.col("artist").alias(a), F.col("title").alias(t), "classification")
    return keyed.join(found, [a, t], "left").select(*rows.columns, "classification")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
