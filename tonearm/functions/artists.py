"""Artist names: compilations and credits of several artists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, match_form

#: All Unicode white space.
_TRIM = "\\A\\p{IsWhite_Space}+|\\p{IsWhite_Space}+\\z"


def trim_white(x: Column) -> Column:
    return F.regexp_replace(x, _TRIM, "")


def is_compilation(x: Column) -> Column:
    low = F.lower(x)
    whole = low.isin("various", "soundtrack", "compilation")
    begins = low.rlike("(?s)\\A(?:various artists|v/a|v\\.a|soundtracks)(?:[^\\p{IsAlphabetic}\\p{N}].*)?\\z")
    return whole | begins


def _parts(x: Column, delimiter: str) -> Column:
    return F.transform(F.split(x, F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E")), -1), trim_white)


def _valid(parts: Column) -> Column:
    """Parts of more than one byte, first of each, NULL if none is left."""
    return F.nullif(F.array_distinct(F.filter(parts, lambda p: F.octet_length(p) > 1)), F.array().cast("array<string>"))


def _by_comma(name: Column) -> Column:
    parts = _parts(name, ", ")
    numeric = F.exists(parts, lambda p: p.rlike("\\A[0-9,]+\\z"))
    last = F.size(parts) - 1
    plain = F.transform(parts, lambda p, i: F.when(i == last, F.regexp_replace(p, "\\A(?:and|And|AND) ", "")).otherwise(p))
    return F.when(~numeric, _valid(F.transform(plain, trim_white)))


def split_artist(x: Column) -> Column:
    """The artists of a credit, by the first kind of delimiter that it has; NULL if it has none."""

    def form(name: Column) -> Column:
        by_comma = F.contains(name, F.lit(", ")) & ~F.exists(_parts(name, ", "), lambda p: p.rlike("\\A[0-9,]+\\z"))
        out = F.when(by_comma, _by_comma(name))
        for delimiter in (" / ", " + "):
            out = out.when(F.contains(name, F.lit(delimiter)), _valid(_parts(name, delimiter)))
        return out

    return let(trim_white(x), form)


def _ampersand(part: Column, known: Column) -> Column:
    """The parts of more than one byte around `` & ``, if there are two and any part is known; else NULL."""

    def form(parts: Column) -> Column:
        valid = F.filter(parts, lambda p: F.octet_length(p) > 1)
        return F.when((F.size(valid) >= 2) & F.exists(parts, lambda p: F.array_contains(known, match_form(p))), valid)

    return F.when(F.contains(part, F.lit(" & ")), let(_parts(part, " & "), form))


def split_artist_contextual(x: Column, known: Iterable[str] | Column) -> Column:
    """``split_artist``, and at `` & `` where one side is a known artist (in match form).

    For a known set that fits in a literal; ``split_credits`` takes a table instead.
    """
    names = known if isinstance(known, Column) else F.array(*[F.lit(k) for k in sorted(known)]).cast("array<string>")
    split = lambda free: F.array_distinct(F.flatten(F.transform(free, lambda p: F.coalesce(_ampersand(p, names), F.array(p)))))
    return F.coalesce(let(split_artist(x), split), F.when(split_artist(x).isNull(), _ampersand(trim_white(x), names)))


def split_credits(credits: DataFrame, id_column: str, name_column: str, known: DataFrame, known_column: str) -> DataFrame:
    """``id, artists`` for a known set of any size: parts are joined to it by their match form."""
    name = trim_white(F.col(name_column))
    base = credits.select(F.col(id_column).alias("id"), name.alias("name"), split_artist(F.col(name_column)).alias("free"))
    parts = base.select("id", F.posexplode(F.coalesce("free", F.array("name"))).alias("at", "part"), F.col("free").isNull().alias("whole"))
    inner = parts.where(F.contains("part", F.lit(" & "))).select("id", "at", "part", "whole", F.posexplode(_parts(F.col("part"), " & ")).alias("k", "piece"))
    keyed = inner.withColumn("key", match_form(F.col("piece")))
    hits = keyed.join(known.select(F.col(known_column).alias("key")).distinct(), "key", "left_semi").select("id", "at").distinct()
    pieces = inner.where(F.octet_length("piece") > 1).groupBy("id", "at").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("ps"))
    pieces = pieces.where(F.size("ps") >= 2).join(hits, ["id", "at"], "left_semi").select("id", "at", F.transform("ps", lambda p: p["piece"]).alias("pieces"))
    joined = parts.join(pieces, ["id", "at"], "left")
    one = joined.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("pieces", F.array("part")).alias("ps")))).alias("all"),
        F.max("whole").alias("whole"),
        F.max(F.col("pieces").isNotNull()).alias("found"),
    )
    flat = F.flatten(F.transform("all", lambda p: p["ps"]))
    artists = F.when(~F.col("whole"), F.array_distinct(flat)).when(F.col("found"), flat)
    return base.select("id").join(one.select("id", artists.alias("artists")), "id", "left")
