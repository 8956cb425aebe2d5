"""First row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """The row of least ``order`` of each key.

    A grouped ``min_by`` combines before the shuffle, so a hot key sends a row from each task.
    No key at all keeps one row of the table.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    whole = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.select(whole.alias("_row"), F.col(order).alias("_order"), *[k.alias(f"_k{i}") for i, k in enumerate(named)])
    kept = first.groupBy(*[f"_k{i}" for i in range(len(named))]).agg(F.min_by("_row", "_order").alias("_row"))
    return kept.where("_row IS NOT NULL").select("_row.*")


def import_dedup(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of each key of texts, where NULL and the empty text are one."""
    return first_by_key(rows, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], order)


def against_seen(rows: DataFrame, key: str, seen: DataFrame, order: str) -> DataFrame:
    """First rows whose key is not in ``seen``; rows with a NULL key all stay."""
    fresh = rows.where(F.col(key).isNotNull()).join(seen.select(key).distinct(), key, "left_anti")
    return first_by_key(fresh, [key], order).select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))
