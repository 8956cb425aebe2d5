"""Transform, drop, deduplicate, write in order, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .dedup import against_seen, first_by_key


@dataclass(frozen=True)
class PipelineStats:
    scanned: int
    processed: int
    written: int
    skipped: int = 0
    duplicates: int = 0

    def __str__(self) -> str:
        text = f"scanned: {self.scanned}, processed: {self.processed}, written: {self.written}, skipped: {self.skipped}"
        return text + (f", duplicates: {self.duplicates}" if self.duplicates else "")


def transform(rows: DataFrame, out: Callable[[DataFrame], Column], name: str = "item") -> DataFrame:
    """``rows`` with the transform's value; rows where it is NULL go."""
    return rows.withColumn(name, out(rows)).where(F.col(name).isNotNull())


def deduplicated(rows: DataFrame, key: str, order: str, seen: DataFrame | None = None) -> DataFrame:
    """First row of each key, in order, that earlier runs have not written; NULL keys all stay."""
    if seen is not None:
        return against_seen(rows, key, seen, order)
    return first_by_key(rows.where(F.col(key).isNotNull()), [key], order).select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def stats(scanned: DataFrame, processed: DataFrame, written: DataFrame) -> DataFrame:
    """One row of counters."""
    names = ("scanned", "processed", "written")
    zero = lambda at: [(F.count("*") if i == at else F.lit(0).cast("long")).alias(n) for i, n in enumerate(names)]
    rows = scanned.agg(*zero(0)).unionByName(processed.agg(*zero(1))).unionByName(written.agg(*zero(2)))
    one = rows.agg(*[F.sum(n).alias(n) for n in names])
    return one.select(*names, F.lit(0).cast("long").alias("skipped"), (F.col("processed") - F.col("written")).alias("duplicates"))


def run(rows: DataFrame, out: Callable[[DataFrame], Column], write: Callable[[DataFrame], None], order: str, key: str | None = None, seen: DataFrame | None = None, name: str = "item") -> PipelineStats:
    """Transform, deduplicate and write; the writer gets rows sorted by ``order``, once.

    What was written is counted as it is written. What was scanned and processed takes a pass over
    the input alone, as deduplication reads it more than once.
    """
    done = transform(rows, out, name)
    kept = deduplicated(done, key, order, seen) if key else done
    seen_there = Observation()
    write(kept.orderBy(order).observe(seen_there, F.count(F.lit(1)).alias("written")))
    written = int(seen_there.get["written"])
    before = rows.agg(F.count(F.lit(1)).alias("scanned"), F.count(out(rows)).alias("processed")).first()
    return PipelineStats(int(before["scanned"]), int(before["processed"]), written, 0, int(before["processed"]) - written if key else 0)
