"""The pipeline over files as they arrive.

Forms are stateless, so they run on a stream as they are. First-wins deduplication over all runs
keeps its seen keys in a table that each batch extends, rather than in state that never expires;
``dropDuplicatesWithinWatermark`` serves where late copies have a bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import against_seen
from ..runtime import ship


def read_parquet(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def dedup_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of each key, where copies come at most ``delay`` apart."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_deduplicated(stream: DataFrame, key: str, order: str, out: str, seen: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Write each batch's new keys to ``out`` and to ``seen``, until the input is used up.

    A batch writes to folders of its own number, so one that is run again after a failure puts
    the same rows in the same place.
    """
    ship(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = transform(batch)
        kind = done.schema[key].dataType.simpleString()
        earlier = _seen_before(spark, seen, key, kind, number)
        kept = against_seen(done, key, earlier, order).persist()
        kept.orderBy(order).write.mode("overwrite").parquet(f"{out}/batch={number}")
        kept.where(F.col(key).isNotNull()).select(key).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _seen_before(spark: SparkSession, folder: str, key: str, kind: str, number: int) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], f"`{key}` {kind}")
    return spark.read.schema(f"`{key}` {kind}, batch int").parquet(folder).where(F.col("batch") < number).select(key)


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events by window and kind, with late ones up to ``delay``."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")
