"""Text, CSV and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: a row a line."""
    return spark.read.text(path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; all columns are texts unless a schema says otherwise."""
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """``id, name`` from a CSV with ``name`` or ``artist_name`` and, if there is one, ``library_id``."""
    rows = csv(spark, path)
    name = next((c for c in ("name", "artist_name") if c in rows.columns), None)
    if name is None:
        raise ValueError("the file has neither a name nor an artist_name column")
    found = F.col("library_id") if "library_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(found.alias("id"), F.col(name).alias("name")).where(F.col("name").isNotNull())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
