"""Helpers shared by the operators of this subpackage.

Every intermediate table goes to the folder that ``spark.checkpoint.dir`` names, which the
driver and all executors share; a lost executor therefore never takes a stage result with it.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by its own path."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, _ROOT) if x)


def give_back() -> None:
    """Return what a Python worker has freed to the system.

    A worker lives from task to task, and its allocators would keep the most that any task needed.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def lean() -> Iterator[None]:
    """A task on a worker that keeps nothing of other operators, before it and after it."""
    from .tokens import word_ids

    word_ids.cache_clear()
    give_back()
    try:
        yield
    finally:
        give_back()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from the session; only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tonearm/{name}-{uuid.uuid4().hex}"


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores after it as make it differ from all of ``taken``."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


_MADE: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove what ``stage`` wrote for ``df``, when nothing reads it any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        remove_path(df.sparkSession, path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that ``stage`` wrote inside.

    For callers that have written what they wanted by then; an error leaves them in place.
    """
    _MADE.append([])
    try:
        yield
        for path in _MADE[-1]:
            remove_path(spark, path)
    finally:
        _MADE.pop()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a file scan it is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 96 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more if they would grow too large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-plan_bytes(df) // bytes_each)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
