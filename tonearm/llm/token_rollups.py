"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) is reduced to signed sums by source,
language and tokenizer version, a small table. The totals are additive: they are the sums of a
snapshot and of the batches after it, and are never rebuilt from documents.

A manifest says which tables count. It is a row of numbered entries in ``path/manifest``; each
names the batches that are applied and the tables, snapshot and deltas, that hold them. Only the
newest entry is read, so a batch is in the totals once, and tables that no entry names (those of a
writer that failed or lost a race) do not count. A new entry is made with the next number by a
create that fails if the file is there: of two writers one goes on from the other's entry, and
finds the other's batches applied. Applying an applied batch does nothing. After ``FOLD`` deltas,
or by ``compact``, they are folded into a new snapshot by an entry of its own.

A change is ``(kind, source, lang, tokenizer_version, old_tokens, new_tokens)``: an insert
counts ``new_tokens``, a delete takes ``old_tokens`` back, a revision does both. A column
``n_rows``, if there is one, says how many equal changes a row stands for.

Defined results: null source, language or count are kept as groups of null, and as 0; an unknown
kind raises, and nothing is applied; repeated rows count each time; groups whose documents and
tokens are all taken back are left out of the totals; an empty batch is applied and changes
nothing; a very long text is counted whole; other columns of the changes are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, read, remove_path, ship, stage, tokenizer_path
from .tokens import word_ids

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
FOLD = 16
TRIES = 20
#: The tokenizer versions of the query, with their vocabulary files.
VERSIONS = {"word-bpe-49k": "word_bpe_49k.json", "byte-bpe-50k": "byte_bpe_50k.tiktoken"}


class Rollup:
    """Totals in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._manifest = f"{self.path}/manifest"
        self._fs = self._place(self._manifest).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- the manifest

    def _entry(self) -> tuple[int, dict]:
        """Number and content of the newest complete entry."""
        here = self._place(self._manifest)
        numbers = sorted((int(s.getPath().getName()) for s in self._fs.listStatus(here) if s.getPath().getName().isdigit()), reverse=True) if self._fs.exists(here) else []
        for n in numbers:
            file = self._fs.open(self._place(f"{self._manifest}/{n:012d}"))
            try:
                body = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
            finally:
                file.close()
            if body.endswith("\n"):  # else its writer was lost; the number stays unused
                return max(numbers), json.loads(body)
        return max(numbers, default=0), {"batches": [], "tables": []}

    def _commit(self, number: int, entry: dict) -> bool:
        """Make the entry; False if another writer has that number."""
        jvm = self.spark.sparkContext._jvm
        try:
            file = self._fs.create(self._place(f"{self._manifest}/{number:012d}"), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            jvm.org.apache.commons.io.IOUtils.write(json.dumps(entry) + "\n", file, "UTF-8")
        finally:
            file.close()
        return True

    def batches(self) -> list[str]:
        """The applied batches."""
        return list(self._entry()[1]["batches"])

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._entry()[1]["batches"]

    # ---- changes and totals

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        number, entry = self._entry()
        if batch_id in entry["batches"]:
            return False
        table = new_path_in(self.path, "delta")
        delta_of(changes).coalesce(1).write.parquet(table)  # a row a group and task at most comes here
        for _ in range(TRIES):
            if self._commit(number + 1, {"batches": [*entry["batches"], batch_id], "tables": [*entry["tables"], table]}):
                if len(entry["tables"]) + 1 > self.fold:
                    self.compact()
                return True
            number, entry = self._entry()
            if batch_id in entry["batches"]:  # the other writer had the same batch
                remove_path(self.spark, table)
                return False
        raise RuntimeError(f"batch {batch_id!r}: no turn in {TRIES} tries")

    def _sum(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], DELTA)
        every = reduce(DataFrame.unionByName, [self.spark.read.schema(DELTA).parquet(t) for t in tables])
        total = every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """The totals of all applied batches."""
        return self._sum(self._entry()[1]["tables"])

    def compact(self) -> bool:
        """Fold snapshot and deltas into a new snapshot; False if another writer came first.

        The old tables stay for readers that have the entry before; ``vacuum`` removes them.
        """
        number, entry = self._entry()
        if len(entry["tables"]) < 2:
            return False
        table = new_path_in(self.path, "snapshot")
        self._sum(entry["tables"]).coalesce(1).write.parquet(table)
        if self._commit(number + 1, {"batches": entry["batches"], "tables": [table]}):
            return True
        remove_path(self.spark, table)
        return False

    def vacuum(self) -> None:
        """Remove tables that the newest entry does not name; not while others write or read."""
        named = {t.rsplit("/", 1)[-1] for t in self._entry()[1]["tables"]}
        for s in self._fs.listStatus(self._place(self.path)):
            name = s.getPath().getName()
            if name != "manifest" and name not in named:
                remove_path(self.spark, f"{self.path}/{name}")


def new_path_in(folder: str, name: str) -> str:
    import uuid

    return f"{folder}/{name}-{uuid.uuid4().hex}"


def delta_of(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch."""
    known = F.col("kind").isin("insert", "delete", "revise")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))))
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    n = F.col("n_rows") if "n_rows" in changes.columns else F.lit(1)
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    signed = changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS], (docs * n).cast("long").alias("n_docs"), (tokens * n).cast("long").alias("n_tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The encoder of a file of ranked byte pairs."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """A function from a text to its number of tokens."""
    if path.endswith(".tiktoken"):
        encoding = _ranked(path)
        return lambda text: len(encoding.encode_ordinary(text)) if text else 0
    encode = word_ids(path).encode
    return lambda text: len(encode(text)) // 4


def counted(documents: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, source, lang, same, n_<i>``: a text's tokens by each version, and a hash of it."""
    from xxhash import xxh3_128_digest

    paths = list((versions or {v: tokenizer_path(f) for v, f in VERSIONS.items()}).values())
    ship(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(p) for p in paths]
        for batch in batches:
            texts = batch.column(3).to_pylist()
            same = [None if t is None else xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            numbers = [pa.array([c(t) for t in texts], pa.int64()) for c in count]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same, pa.binary()), *numbers], names=["doc_id", "source", "lang", "same", *(f"n_{i}" for i in range(len(paths)))])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, "doc_id long, source string, lang string, same binary" + "".join(f", n_{i} long" for i in range(len(paths))))


def changes_of(kind: str, rows: DataFrame, version: str, old: str | None, new: str | None) -> DataFrame:
    at = lambda c: F.expr(c).cast("long") if c else F.lit(None).cast("long")
    n = F.col("n_rows") if "n_rows" in rows.columns else F.lit(1).cast("long")
    return rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("tokenizer_version"), at(old).alias("old_tokens"), at(new).alias("new_tokens"), n.alias("n_rows"))


def maintained(documents: DataFrame, path: str, versions: dict[str, str] | None = None) -> Rollup:
    """Five batches over all documents, the first sent twice.

    1. load: insert every document under the first version; 2. load again (no effect);
    3. retokenize: insert every document under the second version; 4. end-id: revise all counts
    of the first version to one more; 5. copies: delete, under both versions, every row whose text
    an earlier row has.
    """
    first, second = list(versions or VERSIONS)
    rows = stage(counted(documents, versions), "rollup-counts")
    rollup = Rollup(documents.sparkSession, path)
    rollup.apply("load", changes_of("insert", rows, first, None, "n_0"))
    rollup.apply("load", changes_of("insert", rows, first, None, "n_0"))
    rollup.apply("retokenize", changes_of("insert", rows, second, None, "n_1"))
    rollup.apply("end-id", changes_of("revise", rows, first, "n_0", "n_0 + 1"))
    # copies of a text are first counted by source and language, so a large group is a few rows
    groups = rows.where("same IS NOT NULL").groupBy("same", "source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("n_0").alias("n_0"), F.max("n_1").alias("n_1"))
    order = Window.partitionBy("same").orderBy(F.col("least").isNull(), "least", F.col("source").isNull(), "source", F.col("lang").isNull(), "lang")
    extra = groups.withColumn("n_rows", F.col("n") - F.when(F.row_number().over(order) == 1, 1).otherwise(0)).where("n_rows > 0")
    rollup.apply("copies", changes_of("delete", extra, first, "n_0 + 1", None).unionByName(changes_of("delete", extra, second, "n_1", None)))
    return rollup


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that ``maintained`` leaves. SQL has no tokenizer; tests count without rollups."""
    return maintained(read(spark, sf_dir, "documents"), new_path(spark, "rollup")).totals()
