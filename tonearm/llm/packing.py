"""Packing of documents into fixed windows by minimum bin slack.

Each document's ids are cut into full windows and one remainder. Within a group of about
``PIECES_A_GROUP`` pieces, a window is seeded with the longest remainder left; a subset-sum
dynamic program over the multiset of remaining lengths, held as one bitset per item, finds the
fill closest to capacity, and backtracking gives the count of each length. The same pattern is
then used as often as the counts allow.

Groups are independent: pieces are dealt by a hash of all that is known of them and, of equal
pieces, a running number, so that neither a long document nor copies of one fill a group. The
number of groups grows with the input and their size does not; no task holds more than a group.
Only piece metadata is shuffled, never text.

Defined results: a null or empty text is a document of the end id alone; repeated rows and rows
without an id are packed once each; a very long text gives many full windows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, ship, stage, tokenizer_path
from .tokens import word_ids

CAPACITY = 2048
END_ID = 1
PIECES_A_GROUP = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest not over ``room``.

    One bitset holds the sums that the items so far can reach; a length's count is taken in
    binary parts. It stops as soon as ``room`` itself is reached.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            part *= 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def pack_lengths(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns (length -> count in a window) and how many windows use each, for all items."""
    counts = {x: n for x, n in counts.items() if n}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = best_fill({x: n for x, n in counts.items() if n}, capacity - seed) if seed < capacity else {}
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        yield used, times
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: full windows of each document, then its remainder, with their checksums."""
    from zlib import crc32

    ship(documents.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).encode
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                total = len(ids) // 4
                out += [
                    (doc_id, at, min(capacity, total - at), crc32(ids[4 * at : 4 * (at + capacity)]), total)
                    for at in range(0, total, capacity)
                ]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, pieces_a_group: int = PIECES_A_GROUP) -> DataFrame:
    """Give every piece its sequence and its offset there."""
    groups = max(1, round(n_pieces / pieces_a_group))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
        waiting = {int(v): order[f : f + k].tolist() for v, f, k in zip(values, first, n, strict=True)}
        sequence, offset = np.zeros(len(pdf), "i8"), np.zeros(len(pdf), "i8")
        serial = 0
        for used, times in pack_lengths({v: len(x) for v, x in waiting.items()}, capacity):
            for _ in range(times):
                at = 0
                for length, k in used.items():
                    for _ in range(k):
                        row = waiting[length].pop()
                        sequence[row], offset[row] = serial, at
                        at += length
                serial += 1
        return pdf.drop(columns="pack_group").assign(sequence_id=sequence * groups + pdf["pack_group"], offset=offset)

    ship(pieces.sparkSession)
    known = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    each = pieces.groupBy(*known).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    dealt = each.select(*known, F.pmod(F.xxhash64(*known, "copy"), F.lit(groups)).alias("pack_group"))
    return dealt.groupBy("pack_group").applyInPandas(fill, PACKED)


def materialise(documents: DataFrame, packed: DataFrame, vocabulary: str) -> DataFrame:
    """Sequences as arrays of ids: ``sequence_id, ids``. For unique ``doc_id``."""

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).encode
        for batch in batches:
            coded = [np.append(np.frombuffer(encode(x.as_py()), "<u4"), END_ID).astype("i4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ship(documents.sparkSession)
    coded = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ids, "doc_id long, ids array<int>")
    joined = packed.join(coded, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence and offset; see the module for the method."""
    pieces = stage(pieces_of(documents, vocabulary or tokenizer_path(), capacity), "pack-pieces")
    return pack(pieces, pieces.count(), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
