"""Token ids in a binary file format, coded by a static range asymmetric numeral system.

Documents are ordered by ``doc_id`` and dealt to ranges. Each range counts its ids and scales
the counts to a frequency table, which all its blocks share. A block holds whole documents; its
ids are coded by ``LANES`` interleaved 32-bit coders with 16-bit renormalisation. Every
``CHECKPOINT`` steps the block stores the decoder's states and its place in the word stream, so
that the parts of a block decode side by side, and a crc32 guards payload and ids.

A file row is a segment, ``(range_id, segment, n_ids, n_docs, payload)``: the range's table and
up to ``SEGMENT_BLOCKS`` blocks, each after its length, so that any row decodes alone. Spark's Parquet writer holds the rows: its commit protocol makes a lost task
harmless, and any file system that Spark knows will do.

Payload of a block, all little-endian unsigned 32-bit unless said otherwise: magic, lanes,
steps, number of checkpoints, number of words, crc32 of the ids, number of documents; doc_ids
(int64) and ids of each document; for each checkpoint its place in the word stream and its
states; the words (16-bit); crc32 of all before.

Defined results: a null or empty text is a document of the end id alone; repeated rows stay, in
any order among themselves; a null ``doc_id`` sorts first and comes back null; an empty table
writes no block and returns no row; a very long text is one document of one block; ids of 65,536
or more do not fit the format and raise; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, partitions_for, read, ship, tokenizer_path
from .tokens import word_ids

END_ID = 1
LANES = 1024
CHECKPOINT = 128
BLOCK_IDS = 1 << 19
SCALE = 16
MAGIC = 0x31534E52
NULL_ID = -(1 << 63)
SEGMENT_BLOCKS = 8
FILE = "range_id int, segment int, n_ids long, n_docs long, payload binary"


def scaled_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << SCALE
    here = np.flatnonzero(counts)
    if not len(here):
        return np.zeros(len(counts), "u4")
    freq = np.maximum(1, counts[here] * size // total).astype("i8")
    order = np.argsort(-freq, kind="stable")
    over, at = int(freq.sum()) - size, 0
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # take from the most frequent, a part of each in turn
        i = order[at % len(order)]
        less = min(over, max(0, int(freq[i] - 1)), max(1, int(freq[i]) // 8))
        freq[i] -= less
        over -= less
        at += 1
    out = np.zeros(len(counts), "u4")
    out[here] = freq
    return out


class Table:
    """A shared frequency table, ready for coding both ways."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype("u8")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype("u8")
        self.symbol = np.repeat(np.arange(len(freq), dtype="u4"), freq)

    def pack(self) -> bytes:
        here = np.flatnonzero(self.freq)
        body = struct.pack("<II", len(self.freq), len(here)) + here.astype("<u4").tobytes() + self.freq[here].astype("<u4").tobytes()
        return body + struct.pack("<I", crc32(body))

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        if crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("frequency table: checksum differs")
        size, n = struct.unpack_from("<II", data)
        freq = np.zeros(size, "u4")
        freq[np.frombuffer(data, "<u4", n, 8)] = np.frombuffer(data, "<u4", n, 8 + 4 * n)
        return cls(freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, then place and states of each checkpoint, the first at step 0."""
        steps = -(-len(ids) // LANES)
        state, words, marks = np.full(LANES, 1 << 16, "u8"), [], []
        n = 0
        for step in range(steps - 1, -1, -1):
            row = ids[step * LANES : (step + 1) * LANES]
            x, f = state[: len(row)], self.freq[row]
            full = x >= f << np.uint64(16)
            if full.any():
                out = (x[full] & np.uint64(0xFFFF)).astype("<u2")
                words.append(out[::-1])
                n += len(out)
                x = np.where(full, x >> np.uint64(16), x)
            q = x // f
            state[: len(row)] = (q << np.uint64(SCALE)) + (x - q * f) + self.start[row]
            if step % CHECKPOINT == 0:
                marks.append((n, state.astype("<u4")))
        stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u2")
        places = np.array([n - m for m, _ in reversed(marks)], "<u4")
        return stream, places, np.array([s for _, s in reversed(marks)], "<u4").reshape(-1, LANES)

    def decode(self, stream: np.ndarray, places: np.ndarray, states: np.ndarray, n: int) -> np.ndarray:
        """All parts between checkpoints step by step together."""
        parts, steps = len(places), -(-n // LANES)
        out = np.zeros((parts, CHECKPOINT, LANES), "u4")
        x, at = states.astype("u8"), places.astype("i8")
        stream = np.append(stream, np.zeros(1, "<u2")).astype("u8")
        last = n - (steps - 1) * LANES
        for k in range(min(CHECKPOINT, steps)):
            live = parts if (parts - 1) * CHECKPOINT + k < steps else parts - 1
            y = x[:live]
            slot = y & np.uint64(0xFFFF)
            symbol = self.symbol[slot]
            out[:live, k] = symbol
            y = self.freq[symbol] * (y >> np.uint64(SCALE)) + slot - self.start[symbol]
            low = y < 1 << 16
            if (parts - 1) * CHECKPOINT + k == steps - 1:
                low[-1, last:] = False  # the last step of a block may be short
            taken = np.cumsum(low, axis=1)
            place = at[:live, None] + taken - 1
            y = np.where(low, (y << np.uint64(16)) | stream[np.where(low, place, -1)], y)
            at[:live] += taken[:, -1]
            x[:live] = y
        return out.reshape(-1, LANES)[:steps].reshape(-1)[:n]


def pack_block(table: Table, doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    stream, places, states = table.encode(ids)
    head = struct.pack("<7I", MAGIC, LANES, -(-len(ids) // LANES), len(places), len(stream), crc32(ids.astype("<u4").tobytes()), len(doc_ids))
    marks = b"".join(struct.pack("<I", p) + s.tobytes() for p, s in zip(places.tolist(), states, strict=True))
    body = head + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + marks + stream.tobytes()
    return body + struct.pack("<I", crc32(body))


def unpack_block(table: Table, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, ids; raises if a checksum differs."""
    if crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("block: checksum of the payload differs")
    magic, lanes, _, n_marks, n_words, ids_crc, n_docs = struct.unpack_from("<7I", data)
    if magic != MAGIC or lanes != LANES:
        raise ValueError("not a block of this format")
    at = 28
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    marks = np.frombuffer(data, "<u4", n_marks * (LANES + 1), at).reshape(n_marks, LANES + 1)
    at += 4 * n_marks * (LANES + 1)
    ids = table.decode(np.frombuffer(data, "<u2", n_words, at), marks[:, 0], marks[:, 1:], int(lengths.sum()))
    if crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block: checksum of the ids differs")
    return doc_ids, lengths, ids


def write_tokens(documents: DataFrame, path: str, vocabulary: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents and write the files to ``path``."""
    ship(documents.sparkSession)
    size_of_vocabulary = 1 << 16
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, coded = word_ids(vocabulary).encode, []
        doc_ids: list[int] = []
        lengths: list[int] = []
        counts = np.zeros(size_of_vocabulary, "i8")
        for batch in batches:
            doc_ids += [NULL_ID if x is None else x for x in batch.column(0).to_pylist()]
            raw = [code(text.as_py()) for text in batch.column(1)]
            lengths += [len(x) // 4 + 1 for x in raw]
            ids = np.frombuffer(end.join([*raw, b""]), "<u4")
            if len(ids) and ids.max() >= size_of_vocabulary:
                raise ValueError(f"id {ids.max()} does not fit 16 bits")
            coded.append(ids.astype("u2"))
            counts += np.bincount(coded[-1], minlength=size_of_vocabulary)
        if not lengths:
            return
        table, here = Table(scaled_table(counts)), TaskContext.get().partitionId()
        flat = np.concatenate(coded)
        coded.clear()
        starts = np.concatenate([[0], np.cumsum(lengths, dtype="i8")])

        shared = table.pack()
        segment, at = 0, 0
        while at < len(lengths):
            parts, first = [struct.pack("<I", len(shared)), shared], at
            for _ in range(SEGMENT_BLOCKS):
                # as many whole documents as fit, and one at least
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + block_ids, "right")) - 1)
                block = pack_block(table, doc_ids[at:to], lengths[at:to], flat[starts[at] : starts[to]])
                parts += [struct.pack("<I", len(block)), block]
                at = to
                if at >= len(lengths):
                    break
            values = ([here], pa.int32()), ([segment], pa.int32()), ([int(starts[at] - starts[first])], pa.int64()), ([at - first], pa.int64()), ([b"".join(parts)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["range_id", "segment", "n_ids", "n_docs", "payload"])
            segment += 1

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share an id are dealt to several ranges by their text
    ordered = docs.repartitionByRange(partitions_for(docs), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(encode, FILE).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, decoded from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    ship(spark)
    files = spark.read.schema(FILE).parquet(path)
    # a row per segment and per range, not per document: small at any input size
    sizes = files.groupBy("range_id").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("range_id", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("range_base"))
    within = Window.partitionBy("range_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("range_id", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_range"))
    placed = offsets.join(bases, "range_id").select("range_id", "segment", (F.col("range_base") + F.col("in_range")).alias("base"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_id, segment, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from documents_of(range_id, segment, payload)

    names = ["range_id", "segment", "doc_id", "start", "n_tokens", "ids_crc32"]

    def documents_of(range_id: int, segment: int, payload: bytes) -> Iterator[pa.RecordBatch]:
        table, at, base = None, 0, 0
        while at < len(payload):
            size = struct.unpack_from("<I", payload, at)[0]
            part, at = payload[at + 4 : at + 4 + size], at + 4 + size
            if table is None:
                table = Table.unpack(part)
                continue
            doc_ids, lengths, ids = unpack_block(table, part)
            ends = np.cumsum(lengths, dtype="i8")
            starts, n = ends - lengths, len(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            columns = [
                pa.array(np.full(n, range_id, "i4")),
                pa.array(np.full(n, segment, "i4")),
                pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID),
                pa.array(starts + base, pa.int64()),
                pa.array(lengths.astype("i8"), pa.int64()),
                pa.array([crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
            ]
            base += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    decoded = files.select("range_id", "segment", "payload").mapInArrow(decode, "range_id int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return decoded.join(placed, ["range_id", "segment"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path)
