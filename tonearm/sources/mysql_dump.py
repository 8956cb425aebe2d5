"""Rows of a table in a MySQL dump.

The dump is read as lines, so its parts are read side by side; lines of other tables are dropped
in the scan, before Python. A cell keeps its kind: ``struct<kind, i, f, s>`` with kind one of
``null int float str``.

What the reader takes, and loaders rely on: one statement a line; backslash escapes; a doubled quote is not an escape; of white space only U+0020 is skipped;
anything that is no value counts as a NULL of one byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

CELL = "struct<kind:string,i:bigint,f:double,s:string>"
ROW = f"row_in_line int, cells array<{CELL}>"
#: A batch of tuples that a task hands back, about.
PART_BYTES = 4 << 20

_ESCAPES = {b"'": b"'", b"\\": b"\\", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}
_NUMBER = re.compile(rb"[-+0-9][-+0-9.]*")
_PLAIN = re.compile(rb"[^'\\]*")
_VALUES = re.compile(rb"values", re.I)

Cell = tuple[str, int | None, float | None, str | None]
NULL: Cell = ("null", None, None, None)


def _number(text: bytes) -> Cell:
    if b"." in text:
        try:
            return ("float", None, float(text), None)
        except ValueError:
            return ("float", None, 0.0, None)
    try:
        value = int(text)
    except ValueError:
        value = 0
    return ("int", value if -(1 << 63) <= value < 1 << 63 else 0, None, None)


def _quoted(data: bytes, at: int) -> tuple[Cell, int]:
    """From the byte after the opening quote."""
    out = []
    while at < len(data):
        m = _PLAIN.match(data, at)
        out.append(m[0])
        at = m.end()
        if at >= len(data):
            break
        if data[at : at + 1] == b"'":
            at += 1
            break
        nxt = data[at + 1 : at + 2]  # a backslash
        out.append(_ESCAPES.get(nxt, b"\\" + nxt))
        at += 2
    return ("str", None, None, b"".join(out).decode("utf-8", "replace")), at


def parse_cell(data: bytes, at: int) -> tuple[Cell, int]:
    here = data[at : at + 1]
    if here == b"'":
        return _quoted(data, at + 1)
    if data[at : at + 4] == b"NULL":
        return NULL, at + 4
    if m := _NUMBER.match(data, at):
        return _number(m[0]), m.end()
    return NULL, at + 1


def parse_values(data: bytes) -> Iterator[list[Cell]]:
    """Tuples of a VALUES list; empty ones are dropped, a semicolon between tuples ends it."""
    at, n = 0, len(data)
    while at < n:
        if data[at : at + 1] == b";":
            return
        if data[at : at + 1] != b"(":
            at += 1
            continue
        at += 1
        row: list[Cell] = []
        while at < n:
            c = data[at : at + 1]
            if c == b")":
                at += 1
                break
            if c == b" " or c == b"," and not row:
                at += 1
                continue
            cell, at = parse_cell(data, at)
            row.append(cell)
            at += data[at : at + 1] == b","  # only a comma right after the value separates
        if row:
            yield row


def values_start(line: bytes) -> int | None:
    """Place of the first parenthesis after the word VALUES, in any case."""
    m = _VALUES.search(line)
    at = line.find(b"(", m.end()) if m else -1
    return at if at >= 0 else None


def _rows(lines: Iterable[bytes]) -> Iterator[tuple[int, list[Cell]]]:
    for line in lines:
        start = values_start(line)
        if start is not None:
            yield from enumerate(parse_values(line[start:]))


def _parts(texts: pa.Array, kept: int) -> Iterator[list[tuple[int, int, list[Cell]]]]:
    """Place of the statement, ``row_in_line`` and cells of all tuples, in parts of about
    ``PART_BYTES``: short statements together, a long one in several. A tuple also counts ``kept`` bytes."""
    part, size = [], 0
    for at, text in enumerate(texts):
        for i, row in _rows([text.as_py()] if text.is_valid else []):
            part.append((at, i, row))
            size += kept + sum(64 + len(c[3] or "") for c in row)
            if size >= PART_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def parsed(statements: DataFrame, column: str = "value") -> DataFrame:
    """``row_in_line, cells`` and the other columns of ``statements`` for INSERT texts.

    Tasks are those of ``statements``, so these should come spread out.
    """
    others = [f for f in statements.schema.fields if f.name != column]
    ship(statements.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), ROW])
    fields = [pa.field("kind", pa.string()), pa.field("i", pa.int64()), pa.field("f", pa.float64()), pa.field("s", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keep, texts = batch.columns
            for part in _parts(texts, sum(c.nbytes for c in keep) // max(batch.num_rows, 1)):
                lines, nth, rows = zip(*part, strict=True)
                flat = list(chain.from_iterable(rows))
                cells = pa.StructArray.from_arrays([pa.array([c[j] for c in flat], f.type) for j, f in enumerate(fields)], fields=fields)
                ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
                at = pa.array(lines, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in keep), pa.array(nth, pa.int32()), pa.ListArray.from_arrays(ends, cells)], names=[*(f.name for f in others), "row_in_line", "cells"])

    return statements.select(*[f.name for f in others], F.col(column).cast("binary").alias(column)).mapInArrow(run, schema)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every tuple that the dump inserts into ``table``: ``row_in_line, cells``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return parsed(lines.where(F.contains("value", F.lit(f"INSERT INTO `{table}`"))))


def iter_table(path: str, table: str) -> Iterator[list[object]]:
    """The same on the driver, from a local file, a line at a time: plain Python values."""
    needle = f"INSERT INTO `{table}`".encode()
    with Path(path).open("rb") as f:
        for line in f:
            if needle in line:
                for _, row in _rows([line.rstrip(b"\n")]):
                    yield [next((v for v in c[1:] if v is not None), None) for c in row]


def cell_as(cells: Column, at: int, kind: str) -> Column:
    """A cell as ``bigint``, ``double`` or ``string``; NULL if it is of another kind or absent."""
    field = {"bigint": "i", "double": "f", "string": "s"}[kind]
    return F.get(cells, F.lit(at))[field]


def display(cell: Column) -> Column:
    """As it would be written in SQL, without escapes."""
    return F.when(cell["kind"] == "int", cell["i"].cast("string")).when(cell["kind"] == "float", cell["f"].cast("string")).when(cell["kind"] == "str", F.concat(F.lit("'"), cell["s"], F.lit("'"))).otherwise("NULL")
