"""Delimited text for bulk loads, several tables in the order that foreign keys need."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.export import line

_NAME = re.compile(r"[A-Za-z0-9_]+")


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    return name


def as_lines(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``value``: a line a row."""
    return rows.select(line(*[F.col(c) for c in columns or rows.columns]).alias("value"))


def write_copy(rows: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error") -> None:
    as_lines(rows, columns).write.mode(mode).text(path)


@dataclass
class CopyTarget:
    table: str
    columns: Sequence[str]


@dataclass
class BatchCopier:
    """Holds rows of several tables and writes them in the order the tables were given.

    ``write(target, rows)`` does the writing. Each flush writes what was added since the last,
    table by table; tables without rows are passed over. If one fails, it and those after it
    keep their rows.
    """

    targets: Sequence[CopyTarget]
    write: Callable[[CopyTarget, DataFrame], None]
    held: dict[str, list[DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.held = {checked_name(t.table): [] for t in self.targets}

    def add(self, table: str, rows: DataFrame) -> None:
        if table not in self.held:
            raise KeyError(f"unknown table {table!r}")
        self.held[table].append(rows)

    def flush(self) -> list[str]:
        """Names of the tables written."""
        done = []
        for t in self.targets:
            if waiting := self.held[t.table]:
                rows = waiting[0]
                for more in waiting[1:]:
                    rows = rows.unionByName(more)
                if not rows.isEmpty():
                    self.write(t, rows.select(*t.columns))
                    done.append(t.table)
                self.held[t.table] = []
        return done

    finish = flush


def compact(rows: DataFrame, path: str, files: int) -> None:
    """Write a table again in fewer files: what emptying out a table is to a file store."""
    rows.repartition(files).write.mode("overwrite").parquet(path)
