"""Several CSV files with headers in one folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CsvFileSpec:
    filename: str
    columns: Sequence[str]


class MultiCsvWriter:
    """A CSV data set for each spec, under ``folder``, by place or by file name."""

    def __init__(self, folder: str, specs: Sequence[CsvFileSpec]):
        self.folder, self.specs = folder.rstrip("/"), list(specs)

    @property
    def output_dir(self) -> str:
        return self.folder

    def spec(self, which: int | str) -> CsvFileSpec:
        if isinstance(which, int):
            return self.specs[which]
        found = next((s for s in self.specs if s.filename == which), None)
        if found is None:
            raise KeyError(which)
        return found

    def path(self, which: int | str) -> str:
        return f"{self.folder}/{self.spec(which).filename}"

    def write(self, which: int | str, rows: DataFrame, order: str | None = None, one_file: bool = False, mode: str = "error") -> str:
        """``one_file`` for small exports only: all rows then pass through one task."""
        out = rows.select(*self.spec(which).columns, *([order] if order and order not in self.spec(which).columns else []))
        if order:
            out = out.orderBy(order) if not one_file else out.coalesce(1).sortWithinPartitions(order)
        elif one_file:
            out = out.coalesce(1)
        out.select(*self.spec(which).columns).write.mode(mode).option("header", True).option("escape", '"').csv(self.path(which))
        return self.path(which)
