"""Column mapping of an import: source names to table names, transforms, keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import import_dedup


@dataclass
class ColumnMapping:
    source_columns: Sequence[str]
    db_columns: Sequence[str]
    required_columns: Sequence[str] = ()
    unique_key: Sequence[str] | None = None
    transforms: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.source_columns) != len(self.db_columns):
            raise ValueError("source and table columns differ in number")

    def add_transform(self, column: str, transform: Callable[[Column], Column]) -> None:
        """By source name."""
        self.transforms[column] = transform

    def source_index(self, name: str) -> int | None:
        return list(self.source_columns).index(name) if name in self.source_columns else None

    def unique_key_indices(self) -> list[int] | None:
        """Places of the key's columns among the table's; unknown names are left out."""
        if self.unique_key is None:
            return None
        return [list(self.db_columns).index(k) for k in self.unique_key if k in self.db_columns]

    def apply(self, rows: DataFrame, order: str | None = None, enforce_required: bool = True) -> DataFrame:
        """Table columns of ``rows``: mapped, required ones present, first row of each key.

        The first row is the one of least ``order``, a source column, which a key then needs.
        """
        identity = lambda c: c
        columns = [self.transforms.get(s, identity)(F.col(s)).alias(d) for s, d in zip(self.source_columns, self.db_columns, strict=True)]
        out = rows.select(*columns, *([F.col(order).alias("_order")] if order else []))
        required = [c for c in self.required_columns if c in self.db_columns]
        if enforce_required and required:
            out = out.dropna(subset=required)
        keys = self.unique_key_indices()
        if keys is not None:
            if order is None:
                raise ValueError("a unique key needs an order column")
            out = import_dedup(out, [self.db_columns[k] for k in keys], "_order")
        return out.select(*self.db_columns)
