"""State of a run in steps, so that it can go on where it stopped; and what a store holds."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import SparkSession

VERSION = 3
#: The steps, in order.
STEP_NAMES = ("create_schema", "import_csv", "create_indexes", "dedup", "import_tracks", "create_track_indexes", "prune", "vacuum", "set_logged")
_KNOWN = {1: ("create_schema", "import_csv", "create_indexes", "dedup", "prune", "vacuum"), 2: STEP_NAMES[:-1], 3: STEP_NAMES}
#: Steps that older files do not have, and the steps whose completion stands for them.
_IMPLIED = {"import_tracks": ("import_csv",), "create_track_indexes": ("dedup", "create_indexes"), "set_logged": ("vacuum",)}


class PipelineState:
    def __init__(self, database_url: str, csv_dir: str, steps: dict[str, dict] | None = None):
        self.database_url, self.csv_dir = database_url, csv_dir
        self.steps = {s: {"status": "pending"} for s in STEP_NAMES} | (steps or {})

    def status(self, step: str) -> str:
        """``pending``, ``completed``, ``failed``, or ``unknown`` for a step that is none."""
        return self.steps.get(step, {}).get("status", "unknown")

    def error(self, step: str) -> str | None:
        return self.steps.get(step, {}).get("error")

    def is_completed(self, step: str) -> bool:
        return self.status(step) == "completed"

    def _set(self, step: str, value: dict) -> None:
        if step not in self.steps:
            raise KeyError(f"unknown step {step!r}")
        self.steps[step] = value

    def mark_completed(self, step: str) -> None:
        self._set(step, {"status": "completed"})

    def mark_failed(self, step: str, error: str | None = None) -> None:
        self._set(step, {"status": "failed"} | ({"error": error} if error is not None else {}))

    def next_step(self) -> str | None:
        return next((s for s in STEP_NAMES if not self.is_completed(s)), None)

    def validate_resume(self, database_url: str, csv_dir: str) -> None:
        """Raise if the run was of another database or folder."""
        for name, mine, theirs in (("database_url", self.database_url, database_url), ("csv_dir", self.csv_dir, csv_dir)):
            if mine != theirs:
                raise ValueError(f"{name} differs: the state has {mine!r}, this run has {theirs!r}")

    def save(self, path: str) -> None:
        """Whole or not at all: a new file takes the old one's name."""
        body = {"version": VERSION, "database_url": self.database_url, "csv_dir": self.csv_dir, "steps": self.steps}
        temporary = Path(f"{path}.tmp")
        temporary.write_text(json.dumps(body, indent=2))
        os.replace(temporary, path)

    @classmethod
    def load(cls, path: str) -> PipelineState:
        """Any version; steps that an older one lacks follow from those that imply them."""
        body = json.loads(Path(path).read_text())
        version = body.get("version")
        if version not in _KNOWN:
            raise ValueError(f"unsupported state version {version!r}")
        steps = {s: v for s, v in body.get("steps", {}).items() if s in _KNOWN[version]}
        for step, signs in _IMPLIED.items():
            if step not in _KNOWN[version] and any(steps.get(s, {}).get("status") == "completed" for s in signs):
                steps[step] = {"status": "completed"}
        return cls(body["database_url"], body["csv_dir"], steps)


# ---- introspection


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def table_has_rows(spark: SparkSession, table: str) -> bool:
    return table_exists(spark, table) and not spark.table(table).isEmpty()


def column_exists(spark: SparkSession, table: str, column: str) -> bool:
    return table_exists(spark, table) and column in spark.table(table).columns


def index_exists(spark: SparkSession, table: str, index: str) -> bool:
    """Spark has no indexes; a table property of that name marks what stands for one."""
    if not table_exists(spark, table):
        return False
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return any(r["key"] == f"index.{index}" for r in rows)


def mark_index(spark: SparkSession, table: str, index: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('index.{index}' = 'true')")
