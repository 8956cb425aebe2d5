"""Cells and lines of the delimited text that database bulk loads take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_CELL = "\\N"


def remove_nul(x: Column) -> Column:
    """Drop U+0000, which text columns of databases refuse; NULL stays."""
    return F.replace(x, F.lit("\x00"), F.lit(""))


def extract_year(x: Column) -> Column:
    """The first four characters as a year if all are ASCII digits."""
    return F.when(x.rlike("\\A[0-9]{4}"), F.substr(x, F.lit(1), F.lit(4)).cast("smallint"))


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def pick_artwork(images: Column) -> Column:
    """The uri of the first image of type ``primary``, else of the first image."""
    return F.coalesce(F.get(F.filter(images, lambda i: i["type"] == "primary"), F.lit(0))["uri"], F.get(images, F.lit(0))["uri"])


def escape_cell(x: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def cell(x: Column) -> Column:
    """Escaped text; NULL and the empty text are both the null mark."""
    return F.coalesce(F.nullif(escape_cell(x.cast("string")), F.lit("")), F.lit(NULL_CELL))


def line(*columns: Column) -> Column:
    return F.concat_ws("\t", *[cell(c) for c in columns])
