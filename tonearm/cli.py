"""Command-line options shared by tools."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping


class CliError(ValueError):
    pass


def add_database_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--database-url", default=None)


def add_import_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--csv-dir")
    parser.add_argument("--fresh", action="store_true")


def add_resume_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--state-file")


def add_filter_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--library-artists")
    parser.add_argument("--limit", type=int)


def resolve_database_url(flag: str | None, env_name: str, environ: Mapping[str, str] = os.environ) -> str:
    """The flag if it is not empty, else the variable if it is not empty, else an error."""
    if found := flag or environ.get(env_name):
        return found
    raise CliError(f"no database URL: pass --database-url or set {env_name}")
