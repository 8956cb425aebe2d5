"""Names against a catalog: the best match, unless it is too weak or too close to the next.

Every name is held against every catalog entry, in blocks of the catalog. Counts of characters
give an upper bound on the score; entries are scored in order of that bound, until neither
the result nor its ambiguity can change, so most pairs are never scored. Only ``limit`` entries a
name and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import PREFIX, SCALE, SCORERS, winkler
from ..runtime import ship

BLOCK = 20_000
CHUNK = 500
_CELLS = 64


def _counts(names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), _CELLS), "i2")
    for i, name in enumerate(names):
        for c in name:
            out[i, ord(c) % _CELLS] += 1
    return out


def _top(name: str, entries: list[str], at: np.ndarray, counts: np.ndarray, lengths: np.ndarray, limit: int, floor: float) -> list[tuple[int, str, float]]:
    mine, n = _counts([name])[0], len(name)
    shared = np.minimum(counts, mine).sum(1)
    jaro = np.where((lengths > 0) & (n > 0), (shared / max(1, n) + shared / np.maximum(1, lengths) + 1) / 3, (lengths == n).astype(float))
    bound = np.where(shared > 0, jaro + SCALE * PREFIX * (1 - jaro), np.where((lengths == 0) & (n == 0), 1.0, 0.0))
    best: list[tuple[float, int, str]] = []
    for k in np.lexsort((at, -bound)).tolist():
        if bound[k] < floor or len(best) == limit and -best[-1][0] > bound[k] + 1e-12:
            break
        best = sorted([*best, (-winkler(name, entries[k]), int(at[k]), entries[k])])[:limit]
    return [(i, e, -s) for s, i, e in best]


@dataclass(frozen=True)
class Blocks:
    """``block, entries``: catalog rows, each with its place in the catalog's order."""

    rows: DataFrame
    n: int


def catalog_blocks(catalog: DataFrame, name: str, order: str) -> Blocks:
    n = max(1, -(-catalog.count() // BLOCK))
    dealt = catalog.where(F.col(name).isNotNull()).select(F.col(order).cast("long").alias("at"), F.col(name).alias("entry")).withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"))
    return Blocks(dealt.groupBy("block").agg(F.collect_list(F.struct("at", "entry")).alias("entries")), n)  # BLOCK rows on average


def block_pairs(wanted: DataFrame, blocks: Blocks) -> DataFrame:
    """``names, entries``: each chunk of names with each block of the catalog, a row each.

    Chunks and blocks are few; a row is what one call of the scorer works on.
    """
    ship(wanted.sparkSession)
    named = wanted.where("name IS NOT NULL")
    chunks = max(1, -(-named.count() // CHUNK))
    chunked = named.withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(chunks))).groupBy("chunk").agg(F.collect_list("name").alias("names"))
    pairs = chunked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks.n - 1)))).join(blocks.rows, "block")
    return pairs.repartition("chunk", "block").select("names", "entries")


def fuzzy_resolve(names: DataFrame, catalog: DataFrame, name: str = "name", entry: str = "name", order: str = "idx", threshold: float = 0.8, limit: int = 2, ambiguity: float = 0.02) -> DataFrame:
    """``name, resolved`` for distinct names; NULL where the best is under ``threshold`` or the
    first two differ by less than ``ambiguity``. Strings are compared as they are."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    wanted = names.select(F.col(name).alias("name")).distinct()
    blocks = catalog_blocks(catalog, entry, order)
    floor = threshold - ambiguity - 1e-9

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for some, entries in zip(pdf["names"], pdf["entries"], strict=True):
                texts = [e["entry"] for e in entries]
                side = texts, np.array([e["at"] for e in entries], "i8"), _counts(texts), np.array([len(t) for t in texts], "i8")
                yield pd.DataFrame([(who, *x) for who in some for x in _top(who, *side, limit, floor)], columns=["name", "at", "entry", "score"])

    found = block_pairs(wanted, blocks).mapInPandas(run, "name string, at long, entry string, score double")
    # the order of the catalog decides between equal scores, as a stable sort would
    best = Window.partitionBy("name").orderBy(F.desc("score"), "at")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit)
    two = top.groupBy("name").agg(F.max(F.when(F.col("n") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("s2"), F.max(F.when(F.col("n") == 1, F.col("entry"))).alias("entry"))
    sure = (F.col("s1") >= threshold) & ~F.coalesce(F.abs(F.col("s1") - F.col("s2")) < ambiguity, F.lit(False))
    return wanted.join(two.where(sure).select("name", F.col("entry").alias("resolved")), "name", "left")


def best_match(queries: DataFrame, catalog: DataFrame, scorer: str = "jaro_winkler", threshold: float = 0.8, query: str = "name", entry: str = "name", order: str = "idx") -> DataFrame:
    """``name, idx, score`` of the highest score, the first of equal ones; NULL under threshold."""
    score = SCORERS[scorer]
    wanted = queries.select(F.col(query).alias("name")).distinct()
    blocks = catalog_blocks(catalog, entry, order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for some, entries in zip(pdf["names"], pdf["entries"], strict=True):
                best = [(who, *max((score(who, e["entry"]), -e["at"]) for e in entries)) for who in some if len(entries)]
                yield pd.DataFrame([(who, -at, s) for who, s, at in best], columns=["name", "idx", "score"])

    found = block_pairs(wanted, blocks).mapInPandas(run, "name string, idx long, score double")
    first = Window.partitionBy("name").orderBy(F.desc("score"), "idx")
    top = found.withColumn("n", F.row_number().over(first)).where((F.col("n") == 1) & (F.col("score") >= threshold))
    return wanted.join(top.drop("n"), "name", "left")
