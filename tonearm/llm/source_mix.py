"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by complete epochs first. For the rest, each document gets an
exponential variate divided by its quality weight; documents in ascending order of that key are
a weighted sample without replacement, taken while their sizes add up to the budget. The
document at the boundary is taken in part, so that the mix meets its target to the word.

The order of a whole source is never built. Keys are put into ``BUCKETS`` ordered buckets for
each source; bucket totals, a small table, show which buckets lie wholly inside the budget. The
rows of the one bucket at the boundary are put into ``BUCKETS`` finer ones in the same way,
``LEVELS`` times in all, and only the rows of the last one are sorted: a millionth part of a
source. A source with a third of all rows is thus spread over all tasks.

The variate is a hash of ``doc_id``, text and seed, so reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 words; repeated rows are
separate documents, with equal keys if equal, and their order among themselves does not change
any sum; a null source is a source of its own, last in order; a source of size 0 has target 0;
an empty table gives no rows; a very long text is counted whole. Other columns pass through
``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, free_name, read, stage, whole_text

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BUCKETS = 1024
LEVELS = 2
SEED = 20240


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain text, less with the share of symbols; never under 0.1."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - symbols.cast("double") / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row per source.

    With level L, a source gets min(most * size, weight * L). Sources fill up in order of
    most * size / weight, so the level is known from running sums. A row per source: one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    filling = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the first source, in order of filling, that does not fill up at its level sets the level
    leveled = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(filling))
    leveled = leveled.withColumn("level", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("nth", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level")))
    return leveled.select("source", F.col("source_size"), target.alias("target"))


def sized(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """Narrow rows with size and sampling bucket."""
    text = whole_text(documents)
    size = word_count(text)
    uniform = (F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.col("text_hash"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), quality_weight(text).alias("weight"), F.xxhash64(text).alias("text_hash"))
        .withColumn("key", -F.log(uniform) / F.col("weight"))
        # 1 - exp(-key) rises with the key and spreads evenly for equal weights
        .withColumn("at", 1 - F.exp(-F.col("key")))
        .drop("weight", "text_hash")
    )


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row per document."""
    return _mix(documents, weights, share, most, seed).drop("source")


def _mix(documents: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    rows = stage(sized(documents, seed), "mix-sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("words", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.select("source", "source_size", "target", "epochs", (F.col("words") - F.col("epochs") * F.col("source_size")).alias("budget"))
    goal = stage(goal.withColumn("before", F.lit(0).cast("long")).withColumn("cell", F.lit(0).cast("long")), "mix-targets")
    kept = ["source", "doc_id", "size", "source_size", "target"]
    done: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        # cell: the row's bucket at this level; plan: what lies before each bucket of the one cell of
        # each source that the level before has left, BUCKETS rows a source at most
        cells = float(BUCKETS**level)
        rows = rows.withColumn("cell", F.least(F.floor(F.col("at") * cells), F.lit(int(cells) - 1)).cast("long"))
        sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.withColumn("within", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
        plan = ahead.join(goal.withColumnRenamed("source", "g_source").drop("cell"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
        plan = stage(plan.withColumn("before", F.col("before") + F.col("within")).drop("within"), "mix-plan")
        left = F.col("budget") - F.col("before")
        cut = (left > 0) & (left < F.col("cell_size"))
        small = plan.select(*[F.col(c).alias(f"p_{c}") if c in ("source", "cell") else F.col(c) for c in plan.columns])
        same = rows["source"].eqNullSafe(F.col("p_source")) & (rows["cell"] == F.col("p_cell"))
        every = rows.join(F.broadcast(small) if _is_small(plan) else small, same)
        done.append(every.where(~cut).select(*kept, (F.col("size") * (F.col("epochs") + F.when(left > 0, 1).otherwise(0))).alias("taken")))
        edge = every.where(cut)
        if level < LEVELS:
            rows = stage(edge.select("source", "doc_id", "size", "key", "at"), "mix-edge")
            goal = plan.where(cut).select("source", "source_size", "target", "epochs", "budget", "before", "cell")
    within = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("ahead")))
    out = edge.select(*kept, (F.col("size") * F.col("epochs") + part).alias("taken"))
    for d in done:
        out = out.unionByName(d)
    return out


def _is_small(plan: DataFrame) -> bool:
    """Counted, not guessed: sources times buckets decides whether the plan is sent to all."""
    return plan.limit(200_001).count() <= 200_000


def mixed_rows(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``documents``: a copy for each epoch and one for the last, partial one.

    A row taken in part keeps its whole text if at least half its words were taken, so that texts
    stay whole; a row that takes no word goes. Of repeated rows all have the first one's copies.
    """
    keys = ("doc_id", "source", "size")
    taken = _mix(documents, weights, share, most, seed).where("taken > 0").groupBy(*keys).agg(F.max("taken").alias("taken"))
    name = {c: free_name(f"mix_{c}", documents.columns) for c in (*keys, "taken", "words", "copy")}
    taken = taken.select(*[F.col(c).alias(name[c]) for c in (*keys, "taken")])
    counted = documents.withColumn(name["words"], word_count(whole_text(documents)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name["doc_id"])) & F.col("source").cast("string").eqNullSafe(F.col(name["source"])) & (F.col(name["words"]) == F.col(name["size"]))
    copies = F.floor(F.col(name["taken"]) / F.col(name["size"]) + 0.5).cast("int")
    repeated = counted.join(taken, same).withColumn(name["copy"], F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
