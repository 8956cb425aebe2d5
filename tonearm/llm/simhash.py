"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints that differ in ``RADIUS`` bits or fewer are linked; groups are the connected
components. Exact copies meet first: the rest works on distinct fingerprints.

1. Bit statistics over all distinct fingerprints give how the bits correlate. Correlated bits are
   put into one partition, so that partitions are as independent as the data allow.
2. With m partitions, two fingerprints within RADIUS are within t_i on some partition i whenever
   the thresholds t_i (each at least -1, an unused partition) sum to RADIUS - m + 1. Dynamic
   programming over the candidate counts, estimated from the distances of a sample of
   fingerprints on each partition, allocates the thresholds, for m of 2 to 4; the
   cheapest m is used. Longer partitions pay off as the number of fingerprints grows.
3. Each fingerprint goes to the bucket of its own value on each used partition, and as a probe to
   those within t_i. A bucket of more than ``BUCKET`` rows is split again by the same principle:
   its fingerprints agree on the partition up to the probes' flips, so the other bits are cut
   into RADIUS + 1 parts, two linked ones agree on at least one, and that part's value extends
   the key. No bucket is capped or dropped; after ``DEPTH`` splits a bucket that is still large
   is cut into parts of about ``PART`` rows, and each two of its parts are compared in a task.
4. A bucket, or two parts of one, is compared in memory, in blocks, and gives a spanning forest of
   its links, never all its pairs. Components follow by alternating large-star and small-star rounds on tables.

Documents get their component by their fingerprint; the fingerprints of more than 1 / ``HOT``
of all documents, fewer than ``HOT`` in number, are sent to all tasks, so that their documents
need not meet. Only counters, bit statistics, a sample of ``SAMPLE`` fingerprints and thresholds
reach the driver.

Defined results: words are split at ASCII white space; a null, empty or blank text has
fingerprint zero and is linked like any other; repeated rows keep one row each; a null ``doc_id``
never names a component unless all its members are null; a very long text is read whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, ship, stage, unstage

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 512
DEPTH = 3
BLOCK = 1024
ROUNDS = 60
PART = 2048
HOT = 512
SAMPLE = 2000


# ---- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    n, counts = len(starts), np.zeros(64, "i8")
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    bits = (2 * counts > n).astype("u1")
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``; fp is the fingerprint as a signed long."""
    ship(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- plan: partitions and thresholds


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j, for all pairs of bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype("i8")
            for at in range(0, len(fp), 1 << 16):
                part = np.ascontiguousarray(fp[at : at + (1 << 16)])
                bits = np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
                both += bits.T @ bits
                n += len(part)
        cells = np.append(both.ravel(), n).astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype="i4")), pa.array(cells)], names=["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4097)
    out[np.asarray(cells.column("cell"))] = np.asarray(cells.column("n"))
    return int(out[4096]), out[:4096].reshape(64, 64)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of 64 / m bits; each takes, bit by bit, what correlates most with it."""
    p = both.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(64)), []
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    for size in sizes:
        first = max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: tie[b, group].sum())
            group.append(nxt)
            left.remove(nxt)
        out.append(sorted(group))
    return out


def sampled_distances(sample: np.ndarray, group: list[int], radius: int) -> np.ndarray:
    """Part of the sample's pairs that differ in 0, 1, .. radius bits of the group."""
    mask = np.uint64(sum(1 << b for b in group))
    u, n = sample.view("u8") & mask, len(sample)
    counts = np.zeros(65)
    for i in range(n - 1):
        counts += np.bincount(np.bitwise_count(u[i] ^ u[i + 1 :]), minlength=65)
    return counts[: radius + 1] / max(1, n * (n - 1) // 2)


def candidate_estimates(n: int, both: np.ndarray, group: list[int], radius: int, sample: np.ndarray | None = None) -> list[float]:
    """For t = -1..radius: pairs expected within t on this partition, plus the probes for it.

    As the sample's pairs show it; too rare for a sample, as if bits were independent, of which two
    fingerprints differ in each with probability 2 p (1 - p).
    """
    p = both.diagonal()[group] / max(1, n)
    dist = np.zeros(radius + 1)
    dist[0] = 1
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    if sample is not None and len(sample) > 1:
        dist = np.maximum(dist, sampled_distances(sample, group, radius))
    out, probes = [0.0], 0
    for t in range(radius + 1):
        probes += comb(len(group), t)
        out.append(n * (n - 1) / 2 * dist[: t + 1].sum() + 20.0 * n * probes)
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that sum to radius - m + 1, by dynamic programming."""
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                key, value = total + t, c + cost[t + 1]
                if key not in new or value < new[key][0]:
                    new[key] = (value, [*ts, t])
        best = new
    return best[radius - m + 1]


def plan(n: int, both: np.ndarray, radius: int = RADIUS, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each used partition."""
    found = []
    for m in range(2, radius + 2):
        groups = partitions(n, both, m)
        cost, ts = allocate([candidate_estimates(n, both, g, radius, sample) for g in groups], radius)
        found.append((cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# ---- candidates


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucketed(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, fp, own``: a row for each partition and probe; own is true at its own value."""
    rows = []
    for i, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits))))
        flips = [0] + [_mask(list(c)) for k in range(1, t + 1) for c in combinations(bits, k)]
        probe = F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip")
        rows.append(distinct.select("fp", F.lit(i).alias("part"), own.alias("value"), probe).select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).alias("own")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def finer(big: DataFrame, parts: list[tuple[list[int], int]], depth: int, radius: int = RADIUS) -> DataFrame:
    """Rows of large buckets, dealt by radius + 1 parts of the bits that their key leaves free.

    At each depth the bits are cut differently, so that repeated splits differ.
    """
    out = None
    for i, (bits, _) in enumerate(parts):
        free = [b for b in range(64) if b not in bits]
        cut = np.array_split(np.random.default_rng(depth).permutation(free), radius + 1)
        mine = big.where(F.col("part") == i)
        for k, some in enumerate(cut):
            value = F.col("fp").bitwiseAND(F.lit(_signed(_mask([int(b) for b in some]))))
            one = mine.select("part", F.xxhash64("key", F.lit(depth * 16 + k), value).alias("key"), "fp", "own")
            out = one if out is None else out.unionByName(one)
    return out


def forest(fp: np.ndarray, own: np.ndarray | None = None, radius: int = RADIUS, block: int = BLOCK) -> list[tuple[int, int]]:
    """Links (a, b), a star for each component of a bucket; fewer than its fingerprints.

    Least labels spread over links, a block of rows at a time, until none changes. ``own`` is not
    needed: links between two probes are links all the same.
    """
    fp = np.unique(fp)
    u, n = fp.view("u8"), len(fp)
    label, kept = np.arange(n), {}

    def near(a: int, b: int) -> np.ndarray:
        if n > 2 * block:
            return np.bitwise_count(u[a : a + block, None] ^ u[None, b : b + block]) <= radius
        if (a, b) not in kept:
            kept[a, b] = np.bitwise_count(u[a : a + block, None] ^ u[None, b : b + block]) <= radius
        return kept[a, b]

    while True:
        before = label.copy()
        for a in range(0, n, block):
            for b in range(0, n, block):
                least = np.where(near(a, b), label[None, b : b + block], n).min(1)
                label[a : a + block] = np.minimum(label[a : a + block], least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(fp[moved].tolist(), fp[label[moved]].tolist(), strict=True))


def in_parts(work: DataFrame, sizes: DataFrame, bucket: int) -> DataFrame:
    """Rows of all buckets; of one over ``bucket`` rows a copy for each two of its parts.

    A fingerprint is in one part of its bucket, which meets each other part in a bucket of its own.
    """
    part = max(1, min(PART, bucket))
    cuts = F.when(F.col("rows_there") > bucket, F.ceil(F.col("rows_there") / part)).otherwise(1).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda j: F.struct(F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j")))
    dealt = work.join(sizes.select("part", "key", cuts.alias("cuts")), ["part", "key"]).withColumn("mine", mine).withColumn("pair", F.explode(pair))
    key = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", "pair.i", "pair.j"))
    return dealt.select("part", key.alias("key"), "fp", "own")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links whose components are those of all links."""
    spark = distinct.sparkSession
    ship(spark)
    n, both = bit_statistics(distinct)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toArrow()
    parts = plan(n, both, radius, np.asarray(sample.column("fp").combine_chunks()) if len(sample) else None)
    work, small = stage(bucketed(distinct, parts), "simhash-buckets"), []
    for depth in range(DEPTH + 1):
        sizes = work.groupBy("part", "key").agg(F.count("*").alias("rows_there"), F.max("own").alias("any_own"))
        sizes = stage(sizes.where("rows_there > 1 AND any_own"), "simhash-sizes")
        large = sizes.where(F.col("rows_there") > bucket).select("part", "key")
        if depth == DEPTH or large.isEmpty():
            small.append(in_parts(work, sizes, bucket))
            break
        small.append(work.join(sizes.where(F.col("rows_there") <= bucket).select("part", "key"), ["part", "key"], "left_semi"))
        work = stage(finer(work.join(large, ["part", "key"], "left_semi"), parts, depth, radius), "simhash-finer")
    rows = small[0]
    for s in small[1:]:
        rows = rows.unionByName(s)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = forest(pdf["fp"].to_numpy("i8"), pdf["own"].to_numpy(bool), radius)
        return pd.DataFrame(np.array(found, "i8").reshape(-1, 2), columns=["a", "b"])

    def compare_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after another; a bucket may span batches."""
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            edge = np.flatnonzero((pdf["part"].to_numpy()[1:] != pdf["part"].to_numpy()[:-1]) | (pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])) + 1
            found = []
            for a, b in zip([0, *edge], [*edge, len(pdf)], strict=True):
                one = pdf.iloc[a:b]
                name = (one["part"].iat[0], one["key"].iat[0])
                if name != last and held:
                    found.append(compare(pd.concat(held)))
                    held = []
                held.append(one)
                last = name
            if found:
                yield pa.RecordBatch.from_pandas(pd.concat(found), preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(compare(pd.concat(held)), preserve_index=False)

    # by number: partitions would be joined by their bytes, which say little of the work
    dealt = rows.repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(compare_sorted, "a long, b long").dropDuplicates()


# ---- components


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, root``: for each node of an edge, the least node of its component.

    Alternating rounds: every node links its larger neighbours, then its smaller ones, to the
    least of them. Stops when a round changes nothing. The least neighbour of a node that is in more
    than 1 / ``HOT`` of all edges, of which there are fewer than ``HOT``, is sent to all tasks.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    mark, total = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        hot = F.col("n") * HOT > 2 * total
        marked = both.join(F.broadcast(least.where(hot).select("u", F.col("m").alias("often"))), "u", "left")
        rest = marked.where("often IS NULL").select("u", "v").join(least.where(~hot).select("u", "m"), "u").select("u", "v", "m")
        every = marked.where("often IS NOT NULL").select("u", "v", F.col("often").alias("m")).unionByName(rest)
        large = every.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, stage(small.where("u <> v").distinct(), "cc-edges")
        unstage(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = seen[0]
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row per document."""
    docs = stage(fingerprints(documents, shingle), "simhash-fp")
    distinct = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    roots = stage(components(links(distinct.select("fp"), radius, bucket)), "simhash-roots")
    member = distinct.join(roots, distinct["fp"] == roots["node"])
    name = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(name, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("linked"))
    # a fingerprint without links is its own component
    least = distinct.join(named, "fp", "left").select("fp", "copies", F.coalesce("linked", "first").alias("component_id"))
    least = stage(least, "simhash-least")
    n = least.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT > n  # so fewer than HOT rows
    often = F.broadcast(least.where(hot).select("fp", F.col("component_id").alias("often"), F.lit(True).alias("is_often")))
    marked = docs.join(often, "fp", "left")
    found = marked.where("is_often").select("doc_id", "fp", F.col("often").alias("component_id"))
    found = found.unionByName(marked.where("is_often IS NULL").select("doc_id", "fp").join(least.where(~hot).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
