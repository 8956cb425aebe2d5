"""One document of each group of near copies: SimHash groups, held to a similarity of shingles.

Two texts are linked if the sets of their ``SHINGLE``-word shingles have a Jaccard similarity of
``SIMILARITY`` or more; groups are the connected components, and one row of each stays.

Three bits of 64 are too few for that: at a similarity of 0.8 two fingerprints differ in about 10
bits, and a radius that wide leaves the pigeonhole principle nothing to prune. So SimHash links
(``simhash.links``, on fingerprints of five-word shingles) are one source of candidates and minima
of the same shingles are the other, and the shingles themselves decide.

1. Texts of equal shingle sets meet first: the rest works on distinct sets.
2. ``BANDS`` bands of ``WIDTH`` minima each put a set into buckets; sets that share a bucket are
   candidates. A pair at 0.8 is missed with probability (1 - 0.8^6)^40, about 5 in a million, and
   a more similar one less often. A star a bucket and the SimHash links give the candidate
   components.
3. A candidate component of at most ``MEMBERS`` sets and ``HELD`` shingles is read in one task,
   where all its pairs are held against the exact similarity.
4. A larger one is dealt out. In each bucket all sets are compared with a hub, one of ``ORDERS``
   by the bucket's band, in tasks of ``DEALT`` sets; what the links join is one group. Then,
   in each bucket that still has several groups, the sets outside its largest group are compared
   with all that are in other groups, block by block. Every pair that shares a bucket is thus
   compared, or already in one group; no pair is a row.

Texts of candidates only are shuffled; a filter of ``FILTER_BITS`` bits, made of their row keys,
finds them.

Defined results: words are split at ASCII white space and compared without ASCII case; a text of
fewer words than a shingle is one shingle; null, empty and blank texts are one group; a very long
text is compared whole; the row of the least ``doc_id`` stays, null last, and of equal ids that of
the least key; rows of equal id and text are copies, of which one stays; other columns pass
through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, lean, ship, stage
from .simhash import SEED, components, links

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
WIDTH = 6
BLOCK = 2048
FILTER_BITS = 1 << 26
MEMBERS = 512
HELD = 1 << 22
ORDERS = 4
DEALT = 1024
BLOCK_SETS = 256

_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * WIDTH, dtype="u8") * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * WIDTH, dtype="u8")
_MIX = _RNG.integers(0, 1 << 63, WIDTH, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "u8"))


def bands(found: np.ndarray) -> np.ndarray:
    """A bucket of each band, as signed longs."""
    least = np.full(BANDS * WIDTH, np.iinfo("u8").max, "u8")
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[None, at : at + BLOCK] * _FACTOR[:, None] + _SHIFT[:, None]).min(1))
    out = ((least ^ (least >> np.uint64(29))).reshape(BANDS, WIDTH) * _MIX).sum(1, dtype="u8") + np.arange(BANDS, dtype="u8") * _FACTOR[0]
    return (out ^ (out >> np.uint64(31))).view("i8")


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Group of each set: the least index that links of the similarity reach."""
    size = np.array([len(x) for x in sets], "i8")
    group = np.full(len(sets), -1)
    left = np.arange(len(sets))  # not yet reached, of which the index holds the places
    while len(left):
        # shingle -> places in left that have it
        _, word = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True)
        owner = np.repeat(np.arange(len(left)), size[left])
        by_word = np.argsort(word, kind="stable")
        postings, first = owner[by_word], np.concatenate([[0], np.cumsum(np.bincount(word))])
        begin = np.concatenate([[0], np.cumsum(size[left])])
        free = np.ones(len(left), bool)
        unreached, todo, root = len(left), [], 0
        while unreached * 2 > len(left) or todo:
            if not todo:
                while not free[root]:
                    root += 1
                free[root], todo, unreached = False, [root], unreached - 1
                group[left[root]] = left[root]
            at = todo.pop()
            if not unreached:
                continue
            mine = word[begin[at] : begin[at + 1]]
            n = np.zeros(len(left), "i8")
            if len(mine):
                n = np.bincount(np.concatenate([postings[first[w] : first[w + 1]] for w in mine]), minlength=len(left))
            either = size[left[at]] + size[left] - n
            near = np.flatnonzero(free & (n >= similarity * either - 1e-9))
            free[near] = False
            unreached -= len(near)
            group[left[near]] = group[left[at]]
            todo += near.tolist()
        left = left[free]
    return group


def majority(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes, as a signed long."""
    counts = np.zeros(64, "i8")
    for at in range(0, len(found), 1 << 16):
        part = np.ascontiguousarray(found[at : at + (1 << 16)])
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits((2 * counts > len(found)).astype("u1"), bitorder="little").view("<i8")[0])


def _sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, key, whole, size, fp, bands`` of each row; whole stands for its set."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                n = batch.num_rows
                whole, size, fp, found = np.zeros(n, "u8"), np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros((n, BANDS), "i8")
                for i, x in enumerate(batch.column(2)):
                    mine = shingles(x.as_py())
                    whole[i], size[i], fp[i], found[i] = xxh64_intdigest(mine.tobytes(), SEED), len(mine), majority(mine), bands(mine)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, BANDS, dtype="i4"), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole.view("i8")), pa.array(size), pa.array(fp), lists], names=["doc_id", "key", "whole", "size", "fp", "bands"])

    return rows.mapInArrow(run, "doc_id long, key long, whole long, size long, fp long, bands array<long>")


def _stars(sets: DataFrame) -> DataFrame:
    """``a, b``: the sets of a bucket, each with the least."""
    each = sets.select(F.explode("bands").alias("bucket"), "whole")
    least = each.groupBy("bucket").agg(F.min("whole").alias("b"), F.count("*").alias("n")).where("n > 1")
    return each.join(least, "bucket").where("whole <> b").select(F.col("whole").alias("a"), "b").distinct()


def _place(key: np.ndarray) -> np.ndarray:
    return (key.view("u8") % np.uint64(FILTER_BITS)).astype("i8")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be one of ``wanted``; the filter's size does not depend on them."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    words = wanted.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, "u8")
    table[np.asarray(words.column("word").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).view("u8")
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(np.asarray(batch.column(0)))
            yield batch.filter(pa.array((sent.value[at >> 6] >> (at & 63).astype("u8")) & np.uint64(1) == 1))

    return rows.select("key", "text").mapInArrow(run, "key long, text string")


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """``key, group`` of the members (root, key, text) of candidate components, by exact similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, keys, sets = None, [], []

        def done() -> pa.RecordBatch:
            name = np.array(keys, "i8")
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(name[linked(sets, similarity)])], names=["key", "group"])

        for batch in batches:
            for r, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if r != root and keys:
                    yield done()
                    keys, sets = [], []
                root = r
                keys.append(k)
                sets.append(shingles(x.as_py()))
        if keys:
            yield done()

    dealt = members.select("root", "key", "text").repartition("root").sortWithinPartitions("root", "key")
    return dealt.mapInArrow(run, "key long, group long")


def _sets(members: DataFrame) -> DataFrame:
    """``whole, shingles`` of members (whole, text); shingles as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["whole", "shingles"])

    return members.select("whole", "text").mapInArrow(run, "whole long, shingles binary")


def _alike(one: np.ndarray, many: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``many`` sets are as similar to ``one``."""
    size = np.array([len(x) for x in many], "i8")
    out = (size == 0) & (len(one) == 0)
    some = np.flatnonzero((size > 0) & (size >= similarity * len(one) - 1e-9) & (similarity * size <= len(one) + 1e-9))
    if len(some) and len(one):
        flat = np.concatenate([many[i] for i in some])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        begin = np.cumsum(size[some]) - size[some]
        n = np.add.reduceat((one[at] == flat).astype("i8"), begin)
        out[some] = n >= similarity * (len(one) + size[some] - n) - 1e-9
    return out


def _groups(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``width`` columns, which come one after another; a group at a time."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != last and held:
                yield held
                held = []
            last = row[:width]
            held.append(row)
    if held:
        yield held


def _with_hubs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (whole, hub) that are similar, as ``a, b``; a hub's sets in tasks of about DEALT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):  # the hub's own row comes first
            hub = np.frombuffer(rows[0][4], "u8")
            yes = _alike(hub, [np.frombuffer(r[4], "u8") for r in rows[1:]], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([r[3] for r, y in zip(rows[1:], yes, strict=True) if y], pa.int64()), pa.array([rows[0][0]] * int(yes.sum()), pa.int64())], names=["a", "b"])

    cuts = pairs.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / DEALT)).cast("long").alias("cuts"))
    sent = cuts.join(sets.withColumnRenamed("whole", "hub"), "hub").withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    hubs = sent.select("hub", "cut", F.lit(0).alias("nth"), F.col("hub").alias("whole"), "shingles")
    others = pairs.join(cuts, "hub").select("hub", F.pmod(F.xxhash64("whole"), F.col("cuts")).alias("cut"), F.lit(1).alias("nth"), "whole").join(sets, "whole")
    both = hubs.unionByName(others.select(*hubs.columns))
    return both.repartition("hub", "cut").sortWithinPartitions("hub", "cut", "nth", "whole").mapInArrow(run, "a long, b long")


def _between(buckets: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs ``a, b`` of one bucket and two labels, block by block.

    In a bucket the sets outside its most frequent label are compared with all of other labels.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            ours, theirs = ([(r[4], r[5], np.frombuffer(r[6], "u8")) for r in rows if r[3] == side] for side in (0, 1))
            a, b = [], []
            for whole, label, mine in ours:
                other = [t for t in theirs if t[1] != label]
                yes = _alike(mine, [t[2] for t in other], similarity) if other else np.zeros(0, bool)
                b += [t[0] for t, y in zip(other, yes, strict=True) if y]
                a += [whole] * int(yes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    named = buckets.join(labels, "whole")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    open_ = named.join(main.select("bucket", F.col("most.label").alias("main"), F.ceil(F.col("n") / BLOCK_SETS).alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK_SETS).alias("ours")), "bucket")
    at = F.xxhash64("whole", "bucket")
    begin = open_.select("bucket", "whole", "label", "main", F.pmod(at, F.col("ours")).alias("our_block"), F.pmod(at, F.col("blocks")).alias("their_block"), "ours", "blocks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    columns = ["bucket", "our_block", "their_block", "side", "whole", "label"]
    ours = begin.where("label <> main").withColumn("their_block", F.explode(upto("blocks"))).withColumn("side", F.lit(0))
    theirs = begin.withColumn("our_block", F.explode(upto("ours"))).withColumn("side", F.lit(1))
    rows = ours.select(*columns).unionByName(theirs.select(*columns)).join(sets, "whole").select(*columns, "shingles")
    keys = columns[:3]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "whole").mapInArrow(run, "a long, b long")


def _labelled(wholes: DataFrame, edges: DataFrame) -> DataFrame:
    """``whole, label``: the components of the edges; a set without one is its own."""
    roots = components(edges).withColumnRenamed("node", "whole")
    return wholes.select("whole").join(roots, "whole", "left").select("whole", F.coalesce("root", "whole").alias("label"))


def verified_large(members: DataFrame, sketches: DataFrame, proposed: DataFrame, similarity: float) -> DataFrame:
    """``whole, label`` of the members (whole, text) of large candidate components.

    proposed: pairs ``a, b`` from elsewhere, to be compared as well.
    """
    sets = stage(_sets(members), "jaccard-large-sets")
    each = sketches.join(sets.select("whole"), "whole", "left_semi").select("whole", F.posexplode("bands").alias("band", "bucket"))
    each = stage(each, "jaccard-large-buckets")
    turn = F.pmod(F.col("band"), F.lit(ORDERS))
    hub = each.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("whole", turn).alias("turn"), "whole")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = each.join(hub.select("bucket", F.col("hub.whole").alias("hub")), "bucket").where("whole <> hub").select("whole", "hub")
    also = proposed.join(sets.select(F.col("whole").alias("a")), "a", "left_semi").select(F.col("a").alias("whole"), F.col("b").alias("hub"))
    pairs = stage(pairs.unionByName(also).distinct(), "jaccard-large-pairs")
    first = stage(_with_hubs(pairs, sets, similarity), "jaccard-large-links")
    labels = stage(_labelled(sets, first), "jaccard-large-labels")
    more = stage(_between(each.select("bucket", "whole"), labels, sets, similarity), "jaccard-large-more")
    if more.isEmpty():
        return labels
    return stage(_labelled(sets, first.unionByName(more)), "jaccard-large-groups")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY, members: int = MEMBERS, held: int = HELD) -> DataFrame:
    """One row of each group, with all its columns."""
    ship(documents.sparkSession)
    name = free_name("jaccard_row", documents.columns)
    key = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    drawn = stage(_sketches(rows), "jaccard-sketches")
    names = stage(drawn.groupBy("whole").agg(F.min(order).alias("name"), F.max("size").alias("size"), F.max("fp").alias("fp")), "jaccard-sets")
    # the sketch of the row that names a set, so that copies are not dealt out
    named = names.select(F.col("name.key").alias("key"))
    sketches = drawn.join(named, "key", "left_semi").dropDuplicates(["whole"]).select("whole", "bands")
    hub = stage(names.groupBy("fp").agg(F.min("whole").alias("hub")), "jaccard-fingerprints")
    close = links(hub.select("fp")).join(hub.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(hub.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b")
    same = names.join(hub, "fp").where("whole <> hub").select(F.col("whole").alias("a"), F.col("hub").alias("b"))
    proposed = stage(same.unionByName(close.select(F.col("ha").alias("a"), F.col("hb").alias("b"))), "jaccard-simhash")
    sketches = stage(sketches, "jaccard-bands")
    roots = stage(components(_stars(sketches).unionByName(proposed)), "jaccard-roots")
    found = names.join(roots, names["whole"] == roots["node"]).select("root", "whole", F.col("name.key").alias("key"), F.col("name").alias("order"), "size")
    sizes = found.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("in_all"))
    found = stage(found.join(sizes.select("root", ((F.col("n") > members) | ((F.col("in_all") > held) & (F.col("n") > 1))).alias("large")), "root"), "jaccard-candidates")
    texts = stage(_among(rows, found.select("key")).join(found.select("root", "whole", "key", "large"), "key").dropDuplicates(["key"]), "jaccard-texts")
    small = _verified(texts.where("NOT large"), similarity).select("key", F.col("group").alias("in_group"), F.lit(False).alias("large"))
    groups = small
    if not texts.where("large").isEmpty():
        labels = verified_large(texts.where("large"), sketches, proposed, similarity)
        groups = small.unionByName(labels.join(found.select("whole", "key"), "whole").select("key", F.col("label").alias("in_group"), F.lit(True).alias("large")))
    groups = stage(groups, "jaccard-groups")
    first = groups.join(found.select("key", "order"), "key").groupBy("large", "in_group").agg(F.min("order").alias("name"))
    alone = names.join(roots, names["whole"] == roots["node"], "left_anti")
    kept = stage(alone.select("name.key").unionByName(first.select("name.key")).withColumnRenamed("key", name), "jaccard-kept")
    return documents.withColumn(name, key).join(kept, name, "left_semi").dropDuplicates([name]).select(*documents.columns)
