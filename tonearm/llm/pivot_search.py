"""Exact top-k by inner product with a pivot table.

Components become ``floor(256 * x)``. For integer vectors, the inner product follows from norms
and distance: q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2. Distances to ``PIVOTS`` pivots place a vector
in the space that the pivots span, and leave one number, its distance from that space. With both
for q and x, the least distance that q and x can have is

    d(q,x)^2 >= |place(q) - place(x)|^2 + (rest(q) - rest(x))^2

which is never under the best of the single bounds |d(q,p) - d(x,p)|, and gives an upper bound on
the score. The table holds each vector's place and rest over its norm. For each query, a block's
candidates are scored exactly in order of that bound until the k-th best score so far is above
the next bound; the k-th best score among ``PIVOT_SAMPLE`` candidates is known from the start.

Queries and candidates are written in blocks; every pair of a query block and a candidate block
is one row of a join, so neither the driver nor a broadcast holds queries. Only k rows at most for
each query and candidate block are shuffled.

Defined results: vectors that are null or hold a null or non-finite component take no part; a
vector of any finite size does, scored in whole numbers, and a score beyond the range of a long is
ranked by its value and given as the end of that range; a shorter vector counts as padded with
zeros; rows of one ``vec_id`` are one item: a query skips all rows of its own id, and the least of
several vectors of a query's id is asked; a null ``vec_id`` takes no part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import plan_bytes, read, ship, stage

TOP = 5
PIVOTS = 48
#: Least and most vectors of a block: large blocks are copied to fewer others, small ones keep all
#: tasks busy.
QUERY_BLOCK = (4096, 16_384)
CANDIDATE_BLOCK = (2048, 16_384)
PIVOT_SAMPLE = 2048
#: Numbers of a matrix that is held at once; wide vectors come in smaller blocks.
CELLS = 1 << 22
CHUNK = 64
#: For rounding in 32-bit places: bounds on the cosine are loosened by this much.
SLACK = 4e-6
_LONG = 1 << 63

BLOCK = "task int, seq int, n int, ids binary, kind string, x binary, norm binary, place binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: valid vectors as arrays of whole doubles."""
    wide = lambda x: F.lit(256.0) * x.cast("double")
    # floor gives a long, which would cut large components; those are whole as they are
    v = F.transform("embedding", lambda x: F.when(F.abs(wide(x)) < float(1 << 52), F.floor(wide(x)).cast("double")).otherwise(wide(x)))
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(wide(x)) & (F.abs(wide(x)) < 1e300), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(column) and (lengths == width).all():
        return flat.reshape(-1, width).astype("f8")
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=0)
    scale = np.where(top > 0, top, 1)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(1)) * top


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from the space of those before it.

    Gives an orthonormal basis of that space, a row each.
    """
    size = norms(sample)
    left = sample[size > 0] / size[size > 0, None]
    basis = np.zeros((0, sample.shape[1]))
    while len(basis) < min(n, sample.shape[1]) and len(left):
        rest = (left * left).sum(1)
        far = int(rest.argmax())
        if rest[far] < 1e-6:
            break
        one = left[far] - basis.T @ (basis @ left[far])
        one /= np.sqrt(one @ one)
        basis = np.concatenate([basis, one[None]])
        left = left - (left @ one)[:, None] * one
    return basis


def places(x: np.ndarray, norm: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Place in the pivots' space and distance from it, of the vectors over their norms."""
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    at = unit @ basis.T
    rest = np.sqrt(np.maximum((unit * unit).sum(1) - (at * at).sum(1), 0))
    return np.concatenate([at, rest[:, None]], 1).astype("f4")


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles or longs where no sum can leave them, else in whole numbers
    of any size."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 2.0**53:
        return (x @ q).astype("i8")
    if most < 2.0**62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2.0**62:
        return x.astype("i8") @ q.astype("i8")
    whole = [int(b) for b in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x.tolist()] + [None], object)[:-1]


def _first(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:top], "i8")
    return np.lexsort((ids, -score))[:top]


def search_block(queries: tuple, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, place: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per query: ids and scores of its best candidates of this block, and how many were scored.

    queries: ids, vectors, norms, places and scores that k other candidates are known to reach
    (-inf: none).
    """
    q_ids, q_x, q_norm, q_place, known = queries
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q_ids), step):
        bounds = (q_place[at : at + step] @ place.T).astype("f8")
        bounds += SLACK
        bounds *= norm[None]
        bounds *= q_norm[at : at + step, None]
        may = (bounds >= known[at : at + step, None]) & (ids[None] != q_ids[at : at + step, None])
        for k in range(len(bounds)):
            left = np.flatnonzero(may[k])
            if not len(left):
                continue
            left = left[np.argsort(-bounds[k][left], kind="stable")]
            q, bound = q_x[at + k], bounds[k][left]
            best_score, best_id, done, size = np.zeros(0, "i8"), np.zeros(0, "i8"), 0, CHUNK
            while done < len(left) and not (len(best_score) == top and best_score[-1] > bound[done]):
                part = left[done : done + size]
                done, size = done + len(part), size * 2
                new = scores(x[part], q)
                score = np.concatenate([best_score.astype(new.dtype), new]) if new.dtype == object else np.concatenate([best_score, new])
                vec = np.concatenate([best_id, ids[part]])
                keep = _first(score, vec, top)
                best_score, best_id = score[keep], vec[keep]
            yield int(q_ids[at + k]), best_id, best_score, done


def _packed(ids: np.ndarray, x: np.ndarray, basis: np.ndarray, seq: int, *extra: pa.Array) -> pa.RecordBatch:
    """A block as one row."""
    norm = norms(x)
    kind = "i2" if np.abs(x).max(initial=0) < 1 << 15 else "f8"
    here = TaskContext.get()
    values = [np.int32(here.partitionId() if here else 0)], [np.int32(seq)], [len(ids)], [ids.astype("i8").tobytes()], [kind], [x.astype(kind).tobytes()], [norm.tobytes()], [places(x, norm, basis).tobytes()]
    fields = BLOCK.split(", ")
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[f.split()[1]]) for v, f in zip(values, fields, strict=True)] + list(extra), names=[f.split()[0] for f in fields] + ["known"] * len(extra))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return np.frombuffer(row["ids"], "i8"), np.frombuffer(row["x"], row["kind"]).reshape(n, -1).astype("f8"), np.frombuffer(row["norm"], "f8"), np.frombuffer(row["place"], "f4").reshape(n, -1)


def _known(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, top: int) -> np.ndarray:
    """A score that ``top`` candidates of the sample reach, for each vector; -inf if there are fewer."""
    if len(sample) < top:
        return np.full(len(x), -np.inf)
    kth, step = np.zeros(len(x)), max(1, CELLS // len(sample))
    for at in range(0, len(x), step):
        about = x[at : at + step] @ sample.T
        about[ids[at : at + step, None] == sample_ids[None]] = -np.inf
        kth[at : at + step] = np.partition(about, about.shape[1] - top, axis=1)[:, -top]
    # rounding of the sums; what is compared with it has a slack of its own
    return kth - 1e-12 * norms(x) * norms(sample).max(initial=0)


def _blocks(rows: DataFrame, width: int, basis: np.ndarray, size: int, sample: tuple | None = None, top: int = TOP) -> DataFrame:
    """``BLOCK`` rows of at most ``size`` vectors each; queries also get what is known of them."""
    size = max(1, min(size, CELLS // max(1, width)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, n, seq = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                held_ids.append(np.asarray(part.column(0)))
                held.append(matrix(part.column(1), width))
                n += part.num_rows
                while n >= size:
                    ids, x = np.concatenate(held_ids), np.concatenate(held)
                    yield made(ids[:size], x[:size], seq)
                    held_ids, held, n, seq = [ids[size:]], [x[size:]], n - size, seq + 1
        if n:
            yield made(np.concatenate(held_ids), np.concatenate(held), seq)

    def made(ids: np.ndarray, x: np.ndarray, seq: int) -> pa.RecordBatch:
        extra = () if sample is None else (pa.array([_known(x, ids, *sample, top).tobytes()], pa.binary()),)
        return _packed(ids, x, basis, seq, *extra)

    return rows.mapInArrow(pack, BLOCK + (", known binary" if sample is not None else ""))


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query over all rows but those of its own id."""
    found = _search(vectors, queries, top, pivots, query_block, candidate_block).where("vec_id IS NOT NULL")
    # k rows for each query and candidate block at most reach this window
    best = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS) -> float:
    """Part of all pairs of a query and a candidate that was scored."""
    n = _search(vectors, queries, top, pivots, None, None).where("vec_id IS NULL").agg(F.sum("score")).first()[0]
    return (n or 0) / max(1, quantised(vectors).count() * quantised(queries).select("vec_id").distinct().count())


def _search(vectors: DataFrame, queries: DataFrame, top: int, pivots: int, query_block: int | None, candidate_block: int | None) -> DataFrame:
    """The best of each query and block; rows without ``vec_id`` have the number of scored pairs."""
    spark = vectors.sparkSession
    ship(spark)
    every = quantised(vectors)
    width, n = every.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 0
    fit = lambda rows, least, most: max(least, min(most, rows // (4 * spark.sparkContext.defaultParallelism)))
    # pivots: from the rows of least hash, PIVOT_SAMPLE at most; any choice is exact
    drawn = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(top, min(PIVOT_SAMPLE, CELLS // max(1, width)))).toArrow()
    sample = matrix(drawn.column("v").combine_chunks(), width) if len(drawn) else np.zeros((0, width))
    sample_ids = drawn.column("vec_id").to_numpy() if len(drawn) else np.zeros(0, "i8")
    basis = choose_pivots(sample, pivots)
    if plan_bytes(vectors) < 4 << 30 and spark.sparkContext.defaultParallelism > 1:
        every = every.repartition(max(spark.sparkContext.defaultParallelism, int(plan_bytes(vectors) >> 24)))
    table = stage(_blocks(every, width, basis, candidate_block or fit(n, *CANDIDATE_BLOCK)), "pivot-table")
    wanted = quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(_blocks(wanted, width, basis, query_block or fit(n, *QUERY_BLOCK), (sample, sample_ids), top), "pivot-queries")
    # the query set against all rows, in blocks: a row for each pair of blocks
    ours = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "kind", "x", "norm", "place", "known")])
    dealt = ours.crossJoin(table.select(F.col("task").alias("to_task"), F.col("seq").alias("to_seq")))
    pairs = dealt.join(table, (F.col("task") == F.col("to_task")) & (F.col("seq") == F.col("to_seq"))).drop("task", "seq", "to_task", "to_seq")
    names = pairs.columns

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                side = _unpacked({k[2:]: v for k, v in row.items() if k.startswith("q_")})
                found = list(search_block((*side, np.frombuffer(row["q_known"], "f8")), *_unpacked(row), top))
                q = [k for k, i, _, _ in found for _ in range(len(i))]
                vec = [int(v) for _, i, _, _ in found for v in i]
                value = [int(s) for _, _, ss, _ in found for s in ss]
                beyond = [(s >= _LONG) - (s < -_LONG) for s in value]
                exact = [(s + (1 << 1023)).to_bytes(128, "big") if b else None for s, b in zip(value, beyond, strict=True)]
                columns = [
                    pa.array([*q, None], pa.int64()),
                    pa.array([*vec, None], pa.int64()),
                    pa.array([*beyond, 0], pa.int32()),
                    pa.array([*(max(-_LONG, min(_LONG - 1, s)) for s in value), sum(d for *_, d in found)], pa.int64()),
                    pa.array([*exact, None], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "beyond", "score", "exact"])

    return pairs.mapInArrow(search, "query_id long, vec_id long, beyond int, score long, exact binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH q AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
