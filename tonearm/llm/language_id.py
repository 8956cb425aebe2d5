"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of its words' characters, of order ``ORDER``, each word between a
begin and an end mark. All n-grams of one order stand in one sorted array of 64-bit hashes, with
a row of interpolated probabilities, one for each language; contexts stand in another, with the
weights of the lower order. A text's language is the one of lowest cross-entropy a character.

A text is rejected if its cross-entropy is above what texts of that language of its length
have: mean, spread and the room beyond them come from a second sample, which the models have not
seen. The room is ``MARGIN``, what all but ``TAIL`` of that sample need, and ``UNSURE`` bits over
the square root of the language's texts in it, since the mean of a few texts says little.

The models are fitted on a sample of ``TRAIN_DOCS`` labelled documents a language on average, as
is the calibration; a language of fewer than ``FEW`` documents is fitted on all of them and takes
its limits from all languages' texts. The rest covers all documents and whole texts. Scores of
distinct words are kept by each task, ``MEMO`` words at most; ``BLOCK`` words are scored at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; if
no document has a label there is no model, every text is ``und`` with score 0 and none is rejected;
a very long text is scored whole; repeated rows are scored each alone; ties go to the first
language in order; a null ``doc_id`` is not held out; an empty table gives no rows; other columns
are never read, and pass through ``keep_accepted`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, read, ship

ORDER = 5
TRAIN_DOCS = 600
FEW = 100
MEMO = 400_000
BLOCK = 16_384
CHARS = 1 << 20
SPREAD = 6.0
MARGIN = 0.25
TAIL = 0.002
UNSURE = 2.0
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean, n_scored long"

_RUN = regex.compile(r"\p{L}+")
_BEGIN, _END = 2, 3
_M = np.uint64(0x9E3779B97F4A7C15)


def runs_of(chunk: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _RUN.findall(chunk.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype("u8") + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word of each position, its place there (0: the begin mark), and for n = 1..order the hash
    of the n characters that end there."""
    text = "".join([f"\x02{w}\x03" for w in words])
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(w) + 2 for w in words], "i8")
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = _mixed(flat)
    out, factor = [code], _M
    for n in range(2, order + 1):
        h = out[-1].copy()
        h[n - 1 :] += code[: len(code) - n + 1] * factor
        out.append(h)
        factor = np.uint64(int(factor) * int(_M) % (1 << 64))
    return word, place, out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), "i8"), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Models:
    languages: list[str]
    vocabulary: int = 0
    gram: list[np.ndarray] = field(default_factory=list)  # sorted hashes, by order
    prob: list[np.ndarray] = field(default_factory=list)  # (grams, languages)
    context: list[np.ndarray] = field(default_factory=list)
    lower: list[np.ndarray] = field(default_factory=list)  # weight of the lower order
    base: np.ndarray | None = None  # for a character that no model has seen
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    room: np.ndarray | None = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log2 probabilities (words, languages), and characters scored of each."""
        word, place, hashes = grams(words, len(self.gram))
        here = np.flatnonzero(place > 0)
        at, found = find(self.gram[0], hashes[0][here])
        p = np.where(found[:, None], self.prob[0][at], self.base[None])
        for n in range(2, len(self.gram) + 1):
            live = np.flatnonzero(place[here] >= n - 1)
            pos = here[live]
            at, found = find(self.gram[n - 1], hashes[n - 1][pos])
            up, got = find(self.context[n - 1], hashes[n - 2][pos - 1])
            lower = np.where(got[:, None], self.lower[n - 1][up], 1.0) * p[live]
            p[live] = np.where(found[:, None], self.prob[n - 1][at], lower)
        bits = -np.log2(p)
        begins = np.flatnonzero(np.diff(np.concatenate([[-1], word[here]])))
        return np.add.reduceat(bits, begins, axis=0), np.bincount(word[here], minlength=len(words))


def fit_models(words: list[str], counts: np.ndarray, languages: list[str], order: int = ORDER) -> Models:
    """counts: (words, languages), how often each language's sample has each word."""
    word, place, hashes = grams(words, order)
    width = len(languages)
    out = Models(languages)
    raw, unique, sample = [], [], []
    for n in range(1, order + 1):
        pos = np.flatnonzero(place >= max(1, n - 1))
        keys, first, back = np.unique(hashes[n - 1][pos], return_index=True, return_inverse=True)
        raw.append(np.stack([np.bincount(back, counts[word[pos], k], len(keys)) for k in range(width)], 1))
        unique.append(keys)
        sample.append(pos[first])  # a position where each stands
    below = None
    for n in range(1, order + 1):
        c = raw[n - 1]
        if n < order:  # in how many longer n-grams it ends; nothing longer ends at a begin mark
            at, _ = find(unique[n - 1], hashes[n - 1][sample[n]])
            wider = np.stack([np.bincount(at, raw[n][:, k] > 0, len(c)) for k in range(width)], 1)
            c = np.where((place[sample[n - 1]] == n - 1)[:, None], c, wider)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(once / np.maximum(1, once + 2 * twice), 0.1, 0.95)
        if n == 1:
            out.vocabulary = len(c) + 1
            context, back = np.zeros(1, "u8"), np.zeros(len(c), "i8")
            below = np.full((len(c), width), 1 / out.vocabulary)
        else:
            context, back = np.unique(hashes[n - 2][sample[n - 1] - 1], return_inverse=True)
            at, _ = find(unique[n - 2], hashes[n - 2][sample[n - 1]])
            below = out.prob[-1][at]
        total = np.stack([np.bincount(back, c[:, k], len(context)) for k in range(width)], 1)
        kinds = np.stack([np.bincount(back, c[:, k] > 0, len(context)) for k in range(width)], 1)
        lower = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
        p = np.where(total[back] > 0, np.maximum(c - d, 0) / np.maximum(total[back], 1e-9), 0.0) + lower[back] * below
        out.gram.append(unique[n - 1])
        out.prob.append(p)
        out.context.append(context)
        out.lower.append(lower)
    out.base = out.lower[0][0] / out.vocabulary
    return out


class Scorer:
    """Scores of texts, with a memo of the chunks between spaces and line feeds."""

    def __init__(self, models: Models, memo: int = MEMO):
        self.models, self.memo = models, memo
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, len(self.models.languages) + 1))
        self.used = 1

    def learn(self, chunks: list[str]) -> None:
        if self.used + len(chunks) > self.memo and self.used > 1:
            raise MemoryError
        split = [runs_of(c) for c in chunks]
        words = list(dict.fromkeys(w for ws in split for w in ws))
        bits = np.zeros((len(chunks), self.table.shape[1]))
        if words:
            index = {w: i for i, w in enumerate(words)}
            each, n = map(np.concatenate, zip(*(self.models.score(words[a : a + BLOCK]) for a in range(0, len(words), BLOCK)), strict=True))
            owner = np.repeat(np.arange(len(chunks)), [len(ws) for ws in split])
            at = np.array([index[w] for ws in split for w in ws], "i8")
            full = np.concatenate([each, n[:, None]], 1)[at]
            bits = np.stack([np.bincount(owner, full[:, k], len(chunks)) for k in range(full.shape[1])], 1)
        while self.used + len(chunks) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(chunks)] = bits
        self.row.update(zip(chunks, range(self.used, self.used + len(chunks)), strict=True))
        self.used += len(chunks)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits (texts, languages) and characters scored, of texts of about CHARS in all."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        row = self.row
        missing = [c for c in set().union(*split) if c not in row] if split else []
        if missing:
            try:
                self.learn(missing)
            except MemoryError:
                self.clear()
                row = self.row
                self.learn([c for c in set().union(*split) if c])
        out = np.array([self.table[np.fromiter(map(row.__getitem__, s), "i8", len(s))].sum(0) for s in split]).reshape(len(texts), -1)
        return out[:, :-1], out[:, -1].astype("i8")


def in_chunks(batches: Iterable[pa.RecordBatch], text_column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHARS characters of text."""
    for batch in batches:
        n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0))
        part = np.cumsum(n) // CHARS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _sample(documents: DataFrame, share: dict[str, float], turn: int) -> DataFrame:
    """Labelled rows whose hash falls into the turn-th interval of their language's share."""
    if not share:
        return documents.select(F.col("lang"), F.col("text")).limit(0)
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 32)).cast("double") / float(1 << 32)
    at = shares[F.col("lang")]
    return documents.where((u >= at * turn) & (u < at * (turn + 1))).select("lang", "text")


def remainder_of(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5


def train(documents: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER) -> Models:
    """Models and calibration from labelled documents that are not held out."""
    ship(documents.sparkSession)
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder_of() != 0))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    share = {k: min(0.5, train_docs / n) if n >= FEW else 1.0 for k, n in sizes.items()}

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            count: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in runs_of(text):
                    count[lang, w] = count.get((lang, w), 0) + 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])

    counted = _sample(known, share, 0).mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    if not languages:
        return Models([])
    every = sorted(set(counted.column("word").to_pylist()))
    index, column = {w: i for i, w in enumerate(every)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(every), len(languages)))
    for lang, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[index[word], column[lang]] = n
    models = fit_models(every, counts, languages, order)
    seen = _scored(_sample(known, share, 1).withColumn("doc_id", F.lit(0).cast("long")), models, "lang").toArrow()
    entropy, n = np.asarray(seen.column("cross_entropy")).astype("f8"), np.asarray(seen.column("n_scored"))
    guess = np.array([column.get(x, -1) for x in seen.column("lang_pred").to_pylist()], "i8")
    models.mean, models.spread, own = np.zeros(len(languages)), np.ones(len(languages)), np.ones(len(languages))
    for k in range(len(languages)):
        mine = (guess == k) & (n >= 20)
        own[k] = max(1, mine.sum())
        if not mine.any():
            mine = n >= 20
        if mine.any():
            models.mean[k] = np.average(entropy[mine], weights=n[mine])
            models.spread[k] = np.sqrt(np.mean((entropy[mine] - models.mean[k]) ** 2 * n[mine])) + 1e-6
        else:
            models.mean[k], models.spread[k] = np.log2(models.vocabulary), 10.0
    long = n >= 20
    over = entropy[long] - limits(models, guess[long], n[long])
    models.room = MARGIN + (max(0.0, np.quantile(over, 1 - TAIL, method="higher")) if len(over) else 0.0) + UNSURE / np.sqrt(own)
    return models


def limits(m: Models, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cross-entropies that mean and spread of each best language allow texts of n characters."""
    return m.mean[best] + SPREAD * m.spread[best] / np.sqrt(np.maximum(n, 1))


def rejected(m: Models, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its cross-entropy, whether that is too high, and all cross-entropies."""
    entropy = bits / np.maximum(n, 1)[:, None]
    best = entropy.argmin(1)
    lowest = entropy[np.arange(len(best)), best]
    odd = n == 0
    if m.room is not None:
        odd = odd | (lowest > limits(m, best, n) + m.room[best])
    return best, lowest, odd, entropy


def _scored(documents: DataFrame, models: Models, *_: str) -> DataFrame:
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(models)  # its size is bounded by the sample
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from scored(batches)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m) if m.languages else None
        for batch in in_chunks(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if scorer is None:
                bits, n = np.zeros((len(texts), 1)), np.zeros(len(texts), "i8")
            else:
                bits, n = scorer.score(texts)
            best, lowest, odd, entropy = rejected(m, bits, n)
            odd = odd & (scorer is not None)
            score = 1 / np.exp2(np.maximum((lowest[:, None] - entropy) * np.minimum(n, 200)[:, None], -1000)).sum(1)
            label = [m.languages[k] if c else UNKNOWN for k, c in zip(best.tolist(), n.tolist(), strict=True)]
            columns = [batch.column(0), pa.array(label, pa.string()), pa.array(np.where(n > 0, score, 0.0)), pa.array(lowest), pa.array(odd), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(spark)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def identify(documents: DataFrame, models: Models) -> DataFrame:
    """Language, score and rejection of each document."""
    return _scored(documents, models)


def keep_accepted(documents: DataFrame, models: Models) -> DataFrame:
    """The rows that are not rejected, in one pass over the texts, with all their columns."""
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(models)
    at = documents.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from kept(batches)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if not m.languages:
            yield from batches
            return
        scorer = Scorer(m)
        for batch in in_chunks(batches, at):
            bits, n = scorer.score([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(~rejected(m, bits, n)[2]))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = identify(documents, train(documents))
    return found.withColumn("held_out", F.coalesce(remainder_of() == 0, F.lit(False)))
