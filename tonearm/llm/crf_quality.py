"""Quality rules: line labels by a linear-chain conditional random field.

Each line with a word is content or boilerplate. A chain of such lines is scored by weights on
line features and on pairs of neighbouring labels; Viterbi decoding gives the best labelling, and
a document stays if content lines hold at least ``CONTENT_SHARE`` of its word characters. Base
rules (see ``query``) come first.

The weights are trained here, by gradient ascent on the likelihood of chains of labelled lines.
Labels come by document, so a chain of one document never changes its label, and would teach that
labels never change. Half of the chains are therefore spliced: runs of lines of good documents and
runs of lines of bad ones take turns, each line with the label of its own document. Chains are cut
from about ``TRAIN_DOCS`` labelled documents, chosen by a hash, long ones into several; at most
``TRAIN_CHAINS`` chains of ``TRAIN_LINES`` lines are used, chosen by a fixed draw. Everything else
covers all documents and whole texts, as arrays over about ``CHARS`` characters at a time. Words
and lines are compared by 64-bit hashes.

Defined results: a null text is empty, and fails the base rules as it has too few words; repeated
rows are judged each alone; without a labelled document that has a word, or with labels of one
kind only, there is nothing to learn and every line is content; a very long text is one chain of
all its lines; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, ship

TRAIN_DOCS = 1500
TRAIN_LINES = 32
TRAIN_CHAINS = 2048
RUN_LINES = 4
CONTENT_SHARE = 0.5
CHARS = 1 << 20
MIN_WORDS = 50
STEPS = 150

LETTER, UPPER, DIGIT, SYMBOL, SHOUT, BLANK, BAR = 1, 2, 4, 8, 16, 32, 64
FEATURES = 10
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long"

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Flags of each code point of the basic plane; others count as letters."""
    out = np.zeros(1 << 16, "u1")
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        out[i] = LETTER * (kind[0] == "L") | UPPER * (kind in ("Lu", "Lt")) | DIGIT * (kind == "Nd")
    for c in "#*$%&|<>":
        out[ord(c)] |= SYMBOL
    out[ord("!")] |= SHOUT
    out[ord("|")] |= BAR
    for i in (32, *range(9, 14)):
        out[i] |= BLANK
    return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, "u8")), np.cumprod(np.full(n, _INVERSE, "u8"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype("u8") * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


class Lines:
    """Base counts and line features of some texts."""

    def __init__(self, texts: list[str]):
        flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in texts], "i8")
        docs = len(texts)
        doc_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        kind = np.where(flat < 1 << 16, _classes()[np.minimum(flat, 0xFFFF)], LETTER)
        word = (kind & BLANK) == 0
        edge = np.diff(np.concatenate([[0], word.view("i1"), [0]]))
        w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        l0 = np.concatenate([[0], np.flatnonzero(flat == 10) + 1])
        l1 = np.concatenate([l0[1:] - 1, [len(flat)]])
        doc_of = lambda at: np.searchsorted(doc_start, at, "right") - 1
        wd, wl, ld = doc_of(w0), np.searchsorted(l0, w0, "right") - 1, doc_of(l0)

        sums = {}
        for name, flag in (("letter", LETTER), ("upper", UPPER), ("digit", DIGIT), ("symbol", SYMBOL), ("shout", SHOUT), ("bar", BAR)):
            c = np.concatenate([[0], np.cumsum((kind & flag) != 0, dtype="i8")])
            sums[name] = c[l1] - c[l0]
        chars = np.bincount(wl, w1 - w0, len(l0))
        words = np.bincount(wl, minlength=len(l0))

        power, inverse = _powers(1 << max(16, int(len(flat) + 1).bit_length()))
        rolled = np.concatenate([np.zeros(1, "u8"), np.cumsum(_mixed(flat) * power[: len(flat)])])
        salt = _mixed(np.arange(docs) + 1)
        wh = _mixed((rolled[w1] - rolled[w0]) * inverse[w0] + (w1 - w0).astype("u8"))
        repeat = np.zeros(len(w0), bool)
        if len(w0) > 2:
            at = np.flatnonzero(wd[2:] == wd[:-2])
            three = wh[at] + wh[at + 1] * np.uint64(3 * _P % (1 << 64)) + wh[at + 2] * np.uint64(5 * _P % (1 << 64)) + salt[wd[at]]
            _, back, n = np.unique(three, return_inverse=True, return_counts=True)
            again = at[n[back] > 1]
            repeat[again] = repeat[again + 1] = repeat[again + 2] = True

        has = np.flatnonzero(words > 0)
        lh = _mixed((rolled[l1[has]] - rolled[l0[has]]) * inverse[l0[has]] + (l1 - l0)[has].astype("u8")) + salt[ld[has]]
        _, first = np.unique(lh, return_index=True)
        copy = np.ones(len(has), bool)
        copy[first] = False

        count = lambda at, w=None: np.bincount(at, w, docs).astype("i8")
        self.n_words, self.word_chars = count(wd), count(wd, w1 - w0)
        self.n_symbols = count(ld, sums["symbol"])
        self.n_dup_lines, self.n_repeat_words = count(ld[has], copy), count(wd, repeat)
        #: of the lines with a word, in order
        self.doc, self.chars = ld[has], chars[has]
        part = lambda name: sums[name][has] / self.chars
        rep = np.bincount(wl, repeat, len(l0))[has] / words[has]
        f = [np.ones(len(has)), part("letter"), part("symbol"), sums["upper"][has] / np.maximum(1, sums["letter"][has]), part("shout"), part("digit"), np.log1p(words[has]) / 5, copy.astype("f8"), rep, part("bar") * 10]
        self.features = np.stack(f, 1)


def padded(features: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, longest, features) and lengths."""
    n = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, int(n.max(initial=0)), features.shape[1]))
    at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    out[doc, at] = features
    return out, n


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.1, shrink: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and label pairs (2, 2) of largest penalised likelihood, by Adam.

    x: (chains, longest, features); n: lines of each; y: (chains,), the label of all its lines, or
    (chains, longest), those of each.
    """
    docs, longest, width = x.shape
    theta = np.zeros(width * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    live = np.arange(longest)[None] < n[:, None]
    hot = np.eye(2)[y if y.ndim == 2 else np.repeat(y[:, None], longest, 1)] * live[..., None]
    seen = np.concatenate([np.einsum("dtf,dtk->fk", x, hot).ravel(), np.einsum("dtj,dtk->jk", hot[:, :-1], hot[:, 1:]).ravel()])
    total = max(1, int(n.sum()))
    for step in range(1, steps + 1):
        w, pair = theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2)
        score = x @ w
        fore, back = np.zeros((docs, longest, 2)), np.zeros((docs, longest, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, longest):
            go = score[:, t] + _log_sum(fore[:, t - 1, :, None] + pair, 1)
            fore[:, t] = np.where(live[:, t, None], go, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = _log_sum(pair[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], go, 0)
        z = _log_sum(fore[:, -1], 1)
        at = np.exp(fore + back - z[:, None, None]) * live[..., None]
        two = fore[:, :-1, :, None] + pair + (score + back)[:, 1:, None, :] - z[:, None, None, None]
        pairs = np.where(live[:, 1:, None, None], np.exp(np.minimum(two, 0)), 0).sum((0, 1))
        gradient = (seen - np.concatenate([np.einsum("dtf,dtk->fk", x, at).ravel(), pairs.ravel()])) / total - shrink * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2)


def viterbi(features: np.ndarray, doc: np.ndarray, docs: int, weights: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The label (1: content) of each line; all documents step by step together."""
    if not len(doc):
        return np.zeros(0, "i8")
    n = np.bincount(doc, minlength=docs)
    begin = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    score = features @ weights
    came = np.zeros((len(doc), 2), "i1")
    best = score[begin[order[: int((n > 0).sum())]]]
    final = np.zeros((docs, 2))
    live = order[: len(best)]
    final[live] = best
    for t in range(1, int(n.max())):
        live = order[: int(np.searchsorted(-n[order], -t, "left"))]
        ways = best[: len(live), :, None] + pair
        at = begin[live] + t
        came[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
        final[live] = best
    label = np.zeros(len(doc), "i8")
    now = final.argmax(1)
    for t in range(int(n.max()) - 1, -1, -1):
        live = order[: int(np.searchsorted(-n[order], -t, "left"))]
        at = begin[live] + t
        label[at] = now[live]
        now[live] = came[at, now[live]]
    return label


def chains(features: np.ndarray, doc: np.ndarray, good: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Padded features, lengths and line labels of training chains; None without both labels.

    features, doc: of the lines of all documents; good: label of each document.
    """
    rng = np.random.default_rng(seed)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, "i8")
    end = np.append(begin[1:], len(doc))
    cuts = [(a, min(a + TRAIN_LINES, b)) for s, b in zip(begin, end, strict=True) for a in range(s, b, TRAIN_LINES)]
    sides = [[c for c in cuts if good[doc[c[0]]] == k] for k in (0, 1)]
    if not all(sides):
        return None
    pure = [cuts[i] for i in rng.permutation(len(cuts))[: TRAIN_CHAINS // 2]]
    rows = [np.arange(a, b) for a, b in pure]
    for _ in range(len(pure)):
        side, left, parts = int(rng.integers(2)), int(rng.integers(2, TRAIN_LINES + 1)), []
        while left > 0:
            a, b = sides[side][int(rng.integers(len(sides[side])))]
            n = min(left, b - a, int(rng.geometric(1 / RUN_LINES)))
            at = int(rng.integers(a, b - n + 1))
            parts.append(np.arange(at, at + n))
            left, side = left - n, 1 - side
        rows.append(np.concatenate(parts))
    n = np.array([len(r) for r in rows])
    x, y = np.zeros((len(rows), int(n.max()), features.shape[1])), np.zeros((len(rows), int(n.max())), "i8")
    for i, r in enumerate(rows):
        x[i, : len(r)], y[i, : len(r)] = features[r], good[doc[r]]
    return x, n, y


def fit(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights from about ``train_docs`` labelled documents, chosen by a hash; None without any."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_doc_id")).agg(F.max(F.col("quality").cast("int")).alias("l_quality"))
    n = known.count()
    if not n:
        return None
    limit = int(min(1.0, train_docs / n) * (1 << 32))
    some = known.where(F.pmod(F.xxhash64("l_doc_id", F.lit(11)), F.lit(1 << 32)) < limit)
    texts = documents.select(F.col("doc_id").cast("long").alias("d_doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(some, F.col("d_doc_id") == F.col("l_doc_id")).select("l_doc_id", "text", "l_quality").toArrow().sort_by([("l_doc_id", "ascending"), ("text", "ascending")])
    if not len(rows):
        return None
    features, doc, at = [], [], 0
    for part in _by_size(rows.column("text").to_pylist()):
        lines = Lines(part)
        features.append(lines.features)
        doc.append(lines.doc + at)
        at += len(part)
    cut = chains(np.concatenate(features), np.concatenate(doc), (np.asarray(rows.column("l_quality")) > 0).astype("i8"))
    return train(*cut) if cut else None


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about CHARS characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def judge(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, min_words: int = MIN_WORDS, share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts and verdict, a row per document."""
    ship(documents.sparkSession)

    def verdicts(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
        x = Lines(texts)
        label = np.ones(len(x.doc), "i8") if model is None else viterbi(x.features, x.doc, len(texts), *model)
        whole = np.bincount(x.doc, x.chars, len(texts))
        content = np.bincount(x.doc, x.chars * label, len(texts)) / np.maximum(1, whole)
        failed = (x.n_words < min_words) | (100 * x.n_repeat_words > 50 * x.n_words)
        columns = [pa.array(doc_ids, pa.int64()), *(pa.array(c) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, ~failed & (content >= share), content, np.bincount(x.doc, minlength=len(texts))))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                doc_ids.append(doc_id)
                texts.append(t)
                size += len(t)
                if size >= CHARS:
                    yield verdicts(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield verdicts(doc_ids, texts)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules: 50 words at least, and at most half of them in repeated windows of three."""
    documents = read(spark, sf_dir, "documents")
    return judge(documents, fit(documents, read(spark, sf_dir, "labels")))
