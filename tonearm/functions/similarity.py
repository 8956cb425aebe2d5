"""String similarity.

What Spark has stays in Catalyst; the longest common subsequence and Jaro-Winkler run in Arrow
UDFs over whole batches: a step takes one character of every left text against all of its right
text. Texts too long for that go one by one, with the bits of a Python integer as the row of the
dynamic program.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import ship

#: White_Space, as Unicode has it.
_WHITE = "\t-\r \x85\xa0  -     　"
_TOKEN = re.compile(f"[^{_WHITE}]+")
SPLIT = "[\\p{IsWhite_Space}]+"

BOOST_OVER = 0.7
PREFIX = 4
SCALE = 0.1
#: Longest texts that are scored as arrays: the bits of a word, and the cells of a batch.
WORD_BITS = 64
WIDE = 128


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: after each character of b, zeros of the row count the subsequence."""
    n = min(len(a), len(b))
    head = 0  # what both begin and end with is common in any case
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return head + tail + len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def sort_ratio(a: list[str], b: list[str]) -> float:
    return ratio(" ".join(sorted(a)), " ".join(sorted(b)))


def set_ratio(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return float(not a and not b)
    both = " ".join(sorted(a & b))
    left, right = (" ".join(x for x in (both, " ".join(sorted(s))) if x) for s in (a - b, b - a))
    # the shared tokens begin both sides, so they are a subsequence of either
    shared = [2.0 * len(both) / (len(both) + len(x)) if both or x else 1.0 for x in (left, right)]
    return max(*shared, ratio(left, right))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def winkler(a: str, b: str) -> float:
    """Jaro, raised by a common prefix where it is over 0.7."""
    score = jaro(a, b)
    if score > BOOST_OVER:
        prefix = 0
        for x, y in zip(a[:PREFIX], b[:PREFIX], strict=False):
            if x != y:
                break
            prefix += 1
        score += SCALE * prefix * (1.0 - score)
    return score


# ---- whole batches


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded with zeros to the longest text, and lengths."""
    length = np.array([len(t) for t in texts], "i8")
    out = np.zeros((len(texts), int(length.max(initial=0))), "u4")
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, length


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``lcs_length`` of each pair; pairs whose shorter text is over a word go one by one."""
    out = np.zeros(len(a), "i8")
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if len(a) else ((), ())
    fits = np.array([len(x) <= WORD_BITS and len(y) <= 8 * WORD_BITS for x, y in zip(short, long, strict=True)], bool)
    for i in np.flatnonzero(~fits).tolist():
        out[i] = lcs_length(short[i], long[i])
    some = np.flatnonzero(fits)
    if not len(some):
        return out
    x, n = _codes([short[i] for i in some])
    y, m = _codes([long[i] for i in some])
    x = np.concatenate([x, np.zeros((len(x), -x.shape[1] % 8), "u4")], 1)
    inside = np.arange(x.shape[1]) < n[:, None]
    full = np.full(len(x), np.iinfo("u8").max, "u8")
    row, bits = full.copy(), np.zeros((len(x), 8), "u1")
    for i in range(y.shape[1]):
        same = (x == y[:, i : i + 1]) & inside & (i < m)[:, None]
        bits[:, : x.shape[1] // 8] = np.packbits(same, axis=1, bitorder="little")
        u = row & bits.view("<u8")[:, 0]
        row = (row + u) | (row - u)
    count = np.unpackbits((~row).view("u1").reshape(-1, 8), axis=1, bitorder="little")[:, : x.shape[1]]
    out[some] = (count.astype(bool) & inside).sum(1)
    return out


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], "f8")
    return np.where(total > 0, 2.0 * lcs_lengths(a, b) / np.maximum(total, 1), 1.0)


def winklers(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``winkler`` of each pair."""
    out = np.zeros(len(a))
    fits = np.array([0 < len(x) <= WIDE and 0 < len(y) <= WIDE for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(~fits).tolist():
        out[i] = winkler(a[i], b[i])
    some = np.flatnonzero(fits)
    if not len(some):
        return out
    x, n = _codes([a[i] for i in some])
    y, m = _codes([b[i] for i in some])
    place = np.arange(y.shape[1])
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
    free = place < m[:, None]
    ours, every = np.zeros(x.shape, bool), np.arange(len(x))
    for i in range(x.shape[1]):
        may = (y == x[:, i : i + 1]) & free & (np.abs(place - i) <= reach) & (i < n)[:, None]
        at = may.argmax(1)
        ours[:, i] = may[every, at]
        free[every, at] &= ~ours[:, i]
    theirs = ~free & (place < m[:, None])
    count = ours.sum(1)
    width = min(x.shape[1], y.shape[1])
    # the matched characters of each side, in order
    mine, other = (np.take_along_axis(z, np.argsort(~t, axis=1, kind="stable"), 1)[:, :width] for z, t in ((x, ours), (y, theirs)))
    swaps = ((mine != other) & (np.arange(width) < count[:, None])).sum(1) // 2
    hit = np.maximum(count, 1)
    score = np.where(count > 0, (count / n + count / m + (count - swaps) / hit) / 3.0, 0.0)
    head = min(PREFIX, width)
    same = (x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    out[some] = np.where(score > BOOST_OVER, score + SCALE * prefix * (1.0 - score), score)
    return out


def _batched(score):
    """An Arrow UDF of a function of two lists of texts; NULL if either text is."""
    ship()

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        if len(both):
            out[both] = score(a.iloc[both].tolist(), b.iloc[both].tolist())
        return pd.Series(out, dtype="float64").astype(object).where(a.notna().to_numpy() & b.notna().to_numpy(), None) if len(both) < len(a) else pd.Series(out)

    return run


def _token_lists(texts: Sequence[str]) -> list[list[str]]:
    seen = {t: sorted(tokens(t)) for t in set(texts)}
    return [seen[t] for t in texts]


def sort_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return ratios([" ".join(t) for t in _token_lists(a)], [" ".join(t) for t in _token_lists(b)])


def set_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``set_ratio`` of each pair: the shared tokens begin both sides, so only the rest is compared.

    What a text is without its shared tokens is worked out once for each such set of tokens, and
    equal rests are compared once.
    """
    of = {t: frozenset(tokens(t)) for t in {*a, *b}}
    rests: dict[tuple[str, frozenset[str]], tuple[int, str]] = {}

    def rest(text: str, shared: frozenset[str]) -> tuple[int, str]:
        found = rests.get((text, shared))
        if found is None:
            both = " ".join(sorted(shared))
            whole = " ".join(x for x in (both, " ".join(sorted(of[text] - shared))) if x)
            found = rests[text, shared] = len(both), whole[len(both) :]
        return found

    seen: dict[tuple[str, str], int] = {}
    at, shared, sizes, fixed = np.zeros(len(a), "i8"), np.zeros(len(a), "i8"), np.ones((len(a), 2)), np.full(len(a), -1.0)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        u, v = of[x], of[y]
        if not u or not v:
            fixed[i] = float(not u and not v)
            at[i] = seen.setdefault(("", ""), len(seen))
            continue
        both = u & v
        n, left = rest(x, both)
        _, right = rest(y, both)
        shared[i], sizes[i] = n, (n + len(left), n + len(right))
        at[i] = seen.setdefault((left, right), len(seen))
    common = shared + lcs_lengths([p for p, _ in seen], [q for _, q in seen])[at] if len(a) else shared
    whole = 2.0 * common / np.maximum(sizes.sum(1), 1)
    alone = (2.0 * shared[:, None] / np.maximum(shared[:, None] + sizes, 1)).max(1, initial=0)
    return np.where(fixed < 0, np.maximum(whole, alone), fixed)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edits over the longer length; the length is in bytes, the edits are in characters."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def fuzz_ratio(a: Column, b: Column) -> Column:
    return _batched(ratios)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _batched(sort_ratios)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _batched(set_ratios)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _batched(winklers)(a, b)


def token_ratios(a: Column, b: Column) -> Column:
    """``struct<token_set, token_sort>`` in one pass to Python; 0 beside a NULL."""
    ship()

    @F.pandas_udf("token_set double, token_sort double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        known = (a.notna() & b.notna()).to_numpy()
        return pd.DataFrame({"token_set": np.where(known, set_ratios(x, y), 0.0), "token_sort": np.where(known, sort_ratios(x, y), 0.0)})

    return run(a, b)


SCORERS = {"token_set": lambda x, y: set_ratio(set(tokens(x)), set(tokens(y))), "token_sort": lambda x, y: sort_ratio(tokens(x), tokens(y)), "jaro_winkler": winkler}
