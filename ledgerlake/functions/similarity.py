"""String similarity (Ratcliff-Obershelp ``ratio`` as in stdlib difflib) and an
exact distributed similarity join.

``ratio(a, b) = 2*M / (len(a)+len(b))`` where M is the number of matched
characters; it is asymmetric in rare cases, so argument order matters.

Exact candidate generation (no all-pairs, no cross join). With S the sum of the
lengths and U = S - 2M the unmatched characters, ``ratio > t`` means
``U < (1 - t) * S``. Between two matching blocks lies an unmatched character, so
there are at most U + 1 blocks, and the strings share at least ``M - U - 1``
bigrams (as multisets), more than ``(t - 2/3) * 3/2 * S - 1``; with
``min/max length >= alpha = t / (2 - t)`` that is a share of each string's own
length. Bigrams, ordered globally by rarity, are the join tokens wherever that
bound is positive, single characters (M is at most their overlap) for pairs with
a shorter string. Of each string only the first ``tokens - least overlap + 1``
tokens are kept: two strings that can reach the threshold share one of them (the
prefix-filter principle of set-similarity joins). Candidates must also agree in
length and in character overlap, both checked natively, before they are scored.

Where a token is shared by so many strings that its pairs exceed ``CROWD``, these are
not listed: the strings are cut into blocks of ``BLOCK``, and a task takes two blocks,
bounds all their pairs by the longest common subsequence (matching blocks form one)
and scores what is left. Where such tokens have as many pairs together as there are
pairs of strings, all strings are compared so, once. Left strings of a block are in
order: what their common starts leave of the right ones is found once. Every step works on distinct strings where that lists no
more pairs than a few for each row, whatever the keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import python_workers_ready
from .ranges import PART, shuffled, staged

#: pairs of one token from which its strings are compared block by block, and strings in a block
CROWD, BLOCK = 10_000, 2_048
#: least number of ranges that all strings are cut into, and blocks of strings that a range meets at once
RANGES, WIDE = 32, 32
#: strings of a partition that are cut into tokens
DEAL = 1 << 13
#: partitions that these groups are dealt to at most
MOST_GROUPS = 1 << 13
#: pairs of distinct strings to list, for each keyed string, rather than pairs within the keys
PAIRS_A_ROW = 8
#: pairs of strings that are sent to every task
FEW_PAIRS = 20_000
#: strings up to this length are scored many at once; from 200 on difflib ignores popular characters
SHORT = 64
#: bytes of the table of places that a block is compared by
HELD = 1 << 26
#: tokens by whose order a pair is left to the first it shares
MARKED = 62


def py_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised batch wrapper around difflib's ratio (Arrow batches)."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = ratios(a[known].to_numpy(dtype=object), b[known].to_numpy(dtype=object))
    return pd.Series([None if np.isnan(x) else x for x in out], dtype="float64")


def _codes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``SHORT`` code points, a row for each text (0 behind its end), and the lengths."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(int(np.minimum(n, SHORT).max(initial=0)), 1)
    out = np.array([t[:SHORT] for t in texts], dtype=f"<U{width}")
    return out.view("<u4").reshape(len(texts), width).astype(np.int32), n


def ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """difflib's ratio of each pair of texts."""
    out = np.zeros(len(a))
    short = np.array([len(x) <= SHORT and len(y) <= SHORT for x, y in zip(a, b)], dtype=bool)
    for i in np.flatnonzero(~short):
        out[i] = py_ratio(a[i], b[i])
    at = np.flatnonzero(short)
    for lo in range(0, len(at), 8192):
        some = at[lo : lo + 8192]
        (ca, na), (cb, nb) = _codes(a[some]), _codes(b[some])
        out[some] = _scores(ca, na, cb, nb)
    return out


def _scores(ca: np.ndarray, na: np.ndarray, cb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Ratios of rows of code points with their lengths (at most ``SHORT``): the
    longest match of every window, first in a, then in b, then the windows left
    and right of it."""
    matched = np.zeros(len(na), dtype=np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(na)), np.zeros_like(na), na, np.zeros_like(nb), nb
    while len(pair):
        some = (ahi > alo) & (bhi > blo)
        pair, alo, ahi, blo, bhi = (x[some] for x in (pair, alo, ahi, blo, bhi))
        if not len(pair):
            break
        wa, wb = int((ahi - alo).max()), int((bhi - blo).max())
        # a row for each place in the window, so that every step runs over all pairs
        ia, ib = alo + np.arange(wa)[:, None], blo + np.arange(wb)[:, None]
        xa = np.where(ia < ahi, ca[pair, np.minimum(ia, ca.shape[1] - 1)], -1)
        xb = np.where(ib < bhi, cb[pair, np.minimum(ib, cb.shape[1] - 1)], -2)
        best = np.zeros(len(pair), dtype=np.int16)  # length * 64, more for an earlier end in b
        end_a = np.zeros(len(pair), dtype=np.int64)
        early = (SHORT - 1 - np.arange(wb, dtype=np.int16))[:, None]
        run = np.zeros((wb, len(pair)), dtype=np.int16)
        for i in range(wa):
            grown = np.ones_like(run)
            grown[1:] += run[:-1]
            run = np.where(xb == xa[i], grown, np.int16(0))
            top = np.where(run > 0, run * np.int16(SHORT) + early, np.int16(0)).max(axis=0)
            longer = top // SHORT > best // SHORT
            best[longer], end_a[longer] = top[longer], i + 1
        size = (best // SHORT).astype(np.int64)
        end_b = SHORT - best % SHORT
        np.add.at(matched, pair, size)
        found = size > 0
        pair, alo, ahi, blo, bhi, size = (x[found] for x in (pair, alo, ahi, blo, bhi, size))
        end_a, end_b = alo + end_a[found], blo + end_b[found]
        pair, alo, ahi, blo, bhi = (np.concatenate(x) for x in (
            (pair, pair), (alo, end_a), (end_a - size, ahi), (blo, end_b), (end_b - size, bhi)))
    total = na + nb
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def _numbered(ca: np.ndarray, na: np.ndarray, cb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The characters of either side as numbers from 1 on, 0 behind an end and for
    those that the left side does not have, and how many numbers there are."""
    here = lambda c, n: np.arange(c.shape[1]) < n[:, None]
    known = np.unique(ca[here(ca, na)])
    out = []
    for c, n in ((ca, na), (cb, nb)):
        at = np.minimum(np.searchsorted(known, c), max(len(known) - 1, 0))
        out.append(np.where(here(c, n) & (known[at] == c), at + 1, 0) if len(known) else np.zeros(c.shape, dtype=np.int64))
    return out[0], out[1], len(known) + 1


def _places(codes: np.ndarray, numbers: int) -> np.ndarray:
    """For each number the places where a text has it, as bits, a column for each text."""
    width = codes.shape[1]
    kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
    out = np.zeros((numbers, len(codes)), dtype=kind)
    for place in range(width):
        some = np.flatnonzero(codes[:, place])
        out[codes[some, place], some] |= kind(1 << place)
    return out


def _reached(codes: np.ndarray, na: np.ndarray, places: np.ndarray, nb: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(left place, right places) whose longest common subsequence lets them exceed
    the threshold. Left texts are in order, and what a common start of theirs leaves
    of the right side is found once: the state after every character is kept."""
    bits = places.dtype.itemsize * 8
    shared = (codes[1:] == codes[:-1]) & (codes[1:] > 0)
    start = np.concatenate(([0], np.logical_and.accumulate(shared, axis=1).sum(axis=1)))
    longest = [np.full(len(na), na.max())]  # of the left texts with the same first characters
    for q in range(1, int(na.max()) + 1):
        first = np.flatnonzero(start < q)
        longest.append(np.repeat(np.maximum.reduceat(na, first), np.diff(np.append(first, len(na)))))
    lengths = np.arange(int(nb.max()) + 1)
    alike = nb[0] if (nb == nb[0]).all() else None
    room: dict[tuple[int, int], np.ndarray] = {}

    def fits(v: np.ndarray, at: np.ndarray | None, q: int, n: int) -> np.ndarray:
        """Whether the q characters so far leave a text of n enough matches."""
        if (q, n) not in room:
            least = np.floor((threshold - 1e-12) * (n + lengths) / 2).astype(np.int64) + 1
            room[q, n] = np.clip(bits - least + n - q + 1, 0, 255).astype(np.uint8)
        most = room[q, n]
        return np.bitwise_count(v) < (most[alike] if alike is not None else most.take(nb if at is None else nb.take(at)))

    states: list[tuple[np.ndarray | None, np.ndarray]] = [(None, np.full(places.shape[1], -1).astype(places.dtype))]
    for k in range(len(na)):
        n = int(na[k])
        del states[int(start[k]) + 1 :]
        for q in range(len(states), n + 1):
            at, v = states[-1]
            if not len(v):
                break
            held = places[codes[k, q - 1]]
            u = v & (held if at is None else held.take(at))
            v = (v + u) | (v - u)
            kept = fits(v, at, q, int(longest[q][k]))
            if np.count_nonzero(kept) < 0.8 * len(kept):
                kept = np.flatnonzero(kept)
                at, v = kept if at is None else at.take(kept), v.take(kept)
            states.append((at, v))
        at, v = states[-1]
        if len(states) == n + 1 and len(v):
            found = np.flatnonzero(fits(v, at, n, n))
            if len(found):
                yield k, found if at is None else at.take(found)


def _start(ca: np.ndarray, na: np.ndarray, cb: np.ndarray, nb: np.ndarray) -> int:
    """Length of a start common to all texts of both sides, if so long that the first
    match of every pair is its common start: no block off the diagonal is longer.
    Else 0."""
    longest = int(max(na.max(), nb.max()))
    width = int(min(na.min(), nb.min(), longest - 1))
    same = (ca[:, :width] == ca[0, :width]).all(axis=0) & (cb[:, :width] == ca[0, :width]).all(axis=0)
    n = int(np.logical_and.accumulate(same).sum())
    common = ca[0, :n]
    if longest - n - 1 > n:
        return 0
    for shift in range(1, n):
        differs = np.flatnonzero(common[:-shift] != common[shift:])
        if longest - shift - (int(differs[-1]) + 1 if len(differs) else 0) > n:
            return 0
    return n


def _matched(rows: np.ndarray) -> np.ndarray:
    """Matched characters of many pairs: the rows are left characters, the last one
    first, and have the right places equal to them as bits. The longest match of every
    window, first in the left text, then in the right, then the windows before and after it."""
    out = np.zeros(rows.shape[1], dtype=np.int64)
    kind, wide = rows.dtype.type, len(rows)
    one, every = kind(1), np.arange(wide, dtype=kind)[:, None]
    small = np.uint8 if wide * (wide + 1) <= 256 else np.uint16
    lengths, ends = np.divmod(np.arange(wide * (wide + 1)), wide)
    pair = np.flatnonzero(np.bitwise_or.reduce(rows, axis=0))
    rows = rows.take(pair, axis=1)
    while len(pair):
        runs, best = [rows], np.zeros(len(pair), dtype=small)
        while True:  # places where a run of so many characters ends
            rank = (len(runs) * wide + np.arange(wide)).astype(small)[:, None]
            best = np.maximum(best, (np.negative((runs[-1] != 0).view(np.uint8).astype(small, copy=False)) & rank).max(axis=0))
            longer = np.zeros_like(rows)
            np.bitwise_and(rows[:-1], runs[-1][1:] << one, out=longer[:-1])
            if not longer.any():
                break
            runs.append(longer)
        size, end = lengths.take(best), ends.take(best).astype(kind)
        at = (best.astype(np.int64) - wide) * len(pair) + np.arange(len(pair))
        last = np.concatenate(runs).ravel().take(at)
        last &= np.negative(last)
        np.add.at(out, pair, size)
        size = size.astype(kind)
        parts = []
        for inside, whole in ((~kind(0) << (end + size), (last >> (size - one)) - one), ((one << end) - one, ~(last | (last - one)))):
            part = np.negative((inside >> every) & one) & (rows & whole)
            some = np.flatnonzero(np.bitwise_or.reduce(part, axis=0))
            parts.append((part.take(some, axis=1), pair.take(some)))
        rows, pair = (np.concatenate(x, axis=-1) for x in zip(*parts))
    return out


#: bits on the diagonal of eight rows of eight places, and of places from p on in rows from p on
DIAGONAL = np.uint64(0x8040201008040201)
FROM = np.array([sum(0xFF >> p << p << 8 * x for x in range(p, 8)) for p in range(9)], dtype=np.uint64)


class _Squares:
    """Matched characters of windows of up to eight characters a side: eight rows as
    the bytes of a number. Few patterns make up most windows, so those met are kept
    (a place for each, the last one to come has it)."""

    BITS = 18

    def __init__(self) -> None:
        self.known = np.zeros(1 << self.BITS, dtype=np.uint64)  # no match at all is 0
        self.size = np.zeros(1 << self.BITS, dtype=np.uint8)

    def common_start(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Its length and the rows behind it."""
        filled = rows & DIAGONAL | ~DIAGONAL
        n = np.bitwise_count(((~filled & (filled + np.uint64(1))) - np.uint64(1)) & DIAGONAL)
        return n, (rows & FROM.take(n)) >> np.minimum(n * np.uint8(9), 63).astype(np.uint64)

    def matched(self, rows: np.ndarray) -> np.ndarray:
        at = ((rows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.size.take(at)
        new = np.flatnonzero(self.known.take(at) != rows)
        if len(new):
            some, which = np.unique(rows[new], return_inverse=True)
            size = _matched((some >> np.arange(56, -1, -8, dtype=np.uint64)[:, None]).astype(np.uint8)).astype(np.uint8)
            out[new] = size[which]
            there = at[new[np.unique(which, return_index=True)[1]]]
            there, first = np.unique(there, return_index=True)
            self.known[there], self.size[there] = some[first], size[first]
        return out


def _close_short(left: np.ndarray, left_marks: np.ndarray | None, right: np.ndarray, right_marks: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_close`` of texts of 1 to ``SHORT`` characters."""
    order = np.array(sorted(range(len(left)), key=left.__getitem__))
    (ca, na), (cb, nb) = _codes(left[order]), _codes(right)
    head = _start(ca, na, cb, nb)
    ca, cb, numbers = _numbered(ca, na, cb, nb)
    ca, cb = ca[:, : int(na.max())], cb[:, : int(nb.max())]
    places = _places(cb, numbers)
    tail = ca[:, head:]
    behind = _places(cb[:, head:], numbers) if head else places
    wide = tail.shape[1]
    squares = _Squares() if wide <= 8 and behind.dtype == np.uint8 else None
    if squares:
        behind = behind.astype(np.uint64)
    one, back = behind.dtype.type(1), np.arange(wide, dtype=behind.dtype)[::-1, None]
    lot = 1 << 14 if squares else min(max((1 << 22) // (wide * wide * behind.itemsize), 256), 1 << 13)
    flat, starts = behind.ravel(), np.ascontiguousarray(tail.T[::-1]) * len(right)
    held: list[tuple[np.ndarray, ...]] = []

    def sizes(p: np.ndarray, q: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        if squares:
            if not head:
                return squares.matched(rows)
            start, rows = squares.common_start(rows)
            return (head + start.astype(np.int64)) + squares.matched(rows)
        size = np.full(len(p), head)
        rows = flat.take(starts.take(p, axis=1) + q)
        if head:  # the common start is the first match; bits of its places
            start = at = rows[-1] & one
            for row in rows[-2::-1]:
                at = (at << one) & row
                start = start | at
            size += np.bitwise_count(start)
            rows &= ~start
            rows &= ((start >> back) & one) - one
        return size + _matched(rows)

    def scored():
        i, j, *rows = (np.concatenate(x) for x in zip(*held))
        held.clear()
        score = np.zeros(len(i))
        for lo in range(0, len(i), lot):
            part = slice(lo, lo + lot)
            p, q = i[part], j[part]
            score[part] = 2.0 * sizes(p, q, rows[0][part] if rows else None) / (na[p] + nb[q])
        above = np.flatnonzero(score > threshold)
        return order[i[above]], j[above], score[above]

    n = 0
    for k, j in _reached(ca, na, places, nb, threshold):
        if left_marks is not None:
            j = j[(right_marks[j] & left_marks[order[k]]) == 0]
        if squares:
            rows = np.zeros(len(j), dtype=np.uint64)
            for x in range(wide):
                rows |= behind[tail[k, x]].take(j) << np.uint64(8 * x)
            held.append((np.full(len(j), k), j, rows))
        else:
            held.append((np.full(len(j), k), j))
        n += len(j)
        if n >= 1 << 16:
            yield scored()
            n = 0
    if n:
        yield scored()


def _close_long(left: np.ndarray, left_marks: np.ndarray | None, right: np.ndarray, right_marks: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_close`` of pairs with a text of more than ``SHORT`` characters."""
    a = alpha(threshold) - 1e-12
    na, nb = (np.array([len(x) for x in texts], dtype=np.int64) for texts in (left, right))
    if not ((na > SHORT).any() or (nb > SHORT).any()):
        return
    known = set().union(*left)
    holds: dict[str, np.ndarray] = {}  # how often a right text has a character
    for j, text in enumerate(right):
        for c, times in Counter(text).items():
            if c in known:
                holds.setdefault(c, np.zeros(len(right), dtype=np.int64))[j] = times
    for k in range(len(left)):
        n = int(na[k])
        fits = (np.minimum(nb, n) >= np.maximum(nb, n) * a) & ((nb > SHORT) | (n > SHORT))
        if left_marks is not None:
            fits &= (right_marks & left_marks[k]) == 0
        if fits.any():
            common = sum((np.minimum(holds[c], times) for c, times in Counter(left[k]).items() if c in holds), np.zeros(len(right), dtype=np.int64))
            fits &= 2.0 * common > (threshold - 1e-12) * (nb + n)
        j = np.flatnonzero(fits)
        score = np.array([py_ratio(left[k], right[q]) for q in j])
        above = score > threshold
        if above.any():
            yield np.full(int(above.sum()), k), j[above], score[above]


def _close(left: np.ndarray, left_marks: np.ndarray | None, right: np.ndarray, right_marks: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left place, right place, score) of pairs above the threshold, but for
    those that share a marked token before this one; all of a left text that one
    result has lie together."""
    some = lambda marks, at: None if marks is None else marks[at]
    short = lambda texts: np.flatnonzero([len(t) <= SHORT for t in texts])
    step = max(HELD // (8 * len(set().union(*left)) + 8), 256)
    for lo in range(0, len(right), step):
        part, marks = right[lo : lo + step], some(right_marks, slice(lo, lo + step))
        p, q = short(left), short(part)
        if len(p) and len(q):
            for i, j, score in _close_short(left[p], some(left_marks, p), part[q], some(marks, q), threshold):
                yield p[i], lo + q[j], score
        for i, j, score in _close_long(left, left_marks, part, marks, threshold):
            yield i, lo + j, score


def alpha(threshold: float) -> float:
    return threshold / (2.0 - threshold)


def length_bound(la: Column, lb: Column, threshold: float) -> Column:
    """Necessary condition for ratio > threshold: min/max length >= alpha."""
    return F.least(la, lb) >= F.greatest(la, lb) * F.lit(alpha(threshold) - 1e-12)


def _prefix_len(n: Column, threshold: float) -> Column:
    a = alpha(threshold) - 1e-12
    return n - F.ceil(n * F.lit(a)) + 1


def _bigram_share(threshold: float) -> float:
    """Shared bigrams of a pair above the threshold exceed this share of either
    length, less one; not positive for thresholds up to 2/3."""
    return (0.5 - 1.5 * (1.0 - threshold)) * (1.0 + alpha(threshold)) - 1e-9


def _bigrams_from(threshold: float) -> int | None:
    """Least length at which a shared bigram is certain (None: never)."""
    share = _bigram_share(threshold)
    return int(1.0 / share) + 1 if share > 0 else None


TOKEN = ["size", "token", "occ"]


def _tokens(df: DataFrame, keys: list[str], id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(keys, id, len, size, token, occ): multiset tokens of ``size`` characters."""
    least = _bigrams_from(threshold)
    n = F.length(text_col)
    grams = lambda size: F.transform(
        F.sequence(F.lit(1), n - F.lit(size - 1)), lambda i: F.struct(F.lit(size).alias("size"), F.substring(F.col(text_col), i, F.lit(size)).alias("token")))
    if least is None:
        found = grams(1)
    else:
        none = F.array().cast("array<struct<size:int,token:string>>")
        # strings that may pair with one below the limit have characters, too
        found = F.concat(F.when(n * F.lit(alpha(threshold)) <= least, grams(1)).otherwise(none), F.when(n >= least, grams(2)).otherwise(none))
    rows = df.select(*keys, F.col(id_col).alias("_id"), n.alias("_len"), F.explode(found).alias("_g"))
    counts = rows.groupBy(*keys, "_id", "_len", "_g.size", "_g.token").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(*keys, "_id", "_len", "size", "token", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("occ"))


def _prefixes(tokens: DataFrame, freq: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    w = Window.partitionBy(*keys, "_id", "size").orderBy("freq", "token", "occ")
    share = F.lit(max(_bigram_share(threshold), 0.0))
    kept = F.when(F.col("size") == 1, _prefix_len(F.col("_len"), threshold)).otherwise(F.col("_len") - 1 - F.floor(F.col("_len") * share - 1))
    return (
        tokens.join(freq, on=["size", "token", "occ"])
        .withColumn("_pos", F.row_number().over(w))
        .where(F.col("_pos") <= kept)
        .select(*keys, "_id", "_len", "size", "token", "occ", "_pos")
    )


def _characters(text: Column) -> Column:
    """Characters with their occurrence numbers, so sets stand for multisets."""
    n = F.length(text)
    before = lambda i: F.substring(text, F.lit(1), i)
    char = lambda i: F.substring(text, i, F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(char(i), (F.length(before(i)) - F.length(F.replace(before(i), char(i), F.lit("")))).cast("string")))


def _sides(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept tokens of either side, and the rows of each token; every step goes through ``kept``."""
    lt, rt = (kept(_tokens(df, keys, f"_{side}id", f"_{side}text", threshold)) for df, side in ((left, "l"), (right, "r")))
    # global token rarity over both sides (one row per distinct token)
    freq = kept(lt.select(*TOKEN).unionAll(rt.select(*TOKEN)).groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("freq")))
    return kept(_prefixes(lt, freq, keys, threshold)), kept(_prefixes(rt, freq, keys, threshold)), freq


def _fits(threshold: float) -> Column:
    fits = length_bound(F.col("_llen"), F.col("_rlen"), threshold)
    least = _bigrams_from(threshold)
    if least is not None:  # longer pairs meet by bigrams
        fits = fits & ((F.col("size") == 2) | (F.least("_llen", "_rlen") < least))
    return fits


def _listed(lp: DataFrame, rp: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    lp, rp = lp.withColumnsRenamed({"_id": "_lid", "_len": "_llen"}), rp.withColumnsRenamed({"_id": "_rid", "_len": "_rlen"})
    return lp.drop("_pos").join(rp.drop("_pos"), on=[*keys, *TOKEN]).where(_fits(threshold)).select(*keys, "_lid", "_rid").distinct()


def candidate_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, _lid, _rid) of the pairs that share a prefix token and fit in
    length; ``left`` and ``right`` have keys, ``_lid``/``_rid``, ``_ltext``/``_rtext``."""
    lp, rp, _freq = _sides(left, right, keys, threshold)
    return _listed(lp, rp, keys, threshold)


def _token_sizes(lp: DataFrame, rp: DataFrame, keys: list[str]) -> DataFrame:
    """Strings of either side at every token that both have."""
    at = [*keys, *TOKEN]
    both = lp.select(*at, F.lit(1).alias("l")).unionByName(rp.select(*at, F.lit(0).alias("l")))
    sizes = both.groupBy(*at).agg(F.sum("l").cast("bigint").alias("_nl"), F.sum(1 - F.col("l")).cast("bigint").alias("_nr"))
    return sizes.where((F.col("_nl") > 0) & (F.col("_nr") > 0))


def _crowded(left: DataFrame, right: DataFrame, lp: DataFrame, rp: DataFrame, crowds: DataFrame, freq: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, _lid, _ltext, _rid, _rtext, score) of the pairs above the threshold that
    share a token of ``crowds``: its strings in blocks, every two blocks one group."""
    at = [*keys, *TOKEN]
    order = [F.desc("freq"), *TOKEN]
    marks = (
        freq.orderBy(*order).limit(MARKED).withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)
        .select(*TOKEN, F.expr("shiftleft(cast(1 as bigint), _n)").alias("_mark"))
    )
    earlier = Window.partitionBy(*keys, "_id", "size").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    blocks = crowds.select(*at, F.ceil(F.col("_nl") / BLOCK).cast("int").alias("_bl"), F.ceil(F.col("_nr") / BLOCK).cast("int").alias("_br"))

    def side(prefixes: DataFrame, texts: DataFrame, own: str, other: str, from_left: bool) -> DataFrame:
        tid, text = ("_lid", "_ltext") if from_left else ("_rid", "_rtext")
        marked = prefixes.join(F.broadcast(marks), TOKEN, "left").withColumn("_marks", F.coalesce(F.sum("_mark").over(earlier), F.lit(0)))
        rows = marked.join(blocks, at).join(texts.select(*keys, F.col(tid).alias("_id"), F.col(text).alias("_text")), [*keys, "_id"])
        mine = F.pmod(F.xxhash64("_text"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        pair = [mine.alias("_i"), every.alias("_j")] if from_left else [every.alias("_i"), mine.alias("_j")]
        return rows.select(*at, *pair, F.lit(from_left).alias("_left"), "_text", "_marks")

    rows = side(lp, left, "_bl", "_br", True).unionByName(side(rp, right, "_br", "_bl", False))
    group = [*at, "_i", "_j"]
    least = _bigrams_from(threshold)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ltext, lmarks = (rows.loc[rows["_left"], c].to_numpy() for c in ("_text", "_marks"))
        rtext, rmarks = (rows.loc[~rows["_left"], c].to_numpy() for c in ("_text", "_marks"))
        head = rows.iloc[:1][keys].reset_index(drop=True)
        parts = []
        if len(ltext) and len(rtext):
            single = least is not None and rows["size"].iat[0] == 1
            for i, j, score in _close(ltext, lmarks, rtext, rmarks, threshold):
                if single:
                    kept = [min(len(ltext[p]), len(rtext[q])) < least for p, q in zip(i, j)]
                    i, j, score = i[kept], j[kept], score[kept]
                part = head.loc[np.zeros(len(i), dtype=int)].reset_index(drop=True)
                parts.append(part.assign(_ltext=ltext[i], _rtext=rtext[j], score=score))
        empty = head.iloc[:0].assign(_ltext="", _rtext="", score=0.0)
        return pd.concat(parts, ignore_index=True) if parts else empty

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in left.select(*keys).schema.fields) + "_ltext string, _rtext string, score double"
    return rows.groupBy(*group).applyInPandas(compare, schema).distinct()


def _text_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, sides: tuple[DataFrame, DataFrame, DataFrame], sizes: DataFrame) -> DataFrame:
    """(keys, _ltext, _rtext, score) above the threshold; ids are the texts."""
    lp, rp, freq = sides
    many = F.col("_nl") * F.col("_nr") > CROWD
    crowds = sizes.where(many)
    few = sizes.where(~many).select(*keys, *TOKEN)
    drop = lambda p: p.join(few, [*keys, *TOKEN], "left_semi")
    overlap = F.size(F.array_intersect("_lchars", "_rchars"))
    scored = (
        _listed(drop(lp), drop(rp), keys, threshold)
        .join(left.withColumn("_lchars", _characters(F.col("_ltext"))), on=[*keys, "_lid"])
        .join(right.withColumn("_rchars", _characters(F.col("_rtext"))), on=[*keys, "_rid"])
        .where(2 * overlap > F.lit(threshold - 1e-12) * (F.length("_ltext") + F.length("_rtext")))
        .withColumn("score", ratio(F.col("_ltext"), F.col("_rtext")))
        .where(F.col("score") > F.lit(threshold))
    ).select(*keys, "_ltext", "_rtext", "score")
    if crowds.isEmpty():
        return scored
    return scored.unionByName(_crowded(left, right, lp, rp, crowds, freq, keys, threshold)).distinct()


def _whole(left: DataFrame, right: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _l, _br) of the keys whose crowded tokens have as many pairs as all their
    strings: these are compared once, whatever tokens they share. Left strings and
    blocks of the right ones."""
    pairs = F.col("_nl") * F.col("_nr")
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    found = join(join(sizes.groupBy(*keys).agg(F.sum(F.when(pairs > CROWD, pairs)).alias("_crowd")), count(left, "_l")), count(right, "_r"))
    return found.where(F.col("_crowd") >= F.col("_l") * F.col("_r")).select(*keys, "_l", F.ceil(F.col("_r") / (BLOCK * WIDE)).cast("int").alias("_br"))


def _nearest(left: np.ndarray, right: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Sums up pairs by their left place: (left place, number of right texts other than
    its own, place of the one with the highest score, the first in order, that score)."""
    texts, first, rank = np.unique(right, return_index=True, return_inverse=True)
    own = np.searchsorted(texts, left)
    own[texts.take(own, mode="clip") != left] = -1

    def summed(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        other = np.flatnonzero(rank.take(j) != own.take(i))
        i, at, score = i.take(other), rank.take(j.take(other)), score.take(other)
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
        if not len(begin):
            return i, i, i, score
        count = np.diff(np.append(begin, len(i)))
        best = np.maximum.reduceat(score, begin)
        place = np.minimum.reduceat(np.where(score == np.repeat(best, count), at, len(right)), begin)
        return i.take(begin), count, first.take(place), best

    return summed


def _compared(left: DataFrame, right: DataFrame, whole: DataFrame, keys: list[str], threshold: float, nearest: bool) -> DataFrame:
    """(keys, _lid, _ltext, _rid, _rtext, score) of the strings of the keys ``whole``:
    all pairs are compared once, a range of the left strings with a block of the right
    ones in each group, and are not dealt out again. With ``nearest`` they are summed up
    there: (keys, _lid, _ltext, others, _rtext, score) as of ``_nearest``, a row for a
    left string and a block, or several."""
    strings, most = whole.agg(F.sum("_l"), F.max("_br")).first()
    ranges = -(-strings // min(max(strings // RANGES, BLOCK // 8), 2 * BLOCK))
    blocks = lambda df: df.join(whole.select(*keys, "_br"), keys) if keys else df.withColumn("_br", F.lit(most))
    lefts = staged(blocks(left).repartitionByRange(ranges, *keys, "_ltext").withColumn(PART, F.spark_partition_id()), "strings")
    rights = blocks(right).withColumn("_block", F.pmod(F.xxhash64("_rtext"), F.col("_br")).cast("int"))
    if keys:
        rights = rights.join(shuffled(lefts.select(*keys, PART).distinct()), keys)
    else:
        rights = rights.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    group = [*keys, PART, "_block"]
    rows = lefts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_br") - 1))).select(*group, "_lid", none(right, "_rid"), "_ltext", none(right, "_rtext"))
    rows = rows.unionByName(rights.select(*group, none(left, "_lid"), "_rid", none(left, "_ltext"), "_rtext"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        one = lambda name, at: rows.column(name).combine_chunks().filter(at)
        is_left = rows.column("_ltext").combine_chunks().is_valid()
        is_right = rows.column("_rtext").combine_chunks().is_valid()
        (lid, ltext), (rid, rtext) = ((one(f"_{side}id", at), one(f"_{side}text", at)) for side, at in (("l", is_left), ("r", is_right)))
        if not len(ltext) or not len(rtext):
            return
        lefts, rights = (x.to_numpy(zero_copy_only=False) for x in (ltext, rtext))
        summed = _nearest(lefts, rights) if nearest else None
        for i, j, score in _close(lefts, None, rights, None, threshold):
            if summed:
                i, n, j, score = summed(i, j, score)
            by, at, same = pa.array(i), pa.array(j), pa.array(np.zeros(len(i), dtype=np.int64))
            found = [pa.array(n.astype(np.int64)) if summed else rid.take(at), rtext.take(at), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks().take(same) for k in keys), lid.take(by), ltext.take(by), *found], names)

    third = StructField("others", LongType()) if nearest else right.schema["_rid"]
    schema = StructType([*(left.schema[k] for k in keys), left.schema["_lid"], left.schema["_ltext"], third, right.schema["_rtext"], StructField("score", DoubleType())])
    names = schema.names
    return rows.repartition(min(most * ranges, MOST_GROUPS), *group).groupBy(*group).applyInArrow(compare, schema)


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    threshold: float,
    left_id: str = "lid",
    left_text: str = "ltext",
    right_id: str = "rid",
    right_text: str = "rtext",
    keys: list[str] | tuple[str, ...] = (),
    nearest: bool = False,
) -> DataFrame:
    """All (left, right) pairs with ``ratio(left_text, right_text) > threshold``
    that agree on every ``keys`` column (e.g. the account of a per-account run).

    Both inputs are distinct-string tables (ids unique within ``keys``); the
    result carries ``keys, left_id, left_text, right_id, right_text, score``.

    With ``nearest`` the pairs of different texts are summed up where they are found,
    for names that mostly resemble each other make a thousand times as many pairs as
    there are names: ``keys, left_id, left_text, others, right_text, score`` are a left
    string's number of such pairs and the first text with the highest score, in one row
    or several, whose ``others`` are to be added up.
    """
    python_workers_ready(left.sparkSession)
    keys = list(keys)
    L = left.select(*keys, F.col(left_id).alias("_lid"), F.col(left_text).alias("_ltext")).where(F.length("_ltext") > 0)
    R = right.select(*keys, F.col(right_id).alias("_rid"), F.col(right_text).alias("_rtext")).where(F.length("_rtext") > 0)
    texts = lambda df, text, side, keys: df.select(*keys, F.col(text).alias(f"_{side}id"), F.col(text)).distinct()
    same = lambda keys: tuple(shuffled(staged(texts(*side, keys), "texts")) for side in ((L, "_ltext", "l"), (R, "_rtext", "r")))
    # few bytes hold many strings: dealt out, for every string has some ten tokens
    dealt = lambda df: df.repartition(n) if (n := -(-df.count() // DEAL)) > 1 else df

    def tokens(keys: list[str]) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
        lt, rt = same(keys)
        sides = _sides(dealt(lt), dealt(rt), keys, threshold, lambda df: shuffled(staged(df, "tokens")))
        return lt, rt, sides, _token_sizes(sides[0], sides[1], keys)

    scored = compared = None
    if keys:
        # the score of two strings is the same under all keys: pairs of distinct
        # strings, where these are no more than a few for each keyed string
        lt, rt, sides, sizes = tokens([])
        listed = sizes.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0
        if listed <= PAIRS_A_ROW * (L.count() + R.count()):
            near = _text_pairs(lt, rt, [], threshold, sides, sizes)
            scored = shuffled(L).join(F.broadcast(near) if listed <= FEW_PAIRS else near, "_ltext").join(shuffled(R), [*keys, "_rtext"])
    if scored is None:
        lt, rt, (lp, rp, freq), sizes = tokens(keys)
        whole = staged(_whole(lt, rt, sizes, keys), "whole")
        if not whole.isEmpty():
            compared = _compared(L, R, whole, keys, threshold, nearest)
            if keys:
                lp, rp, sizes = (df.join(whole.select(*keys), keys, "left_anti") for df in (lp, rp, sizes))
        if compared is None or (keys and not sizes.isEmpty()):
            near = _text_pairs(lt, rt, keys, threshold, (lp, rp, freq), sizes)
            scored = shuffled(L).join(near, [*keys, "_ltext"]).join(shuffled(R), [*keys, "_rtext"])
    if scored is not None and nearest:
        scored = scored.where(F.col("_ltext") != F.col("_rtext")).withColumn("others", F.lit(1).cast("bigint"))
    third = F.col("others") if nearest else F.col("_rid").alias(right_id)
    found = [
        df.select(*keys, F.col("_lid").alias(left_id), F.col("_ltext").alias(left_text), third, F.col("_rtext").alias(right_text), "score")
        for df in (scored, compared) if df is not None
    ]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
