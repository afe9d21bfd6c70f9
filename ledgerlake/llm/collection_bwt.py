"""Burrows-Wheeler transform and common prefixes of a collection of strings,
built column by column.

Round ``j`` inserts, for every string, the suffix that is one symbol longer than
the one inserted in the round before.  Its place follows from counting the
transform's symbols, its common prefix with the neighbours from the smallest
common prefix between them one round earlier.  Transform and common prefixes are
kept in two external files each, read and written from one end to the other in
each round.

A symbol has a weight, its length in bytes, so a stretch that strings share can
stand as one symbol.  Common prefixes are counted in bytes, up to ``CEILING``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CEILING = 250
#: Marks a string's start in the transform; sorts after all symbols.
END = np.uint16(0xFFFF)


class Column:
    """A sequential external file and its successor."""

    def __init__(self, folder: str, name: str, dtype: type, values: np.ndarray):
        self.paths, self.dtype = [os.path.join(folder, f"{name}.{i}") for i in (0, 1)], dtype
        self.write(values)

    def read(self) -> np.ndarray:
        return np.fromfile(self.paths[0], self.dtype)

    def write(self, values: np.ndarray) -> None:
        values.astype(self.dtype, copy=False).tofile(self.paths[1])
        self.paths.reverse()


def _range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest of ``values[first..last]`` (inclusive, none empty)."""
    length = last - first + 1
    level = np.zeros(len(length), np.int64)
    out = np.empty(len(length), values.dtype)
    if not len(length):
        return out
    level = np.frexp(length)[1] - 1
    table, size = values, 1
    for n in range(int(level.max()) + 1):
        some = np.flatnonzero(level == n)
        out[some] = np.minimum(table[first[some]], table[last[some] - size + 1])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def shared_starts(strings: list[np.ndarray], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string, a boolean for each of its positions: do the ``length`` bytes
    from there also begin another suffix of the collection?

    ``strings`` hold symbols below ``END``, ``weights`` their bytes by symbol."""
    sizes = np.array([len(s) for s in strings])
    many, width = len(strings), int(sizes.max())
    columns = np.full((width + 1, many), END, np.uint16)  # symbols counted from the strings' ends
    for i, s in enumerate(strings):
        columns[: len(s), i] = s[::-1]
    place = np.arange(many)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        bwt_file = Column(folder, "bwt", np.uint16, columns[0])
        lcp_file = Column(folder, "lcp", np.uint8, np.zeros(many))
        for j in range(width):
            bwt, lcp = bwt_file.read(), lcp_file.read()
            order = np.argsort(bwt, kind="stable")
            extended = len(bwt) - int((bwt == END).sum())
            rank = np.empty(len(bwt), np.int64)
            rank[order] = np.arange(len(bwt))
            active = np.flatnonzero(j < sizes)
            active = active[np.argsort(rank[place[active]])]
            at = place[active]
            r = rank[at]
            symbol = bwt[at]
            before = order[np.maximum(r - 1, 0)]
            has_before = (r > 0) & (bwt[before] == symbol)
            after = order[np.minimum(r + 1, extended - 1)]
            has_after = (r + 1 < extended) & (bwt[after] == symbol)
            weight = weights[symbol].astype(np.int64)
            with_before = np.zeros(len(at), np.int64)
            with_before[has_before] = weight[has_before] + _range_minimum(lcp, before[has_before] + 1, at[has_before])
            with_after = weight[has_after] + _range_minimum(lcp, at[has_after] + 1, after[has_after])
            new = many + r
            old = np.ones(many + extended, bool)
            old[new] = False
            bwt2, lcp2 = np.empty(len(old), np.uint16), np.empty(len(old), np.uint8)
            bwt2[old], bwt2[new] = bwt, columns[j + 1, active]
            lcp2[old], lcp2[new] = lcp, np.minimum(with_before, CEILING)
            lcp2[new[has_after] + 1] = np.minimum(with_after, CEILING)
            bwt_file.write(bwt2)
            lcp_file.write(lcp2)
            place[active] = new
        bwt, lcp = bwt_file.read(), lcp_file.read()
    # walk all strings from their ends, one symbol a step
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = many + np.arange(len(bwt))
    shared = np.maximum(lcp, np.append(lcp[1:], 0)) >= length
    found = [np.zeros(n, bool) for n in sizes]
    at, active = np.arange(many), np.arange(many)
    flags = np.zeros((width, many), bool)
    for j in range(width):
        active = active[j < sizes[active]]
        at[active] = step[at[active]]
        flags[j, active] = shared[at[active]]
    for i, n in enumerate(sizes):
        found[i] = flags[:n, i][::-1]
    return found
