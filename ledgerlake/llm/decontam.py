"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Every run of ``seed`` words of a test item is a possible seed, and so are as many
words with one left out between them, which survive a copy that replaces every
third word.  A first pass
over the corpus counts in how many documents each occurs; an item keeps its
rarest runs (by rank, so an item whose text is all over the corpus keeps seeds
too).  A second pass joins the documents to the items on the seeds and aligns
each item with the words around its seeds (Smith-Waterman, word by word).  The
alignment's score, as a share of the score of an unchanged copy, tells copies
and edited copies from texts that merely share a phrase; a long passage that is
nearly unchanged counts whatever share of the item it is.

The test items go to the tasks in blocks of a bounded number of words
(``Matching.block_words``), each against all documents; a larger benchmark means
more blocks, not larger ones.

Defined results: null and empty texts match nothing; null items and items with
fewer words than a seed are never matched; repeated documents each match; items
of the same text each match; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare, texts

_WORD = re.compile(r"[^\W_]+")
_SCORE_BITS = 32
#: Unknown words between two texts: no run leaves out more than one word.
_BETWEEN = 2
#: Bytes of the texts that are cut into words at a time (one text at least).
_PORTION_BYTES = 2 << 20


@dataclass(frozen=True)
class Matching:
    """``seed``: words of a seed; ``keep``: share of an item's runs kept as
    seeds, and ``least`` their least number.  ``match``, ``mismatch``, ``gap``:
    alignment scores.  ``threshold``: least share of a full copy's score, and
    ``cover``: least length of the aligned words as a share of the item's; a
    phrase that text and item share reaches neither, a copy with a third of its
    words replaced both.  ``passage``: score, in matched words, from which an
    alignment counts whatever its cover, if it reaches the share ``alike`` of the
    score of its own words unchanged."""

    seed: int = 3
    keep: float = 0.75
    least: int = 8
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.4
    cover: float = 0.6
    passage: int = 13
    alike: float = 0.7
    block_words: int = 200_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Block:
    """Items as numbers of their words, and where each possible seed stands."""

    size: int
    ids: list[int | None] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    codes: np.ndarray | None = None

    def add(self, item_id: int | None, item: list[str]) -> None:
        for w in item:
            self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids.append(item_id)
        self.items.append(np.array([self.vocabulary[w] for w in item], np.int64))

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the possible seeds: runs of words, and runs with
        one word left out, none of them unknown."""
        places, codes = [], []
        known, parts = numbers > 0, numbers.astype(np.uint64)
        for left_out in range(self.size):
            # 0: none left out
            offsets = [i + (0 < left_out <= i) for i in range(self.size)]
            n = len(numbers) - offsets[-1]
            if n <= 0:
                continue
            at = np.flatnonzero(np.logical_and.reduce([known[i : i + n] for i in offsets]))
            code = np.full(len(at), left_out, np.uint64)
            for i in offsets:
                code *= np.uint64(0x9E3779B97F4A7C15)
                code += parts[at + i]
            places.append(at)
            codes.append((code >> np.uint64(1)).astype(np.int64))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(codes)

    def close(self) -> Block:
        for i, item in enumerate(self.items):
            for at, code in zip(*(x.tolist() for x in self.runs(item))):
                self.places[code].append((i, at))
        self._index()
        return self

    def _index(self) -> None:
        """``codes``, sorted, and a table that most other codes have no mark in."""
        self.codes = np.array(sorted(self.places), np.int64)
        self.shift = np.uint64(64 - (16 * len(self.codes) + 1).bit_length())
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        self.marks[self._mark(self.codes)] = True

    def _mark(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def numbers(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts one after the other (0: in no item),
        ``_BETWEEN`` zeros after each text, and where each text begins.

        Texts are cut at spaces first, as the parts repeat: a space ends a word,
        and no character's lower case depends on what lies beyond one."""
        cut = pc.split_pattern(lines, " ")
        offsets, parts = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        low = " ".join(parts.dictionary.to_numpy(zero_copy_only=False).tolist()).lower().split(" ")
        number = np.fromiter(map(self.vocabulary.get, low, repeat(-1)), np.int64, len(low))
        # all others but single words are cut by the pattern
        mixed = [i for i in np.flatnonzero(number < 0).tolist() if not low[i].isalnum()]
        found = [_WORD.findall(low[i]) for i in mixed]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter(map(self.vocabulary.get, chain.from_iterable(found), repeat(0)), np.int64, int(sizes.sum()))
        values = np.concatenate([np.maximum(number, 0), more, np.zeros(_BETWEEN, np.int64)])
        starts, lengths = np.arange(len(low) + 1), np.ones(len(low) + 1, np.int64)
        starts[mixed], lengths[mixed] = len(low) + np.cumsum(sizes) - sizes, sizes
        starts[-1], lengths[-1] = len(values) - _BETWEEN, _BETWEEN
        at = np.insert(parts.indices.to_numpy().astype(np.int64), offsets[1:] - offsets[0], len(low))
        size = lengths[at]
        ends = np.cumsum(size)
        numbers = values[np.repeat(starts[at] - (ends - size), size) + np.arange(ends[-1])]
        return numbers, np.concatenate([[0], ends[offsets[1:] - offsets[0] + np.arange(len(lines))]])

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words whose run is a code, and the codes' places in ``codes``."""
        at, runs = self.runs(numbers)
        maybe = np.flatnonzero(self.marks[self._mark(runs)])
        at, runs = at[maybe], runs[maybe]
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        slot = np.searchsorted(self.codes, runs).clip(max=len(self.codes) - 1)
        same = self.codes[slot] == runs
        return at[same], slot[same]

    def keep_rarest(self, frequency: dict[int, int], params: Matching) -> None:
        kept: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            places, runs = (x.tolist() for x in self.runs(item))
            # by order of magnitude, then scattered over the item, so that edits
            # in one place leave seeds elsewhere; a run that no document has is no seed
            order = sorted((at for at, run in enumerate(runs) if frequency.get(run)), key=lambda at: (frequency[runs[at]].bit_length(), at * 0x9E3779B1 % 2**32))
            for at in order[: max(params.least, round(params.keep * len(runs)))]:
                kept[runs[at]].append((i, places[at]))
        self.places = kept
        self._index()


def blocks(benchmark: DataFrame, params: Matching, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    block, held = Block(params.seed), 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in rows.orderBy("id", "text").toLocalIterator():
        item = words(row["text"] or "")
        if len(item) < params.seed:
            continue
        if held and held + len(item) > params.block_words:
            yield block.close()
            block, held = Block(params.seed), 0
        block.add(row["id"], item)
        held += len(item)
    if held:
        yield block.close()


def align(item: np.ndarray, text: np.ndarray, params: Matching) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) in words of ``text``.

    Cells hold the score above ``_SCORE_BITS`` bits of the alignment's start, so
    the start travels with the maximum; a gap along the text is a running
    maximum after its cost is taken out."""
    unit = 1 << _SCORE_BITS
    column = np.arange(1, len(text) + 1, dtype=np.int64)
    ramp = column * (-params.gap * unit)
    above = np.concatenate([[0], column])  # row zero: score 0, starting at the next word
    below, other, same = above.copy(), np.empty_like(column), np.empty(len(text), bool)
    best, where = 0, (0, 0)
    for word in item.tolist() if len(text) else ():
        cell = below[1:]
        np.equal(text, word, out=same)
        np.multiply(same, (params.match - params.mismatch) * unit, out=cell)
        cell += above[:-1]
        cell += params.mismatch * unit
        np.add(above[1:], params.gap * unit, out=other)
        np.maximum(cell, other, out=cell)
        np.maximum(cell, column, out=cell)
        cell += ramp
        np.maximum.accumulate(cell, out=cell)
        cell -= ramp
        top = int(cell.max()) >> _SCORE_BITS
        if top > best:
            end = int((cell >= top * unit).argmax())
            best, where = top, (int(cell[end] & (unit - 1)), end + 1)
        np.copyto(cell, column, where=np.less(cell, unit, out=same))
        above, below = below, above
    return best, *where


def accepted(item: np.ndarray, text: np.ndarray, params: Matching) -> tuple[int, int, int] | None:
    """The best alignment that counts as a copy: (score, start, end) or None.

    The best of all may be too short for its item, so what lies before and after
    it is tried too, as long as its score leaves room for another."""
    copy = params.threshold * params.match * len(item)
    passage = params.passage * params.match
    found, parts = None, [(0, len(text))]
    of_item, m = np.unique(item, return_counts=True)
    while parts:
        a, b = parts.pop()
        least = min(copy, passage) if found is None else max(min(copy, passage), found[0] + 1)
        # words in common, however ordered, bound the score
        slot = np.searchsorted(of_item, text[a:b]).clip(max=len(of_item) - 1)
        n = np.bincount(slot[of_item[slot] == text[a:b]], minlength=len(of_item))
        if params.match * int(np.minimum(n, m).sum()) < least:
            continue
        score, first, last = align(item, text[a:b], params)
        if score < least:
            continue
        size = last - first
        if (score >= copy and size >= params.cover * len(item)) or (score >= passage and score >= params.alike * params.match * size):
            found = score, a + first, a + last
        else:
            parts += [(a, a + first), (a + last, b)]
    return found


def portions(lines: pa.Array, size: int = _PORTION_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The texts (null: empty) in runs of ``size`` bytes or one text, with the place of each run's first."""
    lines = pc.fill_null(lines, "")
    at, ends = 0, np.cumsum(pc.binary_length(lines).to_numpy(), dtype=np.int64)
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, lines.slice(at, to - at)
        at = to


def matched(block: Block, lines: pa.Array, params: Matching) -> Iterator[tuple[int, int, float, int, int]]:
    """(text's place, item's place, share of a full score, start, end) of the best
    alignment of each text and item that counts as a copy."""
    for first, portion in portions(lines):
        numbers, begins = block.numbers(portion)
        positions, slots = block.hits(numbers)
        of = np.searchsorted(begins, positions, "right") - 1
        order = np.argsort(of, kind="stable")
        some, at = np.unique(of[order], return_index=True)
        for text, hits in zip(some.tolist(), np.split(order, at[1:])):
            a, b = begins[text], begins[text + 1] - _BETWEEN
            for found in _aligned(block, numbers[a:b], positions[hits] - a, block.codes[slots[hits]], params):
                yield first + text, *found


def _aligned(block: Block, numbers: np.ndarray, positions: np.ndarray, codes: np.ndarray, params: Matching) -> list[tuple[int, float, int, int]]:
    lines: dict[int, list[int]] = defaultdict(list)
    for position, code in zip(positions.tolist(), codes.tolist()):
        for i, at in block.places[code]:
            lines[i].append(position - at)
    out = []
    for i, starts in lines.items():
        item = block.items[i]
        slack = len(item) // 2 + 2
        best, a, b, out_of = None, None, None, params.match * len(item)
        for start in [*sorted(set(starts)), None]:
            if a is not None and (start is None or start - slack > b):
                one = accepted(item, numbers[a:b], params)
                if one is not None and (best is None or one[0] > best[0]):
                    best = one[0], a + one[1], a + one[2]
                a = None
            if start is not None:
                a = max(0, start - slack) if a is None else a
                b = min(len(numbers), start + len(item) + slack)
        if best is not None:
            out.append((i, best[0] / out_of, best[1], best[2]))
    return out


def _with_seeds(docs: DataFrame, benchmark: DataFrame, params: Matching, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark's blocks with the rarest runs of each item as seeds."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("text")
    for block in blocks(benchmark, params):

        def count(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(block.codes), np.int64)
            for batch in batches:
                for _, portion in portions(batch.column("text")):
                    numbers, begins = block.numbers(portion)
                    positions, slots = block.hits(numbers)
                    of = np.searchsorted(begins, positions, "right") - 1
                    # once a text
                    total += np.bincount(np.unique(of * len(total) + slots) % len(total), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(block.codes[some]), pa.array(total[some])], names=["code", "n"])

        counts = rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        # one row for each distinct run of the block, so bounded like the block
        block.keep_rarest({r["code"]: r["n"] for r in counts.collect()}, params)
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Matching = Matching(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (share of a full copy's) and the words
    ``start`` to ``end`` (exclusive) of the document's best alignment, for each
    pair with an alignment that counts as a copy."""
    found = None
    for block in _with_seeds(docs, benchmark, params, id_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(matched(block, batch.column("text"), params))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64())),
                    pa.array([block.ids[o[1]] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.float64()),
                    pa.array([o[3] for o in out], pa.int64()),
                    pa.array([o[4] for o in out], pa.int64()),
                ], names=["doc_id", "item_id", "score", "start", "end"])

        part = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, score double, start long, end long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: Matching = Matching(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that match no test item."""
    kept = docs
    for block in _with_seeds(docs, benchmark, params, id_col, text_col):
        kept = kept.where(_clean(block, params)(F.col(text_col).cast("string")))
    return kept


def _clean(block: Block, params: Matching):
    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        kept = np.ones(len(column), bool)
        kept[[n for n, *_ in matched(block, pa.array(column, pa.string(), from_pandas=True), params)]] = False
        return pd.Series(kept)

    return clean
