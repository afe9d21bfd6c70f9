"""SimHash near-duplicates through an index of deletion variants.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it.  Two fingerprints at most ``max_bits`` apart, cut into
``(max_bits + 1) // 2`` segments, differ by one bit at most in some segment.
So each segment is indexed under its variants with one bit replaced by a
wildcard; an equality join on (segment, wildcard, rest) brings every such pair
together, and the whole fingerprints are compared.

Work is done on distinct fingerprints, so exact copies cost one row.  Within a
key's rows only the edges of a spanning forest are kept, never all pairs, and a
key with very many fingerprints is divided by the bytes outside its segment
(of which one at least is equal in a linked pair).

Defined results: null and empty texts have the fingerprint zero and are linked
like any other, texts of any length are read whole; every input row gives one
output row; other columns are ignored or carried, whatever their names; rows with
a null id take part, and a component has the smallest non-null id (null if there is none); an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import column, prepare, stage, text_rows, texts
from ledgerlake.llm.components import connected_components

SEED = 42
#: A key's fingerprints beyond this number are divided further.
HOT_SEGMENT = 4096


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words, ASCII letters in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each of the consecutive groups of ``hashes``."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    # eight one-byte counters in a word count up to 255 rows at once
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    blocks = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    first = np.cumsum(blocks) - blocks
    cuts = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).astype(np.int64)
    sums = np.add.reduceat(sums, first, axis=0)
    bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``row_key`` (a hash of id and text) and ``fp`` of every row."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, lines in text_rows(frames):
            fps, at = [], 0
            while at < len(lines):
                hashes, counts = [], []
                while at < len(lines) and len(hashes) < 200_000:
                    found = shingle_hashes(lines[at], shingle)
                    hashes += found
                    counts.append(len(found))
                    at += 1
                fps.append(majority_bits(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "row_key": frame["row_key"],
                                "fp": np.concatenate(fps or [np.zeros(0, np.uint64)]).view(np.int64)})

    return rows.mapInPandas(run, "doc_id long, row_key long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max(1, (max_bits + 1) // 2)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``slot`` (a wildcard bit, 0 to 63) and ``rest`` (the segment
    without it): 64 rows for each fingerprint."""
    rows = []
    for start, bits in _segments(max_bits):
        mask = (1 << bits) - 1
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit(mask if bits < 64 else -1))
        slots = F.array([F.struct(F.lit(start + i).alias("slot"), value.bitwiseAND(F.lit(_signed(mask & ~(1 << i)))).alias("rest")) for i in range(bits)])
        rows.append(slots)
    return prints.select("fp", F.explode(F.concat(*rows)).alias("v")).select("fp", "v.slot", "v.rest")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``a`` and ``b``: edges between distinct fingerprints (column ``fp``) at
    most ``max_bits`` apart, enough to keep every such pair connected."""
    index = variants(prints, max_bits)
    extra = F.lit(-1)
    hot = _hot_keys(prints, max_bits)
    if hot is not None:
        marked = index.join(hot, ["slot", "rest"], "left")
        segments = _segments(max_bits)
        outside = F.array([F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("v")) for i in range(8)])
        of = F.element_at(F.array([F.lit(next(s for s, b in segments if s <= slot < s + b)) for slot in range(64)]), F.col("slot") + 1)
        width = F.element_at(F.array([F.lit(next(b for s, b in segments if s <= slot < s + b)) for slot in range(64)]), F.col("slot") + 1)
        # bytes that lie outside the segment; more of them than bits may differ, so one is equal
        beyond = F.filter(outside, lambda x: (x["i"] * 8 + 8 <= of) | (x["i"] * 8 >= of + width))
        parts = F.when(F.col("hot") & (F.size(beyond) > max_bits), F.transform(beyond, lambda x: (x["i"] * 256 + x["v"]).cast("int"))).otherwise(F.array(F.lit(-1)))
        index = marked.select("fp", "slot", "rest", F.explode(parts).alias("part"))
    else:
        index = index.withColumn("part", extra.cast("int"))
    index = index.repartition("slot", "rest", "part").sortWithinPartitions("slot", "rest", "part", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) < 20_000:
                continue
            key = held[["slot", "rest", "part"]].to_numpy()
            same = (key[:-1] == key[-1]).all(axis=1)
            cut = len(held) - 1 - int(same[::-1].argmin()) if not same.all() else 0
            if cut:  # the last key may go on in the next batch
                yield _edges(held.iloc[:cut], max_bits)
                held = held.iloc[cut:]
        if held is not None:
            yield _edges(held, max_bits)

    return index.mapInPandas(run, "a long, b long").distinct()


def _hot_keys(prints: DataFrame, max_bits: int) -> DataFrame | None:
    """Keys (slot, rest) of the segments that very many fingerprints share."""
    found = None
    for start, bits in _segments(max_bits):
        mask = (1 << bits) - 1
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit(mask if bits < 64 else -1))
        some = prints.groupBy(value.alias("value")).count().where(F.col("count") > HOT_SEGMENT // 2)
        slots = F.array([F.struct(F.lit(start + i).alias("slot"), F.col("value").bitwiseAND(F.lit(_signed(mask & ~(1 << i)))).alias("rest")) for i in range(bits)])
        some = some.select(F.explode(slots).alias("v")).select("v.slot", "v.rest")
        found = some if found is None else found.unionByName(some)
    found = stage(found.distinct().withColumn("hot", F.lit(True)), "hot-keys")
    return None if found.isEmpty() else found


def _edges(rows: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Spanning-forest edges within each key of rows sorted by key."""
    key = rows[["slot", "rest", "part"]].to_numpy()
    fps = rows["fp"].to_numpy().view(np.uint64)
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))
    left, right = [], []
    pairs = starts[ends - starts == 2]
    if len(pairs):
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= max_bits
        left.append(fps[pairs[near]])
        right.append(fps[pairs[near] + 1])
    first_slot = {s for s, _ in _segments(max_bits)}
    for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        slot = int(key[a, 0])
        found = _forest(fps[a:b], max_bits, None if slot in first_slot else slot)
        if found:
            left.append(np.array([f[0] for f in found], np.uint64))
            right.append(np.array([f[1] for f in found], np.uint64))
    pick = lambda parts: np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"a": pick(left), "b": pick(right)})


def _forest(fps: np.ndarray, max_bits: int, slot: int | None) -> list[tuple]:
    """Breadth-first search over fingerprints; with ``slot``, only pairs that
    differ in this bit are compared, as pairs with equal segments meet under
    the segment's first slot."""
    side = (fps >> np.uint64(slot or 0)) & np.uint64(1)
    if slot is not None and (not side.any() or side.all()):
        return []
    out, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
            if slot is not None:
                near &= side[rest] != side[at]
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                out.extend((fps[at], fps[i]) for i in reached)
                front.extend(reached)
    return out


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp``, ``component_id`` (smallest id reachable)
    and ``kept_key`` (``row_key`` of the row that stands for the component)."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # the row that stands for a class: the smallest id, null last, then a hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    classes = stage(prints.groupBy("fp").agg(first.alias("first")), "classes")
    roots = connected_components(links(classes.select("fp"), max_bits))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    of = joined.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("kept_key"))
    return prints.join(of, "fp").select("doc_id", "row_key", "fp", "component_id", "kept_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the one with the
    smallest id.  Of rows that repeat its id and text, the first by the other
    columns stays.  Columns may have any name: a row travels as one struct."""
    found = components(docs, id_col, text_col, shingle, max_bits)
    kept = found.where(F.col("row_key") == F.col("kept_key")).select(F.col("doc_id").alias("kept_id"), "kept_key")
    whole = F.struct(*[column(c) for c in docs.columns]).alias("row")
    rest = F.array(F.lit(""), *[column(c).cast("string") for c in docs.columns if c != text_col]).alias("rest")
    keyed = docs.select(whole, rest, _row_key(id_col, text_col).alias("row_key"), column(id_col).cast("long").alias("row_id"))
    stay = keyed.join(kept, (F.col("row_key") == F.col("kept_key")) & F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # repeated rows meet their like before the shuffle: only the first of each key is kept
    first = stay.groupBy("row_key", "row_id").agg(F.min_by("row", "rest").alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(column(id_col).cast("long"), column(text_col).cast("string"))
