"""Removal of byte strings that occur elsewhere, by collection suffix sorting.

Every byte covered by a string of ``SPAN`` bytes that also starts anywhere else
(same document included) is removed.  Whether a window of ``SPAN`` bytes occurs
twice is read from the common prefixes of a sorted collection of suffixes, built
column-wise (:mod:`ledgerlake.llm.collection_bwt`).  One collection of whole
documents would need as many rounds as the longest has bytes, and each round
rewrites the files; so the windows are first dealt to small collections, without
ever parting two equal windows:

1. A window belongs to its anchor, the smallest hash of its ``GRAM``-byte
   strings (the first of equals).  Windows in a row with one anchor make a piece.
   Pieces whose anchor occurs once in the corpus have no repeated window.
2. A piece that occurs twice, byte for byte, is repeated entirely.  Of other
   pieces with an anchor that several have, the windows are classed by the
   anchor's offset; all windows of a class share a core of at least ``SPAN -
   CLASS + 1`` bytes, and the bytes on either side are its flanks.
3. Strings (flank, core as one symbol, flank) with the same core make a
   collection; equal strings are repeated entirely, others go through the
   column-wise construction, at most ``2 * CLASS`` rounds.  A core with very many
   different strings is divided: half of its windows have a longer core to the
   left, the other half to the right, until a window is its own core.

A document's removed starts are thus the windows of its pieces with a repeated
anchor, less those of strings found to occur once, plus those that the
construction finds shared.

Defined results: null texts are empty; texts under ``SPAN`` bytes lose nothing;
a text that occurs twice loses all (if long enough); rows that repeat id and
text get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.collection_bwt import shared_starts
from ledgerlake.llm.common import prepare, stage

SPAN = 200
GRAM = 32
CLASS = 57
#: Window starts handled at once, so a very long text needs no more memory.
CHUNK = 1 << 20
#: Strings of one construction, and different strings of one core beyond which it is divided.
BATCH = 4000
HOT_CORE = 4000

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position, doubling the length."""
    h, n = _BYTE[data], 1
    for multiplier in _MULTIPLIERS:
        h = (h[:-n] ^ (h[:-n] >> np.uint64(29))) * multiplier + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pieces(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor, first start, anchor's offset from it, starts), by chunk."""
    whole = np.frombuffer(data, np.uint8)
    for low in range(0, max(0, len(whole) - SPAN + 1), CHUNK):
        part = whole[low : low + CHUNK + SPAN - 1]
        h = gram_hashes(part)
        # the hash's high bits above the position: the first of the smallest
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, size = SPAN - GRAM + 1, 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        anchor = (key & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        yield h[anchor[first]].view(np.int64), first + low, anchor[first] - first, count


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row_key"))


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [a for data in frame["data"] for a, *_ in pieces(data)]
        anchor, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pd.DataFrame({"anchor": anchor, "n": n})


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        anchors, digests, keys, packed = [], [], [], []
        for data, row_key in zip(frame["data"], frame["row_key"]):
            for anchor, first, offset, count in pieces(data):
                ends = (first + count + SPAN - 1).tolist()
                digests.append(np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends)), np.uint64, len(first)))
                anchors.append(anchor)
                keys.append(np.full(len(first), row_key, np.int64))
                packed.append(first << 16 | offset << 8 | count)
        join = lambda parts: np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        yield pd.DataFrame({"anchor": join(anchors), "digest": join(digests), "row_key": join(keys), "packed": join(packed)})


def _classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of the pieces' classes: core digest, flanks, first start, windows."""
    for frame in frames:
        rows = []
        for data, row_key, reps in zip(frame["data"], frame["row_key"], frame["reps"]):
            for rep in reps:
                packed, once = rep["packed"], rep["once"]
                first, offset, count = packed >> 16, (packed >> 8) & 255, packed & 255
                anchor, last = first + offset, first + count - 1
                for low in range(0, SPAN - GRAM + 1, CLASS):
                    high = min(low + CLASS - 1, SPAN - GRAM)
                    start, core, core_end = max(first, anchor - high), anchor - low, anchor - high + SPAN
                    end = min(last, core)
                    if start <= end:
                        rows.append((xxhash.xxh3_128_digest(data[core:core_end]), data[start:core], data[core_end : end + SPAN],
                                     core_end - core, row_key, start, end - start + 1, once))
        yield _strings(rows)


_STRING_SCHEMA = "core binary, left binary, right binary, core_size int, row_key long, start long, windows int, once boolean"


def _strings(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["core", "left", "right", "core_size", "row_key", "start", "windows", "once"])


def _halves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Divide strings: windows nearer to the core take bytes of its right flank
    into their core, the others bytes of the left one."""
    for frame in frames:
        rows = []
        for core, left, right, size, row_key, start, windows, once in frame[["core", "left", "right", "core_size", "row_key", "start", "windows", "once"]].itertuples(index=False):
            width = SPAN - size + 1  # offsets of a window's start from the core's
            half = (width + 1) // 2
            far, near = len(left), len(left) - windows + 1  # of the first and the last window
            if near < half:
                keep = min(far, half - 1)
                rows.append((xxhash.xxh3_128_digest(b">" + core + right[: width - half]), left[len(left) - keep :], right[width - half :],
                             size + width - half, row_key, start + far - keep, keep - near + 1, once))
            if far >= half:
                last = max(near, half)
                rows.append((xxhash.xxh3_128_digest(b"<" + core + left[len(left) - half :]), left[: len(left) - half], right[: SPAN - size - last],
                             size + half, row_key, start, far - last + 1, once))
        yield _strings(rows)


def _construct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs the construction on whole cores, sorted by core, batch by batch."""
    held: list[tuple] = []
    for frame in frames:
        for row in frame[["core", "left", "right", "core_size", "row_key", "start", "windows", "once"]].itertuples(index=False):
            if len(held) >= BATCH and held[-1][0] != row[0]:
                yield _shared(held)
                held = []
            held.append(tuple(row))
    if held:
        yield _shared(held)


def _shared(rows: list[tuple]) -> pd.DataFrame:
    names: dict[bytes, int] = {}
    weights, strings = [1] * 256, []
    for core, left, right, size, *_ in rows:
        if core not in names:
            names[core] = 256 + len(names)
            weights.append(size)
        strings.append(np.concatenate([np.frombuffer(left, np.uint8), [names[core]], np.frombuffer(right, np.uint8)]).astype(np.uint16))
    flags = shared_starts(strings, np.array(weights), SPAN)
    out = []
    for (_, _, _, _, row_key, start, windows, once), shared in zip(rows, flags):
        if once:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], shared[:windows], [0]])))
            out += [(row_key, (start + int(a)) << 16 | int(b - a)) for a, b in zip(edge[::2], edge[1::2])]
    return pd.DataFrame(out, columns=["row_key", "packed"])


def _result(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, data, marks in zip(frame["doc_id"], frame["data"], frame["marks"]):
            kept, removed, spans = hashlib.sha256(), 0, 0
            at = 0
            for a, b in removed_spans(len(data), marks):
                kept.update(data[at:a])
                removed, spans, at = removed + b - a, spans + 1, b
            kept.update(data[at:])
            out.append((doc_id, len(data), removed, spans, kept.hexdigest()))
        result = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        result["doc_id"] = frame["doc_id"].reset_index(drop=True)
        yield result


def removed_spans(size: int, marks) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes from marks (start, windows, +1 or -1)."""
    if marks is None or not len(marks):
        return []
    starts = np.array([m["packed"] >> 16 for m in marks])
    counts = np.array([m["packed"] & 0xFFFF for m in marks])
    signs = np.array([m["sign"] for m in marks])
    level = np.zeros(size + 1, np.int32)
    np.add.at(level, starts, signs)
    np.add.at(level, starts + counts, -signs)
    repeated = np.cumsum(level[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated, [0]])))
    spans: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + SPAN - 1).tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``
    (of the remaining bytes, in order) of every row."""
    prepare(docs.sparkSession)
    rows = _documents(docs, id_col, text_col)
    return rows.join(row_marks(rows), "row_key", "left").select("doc_id", "data", "marks").mapInPandas(
        _result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def row_marks(rows: DataFrame) -> DataFrame:
    """``row_key`` and its ``marks``.  Rows that repeat id and text make the same
    marks; as sets, these are one document's however often it is repeated."""
    return repeated_windows(rows).groupBy("row_key").agg(F.collect_set(F.struct("packed", "sign", "of")).alias("marks"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``row_key``, ``packed`` (start << 16 | windows), ``sign`` and ``of`` (the
    step that made the mark, so equal marks of two steps both count): a window is
    repeated where the signs over it add up to more than zero."""
    data = rows.select("data", "row_key")
    anchors = rows.select("data").mapInPandas(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = stage(anchors.where("n > 1").select("anchor"), "anchors")
    found = data.mapInPandas(_pieces, "anchor long, digest long, row_key long, packed long")
    found = stage(found.join(repeated, "anchor", "left_semi"), "pieces")

    # pieces by content: how often each occurs, and where the first one stands
    distinct = stage(found.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "packed")).alias("own")), "distinct-pieces")
    open_anchors = distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("anchor")
    reps = distinct.join(open_anchors, "anchor", "left_semi")
    reps = reps.groupBy(F.col("own.row_key").alias("row_key")).agg(
        F.collect_list(F.struct(F.col("own.packed").alias("packed"), (F.col("n") == 1).alias("once"))).alias("reps"))
    strings = data.join(reps, "row_key").mapInPandas(_classes, _STRING_SCHEMA)

    single, shared = None, None
    while True:
        # equal strings occur twice; a string of a piece that does, too
        own = F.min(F.struct("row_key", "start", "windows")).alias("own")
        strings = stage(strings.groupBy("core", "left", "right", "core_size").agg(F.count("*").alias("n"), F.min("once").alias("once"), own)
                        .select("core", "left", "right", "core_size", "own.*", ((F.col("n") == 1) & F.col("once")).alias("once")), "strings")
        cores = strings.groupBy("core").agg(F.count("*").alias("m"), F.max("once").alias("open")).where("m > 1 and open")
        cores = stage(cores.withColumn("hot", F.col("m") > HOT_CORE).select("core", "hot"), "cores")
        several = strings.join(cores, "core")
        hot = cores.where("hot")
        divided = not hot.isEmpty()
        calm = strings.join(hot, "core", "left_anti") if divided else strings
        alone = calm.where("once").select("row_key", "start", "windows")
        single = alone if single is None else single.unionByName(alone)
        batch = several.where("not hot").drop("hot").repartition("core").sortWithinPartitions("core")
        part = batch.mapInPandas(_construct, "row_key long, packed long")
        shared = part if shared is None else shared.unionByName(part)
        if not divided:
            break
        strings = several.where("hot").drop("hot").mapInPandas(_halves, _STRING_SCHEMA)

    mark = lambda df, packed, sign, of: df.select("row_key", packed.alias("packed"), F.lit(sign).alias("sign"), F.lit(of).alias("of"))
    start = F.shiftright("packed", 16)
    marks = mark(found, F.shiftleft(start, 16).bitwiseOR(F.col("packed").bitwiseAND(F.lit(255))), 1, 0)
    marks = marks.unionByName(mark(single, F.shiftleft("start", 16).bitwiseOR(F.col("windows").cast("long")), -1, 1))
    return marks.unionByName(mark(shared, F.col("packed"), 1, 2))


def oracle_sql() -> str:
    """Query ``op9_suffix_dedup`` over table ``documents`` as DuckDB SQL, by the
    definition: every window of every text is compared with every other."""
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
                             hex(encode(coalesce(text, ''))) AS digits FROM documents),
        windows AS (SELECT n, p, md5(substr(digits, 2 * p + 1, {2 * SPAN})) AS content
                    FROM (SELECT n, digits, unnest(range(n_bytes - {SPAN - 1})) AS p FROM docs)),
        repeated AS (SELECT n, p FROM (SELECT n, p, count(*) OVER (PARTITION BY content) AS times FROM windows) WHERE times > 1),
        opened AS (SELECT n, p, coalesce(p - lag(p) OVER (PARTITION BY n ORDER BY p) > {SPAN}, true) AS opens FROM repeated),
        numbered AS (SELECT n, p, sum(opens::INT) OVER (PARTITION BY n ORDER BY p) AS span FROM opened),
        spans AS (SELECT n, min(p) AS a, max(p) + {SPAN} AS b FROM numbered GROUP BY n, span),
        between_spans AS (SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS since FROM spans),
        parts AS (SELECT n, string_agg(substr(digits, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept, sum(b - a)::BIGINT AS n_removed,
                         count(*) AS n_spans, max(b) AS last FROM between_spans JOIN docs USING (n) GROUP BY n)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM docs LEFT JOIN parts USING (n)"""
