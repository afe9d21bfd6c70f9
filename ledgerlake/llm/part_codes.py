"""Vector codes: the parts of each vector as indexes into learned codebooks.

Components become integers, floor(``scale`` * x); a vector is cut into ``parts``
consecutive parts, and each part position has a codebook of ``entries`` parts.
A codebook starts as the parts of the vectors with the smallest ids; each round
assigns every part to its nearest entry and moves each entry to the floor of the
mean of its parts.  All distances and sums are integers, so results do not
depend on how Spark deals out the work.

Distances come from a trie over the parts in lexicographic order.  The distance
from a prefix of a part to the prefixes of all entries is a vector (one number an
entry) that every part below that node shares; a depth-first walk adds one
dimension's squares a step, and a leaf takes the smallest number and adds the
part, times the rows that hold it, to its entry's sum.  Small subtries are walked
a level at a time in one matrix, so memory is bounded by the depth and
``SUBTRIE`` rows.  Rounds work on distinct parts with their counts (a part that a
third of all rows hold is one leaf), sorted once and written to the shared folder;
a round moves only one row for each entry and task.

Defined results: vectors that are null, hold null or non-finite components or
have another length than most are left out; integers beyond ``BOUND`` either way
are held there, so every sum of squares is exact in 64 bits; a length that the
parts do not divide gives parts that differ by one component; rows that repeat an
id are rows of their own (the smaller vector first); null ids count as largest;
with fewer rows than entries a codebook has as many entries as rows; ties go to
the lower index; a label's sum beyond 64 bits is null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import column, stage
from ledgerlake.llm.vectors import common_length, finite

#: Integers of components stay within this bound.
BOUND = 1 << 26
#: Rows of a subtrie that is walked a level at a time.
SUBTRIE = 256


@dataclass(frozen=True)
class Coding:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: float = 1024.0


# --- the trie ----------------------------------------------------------------

def nearest(parts: np.ndarray, entries: np.ndarray, subtrie: int = SUBTRIE) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` (integers, in lexicographic order) the index of
    the nearest of ``entries`` (ties: the lower) and its squared distance."""
    n, dims = parts.shape
    columns = np.ascontiguousarray(entries.T)
    best, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    differs = np.zeros((n, dims), bool)  # whether a row's prefix differs from the row before
    differs[0] = True
    differs[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)

    def level_by_level(a: int, b: int, depth: int, sums: np.ndarray) -> None:
        held, owner = sums[None, :], np.zeros(b - a, np.int64)
        for d in range(depth, dims):
            new = differs[a:b, d].copy()
            new[0] = True
            firsts = np.flatnonzero(new)
            held = held[owner[firsts]] + np.square(parts[a + firsts, d][:, None] - columns[d])
            owner = np.cumsum(new) - 1
        at = held.argmin(axis=1)
        best[a:b] = at[owner]
        least[a:b] = held[np.arange(len(held)), at][owner]

    nodes = [(0, n, 0, np.zeros(len(entries), np.int64))]  # rows, depth, sums of the prefix
    while nodes:
        a, b, depth, sums = nodes.pop()
        if b - a <= subtrie or depth == dims:
            level_by_level(a, b, depth, sums)
            continue
        starts = a + np.flatnonzero(np.concatenate([[True], differs[a + 1 : b, depth]]))
        ends = np.append(starts[1:], b)
        below, i = [], 0
        while i < len(starts):
            if ends[i] - starts[i] > subtrie:
                step = np.square(parts[starts[i], depth] - columns[depth])
                below.append((starts[i], ends[i], depth + 1, sums + step))
                i += 1
                continue
            j = i  # small children that stand together are walked together
            while j + 1 < len(starts) and ends[j + 1] - starts[i] <= subtrie:
                j += 1
            below.append((starts[i], ends[j], depth, sums))
            i = j + 1
        nodes += reversed(below)
    return best, least


def weighted_sums(parts: np.ndarray, weights: np.ndarray, best: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, weighted sum of parts) of each entry."""
    counts, sums = np.zeros(entries, np.int64), np.zeros((entries, parts.shape[1]), np.int64)
    order = np.argsort(best, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) > 0])) if len(best) else []
    if len(best):
        own = best[order][first]
        counts[own] = np.add.reduceat(weights[order], first)
        sums[own] = np.add.reduceat(parts[order] * weights[order][:, None], first, axis=0)
    return counts, sums


# --- on Spark ----------------------------------------------------------------

def _cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def _integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, held within the bound."""
    held = lambda x: F.greatest(F.least(x * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def distinct_parts(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """``pos``, ``part`` and ``n`` (rows that hold it), in lexicographic order."""
    slices = F.array(*[F.struct(F.lit(i).alias("pos"), F.slice("q", a + 1, b - a).alias("part")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    parts = rows.select(F.explode(slices).alias("p")).groupBy("p.pos", "p.part").agg(F.count("*").alias("n"))
    return stage(parts.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "distinct-parts")


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round of assignment and means."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}  # a codebook's size for each position, whatever the rows
        for frame in frames:
            for pos, own in frame.groupby("pos"):
                values, weights = _stacked(own["part"]), own["n"].to_numpy()
                found = weighted_sums(values, weights, nearest(values, books[pos])[0], len(books[pos]))
                held[pos] = tuple(a + b for a, b in zip(held[pos], found)) if pos in held else found
        for pos, (counts, sums) in held.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"pos": pos, "entry": used, "n": counts[used], "total": list(sums[used])})

    found = parts.mapInPandas(run, "pos int, entry int, n long, total array<long>")
    dims = max(b.shape[1] for b in books)
    total = [F.sum(F.get("total", F.lit(i))).alias(f"d{i}") for i in range(dims)]
    out = [b.copy() for b in books]
    for r in found.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *total).collect():  # one row for each entry
        width = books[r["pos"]].shape[1]
        out[r["pos"]][r["entry"]] = [r[f"d{i}"] // r["n"] for i in range(width)]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, label, code and error; ``books``: the codebooks."""

    rows: DataFrame
    books: list[np.ndarray]


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: Coding = Coding()) -> Codes:
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("v"), column(label_col).alias("label"))
    length = common_length(rows)
    rows = rows.where(finite(F.col("v"), length)).select("vec_id", "label", _integers(F.col("v"), params.scale).alias("q"))
    cuts = _cuts(length, params.parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(params.entries).collect()  # as many rows as a codebook
    whole = np.array([r["q"] for r in first], np.int64).reshape(len(first), length)
    books = [whole[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    if first:
        parts = distinct_parts(rows, cuts)
        for _ in range(params.rounds):
            books = _round(parts, books)
    digits = len(f"{params.entries - 1:x}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q, codes, error = _stacked(frame["q"]), [], np.zeros(len(frame), np.int64)
            for a, b, book in zip(cuts, cuts[1:], books):
                own = q[:, a:b]
                order = np.lexsort(own.T[::-1]) if b > a else np.arange(len(own))
                best, least = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
                best[order], least[order] = nearest(own[order], book)
                codes.append(best)
                error += least
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "error": error,
                                "code": ["".join(f"{x:0{digits}x}" for x in code) for code in zip(*codes)]})

    label = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInPandas(run, f"vec_id long, label {label}, code string, error long")
    return Codes(stage(coded, "vector-codes"), books)


def with_label_error(codes: Codes) -> DataFrame:
    """The coded rows with ``label_error``, the sum over rows of an equal label."""
    sums = codes.rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return codes.rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def oracle_sql(params: Coding = Coding()) -> str:
    def assigned(nth: int) -> str:
        return f"""
a{nth} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(entry, d * 1024 + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.p, e.entry, sum((x.x - e.x) * (x.x - e.x)) AS d
    FROM parts x JOIN e{nth} e ON x.p = e.p AND x.j = e.j GROUP BY x.vec_id, x.p, e.entry)
  GROUP BY vec_id, p)"""

    def moved(nth: int) -> str:
        return f"""
e{nth + 1} AS MATERIALIZED (
  SELECT e.p, e.entry, e.j, coalesce(m.x, e.x) AS x FROM e{nth} e LEFT JOIN (
    SELECT a.p, a.entry, x.j, floor(sum(x.x)::double / count(*))::bigint AS x
    FROM a{nth} a JOIN parts x ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY a.p, a.entry, x.j) m
  ON e.p = m.p AND e.entry = m.entry AND e.j = m.j)"""

    rounds = ",".join(assigned(i) + "," + moved(i) for i in range(params.rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place, len(embedding) // {params.parts} AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (
  SELECT vec_id, place, width, unnest(range(len(embedding))) AS i, floor({params.scale:.0f} * unnest(embedding)::double)::bigint AS x FROM kept),
parts AS MATERIALIZED (SELECT vec_id, place, i // width AS p, i % width AS j, x FROM flat),
e0 AS MATERIALIZED (SELECT p, place AS entry, j, x FROM parts WHERE place < {params.entries}),
{rounds},{assigned(params.rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM a{params.rounds} GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::bigint AS label_error,
  (SELECT sha256(string_agg(x::varchar, ',' ORDER BY p, entry, j)) FROM e{params.rounds}) AS codebooks_sha256
FROM kept k JOIN coded c ON k.vec_id = c.vec_id"""
