"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs
and a fast Hadamard transform) and hashed to the signed axis nearest to it.  A
table concatenates ``hashes`` rotations; each of ``tables`` tables deals all
vectors to buckets.  A query probes, in each table, the ``probes`` buckets whose
axes lie nearest to it, and the vectors found there are ranked by exact cosine
in double precision.

Vectors and probing queries meet in blocks of a bucket: a bucket that holds many
vectors or is probed by many queries is split on both sides, so no task's group
exceeds ``block`` rows a side.  A block returns its best few for each query, not
the pairs.  Queries that found fewer than asked are then compared with all.

Defined results: vectors that are null, zero, of another length than most
vectors (ties: the longer), or hold null or non-finite components take no part,
as candidate or as query; rows without an id take no part; rows that repeat an
id count once, with their best score, and are no candidates of that id's query;
equal scores go to the smaller id; with no valid vector there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import stage


@dataclass(frozen=True)
class Hashing:
    """More ``hashes`` make finer buckets, for larger collections."""

    tables: int = 16
    probes: int = 6
    hashes: int = 1
    seed: int = 5
    block: int = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the rows."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, nth: int, seed: int) -> np.ndarray:
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table, nth]).choice([-1.0, 1.0], (3, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def _axes(x: np.ndarray) -> np.ndarray:
    """Nearness of each signed axis: axis i at 2i, its opposite at 2i + 1."""
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def buckets(x: np.ndarray, table: int, p: Hashing) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for nth in range(p.hashes):
        axes = _axes(rotated(x, table, nth, p.seed))
        code = code * axes.shape[1] + axes.argmax(axis=1)
    return code


def probed(x: np.ndarray, table: int, p: Hashing) -> np.ndarray:
    """The buckets of the ``probes`` nearest combinations of axes, by row."""
    near = [_axes(rotated(x, table, nth, p.seed)) for nth in range(p.hashes)]
    each = min(near[0].shape[1], p.probes)
    tops = [np.argsort(-a, axis=1, kind="stable")[:, :each] for a in near]
    codes, sums = [], []
    for pick in product(range(each), repeat=p.hashes):
        code, total = np.zeros(len(x), np.int64), np.zeros(len(x))
        for axes, top, i in zip(near, tops, pick):
            code = code * axes.shape[1] + top[:, i]
            total += np.take_along_axis(axes, top[:, i : i + 1], 1)[:, 0]
        codes.append(code)
        sums.append(total)
    order = np.argsort(-np.stack(sums, 1), axis=1, kind="stable")[:, : p.probes]
    return np.take_along_axis(np.stack(codes, 1), order, 1)


def _valid(vector: Column, length: int) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & fine & F.exists(vector, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) if isinstance(v, (bytes, bytearray)) else np.asarray(v, np.float64) for v in column])


def _scale(x: np.ndarray) -> np.ndarray:
    # by the largest component first, so squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each pair by the same steps wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest distinct ``ids`` for each query, its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # where each id's rows begin
    unit, out = _scale(vectors), []
    for at in range(0, len(queries), 256):
        rough = _scale(queries[at : at + 256]) @ unit.T
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        each = rough if len(first) == len(ids) else np.maximum.reduceat(rough, first, axis=1)
        n = min(k, len(first))
        least = -np.partition(-each, n - 1, axis=1)[:, n - 1]
        for i, bound in enumerate(least):
            # what might be among the best by the exact measure, ties included
            near = np.flatnonzero((rough[i] >= bound - 1e-9) & np.isfinite(rough[i]))
            if not len(near):
                continue
            query = queries[at + i]
            score = cosine(np.broadcast_to(query, (len(near), len(query))), vectors[near])
            seen: set[int] = set()
            for j in np.lexsort((ids[near], -score)):
                if len(seen) == k:
                    break
                if int(ids[near[j]]) not in seen:
                    seen.add(int(ids[near[j]]))
                    out.append((query_ids[at + i], ids[near[j]], score[j]))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _round(vectors: DataFrame, queries: DataFrame, k: int, p: Hashing, every: bool = False) -> DataFrame:
    """Best ``k`` found in each block; with ``every``, one table is probed entirely."""
    tables = 1 if every else p.tables

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _matrix(frame["v"])
                unit, packed = _scale(x), [r.tobytes() for r in x]
                for t in range(tables):
                    yield pd.DataFrame({"id": frame["id"], "v": packed, "t": t, "b": 0 if every else buckets(unit, t, p)})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _matrix(frame["v"])
                unit, packed = _scale(x), [r.tobytes() for r in x]
                for t in range(tables):
                    codes = np.zeros((len(x), 1), np.int64) if every else probed(unit, t, p)
                    for n in range(codes.shape[1]):
                        yield pd.DataFrame({"id": frame["id"], "v": packed, "t": t, "b": codes[:, n]})

    schema = "id long, v binary, t int, b long"
    dealt, probes = vectors.mapInPandas(deal, schema), queries.mapInPandas(probe, schema)
    # a row for each bucket: how many parts its vectors and its queries need
    parts = stage(dealt.groupBy("t", "b").agg(F.ceil(F.count("*") / p.block).alias("n_v")).join(
        probes.groupBy("t", "b").agg(F.ceil(F.count("*") / p.block).alias("n_q")), ["t", "b"]), "ann-parts")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias("own")
    every_part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt.join(parts, ["t", "b"]).select("id", "v", "t", "b", own("n_v"), every_part("n_q").alias("other"))
    right = probes.join(parts, ["t", "b"]).select("id", "v", "t", "b", own("n_q").alias("other"), every_part("n_v").alias("own"))

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(two["id"].to_numpy(), _matrix(two["v"]), one["id"].to_numpy(), _matrix(one["v"]), k)

    key = ["t", "b", "own", "other"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           params: Hashing = Hashing()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k``
    nearest found for each row that ``is_query`` (a condition on ``vec_id``)
    selects, among all rows but its own."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 0
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("v"), length))
    queries = rows.where(is_query)
    rows, queries = (x.withColumnRenamed("vec_id", "id") for x in (rows, queries))
    found = stage(_top(_round(rows, queries, k, params), k), "ann-found")
    asked = queries.select("id").distinct()
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(asked.join(enough, "id", "left_anti"), "ann-short")
    if not short.isEmpty():
        rest = _top(_round(rows, queries.join(short, "id", "left_semi"), k, params, every=True), k)
        found = found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
