"""Near-duplicate embeddings by iterative quantisation.

Vectors of length one are turned along their principal axes and then by a rotation
learned so that the signs of the result lose least (alternating between signs and
the orthogonal matrix that best maps the vectors onto them).  Cut at the sample's
medians, the bits are balanced.  Rotations from several random starts give a
long code; consecutive runs of its bits index one Hamming table each, and vectors
with an equal run meet.

The length of a run grows with the logarithm of the number of vectors, so chance
meetings stay few.  The number of tables is measured, not guessed: partners at
exactly the threshold are made for sample vectors, and tables are added until the
share ``recall`` of them meets; if ``max_tables`` do not reach it, runs get
shorter.  The same is tried with signs around zero, whose bits depend on the angle
alone, and kept where they cost less than half (tables, and chance meetings on the
sample): collections far from the origin need it.

First only (table, run, id) rows are brought together.  Vectors follow for the
buckets that hold more than one, a bucket beyond ``block`` rows is split into parts that
meet pairwise, and pairs are reranked by exact cosine.  A pair that meets in
several tables counts in the first of them.  A task returns, for each vector,
its number of links and one edge to its group's representative, never the pairs.
Equal vectors are one row with a count throughout.

Defined results: vectors that are null, zero, of another length than most vectors
(ties: the longer), or hold null or non-finite components link with nothing; every
input row gives one output row; rows that repeat an id are rows of their own; a
component has its smallest non-null id (null if there is none), a row with a null id is
kept only if its component has none; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import column, stage
from ledgerlake.llm.components import connected_components
from ledgerlake.llm.vectors import common_length, cosine, finite, matrix, nonzero, unit


@dataclass(frozen=True)
class Quantising:
    """``sample`` bounds the vectors that rotations are learned from; ``spare`` is
    added to the logarithm of the number of vectors for a run's bits."""

    threshold: float = 0.9
    recall: float = 0.97
    sample: int = 4096
    spare: int = 4
    iterations: int = 20
    max_tables: int = 256
    max_axes: int = 128
    block: int = 1024
    seed: int = 13


# --- learning ----------------------------------------------------------------

@dataclass(frozen=True)
class Quantiser:
    """Bits are ``(x - mean) @ turn > cut``; a table has ``run`` of them."""

    mean: np.ndarray
    turn: np.ndarray
    cut: np.ndarray
    run: int

    def runs(self, units: np.ndarray) -> np.ndarray:
        """One integer for each table, by row."""
        bits = (units - self.mean) @ self.turn > self.cut
        values = bits.reshape(len(units), -1, self.run) @ (1 << np.arange(self.run, dtype=np.int64))
        return (values ^ (values >> 31)).astype(np.int32)  # chance meetings of longer runs are verified like others


def rotation(y: np.ndarray, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """An orthogonal matrix that brings ``y`` near its signs, from a random start."""
    turn, _ = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))
    for _ in range(iterations):
        left, _, right = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (left @ right).T
    return turn


def _partners(x: np.ndarray, similarity: float, rng: np.random.Generator) -> np.ndarray:
    """A vector at exactly ``similarity`` from each row, in a random direction."""
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return similarity * x + np.sqrt(1 - similarity**2) * np.divide(away, length, out=np.zeros_like(away), where=length > 0)


def learn(sample: np.ndarray, rows: int, p: Quantising = Quantising()) -> Quantiser:
    """From distinct vectors of length one, for a collection of ``rows``."""
    (cost, model), (other, unshifted) = (_learn(sample, rows, p, balanced) for balanced in (True, False))
    return model if cost <= 2 * other else unshifted


def _learn(x: np.ndarray, rows: int, p: Quantising, balanced: bool) -> tuple[float, Quantiser]:
    rng = np.random.default_rng([p.seed, balanced])
    mean = x.mean(axis=0) if balanced else np.zeros(x.shape[1])
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, : p.max_axes]
    y, probe = (x - mean) @ axes, x[:1024]
    partner = _partners(probe, min(p.threshold, 1.0), rng)
    turns, cuts, run = [], [], max(4, min(60, rows.bit_length() + p.spare))
    while True:
        tables, met, crowd = 0, np.zeros(len(probe), bool), 0.0
        while tables < p.max_tables and met.mean() < p.recall:
            while len(turns) * axes.shape[1] < (tables + 1) * run:
                turn = rotation(y, rng, p.iterations)
                turns.append(axes @ turn)
                cuts.append(np.median(y @ turn, axis=0) if balanced else np.zeros(axes.shape[1]))
            part = slice(tables * run, (tables + 1) * run)
            one = Quantiser(mean, np.hstack(turns)[:, part], np.concatenate(cuts)[part], run)
            met |= one.runs(probe)[:, 0] == one.runs(partner)[:, 0]
            _, each = np.unique(one.runs(x), return_counts=True)
            crowd += float((each * (each - 1)).sum()) / max(1, len(x) * (len(x) - 1))
            tables += 1
        if met.mean() >= p.recall or run == 1:
            return tables + rows * crowd, Quantiser(mean, np.hstack(turns)[:, : tables * run], np.concatenate(cuts)[: tables * run], run)
        run = max(1, run - 2)


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """``size`` distinct vectors at most, picked by hash: the same on every run."""
    hashed = rows.select(F.xxhash64("v").alias("h"), "v")
    bound = hashed.groupBy("h").agg(F.count("*")).select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if bound is None:
        return np.zeros((0, 0))
    found = hashed.where(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").select("v").collect()
    return unit(np.array([r["v"] for r in found], np.float64))


# --- meeting -----------------------------------------------------------------

def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the given links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _within(sizes: np.ndarray, starts: np.ndarray, chunk: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within groups, some ten thousands at a time."""
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        step = max(1, chunk // len(i)) if len(i) else len(at)
        for k in range(0, len(at) if len(i) else 0, step):
            yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()


def _linked(rows: pd.DataFrame, threshold: float, small: int = 32) -> pd.DataFrame:
    """Links of rows sorted by group (t, code, lo, hi): ``a`` (node), ``b`` (the
    node that stands for its linked set) and ``n`` (vectors it is linked with)."""
    key = rows[["t", "code", "lo", "hi"]].to_numpy()
    t, own, split, m = key[:, 0], rows["own"].to_numpy(), key[:, 2] != key[:, 3], rows["m"].to_numpy()
    x, runs, node = matrix(rows["v"]), np.stack(rows["codes"].to_numpy()), rows["node"].to_numpy()
    units = unit(x)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            score = cosine(x[i], x[j])
            left.append(i[score >= threshold])
            right.append(j[score >= threshold])

    for i, j in _within(sizes[sizes <= small], starts[sizes <= small]):
        fit = ~split[i] | (own[i] != own[j])
        i, j = i[fit], j[fit]
        first = (runs[i] == runs[j]).argmax(axis=1) == t[i]
        keep(i[first], j[first])
    for a, b in zip(starts[sizes > small], (starts + sizes)[sizes > small]):
        for r in range(a, b, 256):
            s = min(r + 256, b)
            near = units[r:s] @ units[r:b].T >= threshold - 1e-9
            near &= np.arange(r, s)[:, None] < np.arange(r, b)
            if split[a]:
                near &= own[r:s, None] != own[None, r:b]
            for earlier in range(t[a]):
                if not near.any():
                    break
                near &= runs[r:s, earlier, None] != runs[None, r:b, earlier]
            i, j = np.nonzero(near)
            for k in range(0, len(i), 50_000):
                keep(r + i[k : k + 50_000], r + j[k : k + 50_000])
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, i, m[j])
    np.add.at(links, j, m[i])
    used = np.flatnonzero(links)
    return pd.DataFrame({"a": node[used], "b": node[_labels(len(rows), i, j)[used]], "n": links[used]})


def _meet(reps: DataFrame, p: Quantising) -> DataFrame:
    """``a``, ``b``, ``n`` of every group of vectors that share a run of bits."""
    index = reps.select("node", F.posexplode("codes").alias("t", "code"))
    crowded = stage(index.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1"), "itq-crowded")
    parts = F.ceil(F.col("n") / p.block)
    entries = index.join(crowded, ["t", "code"]).withColumn("own", F.pmod(F.xxhash64("node"), parts))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    entries = entries.select("t", "code", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node")
    key = ["t", "code", "lo", "hi"]
    groups = entries.join(reps, "node").repartition(*key).sortWithinPartitions(*key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < 20_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            keys = rows[key].to_numpy()
            last = (keys != keys[-1]).any(axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:  # the last group may go on in the next batch
                yield _linked(rows.iloc[:cut], p.threshold)
            held = [rows.iloc[cut:]]
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            yield _linked(rows, p.threshold)

    return groups.mapInPandas(run, "a long, b long, n long")


# --- the operator ------------------------------------------------------------

def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Quantising = Quantising()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("v"))
    length = common_length(rows)
    valid = F.coalesce(finite(F.col("v"), length) & nonzero(F.col("v")), F.lit(False))
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(valid)
    sample = _sample(rows, params.sample)
    if not len(sample):
        return alone
    model = learn(sample, rows.count(), params)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = matrix(frame["v"])
                yield pd.DataFrame({"vec_id": frame["vec_id"], "v": [r.tobytes() for r in x], "codes": list(model.runs(unit(x)))})

    coded = rows.mapInPandas(encode, "vec_id long, v binary, codes array<int>")
    coded = stage(coded.select("*", F.unhex(F.md5("v")).alias("key"), F.monotonically_increasing_id().alias("nth")), "itq-codes")
    classes = stage(coded.groupBy("key").agg(F.min("nth").alias("node"), F.count("*").alias("m"), F.min("vec_id").alias("least")), "itq-classes")
    reps = coded.select("nth", "v", "codes").join(classes.select("node", "m"), F.col("nth") == F.col("node")).drop("nth")
    links = stage(_meet(stage(reps, "itq-distinct"), params), "itq-links")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(links.select("a", "b"))
    of = classes.join(counts, "node", "left").join(roots, "node", "left")
    of = of.select("key", "least", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = coded.select("vec_id", "key").join(of.join(ids, "root").select("key", "n_links", "component_id"), "key")
    found = found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return found.unionByName(alone)


def oracle_sql(threshold: float = 0.9) -> str:
    return f"""
WITH RECURSIVE fine AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r USING (vec_id) GROUP BY e.vec_id"""
