"""Skew-tolerant ordered window helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    out: str,
    chunk: Column,
) -> DataFrame:
    """Add ``out`` = cumulative sum of ``value`` per ``keys`` in ``order``.

    A plain ``Window.partitionBy(keys)`` puts every row of a key in one task,
    so one hot key serialises the whole job. Instead rows are split into
    ordered chunks (``chunk`` must be monotone in ``order``, e.g. the day of
    the date): a small per-(key, chunk) total table gets an exclusive prefix
    sum, and each chunk runs its own window in parallel, seeded with that
    offset. The result equals the single-window cumulative sum.
    """
    keys = list(keys)
    tmp = df.withColumn("_chunk", chunk).withColumn("_v", value)
    totals = tmp.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_chunk_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_chunk_total").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = tmp.withColumn("_within", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    # null-safe left join: rows with a null key or chunk are kept (they sort
    # first, as in a single window), and when ``out`` is not used downstream
    # the join (unique on its keys) and both windows are pruned by Catalyst
    offsets = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_chunk").alias("_o_chunk"), "_offset")
    cond = running["_chunk"].eqNullSafe(offsets["_o_chunk"])
    for k in keys:
        cond = cond & running[k].eqNullSafe(offsets[f"_o_{k}"])
    return (
        running.join(offsets, cond, how="left")
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_chunk", "_v", "_offset", "_within", "_o_chunk", *[f"_o_{k}" for k in keys])
    )
