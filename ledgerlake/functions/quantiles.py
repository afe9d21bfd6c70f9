"""Exact linear-interpolation quantiles, for a whole table or each of its groups.

Spark's exact ``percentile`` keeps a value -> count map per group and merges
it in one task, so its memory grows with the number of distinct values.  Here:

1. ``value_counts``: (group, value) -> rows by a partial aggregation, dealt out
   by ranges and written once; every quantile, and every count of rows beyond a
   threshold, comes from this table, without the rows;
2. running counts over the ranges (``ranges.running_totals``) give each value the
   ranks it covers; the values that cover the wanted ranks of their group are
   picked by a partial aggregation.

So a group of any size is spread over tasks, nothing passes through the driver, and
all probabilities share one pass.  The interpolation ``v[lo] + (v[hi] - v[lo]) *
frac`` with ``pos = (n-1)*p`` is done in exact decimal arithmetic, the same
definition as numpy's default, DuckDB ``quantile_cont`` and Spark ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import ordered_ranges, running_totals

Q_TYPE = "decimal(38,6)"


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``x`` (nulls too) and ``c``, the rows that hold it, in ranges."""
    return ordered_ranges(df.groupBy(*by, value.alias("x")).agg(F.count(F.lit(1)).alias("c")), [*by, "x"])


def quantiles(values: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``_q``, the quantiles of ``value_counts`` at ``probs`` (null where
    a group has no value); with no ``by`` always one row."""
    weight = F.when(F.col("x").isNotNull(), F.col("c"))
    ranks = running_totals(values, by, ["x"], weight, "_upto", "_rows")
    wanted = []
    for p in probs:
        place = (F.col("_rows") - 1).cast("decimal(20,0)") * F.lit(Decimal(str(p)))
        wanted.append((F.floor(place).cast("bigint"), F.ceil(place).cast("bigint"), place - F.floor(place)))
    covers = lambda rank: F.col("x").isNotNull() & (F.col("_upto") > rank) & (F.col("_upto") - F.col("c") <= rank)
    picked = []
    for i, (low, high, share) in enumerate(wanted):
        picked += [F.max(F.when(covers(low), F.col("x"))).alias(f"_low{i}"), F.max(F.when(covers(high), F.col("x"))).alias(f"_high{i}"),
                   F.max(share).cast("decimal(10,8)").alias(f"_share{i}")]
    found = ranks.groupBy(*by).agg(*picked)
    between = [(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_share{i}")).cast(Q_TYPE) for i in range(len(probs))]
    return found.select(*by, F.array(*between).alias("_q"))
