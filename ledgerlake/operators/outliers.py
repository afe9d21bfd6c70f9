"""Outliers, large transactions, top-N by size, potential duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_out, pct
from ..functions.quantiles import Q_TYPE, quantiles, value_counts
from ..functions.ranges import join_on
from ..functions.text import truncate

def _A():
    return F.col("amount")


def _ABS():
    return F.abs(F.col("amount"))


def amount_values(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each |amount| (per ``by``); the two reports below read it, so
    a run that makes both passes it to them and scans its rows once."""
    return value_counts(df, _ABS(), by)


def _quantiles(df: DataFrame, values: DataFrame | None, probs: Sequence[float], method: str, by: Sequence[str]) -> DataFrame:
    """``by`` and ``_q``, an array of decimal(38,6) quantiles of |amount|.

    ``distributed`` (default): exact, from the value table (see
    ``functions.quantiles``); ``percentile``: Spark's exact aggregate (a group's
    value map merged in a single task; fine for modest distinct counts);
    ``approx``: the mergeable ``percentile_approx`` sketch.  All three use linear
    interpolation between order statistics."""
    if method == "distributed":
        return quantiles(values, probs, by)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if method == "approx":
        agg = F.percentile_approx(_ABS().cast("double"), arr, 100000)
    elif method == "percentile":
        agg = F.percentile(_ABS().cast("double"), arr)
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    return df.groupBy(*by).agg(F.transform(agg, lambda q: q.cast(Q_TYPE)).alias("_q"))


def _q(i: int) -> Column:
    # quantiles of 2-dp data have at most 4 decimals: decimal(38,6) is exact
    return F.col("_q")[i]


def iqr_outliers(df: DataFrame, *, method: str = "distributed", by: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """|amount| above q75 + 1.5 * IQR (linear quantiles of |amount|), for all rows
    or each of ``by``.  Rows beyond the threshold are counted in the value table."""
    by = list(by)
    values = amount_values(df, by=by) if values is None else values
    stats = _quantiles(df, values, [0.25, 0.75], method, by).select(*by, _q(0).alias("q25"), _q(1).alias("q75"))
    stats = stats.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn(
        "upper_bound", F.col("q75") + F.lit(1.5).cast("decimal(2,1)") * F.col("iqr")
    ).withColumn("lower_bound", F.col("q25") - F.lit(1.5).cast("decimal(2,1)") * F.col("iqr"))
    bounds = ["q25", "q75", "iqr", "lower_bound", "upper_bound"]
    counted = join_on(values, stats, by).groupBy(*by, *bounds).agg(
        F.coalesce(F.sum(F.when(F.col("x") > F.col("upper_bound"), F.col("c"))), F.lit(0)).alias("outlier_count"), F.sum("c").alias("_n")
    )
    return counted.select(*by, *bounds, "outlier_count", pct(F.col("outlier_count"), F.col("_n")).alias("outlier_percentage"))


def large_transactions(
    df: DataFrame, *, percentile: float = 95.0, method: str = "distributed", by: Sequence[str] = (), values: DataFrame | None = None
) -> DataFrame:
    """|amount| above its ``percentile``-th percentile, for all rows or each of ``by``."""
    by = list(by)
    values = amount_values(df, by=by) if values is None else values
    stats = _quantiles(df, values, [percentile / 100.0], method, by).select(*by, _q(0).alias("threshold"))
    counted = join_on(values, stats, by).groupBy(*by, "threshold").agg(
        F.coalesce(F.sum(F.when(F.col("x") > F.col("threshold"), F.col("c"))), F.lit(0)).alias("large_count"), F.sum("c").alias("_n")
    )
    return counted.select(*by, "threshold", "large_count", pct(F.col("large_count"), F.col("_n")).alias("large_percentage"))


def top_outliers(df: DataFrame, *, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows by |amount| (ties by row order), of all rows or each of
    ``by``, description cut to 50."""
    rows = df.where(_A().isNotNull())
    order = [_ABS().desc(), F.col("row_id").asc()]
    if by:  # the limit by group applies before the shuffle, too
        top = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n)
    else:
        top = rows.orderBy(*order).limit(n)
    return (
        top.select(
            *by,
            "row_id",
            F.col("transaction_date").alias("date"),
            F.col("account_number").alias("account"),
            truncate(F.col("main_description"), 50).alias("description"),
            money_out(_A()).alias("amount"),
            money_out(_ABS()).alias("abs_amount"),
        )
    )


def duplicates(df: DataFrame, *, keys: Sequence[str] = ("transaction_date", "amount"), by: Sequence[str] = ()) -> DataFrame:
    """Rows sharing every key (nulls equal) with at least one other row,
    across accounts or within each of ``by``: count and percentage. Partial
    aggregation per key, so a hot (date, amount) pair is combined map-side."""
    groups = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_c"))
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("duplicate_count"),
        F.sum("_c").alias("_n"),
    ).select(*by, "duplicate_count", pct(F.col("duplicate_count"), F.col("_n")).alias("duplicate_percentage"))


def duplicate_rows(df: DataFrame, *, keys: Sequence[str] = ("transaction_date", "amount")) -> DataFrame:
    """The duplicate rows themselves: null-safe left-semi join with the keys
    that occur more than once."""
    dup_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).drop("_c")
    cond = None
    right = dup_keys.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    for k in keys:
        c = df[k].eqNullSafe(right[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left_semi")
