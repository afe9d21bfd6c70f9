"""Transaction pattern profile used before categorisation: amount signs and
quantiles, merchant frequencies, month-of-year and weekday distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import weekday
from ..functions.quantiles import quantiles, value_counts
from ..functions.ranges import join_on
from . import merchants

PROFILE_PROBS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def pattern_profile(df: DataFrame, *, probs: Sequence[float] = PROFILE_PROBS, by: Sequence[str] = ()) -> DataFrame:
    """Sign counts, mean of positive / negative amounts (0 when none) and
    exact quantiles of the signed amount (one column per probability), for all
    rows or each of ``by``; all from the rows of each amount."""
    by = list(by)
    values = value_counts(df, F.col("amount"), by)
    x, c = F.col("x"), F.col("c")
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    mean = lambda cond: F.coalesce(F.sum(F.when(cond, x * c)).cast("double") / F.sum(F.when(cond, c)), F.lit(0.0))
    counts = values.groupBy(*by).agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("total_transactions"),
        rows(x > 0).alias("positive_count"),
        rows(x < 0).alias("negative_count"),
        rows(x == 0).alias("zero_count"),
        mean(x > 0).alias("mean_positive"),
        mean(x < 0).alias("mean_negative"),
    )
    qcols = [F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)]
    return join_on(counts, quantiles(values, probs, by), by).select(*counts.columns, *qcols)


def pattern_merchants(df: DataFrame, *, top_n: int = 20) -> DataFrame:
    return merchants.top_merchants(df, n=top_n)


def month_distribution(df: DataFrame) -> DataFrame:
    d = F.col("transaction_date")
    return df.where(d.isNotNull()).groupBy(F.month(d).alias("month")).agg(F.count(F.lit(1)).alias("transaction_count"))


def weekday_distribution(df: DataFrame) -> DataFrame:
    d = F.col("transaction_date")
    return df.where(d.isNotNull()).groupBy(weekday(d).alias("day_of_week")).agg(F.count(F.lit(1)).alias("transaction_count"))


def merchant_rank(counts: DataFrame, *, key: str = "clean_merchant", count: str = "merchant_count") -> DataFrame:
    """Dense 1-based frequency rank (count desc, name asc) of a distinct
    merchant table without a global window: rank = merchants with a higher
    count (prefix sum over the small count-value histogram) + position among
    merchants sharing the count (window partitioned by the count value)."""
    hist = counts.groupBy(count).agg(F.count(F.lit(1)).alias("_k"))
    higher = hist.withColumn(
        "_before",
        F.coalesce(F.sum("_k").over(Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(count, "_before")
    within = Window.partitionBy(count).orderBy(F.col(key).asc())
    # k distinct count values need at least k(k+1)/2 rows, so the histogram
    # has at most sqrt(2N) rows; it still grows with N, so the join strategy
    # is left to AQE's measured sizes rather than forced to a broadcast
    return (
        counts.withColumn("_pos", F.row_number().over(within))
        .join(higher, on=count)
        .select(key, count, (F.col("_before") + F.col("_pos")).cast("bigint").alias("merchant_rank"))
    )
