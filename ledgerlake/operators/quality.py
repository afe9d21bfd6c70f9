"""Data-quality reports: missing values per column, zero / extreme amounts,
currency and account distributions, date and coercion checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import ts_literal
from ..functions.money import pct
from ..functions.ranges import join_on

def _A():
    return F.col("amount")


def _D():
    return F.col("transaction_date")




def is_null(name: str) -> Column:
    """Whether the column of this name, dots and backticks included, is null."""
    return F.col(f"`{name.replace('`', '``')}`").isNull()


def missing_data(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group of ``by``): null count, percentage of rows,
    has_data.

    One aggregation computes every null count; ``stack`` turns the single
    result row into one row per column."""
    cols = list(columns or df.columns)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(is_null(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    return missing_rows(counts, cols, by=by)


def missing_rows(counts: DataFrame, cols: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``_n`` and nulls ``_m0``, ``_m1``, ... of ``cols`` as one row per column."""
    pairs = [x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"_m{i}"))]
    long = counts.select(*by, "_n", F.stack(F.lit(len(cols)), *pairs).alias("column_name", "missing_count"))
    return long.select(
        *by,
        "column_name",
        "missing_count",
        F.round(pct(F.col("missing_count"), F.col("_n")), 2).alias("missing_percentage"),
        (F.col("missing_count") < F.col("_n")).alias("has_data"),
    )


def extreme_amounts(df: DataFrame, *, k: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows with |amount - mean| > k * sample std, of all rows or each of ``by``.
    The mean/std (one row, or one for each group) meet the rows of each amount,
    not the rows, in a second pass."""
    by = list(by)
    values = df.groupBy(*by, _A().alias("x")).agg(F.count(F.lit(1)).alias("c"))
    stats = df.groupBy(*by).agg(
        (F.sum(_A()).cast("double") / F.count(_A())).alias("_mean"),
        F.stddev_samp(_A().cast("double")).alias("_std"),
        F.count(F.lit(1)).alias("_n"),
    )
    thr = F.lit(k) * F.col("_std")
    flagged = join_on(values, stats, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.abs(F.col("x").cast("double") - F.col("_mean")) > thr, F.col("c"))), F.lit(0)).alias("extreme_count"),
        F.first(thr).alias("_thr"),
        F.first("_n").alias("_n"),
    )
    return flagged.select(
        *by,
        "extreme_count",
        F.round(F.col("_thr").cast("decimal(38,6)"), 2).cast("decimal(38,2)").alias("threshold"),
        pct(F.col("extreme_count"), F.col("_n")).alias("extreme_percentage"),
    )


def currency_distribution(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    counts = df.where(F.col("currency").isNotNull()).groupBy(*by, "currency").agg(F.count(F.lit(1)).alias("transaction_count"))
    return with_currency_issue(counts, Window.partitionBy(*by))


def with_currency_issue(counts: DataFrame, group: WindowSpec) -> DataFrame:
    # window over the per-currency table only (one row per currency code)
    n_cur = F.count(F.lit(1)).over(group)
    return counts.withColumn(
        "issue", F.when(n_cur > 1, F.lit("Multiple currencies detected")).otherwise(F.lit(None).cast("string"))
    )


def date_quality(df: DataFrame, *, as_of, raw_column: str | None = None) -> DataFrame:
    """Parse failures, min/max/span, unique dates, future dates (> as_of) and
    dates before 1900, in one aggregation."""
    from ..functions.dates import floor_days

    fail = F.count_if(F.col(raw_column).isNotNull() & _D().isNull()) if raw_column else F.lit(0).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        fail.alias("parse_failures"),
        F.count_if(_D().isNull()).alias("null_dates"),
        F.min(_D()).alias("min_date"),
        F.max(_D()).alias("max_date"),
        F.countDistinct(_D()).alias("unique_dates"),
        F.count_if(_D() > ts_literal(as_of)).alias("future_dates"),
        F.count_if(_D() < ts_literal("1900-01-01")).alias("dates_before_1900"),
    ).withColumn("span_days", floor_days(F.col("max_date"), F.col("min_date")))
