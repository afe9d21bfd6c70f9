"""Time-based reports: monthly summaries, weekday profile, daily frequency,
daily/weekly/monthly trends, month-over-month growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_of, month_start, week_start, weekday, weekday_name
from ..functions.measures import Measures, of_rows
from ..functions.money import mean_2dp, money_out

def _A():
    return F.col("amount")


def _D():
    return F.col("transaction_date")




def _dated(df: DataFrame) -> DataFrame:
    return df.where(_D().isNotNull())


def _grain(grain: str) -> Column:
    if grain == "day":
        return day_of(_D())
    if grain == "timestamp":
        return _D()
    raise ValueError(f"unknown grain {grain!r}")


def monthly_summary(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Per (year, month): non-null amount count, total, 2-dp mean, distinct dates."""
    m = m or of_rows()
    return (
        _dated(df)
        .groupBy(*by, F.year(_D()).alias("year"), F.month(_D()).alias("month"))
        .agg(
            m.amounts.alias("transaction_count"),
            F.coalesce(m.total, F.lit(0)).alias("_sum"),
            m.dates.alias("active_days"),
        )
        .select(
            *by,
            "year",
            "month",
            "transaction_count",
            money_out(F.col("_sum")).alias("total_amount"),
            mean_2dp(F.col("_sum"), F.col("transaction_count")).alias("avg_amount"),
            "active_days",
        )
    )


def monthly_cash_flow(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Per (year, month): income, expenses (negative) and net flow."""
    m = m or of_rows()
    income = F.coalesce(m.credits, F.lit(0))
    expenses = F.coalesce(m.debits, F.lit(0))
    return (
        _dated(df)
        .groupBy(*by, F.year(_D()).alias("year"), F.month(_D()).alias("month"))
        .agg(income.alias("_in"), expenses.alias("_out"))
        .select(
            *by,
            "year",
            "month",
            money_out(F.col("_in")).alias("income"),
            money_out(F.col("_out")).alias("expenses"),
            money_out(F.col("_in") + F.col("_out")).alias("net_flow"),
        )
    )


def cash_flow_monthly(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Per calendar month: income, expenses and net of the month."""
    m = m or of_rows()
    return (
        _dated(df)
        .groupBy(*by, month_start(_D()).alias("year_month"))
        .agg(
            F.coalesce(m.credits, F.lit(0)).alias("_in"),
            F.coalesce(m.debits, F.lit(0)).alias("_out"),
            F.coalesce(m.total, F.lit(0)).alias("_net"),
        )
        .select(
            *by,
            "year_month",
            money_out(F.col("_in")).alias("monthly_income"),
            money_out(F.col("_out")).alias("monthly_expenses"),
            money_out(F.col("_net")).alias("monthly_net"),
        )
    )


def weekday_patterns(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Rows per weekday, labelled by weekday number (Monday = 0)."""
    return (
        _dated(df)
        .groupBy(*by, weekday(_D()).alias("day_of_week"))
        .agg((m or of_rows()).rows.alias("transaction_count"))
        .withColumn("day_name", weekday_name(F.col("day_of_week")))
    )


def daily_frequency(df: DataFrame, *, by: Sequence[str] = (), grain: str = "day", m: Measures | None = None) -> DataFrame:
    """Rows per present day: mean / max / min and the busiest / quietest day
    (earliest on ties). Two-level aggregation: the per-day table is small."""
    daily = _dated(df).groupBy(*by, _grain(grain).alias("day")).agg((m or of_rows()).rows.alias("cnt"))
    return daily.groupBy(*by).agg(
        (F.sum("cnt").cast("double") / F.count(F.lit(1))).alias("avg_transactions_per_day"),
        F.max("cnt").alias("max_transactions_per_day"),
        F.min("cnt").alias("min_transactions_per_day"),
        F.min_by("day", F.struct(-F.col("cnt"), F.col("day"))).alias("busiest_day"),
        F.min_by("day", F.struct(F.col("cnt"), F.col("day"))).alias("quietest_day"),
    )


def _trend(df: DataFrame, key: Column, name: str, prefix: str, by: Sequence[str], m: Measures | None) -> DataFrame:
    m = m or of_rows()
    return (
        _dated(df)
        .groupBy(*by, key.alias(name))
        .agg(m.amounts.alias("_n"), F.coalesce(m.total, F.lit(0)).alias("_sum"))
        .select(
            *by,
            name,
            F.col("_n").alias(f"{prefix}_transaction_count"),
            money_out(F.col("_sum")).alias(f"{prefix}_total_amount"),
            mean_2dp(F.col("_sum"), F.col("_n")).alias(f"{prefix}_avg_amount"),
        )
    )


def _last(df: DataFrame, key: str, n: int | None, by: Sequence[str]) -> DataFrame:
    if n is None:
        return df
    if by:
        w = Window.partitionBy(*by).orderBy(F.col(key).desc())
        return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
    return df.orderBy(F.col(key).desc()).limit(n)


def trend_daily(df: DataFrame, *, by: Sequence[str] = (), last: int | None = 30, grain: str = "day", m: Measures | None = None) -> DataFrame:
    """Per day: count, total, mean; the last ``last`` present days."""
    return _last(_trend(df, _grain(grain), "day", "daily", by, m), "day", last, by)


def trend_weekly(df: DataFrame, *, by: Sequence[str] = (), last: int | None = 12, m: Measures | None = None) -> DataFrame:
    """Per Monday-start week; the last ``last`` present weeks."""
    return _last(_trend(df, week_start(_D()), "week_start", "weekly", by, m), "week_start", last, by)


def trend_monthly(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    return _trend(df, month_start(_D()), "month", "monthly", by, m)


def growth_mom(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Last present month against the previous present month.

    Runs on the monthly table (one row per month), so the ordered window has
    no raw rows in it. Empty when fewer than two months or the previous
    month's total is 0.
    """
    monthly = (
        _dated(df)
        .groupBy(*by, month_start(_D()).alias("month"))
        .agg(F.coalesce((m or of_rows()).total, F.lit(0)).alias("total"))
    )
    w = Window.partitionBy(*by).orderBy(F.col("month").desc())
    ranked = monthly.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= 2)
    pair = ranked.groupBy(*by).agg(
        F.max_by("month", F.when(F.col("_rk") == 1, F.lit(1))).alias("latest_month"),
        F.max_by("total", F.when(F.col("_rk") == 1, F.lit(1))).alias("_latest"),
        F.max_by("total", F.when(F.col("_rk") == 2, F.lit(1))).alias("_previous"),
        F.count(F.lit(1)).alias("_months"),
    )
    return pair.where((F.col("_months") == 2) & (F.col("_previous") != 0)).select(
        *by,
        "latest_month",
        money_out(F.col("_latest")).alias("latest_month_amount"),
        money_out(F.col("_previous")).alias("previous_month_amount"),
        F.round(
            (F.col("_latest") - F.col("_previous")).cast("double") / F.abs(F.col("_previous")).cast("double") * 100, 2
        ).alias("month_over_month_change"),
    )
