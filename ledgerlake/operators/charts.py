"""Chart-ready datasets (rendering is left to the consumer).

Each function returns a small aggregated DataFrame that a plotting tool can
draw directly; none of them ships raw rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_of, month_start, weekday, weekday_name
from ..functions.money import mean_2dp, money_out
from . import merchants, temporal


def _A() -> Column:
    return F.col("amount")


def _D() -> Column:
    return F.col("transaction_date")


def _label(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def amount_histogram(df: DataFrame, *, bins: int = 50) -> DataFrame:
    """Equal-width histograms of income (amount > 0) and |expense| (amount < 0).

    Edges span each side's min..max (widened by 0.5 when min = max); the last
    bin is closed on the right. The 1-row bounds are broadcast (bounded)."""
    vals = df.where(_A().isNotNull() & (_A() != 0)).select(
        F.when(_A() > 0, F.lit("income")).otherwise(F.lit("expense")).alias("side"),
        F.abs(_A()).cast("double").alias("x"),
    )
    bounds = vals.groupBy("side").agg(F.min("x").alias("_lo0"), F.max("x").alias("_hi0"))
    same = F.col("_lo0") == F.col("_hi0")
    bounds = bounds.select(
        "side",
        F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("lo"),
        F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return (
        vals.join(F.broadcast(bounds), on="side")
        .withColumn("bin", b)
        .groupBy("side", "bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select(
            "side",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            "frequency",
        )
    )


def merchant_frequency_chart(df: DataFrame, *, top_n: int = 15) -> DataFrame:
    return merchants.top_merchants(df, n=top_n).select(
        "main_description", _label(F.col("main_description"), 40).alias("label"), "transaction_count"
    )


def monthly_trends_chart(df: DataFrame) -> DataFrame:
    return temporal.trend_monthly(df).select(
        F.col("month").alias("year_month"),
        F.col("monthly_transaction_count").alias("transaction_count"),
        F.col("monthly_total_amount").alias("total_amount"),
    )


def category_share(categorised: DataFrame, *, max_slices: int = 15) -> DataFrame:
    """Rows per category; more than ``max_slices`` -> top (max_slices-1) plus
    OTHERS; empty when there is at most one category. The ranking window
    runs on the per-category table (one row per category)."""
    counts = categorised.groupBy("auto_category").agg(F.count(F.lit(1)).alias("cnt"))
    # one row per category (bounded by the category cap + UNCATEGORIZED)
    w = Window.orderBy(F.col("cnt").desc(), F.col("auto_category").asc())
    n_cat = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = counts.withColumn("_rk", F.row_number().over(w)).withColumn("_ncat", n_cat)
    label = F.when((F.col("_ncat") > max_slices) & (F.col("_rk") >= max_slices), F.lit("OTHERS")).otherwise(F.col("auto_category"))
    return (
        ranked.where(F.col("_ncat") > 1)
        .groupBy(label.alias("category"))
        .agg(F.sum("cnt").cast("bigint").alias("transaction_count"))
    )


def cash_flow_chart(df: DataFrame) -> DataFrame:
    return (
        df.where(_D().isNotNull())
        .groupBy(month_start(_D()).alias("year_month"))
        .agg(
            F.coalesce(F.sum(F.when(_A() > 0, _A())), F.lit(0)).alias("_in"),
            F.coalesce(F.sum(F.when(_A() < 0, _A())), F.lit(0)).alias("_out"),
        )
        .select(
            "year_month",
            money_out(F.col("_in")).alias("income"),
            money_out(F.abs(F.col("_out"))).alias("expenses"),
            money_out(F.col("_in") + F.col("_out")).alias("net_flow"),
        )
    )


def account_comparison(df: DataFrame) -> DataFrame:
    """Per account count / total / 2-dp mean; empty with a single account."""
    per = (
        df.where(F.col("account_number").isNotNull())
        .groupBy("account_number")
        .agg(F.count(_A()).alias("transaction_count"), F.coalesce(F.sum(_A()), F.lit(0)).alias("_s"))
    )
    # account count as a one-row aggregate (a window over () would pull the
    # whole per-account table into one partition)
    n_acc = per.agg(F.count(F.lit(1)).alias("_nacc"))
    return (
        per.crossJoin(F.broadcast(n_acc))
        .where(F.col("_nacc") > 1)
        .select(
            "account_number",
            "transaction_count",
            money_out(F.col("_s")).alias("total_amount"),
            mean_2dp(F.col("_s"), F.col("transaction_count")).alias("avg_amount"),
        )
    )


def account_daily_activity(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("account_number").isNotNull() & _D().isNotNull())
        .groupBy("account_number", day_of(_D()).alias("day"))
        .agg(F.count(F.lit(1)).alias("transaction_count"))
    )


def weekday_chart(df: DataFrame) -> DataFrame:
    return (
        df.where(_D().isNotNull())
        .groupBy(weekday(_D()).alias("day_of_week"))
        .agg(F.count(_A()).alias("transaction_count"), F.coalesce(F.sum(_A()), F.lit(0)).alias("_s"))
        .select(
            "day_of_week",
            weekday_name(F.col("day_of_week")).alias("weekday_name"),
            "transaction_count",
            money_out(F.col("_s")).alias("total_amount"),
            mean_2dp(F.col("_s"), F.col("transaction_count")).alias("avg_amount"),
        )
    )


def outliers_chart(df: DataFrame, *, top_n: int = 15) -> DataFrame:
    """Top ``top_n`` rows by |amount|, labels cut to 30 (+ '...'), sign flag."""
    desc = F.coalesce(F.col("main_description"), F.lit("Unknown"))
    return (
        df.where(_A().isNotNull())
        .orderBy(F.abs(_A()).desc(), F.col("row_id").asc())
        .limit(top_n)
        .select(
            "row_id",
            _label(desc, 30).alias("label"),
            money_out(_A()).alias("amount"),
            money_out(F.abs(_A())).alias("abs_amount"),
            F.when(_A() > 0, F.lit("income")).otherwise(F.lit("expense")).alias("direction"),
        )
    )


def balance_trend(df: DataFrame, *, daily_close: bool = False) -> DataFrame:
    """Balance series per account in (date, row_id) order; ``daily_close``
    keeps the last balance of each day (one partial aggregate)."""
    rows = df.where(F.col("account_number").isNotNull() & _D().isNotNull() & F.col("balance").isNotNull())
    if daily_close:
        return rows.groupBy("account_number", day_of(_D()).alias("day")).agg(
            money_out(F.max_by(F.col("balance"), F.struct(_D(), F.col("row_id")))).alias("balance")
        )
    return rows.select("account_number", "transaction_date", "row_id", money_out(F.col("balance")).alias("balance"))


def income_vs_expense(df: DataFrame) -> DataFrame:
    return df.agg(
        money_out(F.coalesce(F.sum(F.when(_A() > 0, _A())), F.lit(0))).alias("total_income"),
        money_out(F.abs(F.coalesce(F.sum(F.when(_A() < 0, _A())), F.lit(0)))).alias("total_expenses"),
    )


def chart_data(df: DataFrame, categorised: DataFrame | None = None, *, errors: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All applicable chart datasets (lazy; each is independent). A dataset
    that cannot be built is left out instead of failing the others, and noted
    in ``errors`` if given."""
    builders = {
        "amount_distribution": lambda: amount_histogram(df),
        "merchant_frequency": lambda: merchant_frequency_chart(df),
        "monthly_trends": lambda: monthly_trends_chart(df),
        "cash_flow": lambda: cash_flow_chart(df),
        "account_comparison": lambda: account_comparison(df),
        "account_daily_activity": lambda: account_daily_activity(df),
        "weekday_patterns": lambda: weekday_chart(df),
        "outliers": lambda: outliers_chart(df),
        "balance_trend": lambda: balance_trend(df, daily_close=True),
        "income_vs_expense": lambda: income_vs_expense(df),
    }
    if categorised is not None and "auto_category" in categorised.columns:
        builders["category_distribution"] = lambda: category_share(categorised)
    out = {}
    for name, build in builders.items():
        try:
            out[name] = build()
        except Exception as e:  # noqa: BLE001 - an inapplicable chart is skipped
            if errors is not None:
                errors[name] = f"{type(e).__name__}: {e}"
    return out
