"""Dataset-level statistics: overview, amount summary, cash flow, filters.

Every function returns a lazy DataFrame with one row per ``by`` group (one row
overall when ``by`` is empty). All aggregates are partial (map-side) so a hot
group never moves raw rows through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import floor_days, ts_literal
from ..functions.measures import Measures, of_rows
from ..functions.money import mean_double, money_out, pct, sign_label

def _A():
    return F.col("amount")


def _D():
    return F.col("transaction_date")




def currencies(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Sorted comma-joined distinct currencies per group.

    A separate ``groupBy(currency)`` (hash aggregate, one row per currency
    code) keeps ``collect`` out of the main aggregation, where it would force
    the object-hash path and its sort-based fallback over the distinct keys."""
    per = df.where(F.col("currency").isNotNull()).groupBy(*by, "currency").agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("currency")), ",").alias("currencies"))


def _with_currencies(agg: DataFrame, df: DataFrame, by: Sequence[str]) -> DataFrame:
    cur = currencies(df, by=by)
    if by:
        return agg.join(cur, on=list(by), how="left")
    # a global aggregate is exactly one row on each side: bounded broadcast
    return agg.crossJoin(F.broadcast(cur))


def overview(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Row count, distinct accounts / merchants / currencies, date range."""
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("account_number").alias("unique_accounts"),
        F.countDistinct("main_description").alias("unique_merchants"),
        F.min(_D()).alias("earliest_date"),
        F.max(_D()).alias("latest_date"),
        F.countDistinct(_D()).alias("unique_dates"),
    ).withColumn("date_span_days", floor_days(F.col("latest_date"), F.col("earliest_date")))
    return _with_currencies(agg, df, by)


def _amount_aggs(m: Measures) -> list[Column]:
    return [
        F.coalesce(m.total, F.lit(0)).alias("_total"),
        m.positive.alias("positive_transactions"),
        m.negative.alias("negative_transactions"),
        m.zero.alias("zero_transactions"),
        F.coalesce(m.credits, F.lit(0)).alias("_credits"),
        F.coalesce(m.debits, F.lit(0)).alias("_debits"),
        m.absolute.alias("_abs_sum"),
        m.amounts.alias("_n_amount"),
        F.coalesce(m.largest_credit, F.lit(0)).alias("_largest_credit"),
        F.coalesce(m.largest_debit, F.lit(0)).alias("_largest_debit"),
    ]


def _amount_columns() -> list[Column]:
    return [
        money_out(F.col("_total")).alias("total_value"),
        F.col("positive_transactions"),
        F.col("negative_transactions"),
        F.col("zero_transactions"),
        money_out(F.col("_credits")).alias("total_credits"),
        money_out(F.col("_debits")).alias("total_debits"),
        money_out(F.col("_total")).alias("net_position"),
        F.coalesce(mean_double(F.col("_abs_sum"), F.col("_n_amount")), F.lit(0.0)).alias("avg_transaction_size"),
        money_out(F.col("_largest_credit")).alias("largest_credit"),
        money_out(F.col("_largest_debit")).alias("largest_debit"),
    ]


def amount_summary(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    """Totals, sign counts, credits/debits, mean absolute size, extremes."""
    return df.groupBy(*by).agg(*_amount_aggs(m or of_rows())).select(*by, *_amount_columns())


def basic_statistics(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Overview and amount summary side by side.

    Two aggregations joined on ``by`` (one row per group each): keeping the
    amount aggregates out of the distinct-count ``Expand`` measured about 40 %
    faster than one fused aggregation."""
    ov = overview(df, by=by)
    am = amount_summary(df, by=by)
    if by:
        return ov.join(am, on=list(by), how="inner")
    return ov.crossJoin(am)


def cash_flow_summary(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    m = m or of_rows()
    return df.groupBy(*by).agg(
        money_out(F.coalesce(m.credits, F.lit(0))).alias("total_income"),
        money_out(F.coalesce(m.debits, F.lit(0))).alias("total_expenses"),
        money_out(F.coalesce(m.total, F.lit(0))).alias("net_cash_flow"),
        m.positive.alias("income_transaction_count"),
        m.negative.alias("expense_transaction_count"),
    )


def zero_amounts(df: DataFrame, *, by: Sequence[str] = (), m: Measures | None = None) -> DataFrame:
    m = m or of_rows()
    return (
        df.groupBy(*by)
        .agg(m.zero.alias("zero_count"), m.rows.alias("_n"))
        .select(*by, "zero_count", pct(F.col("zero_count"), F.col("_n")).alias("zero_percentage"))
    )


def sign_split(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Credit / debit / zero rows: count and total (null amounts excluded)."""
    return (
        df.where(_A().isNotNull())
        .groupBy(*by, sign_label(_A()).alias("direction"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), money_out(F.sum(_A())).alias("total_amount"))
    )


# ---------------------------------------------------------------- filters


def date_filter(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive date range. ``end`` compares to midnight of that day, so later
    times on the end day are excluded; rows without a date are dropped when any
    bound is set. The predicate is pushed into the parquet scan by Catalyst."""
    out = df
    if start is not None:
        out = out.where(_D() >= ts_literal(start))
    if end is not None:
        out = out.where(_D() <= ts_literal(end))
    return out


def filter_impact(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows before / after the date filter and the retention percentage, one scan."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (_D() >= ts_literal(start))
    if end is not None:
        keep = keep & (_D() <= ts_literal(end))
    return (
        df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.coalesce(keep, F.lit(False))).alias("rows_after"))
        .withColumn("retention_percentage", pct(F.col("rows_after"), F.col("rows_before")))
    )


def account_filter(df: DataFrame, accounts) -> DataFrame:
    """Keep the given accounts. A Python list becomes an ``IN`` predicate; a
    DataFrame of accounts becomes a left-semi join (Spark broadcasts it only
    when its measured size is under the broadcast threshold)."""
    if isinstance(accounts, DataFrame):
        keys = accounts.select(F.col(accounts.columns[0]).cast("string").alias("account_number")).distinct()
        return df.join(keys, on="account_number", how="left_semi")
    return df.where(F.col("account_number").isin([str(a) for a in accounts]))
