"""Per-account reports: overview, financials, activity status, activity
classification with the global context, distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MICROS_PER_DAY, floor_days, micros, ts_literal
from ..functions.money import mean_2dp, money_out, pct

def _A():
    return F.col("amount")


def _D():
    return F.col("transaction_date")


ACC = "account_number"


def _accounts(df: DataFrame) -> DataFrame:
    # rows without an account never form an account of their own
    return df.where(F.col(ACC).isNotNull())


def account_overview(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return _accounts(df).groupBy(*by).agg(F.countDistinct(ACC).alias("total_accounts"))


def account_list(df: DataFrame) -> DataFrame:
    return _accounts(df).select(ACC).distinct()


def account_distribution(df: DataFrame) -> DataFrame:
    return _accounts(df).groupBy(ACC).agg(F.count(F.lit(1)).alias("transaction_count"))


def account_financials(df: DataFrame) -> DataFrame:
    """Per account: count, first/last date, credits, debits, net, 2-dp mean and
    the current balance = balance of the last dated row with a balance, in
    (date, row_id) order. One partial aggregation, no window."""
    last_key = F.when(_D().isNotNull() & F.col("balance").isNotNull(), F.struct(_D(), F.col("row_id")))
    return (
        _accounts(df)
        .groupBy(ACC)
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.min(_D()).alias("first_transaction"),
            F.max(_D()).alias("last_transaction"),
            F.coalesce(F.sum(F.when(_A() > 0, _A())), F.lit(0)).alias("_cr"),
            F.coalesce(F.sum(F.when(_A() < 0, _A())), F.lit(0)).alias("_db"),
            F.coalesce(F.sum(_A()), F.lit(0)).alias("_net"),
            F.count(_A()).alias("_na"),
            F.max_by(F.col("balance"), last_key).alias("_bal"),
        )
        .select(
            ACC,
            "transaction_count",
            "first_transaction",
            "last_transaction",
            money_out(F.col("_cr")).alias("total_credits"),
            money_out(F.col("_db")).alias("total_debits"),
            money_out(F.col("_net")).alias("net_position"),
            F.coalesce(mean_2dp(F.col("_net"), F.col("_na")), F.lit(0).cast("decimal(38,2)")).alias("avg_transaction"),
            money_out(F.col("_bal")).alias("current_balance"),
        )
    )


def account_activity(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    """Per-account status against ``as_of``: days since the account's last
    row; a historical account (> 30 days) is measured from its own last date,
    otherwise from ``as_of``; rows in the 30 days before that reference.

    Rows are first counted per account and timestamp; the last date of an
    account is joined to those counts, never to the rows.
    """
    now = ts_literal(as_of)
    per = _accounts(df).groupBy(ACC, _D()).agg(F.count(F.lit(1)).alias("_n"))
    last = per.groupBy(ACC).agg(F.max(_D()).alias("last_transaction"))
    days = floor_days(now, F.col("last_transaction"))
    last = last.withColumn("days_since_last_transaction", days).withColumn(
        "_ref", F.when(F.col("days_since_last_transaction") > 30, F.col("last_transaction")).otherwise(now)
    )
    counts = (
        per.join(last.select(ACC, "_ref"), on=ACC, how="inner")
        .groupBy(ACC)
        .agg(
            F.coalesce(
                F.sum(F.when(micros(_D()) > micros(F.col("_ref")) - F.lit(30 * MICROS_PER_DAY), F.col("_n"))), F.lit(0).cast("bigint")
            ).alias("transactions_last_30_days")
        )
    )
    return last.join(counts, on=ACC, how="inner").select(
        ACC,
        "last_transaction",
        "days_since_last_transaction",
        F.coalesce(F.col("days_since_last_transaction") <= active_days, F.lit(False)).alias("is_active"),
        F.when(F.col("days_since_last_transaction") > 30, F.lit("data_end")).otherwise(F.lit("current_date")).alias("reference_date_used"),
        F.coalesce(F.col("days_since_last_transaction") > 30, F.lit(False)).alias("is_historical_data"),
        "transactions_last_30_days",
    )


# ------------------------------------------------------------ activity context


def activity_context(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    """One row: data start/end, period, days since end, Historical / Current,
    reference date and the (possibly adaptive, fractional) threshold in days."""
    now = ts_literal(as_of)
    span = df.agg(F.min(_D()).alias("data_start"), F.max(_D()).alias("data_end"))
    period = floor_days(F.col("data_end"), F.col("data_start"))
    since = floor_days(now, F.col("data_end"))
    return span.select(
        "data_start",
        "data_end",
        period.alias("period_days"),
        since.alias("days_since_data_end"),
        F.when(since > 30, F.lit("Historical")).otherwise(F.lit("Current")).alias("analysis_context"),
        F.when(since > 30, F.col("data_end")).otherwise(now).alias("reference_date"),
        F.lit(active_days).alias("configured_threshold_days"),
        F.when(period < active_days, F.greatest(F.lit(30.0), period * F.lit(0.33)))
        .otherwise(F.lit(float(active_days)))
        .alias("threshold_days"),
        (period < active_days).alias("is_adaptive"),
    ).withColumn("applied_threshold_days", F.col("threshold_days").cast("bigint"))


def activity_accounts(df: DataFrame, *, as_of, active_days: int = 90, context: DataFrame | None = None) -> DataFrame:
    """Multi-criteria activity classification per account (see README).

    The one-row context is broadcast (bounded: a single row) and every
    per-account figure comes from one partial aggregation.
    """
    if context is None:
        context = activity_context(df, as_of=as_of, active_days=active_days)
    ctx = context.select("reference_date", "threshold_days")
    ref_us = micros(F.col("reference_date"))
    recent_cut = ref_us - F.col("threshold_days") * F.lit(float(MICROS_PER_DAY))
    very_recent_cut = ref_us - F.lit(30 * MICROS_PER_DAY)
    per = (
        _accounts(df)
        .crossJoin(F.broadcast(ctx))
        .groupBy(ACC)
        .agg(
            F.max(_D()).alias("last_transaction_date"),
            F.min(_D()).alias("first_transaction_date"),
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(micros(_D()) > recent_cut).alias("recent_transactions_90_days"),
            F.count_if(micros(_D()) > very_recent_cut).alias("very_recent_transactions_30_days"),
            F.coalesce(F.sum(_A()), F.lit(0)).alias("_sum"),
            F.count(_A()).alias("_na"),
            F.first("reference_date").alias("_ref"),
            F.first("threshold_days").alias("_thr"),
        )
    )
    days_last = floor_days(F.col("_ref"), F.col("last_transaction_date"))
    days_first = floor_days(F.col("_ref"), F.col("first_transaction_date"))
    period = floor_days(F.col("last_transaction_date"), F.col("first_transaction_date")) + 1
    per = (
        per.withColumn("days_since_last_transaction", days_last)
        .withColumn("days_since_first_transaction", days_first)
        .withColumn("account_active_period_days", period)
    )
    c1 = F.coalesce(F.col("days_since_last_transaction") <= F.col("_thr"), F.lit(False))
    c2 = F.col("recent_transactions_90_days") > 0
    freq = F.col("total_transactions") / F.greatest(F.lit(1), F.col("account_active_period_days"))
    c3 = F.coalesce((F.col("account_active_period_days") > 30) & (freq >= 0.1), F.lit(False))
    met = c1.cast("int") + c2.cast("int") + c3.cast("int")
    per = per.withColumn("_met", met)
    is_active = (F.col("_met") >= 2) | ((F.col("_met") >= 1) & (F.col("total_transactions") >= 10))
    confidence = F.least(
        F.lit(100.0),
        F.col("_met") / 3 * 100 + F.least(F.col("total_transactions"), F.lit(50)) / 50 * 20,
    )
    criteria = F.array_join(
        F.array_compact(
            F.array(
                F.when(c1, F.lit("Recent transactions")),
                F.when(c2, F.lit("Activity in threshold period")),
                F.when(c3, F.lit("Consistent activity pattern")),
            )
        ),
        ", ",
    )
    return per.select(
        ACC,
        F.when(is_active, F.lit("Active")).otherwise(F.lit("Inactive")).alias("status"),
        F.round(confidence, 1).alias("confidence_score"),
        "total_transactions",
        "recent_transactions_90_days",
        "very_recent_transactions_30_days",
        "days_since_last_transaction",
        "days_since_first_transaction",
        "account_active_period_days",
        F.round(freq, 3).alias("activity_intensity"),
        "last_transaction_date",
        "first_transaction_date",
        money_out(F.col("_sum")).alias("total_amount"),
        F.coalesce(mean_2dp(F.col("_sum"), F.col("_na")), F.lit(0).cast("decimal(38,2)")).alias("avg_transaction_amount"),
        is_active.alias("is_active"),
        criteria.alias("activity_criteria_met"),
        F.concat(F.col("_met").cast("string"), F.lit("/3")).alias("criteria_score"),
    )


def activity_summary(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    """Totals and confidence bands over the per-account classification."""
    ctx = activity_context(df, as_of=as_of, active_days=active_days)
    acc = activity_accounts(df, as_of=as_of, active_days=active_days, context=ctx)
    act = F.col("is_active")
    conf = F.col("confidence_score")
    summary = acc.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(act).alias("active_accounts"),
        F.count_if(~act).alias("inactive_accounts"),
        F.count_if(act & (conf >= 80)).alias("high_confidence_active"),
        F.count_if(act & (conf >= 50) & (conf < 80)).alias("moderate_confidence_active"),
        F.count_if(act & (conf < 50)).alias("low_confidence_active"),
    )
    return summary.crossJoin(ctx).select(
        "analysis_context",
        "reference_date",
        "data_start",
        "data_end",
        "period_days",
        "days_since_data_end",
        "configured_threshold_days",
        "applied_threshold_days",
        "is_adaptive",
        "total_accounts",
        "active_accounts",
        "inactive_accounts",
        F.round(pct(F.col("active_accounts"), F.col("total_accounts")), 2).alias("active_percentage"),
        F.round(pct(F.col("inactive_accounts"), F.col("total_accounts")), 2).alias("inactive_percentage"),
        "high_confidence_active",
        "moderate_confidence_active",
        "low_confidence_active",
    )


def activity_active(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    return activity_accounts(df, as_of=as_of, active_days=active_days).where(F.col("is_active"))


def activity_inactive(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    return activity_accounts(df, as_of=as_of, active_days=active_days).where(~F.col("is_active"))
