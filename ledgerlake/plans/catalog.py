"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every query reads the whole driver tables through an adapter view and runs a
library operator over it. ``AS_OF`` values are fixed so results are
reproducible (the reports take ``as_of`` instead of the wall clock).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, balance, merchants, outliers, quality, shared, stats, temporal
from ..schema import CANONICAL_COLUMNS
from ..sources import adapters
from . import oracle as O
from .oracle import floor_days as FD
from .oracle import mean_2dp as M2
from .oracle import money as MO
from .oracle import pct as PCT
from .oracle import ts as TS

AS_OF_ORDERS = "2002-01-01 00:00:00"
AS_OF_EVENTS = "2024-02-10 00:00:00"
FILTER_START, FILTER_END = "1996-03-01", "1998-06-30"

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def attach_oracle(name: str, sql: str) -> None:
    """Give an already registered query its oracle SQL (used where the SQL
    is built from pieces defined further down this module)."""
    fn, old = REGISTRY[name]
    if old is not None:
        raise ValueError(f"query {name!r} already has an oracle")
    REGISTRY[name] = (fn, sql)


def orders(spark, sf):
    return adapters.orders_transactions(spark, sf)


def events(spark, sf):
    return adapters.events_transactions(spark, sf)


# ------------------------------------------------------------------ stats

_AMOUNT_SQL = f"""
  count(*) FILTER (WHERE amount > 0) AS positive_transactions,
  count(*) FILTER (WHERE amount < 0) AS negative_transactions,
  count(*) FILTER (WHERE amount = 0) AS zero_transactions,
  {MO("coalesce(sum(amount), 0)")} AS total_value,
  {MO("coalesce(sum(amount) FILTER (WHERE amount > 0), 0)")} AS total_credits,
  {MO("coalesce(sum(amount) FILTER (WHERE amount < 0), 0)")} AS total_debits,
  {MO("coalesce(sum(amount), 0)")} AS net_position,
  coalesce(CASE WHEN count(amount) > 0 THEN CAST(sum(abs(amount)) AS DOUBLE) / count(amount) END, 0.0) AS avg_transaction_size,
  {MO("coalesce(max(amount) FILTER (WHERE amount > 0), 0)")} AS largest_credit,
  {MO("coalesce(min(amount) FILTER (WHERE amount < 0), 0)")} AS largest_debit
"""

_OVERVIEW_SQL = f"""
  count(*) AS total_transactions,
  count(DISTINCT account_number) AS unique_accounts,
  count(DISTINCT main_description) AS unique_merchants,
  array_to_string(list_sort(list(DISTINCT currency) FILTER (WHERE currency IS NOT NULL)), ',') AS currencies,
  min(transaction_date) AS earliest_date,
  max(transaction_date) AS latest_date,
  count(DISTINCT transaction_date) AS unique_dates,
  {FD("max(transaction_date)", "min(transaction_date)")} AS date_span_days
"""


@register("overview", O.with_txn("orders", f"SELECT {_OVERVIEW_SQL} FROM txn"))
def q_overview(spark, sf):
    return stats.overview(orders(spark, sf))


@register("amount_summary", O.with_txn("orders", f"SELECT {_AMOUNT_SQL} FROM txn"))
def q_amount_summary(spark, sf):
    return stats.amount_summary(orders(spark, sf))


@register("basic_statistics", O.with_txn("orders", f"SELECT {_OVERVIEW_SQL}, {_AMOUNT_SQL} FROM txn"))
def q_basic_statistics(spark, sf):
    return stats.basic_statistics(orders(spark, sf))


@register(
    "per_account_overview",
    O.with_txn(
        "orders",
        f"SELECT account_number, {_OVERVIEW_SQL}, {_AMOUNT_SQL} FROM txn GROUP BY account_number",
    ),
)
def q_per_account_overview(spark, sf):
    return stats.basic_statistics(orders(spark, sf), by=["account_number"])


@register(
    "cash_flow_summary",
    O.with_txn(
        "orders",
        f"""SELECT {MO("coalesce(sum(amount) FILTER (WHERE amount > 0), 0)")} AS total_income,
                   {MO("coalesce(sum(amount) FILTER (WHERE amount < 0), 0)")} AS total_expenses,
                   {MO("coalesce(sum(amount), 0)")} AS net_cash_flow,
                   count(*) FILTER (WHERE amount > 0) AS income_transaction_count,
                   count(*) FILTER (WHERE amount < 0) AS expense_transaction_count
            FROM txn""",
    ),
)
def q_cash_flow_summary(spark, sf):
    return stats.cash_flow_summary(orders(spark, sf))


@register(
    "zero_amounts",
    O.with_txn(
        "orders",
        f"SELECT count(*) FILTER (WHERE amount = 0) AS zero_count, {PCT('count(*) FILTER (WHERE amount = 0)', 'count(*)')} AS zero_percentage FROM txn",
    ),
)
def q_zero_amounts(spark, sf):
    return stats.zero_amounts(orders(spark, sf))


@register(
    "sign_split",
    O.with_txn(
        "orders",
        f"""SELECT CASE WHEN amount > 0 THEN 'credit' WHEN amount < 0 THEN 'debit' WHEN amount = 0 THEN 'zero' END AS direction,
                   count(*) AS transaction_count, {MO("sum(amount)")} AS total_amount
            FROM txn WHERE amount IS NOT NULL GROUP BY 1""",
    ),
)
def q_sign_split(spark, sf):
    return stats.sign_split(orders(spark, sf))


@register(
    "date_filter",
    O.with_txn(
        "orders",
        f"""SELECT * FROM txn
            WHERE transaction_date >= {TS(FILTER_START + ' 00:00:00')} AND transaction_date <= {TS(FILTER_END + ' 00:00:00')}""",
    ),
)
def q_date_filter(spark, sf):
    return stats.date_filter(orders(spark, sf), FILTER_START, FILTER_END)


@register(
    "filter_impact",
    O.with_txn(
        "orders",
        f"""SELECT count(*) AS rows_before,
                   count(*) FILTER (WHERE transaction_date >= {TS(FILTER_START + ' 00:00:00')} AND transaction_date <= {TS(FILTER_END + ' 00:00:00')}) AS rows_after,
                   {PCT(f"count(*) FILTER (WHERE transaction_date >= {TS(FILTER_START + ' 00:00:00')} AND transaction_date <= {TS(FILTER_END + ' 00:00:00')})", "count(*)")} AS retention_percentage
            FROM txn""",
    ),
)
def q_filter_impact(spark, sf):
    return stats.filter_impact(orders(spark, sf), FILTER_START, FILTER_END)


@register(
    "account_filter",
    O.with_txn(
        "orders",
        """SELECT * FROM txn WHERE account_number IN
             (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey IN (1, 2, 3, 5, 8, 13))""",
    ),
)
def q_account_filter(spark, sf):
    wanted = adapters.table(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 2, 3, 5, 8, 13)).select("c_custkey")
    return stats.account_filter(orders(spark, sf), wanted)


# --------------------------------------------------------------- temporal

_DATED = "WHERE transaction_date IS NOT NULL"


@register(
    "monthly_summary",
    O.with_txn(
        "orders",
        f"""SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
                   count(amount) AS transaction_count,
                   {MO("coalesce(sum(amount), 0)")} AS total_amount,
                   {M2("coalesce(sum(amount), 0)", "count(amount)")} AS avg_amount,
                   count(DISTINCT transaction_date) AS active_days
            FROM txn {_DATED} GROUP BY 1, 2""",
    ),
)
def q_monthly_summary(spark, sf):
    return temporal.monthly_summary(orders(spark, sf))


@register(
    "monthly_cash_flow",
    O.with_txn(
        "orders",
        f"""SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
                   {MO("coalesce(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0)")} AS income,
                   {MO("coalesce(sum(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0)")} AS expenses,
                   {MO("coalesce(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) + coalesce(sum(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0)")} AS net_flow
            FROM txn {_DATED} GROUP BY 1, 2""",
    ),
)
def q_monthly_cash_flow(spark, sf):
    return temporal.monthly_cash_flow(orders(spark, sf))


@register(
    "cash_flow_monthly",
    O.with_txn(
        "orders",
        f"""SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS year_month,
                   {MO("coalesce(sum(amount) FILTER (WHERE amount > 0), 0)")} AS monthly_income,
                   {MO("coalesce(sum(amount) FILTER (WHERE amount < 0), 0)")} AS monthly_expenses,
                   {MO("coalesce(sum(amount), 0)")} AS monthly_net
            FROM txn {_DATED} GROUP BY 1""",
    ),
)
def q_cash_flow_monthly(spark, sf):
    return temporal.cash_flow_monthly(orders(spark, sf))


@register(
    "weekday_patterns",
    O.with_txn(
        "events",
        f"""SELECT CAST(isodow(transaction_date) - 1 AS INTEGER) AS day_of_week, count(*) AS transaction_count,
                   (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[isodow(transaction_date)] AS day_name
            FROM txn {_DATED} GROUP BY 1, 3""",
    ),
)
def q_weekday_patterns(spark, sf):
    return temporal.weekday_patterns(events(spark, sf))


@register(
    "daily_frequency",
    O.with_txn(
        "events",
        """SELECT CAST(sum(cnt) AS DOUBLE) / count(*) AS avg_transactions_per_day,
                  max(cnt) AS max_transactions_per_day, min(cnt) AS min_transactions_per_day,
                  (SELECT day FROM d ORDER BY cnt DESC, day LIMIT 1) AS busiest_day,
                  (SELECT day FROM d ORDER BY cnt ASC, day LIMIT 1) AS quietest_day
           FROM d""",
        extra_ctes=f"d AS (SELECT CAST(transaction_date AS DATE) AS day, count(*) AS cnt FROM txn {_DATED} GROUP BY 1)",
    ),
)
def q_daily_frequency(spark, sf):
    return temporal.daily_frequency(events(spark, sf))


def _trend_sql(key: str, name: str, prefix: str, tail: int | None) -> str:
    lim = f"ORDER BY {name} DESC LIMIT {tail}" if tail else ""
    return O.with_txn(
        "orders",
        f"""SELECT {key} AS {name}, count(amount) AS {prefix}_transaction_count,
                   {MO("coalesce(sum(amount), 0)")} AS {prefix}_total_amount,
                   {M2("coalesce(sum(amount), 0)", "count(amount)")} AS {prefix}_avg_amount
            FROM txn {_DATED} GROUP BY 1 {lim}""",
    )


@register("trend_daily", _trend_sql("CAST(transaction_date AS DATE)", "day", "daily", 30))
def q_trend_daily(spark, sf):
    return temporal.trend_daily(orders(spark, sf))


@register("trend_weekly", _trend_sql("CAST(date_trunc('week', transaction_date) AS DATE)", "week_start", "weekly", 12))
def q_trend_weekly(spark, sf):
    return temporal.trend_weekly(orders(spark, sf))


@register("trend_monthly", _trend_sql("CAST(date_trunc('month', transaction_date) AS DATE)", "month", "monthly", None))
def q_trend_monthly(spark, sf):
    return temporal.trend_monthly(orders(spark, sf))


@register(
    "growth_mom",
    O.with_txn(
        "orders",
        f"""SELECT l.month AS latest_month, {MO("l.total")} AS latest_month_amount, {MO("p.total")} AS previous_month_amount,
                   round(CAST(l.total - p.total AS DOUBLE) / CAST(abs(p.total) AS DOUBLE) * 100, 2) AS month_over_month_change
            FROM r l JOIN r p ON l.rk = 1 AND p.rk = 2 WHERE p.total <> 0""",
        extra_ctes=f"""m AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, coalesce(sum(amount), 0) AS total
                             FROM txn {_DATED} GROUP BY 1),
                       r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS rk FROM m)""",
    ),
)
def q_growth_mom(spark, sf):
    return temporal.growth_mom(orders(spark, sf))


# --------------------------------------------------------------- accounts


@register("account_overview", O.with_txn("orders", "SELECT count(DISTINCT account_number) AS total_accounts FROM txn"))
def q_account_overview(spark, sf):
    return accounts.account_overview(orders(spark, sf))


@register(
    "account_distribution",
    O.with_txn("orders", "SELECT account_number, count(*) AS transaction_count FROM txn WHERE account_number IS NOT NULL GROUP BY 1"),
)
def q_account_distribution(spark, sf):
    return accounts.account_distribution(orders(spark, sf))


@register(
    "account_financials",
    O.with_txn(
        "events",
        f"""SELECT account_number, count(*) AS transaction_count,
                   min(transaction_date) AS first_transaction, max(transaction_date) AS last_transaction,
                   {MO("coalesce(sum(amount) FILTER (WHERE amount > 0), 0)")} AS total_credits,
                   {MO("coalesce(sum(amount) FILTER (WHERE amount < 0), 0)")} AS total_debits,
                   {MO("coalesce(sum(amount), 0)")} AS net_position,
                   coalesce({M2("coalesce(sum(amount), 0)", "count(amount)")}, CAST(0 AS DECIMAL(38,2))) AS avg_transaction,
                   {MO("max_by(balance, (transaction_date, row_id)) FILTER (WHERE transaction_date IS NOT NULL AND balance IS NOT NULL)")} AS current_balance
            FROM txn WHERE account_number IS NOT NULL GROUP BY 1""",
    ),
)
def q_account_financials(spark, sf):
    return accounts.account_financials(events(spark, sf))


def _account_activity_sql(source: str, as_of: str) -> str:
    ref = f"CASE WHEN {FD(TS(as_of), 'last_transaction')} > 30 THEN last_transaction ELSE {TS(as_of)} END"
    return O.with_txn(
        source,
        f"""SELECT l.account_number, l.last_transaction,
                   {FD(TS(as_of), 'l.last_transaction')} AS days_since_last_transaction,
                   coalesce({FD(TS(as_of), 'l.last_transaction')} <= 90, false) AS is_active,
                   CASE WHEN {FD(TS(as_of), 'l.last_transaction')} > 30 THEN 'data_end' ELSE 'current_date' END AS reference_date_used,
                   coalesce({FD(TS(as_of), 'l.last_transaction')} > 30, false) AS is_historical_data,
                   count(*) FILTER (WHERE epoch_us(t.transaction_date) > epoch_us(l.ref) - {30 * O.MICROS_PER_DAY}) AS transactions_last_30_days
            FROM txn t JOIN l ON t.account_number = l.account_number
            GROUP BY l.account_number, l.last_transaction, l.ref""",
        extra_ctes=f"""l0 AS (SELECT account_number, max(transaction_date) AS last_transaction FROM txn
                              WHERE account_number IS NOT NULL GROUP BY 1),
                       l AS (SELECT *, {ref} AS ref FROM l0)""",
    )


@register("account_activity", _account_activity_sql("events", AS_OF_EVENTS))
def q_account_activity(spark, sf):
    return accounts.account_activity(events(spark, sf), as_of=AS_OF_EVENTS)


@register("account_activity_orders", _account_activity_sql("orders", AS_OF_ORDERS))
def q_account_activity_orders(spark, sf):
    return accounts.account_activity(orders(spark, sf), as_of=AS_OF_ORDERS)


def _ctx_ctes(as_of: str, active_days: int = 90) -> str:
    return f"""
    c0 AS (SELECT min(transaction_date) AS data_start, max(transaction_date) AS data_end FROM txn),
    c1 AS (SELECT *, {FD('data_end', 'data_start')} AS period_days, {FD(TS(as_of), 'data_end')} AS days_since_data_end FROM c0),
    ctx AS (SELECT data_start, data_end, period_days, days_since_data_end,
                   CASE WHEN days_since_data_end > 30 THEN 'Historical' ELSE 'Current' END AS analysis_context,
                   CASE WHEN days_since_data_end > 30 THEN data_end ELSE {TS(as_of)} END AS reference_date,
                   {active_days} AS configured_threshold_days,
                   CASE WHEN period_days < {active_days} THEN greatest(CAST(30.0 AS DOUBLE), period_days * CAST(0.33 AS DOUBLE))
                        ELSE CAST({active_days} AS DOUBLE) END AS threshold_days,
                   period_days < {active_days} AS is_adaptive
            FROM c1)"""


def _ctx_select() -> str:
    return "SELECT *, CAST(trunc(threshold_days) AS BIGINT) AS applied_threshold_days FROM ctx"


def _activity_ctes(as_of: str) -> str:
    return _ctx_ctes(as_of) + f""",
    a0 AS (SELECT t.account_number,
                  max(t.transaction_date) AS last_transaction_date, min(t.transaction_date) AS first_transaction_date,
                  count(*) AS total_transactions,
                  count(*) FILTER (WHERE epoch_us(t.transaction_date) > epoch_us(c.reference_date) - c.threshold_days * CAST({O.MICROS_PER_DAY} AS DOUBLE)) AS recent_transactions_90_days,
                  count(*) FILTER (WHERE epoch_us(t.transaction_date) > epoch_us(c.reference_date) - {30 * O.MICROS_PER_DAY}) AS very_recent_transactions_30_days,
                  coalesce(sum(t.amount), 0) AS s, count(t.amount) AS na,
                  any_value(c.reference_date) AS ref, any_value(c.threshold_days) AS thr
           FROM txn t CROSS JOIN ctx c WHERE t.account_number IS NOT NULL GROUP BY t.account_number),
    a1 AS (SELECT *, {FD('ref', 'last_transaction_date')} AS days_since_last_transaction,
                  {FD('ref', 'first_transaction_date')} AS days_since_first_transaction,
                  {FD('last_transaction_date', 'first_transaction_date')} + 1 AS account_active_period_days
           FROM a0),
    a2 AS (SELECT *, coalesce(days_since_last_transaction <= thr, false) AS c1,
                  recent_transactions_90_days > 0 AS c2,
                  coalesce(account_active_period_days > 30 AND total_transactions / greatest(1, account_active_period_days) >= 0.1, false) AS c3
           FROM a1),
    a3 AS (SELECT *, CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) AS met FROM a2),
    acc AS (SELECT account_number,
                   CASE WHEN met >= 2 OR (met >= 1 AND total_transactions >= 10) THEN 'Active' ELSE 'Inactive' END AS status,
                   round(least(100.0, met / 3 * 100 + least(total_transactions, 50) / 50 * 20), 1) AS confidence_score,
                   total_transactions, recent_transactions_90_days, very_recent_transactions_30_days,
                   days_since_last_transaction, days_since_first_transaction, account_active_period_days,
                   round(total_transactions / greatest(1, account_active_period_days), 3) AS activity_intensity,
                   last_transaction_date, first_transaction_date,
                   {MO('s')} AS total_amount,
                   coalesce({M2('s', 'na')}, CAST(0 AS DECIMAL(38,2))) AS avg_transaction_amount,
                   (met >= 2 OR (met >= 1 AND total_transactions >= 10)) AS is_active,
                   concat_ws(', ', CASE WHEN c1 THEN 'Recent transactions' END,
                                   CASE WHEN c2 THEN 'Activity in threshold period' END,
                                   CASE WHEN c3 THEN 'Consistent activity pattern' END) AS activity_criteria_met,
                   CAST(met AS VARCHAR) || '/3' AS criteria_score
            FROM a3)"""


@register("activity_context", O.with_txn("events", _ctx_select(), extra_ctes=_ctx_ctes(AS_OF_EVENTS)))
def q_activity_context(spark, sf):
    return accounts.activity_context(events(spark, sf), as_of=AS_OF_EVENTS)


@register("activity_context_orders", O.with_txn("orders", _ctx_select(), extra_ctes=_ctx_ctes(AS_OF_ORDERS)))
def q_activity_context_orders(spark, sf):
    return accounts.activity_context(orders(spark, sf), as_of=AS_OF_ORDERS)


@register("activity_accounts", O.with_txn("events", "SELECT * FROM acc", extra_ctes=_activity_ctes(AS_OF_EVENTS)))
def q_activity_accounts(spark, sf):
    return accounts.activity_accounts(events(spark, sf), as_of=AS_OF_EVENTS)


@register("activity_accounts_orders", O.with_txn("orders", "SELECT * FROM acc", extra_ctes=_activity_ctes(AS_OF_ORDERS)))
def q_activity_accounts_orders(spark, sf):
    return accounts.activity_accounts(orders(spark, sf), as_of=AS_OF_ORDERS)


@register("activity_active", O.with_txn("orders", "SELECT * FROM acc WHERE is_active", extra_ctes=_activity_ctes(AS_OF_ORDERS)))
def q_activity_active(spark, sf):
    return accounts.activity_active(orders(spark, sf), as_of=AS_OF_ORDERS)


@register("activity_inactive", O.with_txn("orders", "SELECT * FROM acc WHERE NOT is_active", extra_ctes=_activity_ctes(AS_OF_ORDERS)))
def q_activity_inactive(spark, sf):
    return accounts.activity_inactive(orders(spark, sf), as_of=AS_OF_ORDERS)


@register(
    "activity_summary",
    O.with_txn(
        "events",
        f"""SELECT c.analysis_context, c.reference_date, c.data_start, c.data_end, c.period_days, c.days_since_data_end,
                   c.configured_threshold_days, CAST(trunc(c.threshold_days) AS BIGINT) AS applied_threshold_days, c.is_adaptive,
                   s.total_accounts, s.active_accounts, s.inactive_accounts,
                   round({PCT('s.active_accounts', 's.total_accounts')}, 2) AS active_percentage,
                   round({PCT('s.inactive_accounts', 's.total_accounts')}, 2) AS inactive_percentage,
                   s.high_confidence_active, s.moderate_confidence_active, s.low_confidence_active
            FROM s CROSS JOIN ctx c""",
        extra_ctes=_activity_ctes(AS_OF_EVENTS)
        + """,
    s AS (SELECT count(*) AS total_accounts, count(*) FILTER (WHERE is_active) AS active_accounts,
                 count(*) FILTER (WHERE NOT is_active) AS inactive_accounts,
                 count(*) FILTER (WHERE is_active AND confidence_score >= 80) AS high_confidence_active,
                 count(*) FILTER (WHERE is_active AND confidence_score >= 50 AND confidence_score < 80) AS moderate_confidence_active,
                 count(*) FILTER (WHERE is_active AND confidence_score < 50) AS low_confidence_active
          FROM acc)""",
    ),
)
def q_activity_summary(spark, sf):
    return accounts.activity_summary(events(spark, sf), as_of=AS_OF_EVENTS)


# -------------------------------------------------------------- merchants

_MC = "mc AS (SELECT main_description, count(*) AS transaction_count FROM txn WHERE main_description IS NOT NULL GROUP BY 1)"


@register(
    "merchant_frequency",
    O.with_txn(
        "orders",
        """SELECT count(*) AS total_unique_merchants,
                  count(*) FILTER (WHERE transaction_count = 1) AS single_occurrence_merchants,
                  count(*) FILTER (WHERE transaction_count >= 5) AS frequent_merchants FROM mc""",
        extra_ctes=_MC,
    ),
)
def q_merchant_frequency(spark, sf):
    return merchants.merchant_frequency(orders(spark, sf))


@register(
    "top_merchants",
    O.with_txn("lineitem", "SELECT * FROM mc ORDER BY transaction_count DESC, main_description LIMIT 15", extra_ctes=_MC),
)
def q_top_merchants(spark, sf):
    return merchants.top_merchants(adapters.lineitem_transactions(spark, sf), n=15)


@register(
    "merchant_expense_top",
    O.with_txn(
        "orders",
        f"""SELECT main_description, {MO("abs(sum(amount))")} AS expense_amount FROM txn
            WHERE amount < 0 AND main_description IS NOT NULL GROUP BY 1
            ORDER BY expense_amount DESC, main_description LIMIT 15""",
    ),
)
def q_merchant_expense_top(spark, sf):
    return merchants.merchant_expense_top(orders(spark, sf), n=15)


@register(
    "merchant_revenue_top",
    O.with_txn(
        "orders",
        f"""SELECT main_description, {MO("sum(amount)")} AS revenue_amount FROM txn
            WHERE amount > 0 AND main_description IS NOT NULL GROUP BY 1
            ORDER BY revenue_amount DESC, main_description LIMIT 15""",
    ),
)
def q_merchant_revenue_top(spark, sf):
    return merchants.merchant_revenue_top(orders(spark, sf), n=15)


# ---------------------------------------------------------------- quality


def _missing_sql(source: str) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
                   round({PCT(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')}, 2) AS missing_percentage,
                   count(*) FILTER (WHERE {c} IS NULL) < count(*) AS has_data FROM txn"""
        for c in CANONICAL_COLUMNS
    ]
    return O.with_txn(source, "\nUNION ALL\n".join(parts))


@register("missing_data", _missing_sql("orders"))
def q_missing_data(spark, sf):
    return quality.missing_data(orders(spark, sf))


@register(
    "extreme_amounts",
    O.with_txn(
        "orders",
        f"""SELECT count(*) FILTER (WHERE abs(CAST(t.amount AS DOUBLE) - s.m) > 5.0 * s.sd) AS extreme_count,
                   CAST(round(CAST(any_value(5.0 * s.sd) AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) AS threshold,
                   {PCT('count(*) FILTER (WHERE abs(CAST(t.amount AS DOUBLE) - s.m) > 5.0 * s.sd)', 'any_value(s.n)')} AS extreme_percentage
            FROM txn t CROSS JOIN s""",
        extra_ctes="s AS (SELECT CAST(sum(amount) AS DOUBLE) / count(amount) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS sd, count(*) AS n FROM txn)",
    ),
)
def q_extreme_amounts(spark, sf):
    return quality.extreme_amounts(orders(spark, sf))


@register(
    "currency_distribution",
    O.with_txn(
        "orders",
        """SELECT currency, count(*) AS transaction_count,
                  CASE WHEN count(*) OVER () > 1 THEN 'Multiple currencies detected' END AS issue
           FROM txn WHERE currency IS NOT NULL GROUP BY 1""",
    ),
)
def q_currency_distribution(spark, sf):
    return quality.currency_distribution(orders(spark, sf))


@register(
    "date_quality",
    O.with_txn(
        "orders",
        f"""SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS parse_failures,
                   count(*) FILTER (WHERE transaction_date IS NULL) AS null_dates,
                   min(transaction_date) AS min_date, max(transaction_date) AS max_date,
                   count(DISTINCT transaction_date) AS unique_dates,
                   count(*) FILTER (WHERE transaction_date > {TS('1999-01-01 00:00:00')}) AS future_dates,
                   count(*) FILTER (WHERE transaction_date < {TS('1900-01-01 00:00:00')}) AS dates_before_1900,
                   {FD('max(transaction_date)', 'min(transaction_date)')} AS span_days
            FROM txn""",
    ),
)
def q_date_quality(spark, sf):
    return quality.date_quality(orders(spark, sf), as_of="1999-01-01 00:00:00")


# --------------------------------------------------------------- outliers


@register(
    "iqr_outliers",
    O.with_txn(
        "orders",
        f"""SELECT q25, q75, iqr, CAST(q25 - CAST(1.5 AS DECIMAL(2,1)) * iqr AS DECIMAL(38,6)) AS lower_bound, CAST(ub AS DECIMAL(38,6)) AS upper_bound,
                   (SELECT count(*) FROM txn WHERE abs(amount) > ub) AS outlier_count,
                   {PCT('(SELECT count(*) FROM txn WHERE abs(amount) > ub)', '(SELECT count(*) FROM txn)')} AS outlier_percentage
            FROM (SELECT *, q75 + CAST(1.5 AS DECIMAL(2,1)) * iqr AS ub FROM (SELECT *, q75 - q25 AS iqr FROM q))""",
        extra_ctes="""q AS (SELECT CAST(qs[1] AS DECIMAL(38,6)) AS q25, CAST(qs[2] AS DECIMAL(38,6)) AS q75
                             FROM (SELECT quantile_cont(CAST(abs(amount) AS DOUBLE), [0.25, 0.75]) AS qs FROM txn))""",
    ),
)
def q_iqr_outliers(spark, sf):
    return outliers.iqr_outliers(orders(spark, sf))


@register(
    "large_transactions",
    O.with_txn(
        "orders",
        f"""SELECT threshold, (SELECT count(*) FROM txn WHERE abs(amount) > threshold) AS large_count,
                   {PCT('(SELECT count(*) FROM txn WHERE abs(amount) > threshold)', '(SELECT count(*) FROM txn)')} AS large_percentage
            FROM (SELECT CAST(quantile_cont(CAST(abs(amount) AS DOUBLE), 0.95) AS DECIMAL(38,6)) AS threshold FROM txn)""",
    ),
)
def q_large_transactions(spark, sf):
    return outliers.large_transactions(orders(spark, sf))


@register(
    "top_outliers",
    O.with_txn(
        "orders",
        f"""SELECT row_id, transaction_date AS date, account_number AS account, substr(main_description, 1, 50) AS description,
                   {MO('amount')} AS amount, {MO('abs(amount)')} AS abs_amount
            FROM txn WHERE amount IS NOT NULL ORDER BY abs(amount) DESC, row_id LIMIT 10""",
    ),
)
def q_top_outliers(spark, sf):
    return outliers.top_outliers(orders(spark, sf))


@register(
    "duplicates",
    O.with_txn(
        "orders",
        f"""SELECT CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS duplicate_count,
                   {PCT('coalesce(sum(c) FILTER (WHERE c > 1), 0)', 'sum(c)')} AS duplicate_percentage
            FROM (SELECT count(*) AS c FROM txn GROUP BY transaction_date, amount)""",
    ),
)
def q_duplicates(spark, sf):
    return outliers.duplicates(orders(spark, sf))


@register(
    "duplicate_rows",
    O.with_txn(
        "orders",
        """SELECT t.* FROM txn t WHERE EXISTS (
             SELECT 1 FROM (SELECT transaction_date, amount FROM txn GROUP BY 1, 2 HAVING count(*) > 1) k
             WHERE t.transaction_date IS NOT DISTINCT FROM k.transaction_date AND t.amount IS NOT DISTINCT FROM k.amount)""",
    ),
)
def q_duplicate_rows(spark, sf):
    return outliers.duplicate_rows(orders(spark, sf))


# ---------------------------------------------------------------- balance

_RUN_CTES = """
r0 AS (SELECT account_number, row_id, transaction_date, amount, balance,
              sum(amount) OVER (PARTITION BY account_number ORDER BY transaction_date, row_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              first_value(balance) OVER (PARTITION BY account_number ORDER BY transaction_date, row_id) AS fb,
              first_value(amount) OVER (PARTITION BY account_number ORDER BY transaction_date, row_id) AS fa,
              count(*) OVER (PARTITION BY account_number) AS account_rows
       FROM txn WHERE account_number IS NOT NULL AND transaction_date IS NOT NULL),
rb AS (SELECT account_number, row_id, transaction_date, amount, balance, fb - fa + cum AS calculated_balance,
              abs(balance - (fb - fa + cum)) AS difference, account_rows FROM r0)"""


@register("running_balance", O.with_txn("events", "SELECT * FROM rb", extra_ctes=_RUN_CTES))
def q_running_balance(spark, sf):
    return balance.running_balance(events(spark, sf))


@register(
    "balance_check",
    O.with_txn(
        "events",
        f"""SELECT account_number, {MO('max(difference)')} AS max_difference,
                   CAST(sum(difference) AS DOUBLE) / count(difference) AS avg_difference,
                   coalesce(max(difference) < 0.01, false) AS is_valid,
                   count(*) FILTER (WHERE difference > 0.01) AS error_count
            FROM rb WHERE account_rows > 1 GROUP BY 1 HAVING count(balance) > 0""",
        extra_ctes=_RUN_CTES,
    ),
)
def q_balance_check(spark, sf):
    return balance.balance_check(events(spark, sf))


# -------------------------------------------------------------- ingestion

from ..functions import text as T  # noqa: E402
from ..operators import categorize as C  # noqa: E402
from ..operators import charts as CH  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import ingest  # noqa: E402
from . import report as R  # noqa: E402


def raw_orders_statement(spark, sf):
    """orders as a statement file would arrive: every column a string, with
    deterministic bad dates, blank / 'nan' descriptions, unparsable amounts and
    missing currencies."""
    o = adapters.table(spark, sf, "orders")
    c = adapters.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_custkey").cast("string").alias("AccNo"),
        F.when(k % 101 == 0, F.lit("bad-date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.when(k % 53 == 0, F.lit("  ")).when(k % 59 == 0, F.lit("nan"))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))
        .alias("MainDesc"),
        F.when(k % 61 == 0, F.lit("1,5")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Amount"),
        F.when(k % 67 == 0, F.lit(None).cast("string")).otherwise(F.lit("GBP")).alias("Currency"),
        F.col("o_orderstatus").alias("TransactionType"),
        F.col("o_orderpriority").alias("Priority"),
    )


def raw_events_statement(spark, sf):
    e = adapters.table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("AccNo"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.col("event_type").alias("MainDesc"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("Amount"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("Balance"),
        F.col("props").alias("AddDesc"),
    )


_RAW_ORDERS_SQL = """
    SELECT CAST(o.o_custkey AS VARCHAR) AS AccNo,
           CASE WHEN o.o_orderkey % 101 = 0 THEN 'bad-date' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS Date,
           CASE WHEN o.o_orderkey % 53 = 0 THEN '  ' WHEN o.o_orderkey % 59 = 0 THEN 'nan'
                ELSE ' ' || c.c_mktsegment || ' ' END AS MainDesc,
           CASE WHEN o.o_orderkey % 61 = 0 THEN '1,5' ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS Amount,
           CASE WHEN o.o_orderkey % 67 = 0 THEN NULL ELSE 'GBP' END AS Currency,
           o.o_orderstatus AS TransactionType,
           o.o_orderpriority AS Priority
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

_RAW_EVENTS_SQL = """
    SELECT CAST(user_id AS VARCHAR) AS AccNo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS Date, event_type AS MainDesc,
           CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS Amount, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS Balance,
           props AS AddDesc
    FROM events"""


def _std_sql(raw: str, has_balance: bool, has_currency: bool, has_type: bool, has_add: bool, extras: list[str]) -> str:
    desc = "regexp_replace(MainDesc, '^\\s+|\\s+$', '', 'g')"
    add = "regexp_replace(AddDesc, '^\\s+|\\s+$', '', 'g')"
    date = ("coalesce(try_strptime(trim(Date), '%Y-%m-%d'), try_strptime(trim(Date), '%Y-%m-%d %H:%M:%S'), "
            "try_strptime(trim(Date), '%m/%d/%Y'))")
    cols = [
        "trim(CAST(AccNo AS VARCHAR)) AS account_number",
        f"CAST({date} AS TIMESTAMP) AS transaction_date",
        f"CASE WHEN {desc} IN ('', 'nan') THEN NULL ELSE {desc} END AS main_description",
        (f"coalesce(CASE WHEN {add} IN ('', 'nan') THEN NULL ELSE {add} END, '') AS additional_description"
         if has_add else "CAST(NULL AS VARCHAR) AS additional_description"),
        "coalesce(TransactionType, 'UNKNOWN') AS transaction_type" if has_type else "CAST(NULL AS VARCHAR) AS transaction_type",
        "TRY_CAST(trim(Amount) AS DECIMAL(28,6)) AS amount",
        "TRY_CAST(trim(Balance) AS DECIMAL(28,6)) AS balance" if has_balance else "CAST(NULL AS DECIMAL(28,6)) AS balance",
        "CAST(NULL AS VARCHAR) AS spend_category",
        "coalesce(Currency, 'GBP') AS currency" if has_currency else "CAST(NULL AS VARCHAR) AS currency",
    ] + extras
    return f"SELECT {', '.join(cols)} FROM ({raw}) r"


@register("ingest_statement", "WITH std AS (" + _std_sql(_RAW_ORDERS_SQL, False, True, True, False, ["Priority"]) + ") SELECT * FROM std")
def q_ingest_statement(spark, sf):
    return ingest.to_canonical(ingest.standardise(raw_orders_statement(spark, sf))).drop("row_id")


@register(
    "load_union",
    "SELECT * FROM (" + _std_sql(_RAW_ORDERS_SQL, False, True, True, False, ["Priority"]) + ") "
    "UNION ALL BY NAME SELECT * FROM (" + _std_sql(_RAW_EVENTS_SQL, True, False, False, True, ["CAST(NULL AS VARCHAR) AS Priority"]) + ")",
)
def q_load_union(spark, sf):
    return ingest.union_sources([raw_orders_statement(spark, sf), raw_events_statement(spark, sf)]).drop("row_id")


@register(
    "row_id_uniqueness",
    "SELECT count(*) AS transactions, count(*) AS row_ids FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT event_id FROM events) u",
)
def q_row_id_uniqueness(spark, sf):
    """Ids of two sources of 150 partitions each: as many as there are rows."""
    frames = [raw_orders_statement(spark, sf).repartition(150), raw_events_statement(spark, sf).repartition(150)]
    return ingest.union_sources(frames).agg(F.count(F.lit(1)).alias("transactions"), F.countDistinct("row_id").alias("row_ids"))


def _orders_files(spark, sf) -> str:
    """The raw orders statement written as delimited files to the shared folder,
    some descriptions over two lines, some with quotes and separators."""
    k = F.col("TransactionType")
    text = F.concat(F.col("MainDesc"), F.when(k == "F", F.lit('line one\nline "two", end')).when(k == "P", F.lit(', "x"\n\n')).otherwise(F.lit("")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/statement-{uuid.uuid4().hex}.csv"
    raw = raw_orders_statement(spark, sf).withColumn("MainDesc", text)
    raw.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


_FILE_ORDERS_SQL = _RAW_ORDERS_SQL.replace(
    "END AS MainDesc", "END || CASE o.o_orderstatus WHEN 'F' THEN 'line one' || chr(10) || 'line \"two\", end' "
    "WHEN 'P' THEN ', \"x\"' || chr(10) || chr(10) ELSE '' END AS MainDesc")


@register("ingest_csv", "WITH std AS (" + _std_sql(_FILE_ORDERS_SQL, False, True, True, False, ["Priority"]) + ") SELECT * FROM std")
def q_ingest_csv(spark, sf):
    """Delimited files with records over several lines, written and read back."""
    return ingest.load(spark, _orders_files(spark, sf)).drop("row_id")


_PARTIAL_SQL = "SELECT * FROM (" + _std_sql(_FILE_ORDERS_SQL, False, True, True, False, ["Priority"]) + ")"


def _partly_broken(spark, sf) -> ingest.LoadedSources:
    """Three sources: the statement files, events that break while they are read
    (after planning), and a path without files."""
    broken = raw_events_statement(spark, sf).withColumn("Amount", F.when(F.col("AddDesc").isNotNull(), F.raise_error(F.lit("damaged"))).otherwise(F.col("Amount")))
    broken.createOrReplaceTempView("damaged_events")
    return ingest.load_sources(spark, [_orders_files(spark, sf), "table:damaged_events", "/nowhere/x.csv"])


@register("load_many_partial", _PARTIAL_SQL)
def q_load_many_partial(spark, sf):
    return _partly_broken(spark, sf).transactions.drop("row_id")


@register("load_many_errors", "SELECT 'table:damaged_events' AS path, true AS damaged UNION ALL SELECT '/nowhere/x.csv', false")
def q_load_many_errors(spark, sf):
    return _partly_broken(spark, sf).errors.select("path", F.col("error").contains("damaged").alias("damaged"))


@register(
    "load_checks",
    f"""SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE Date IS NOT NULL AND trim(Date) <> '' AND transaction_date IS NULL) AS date_failures,
               count(*) FILTER (WHERE Amount IS NOT NULL AND trim(Amount) <> '' AND parsed_amount IS NULL) AS amount_failures,
               count(*) FILTER (WHERE parsed_amount IS NULL) AS null_amounts, CAST(0 AS BIGINT) AS balance_failures,
               min(transaction_date) AS min_date, max(transaction_date) AS max_date
        FROM (SELECT *, TRY_CAST(trim(Amount) AS DECIMAL(28,6)) AS parsed_amount, try_strptime(trim(Date), '%Y-%m-%d') AS transaction_date
              FROM ({_RAW_ORDERS_SQL}) r) s""",
)
def q_load_checks(spark, sf):
    """What is observed while the statement files are loaded."""
    return ingest.load_sources(spark, [_orders_files(spark, sf)]).checks.drop("path")


@register("row_ids_of_files", "SELECT count(*) AS transactions, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id, count(*) AS ids FROM orders")
def q_row_ids_of_files(spark, sf):
    """Row ids of files are the rows' places, without gaps."""
    df = ingest.load(spark, _orders_files(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("transactions"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.countDistinct("row_id").alias("ids"))


_DATE_FORMS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/M/d", "yyyyMMdd", "dd MMM yyyy"]


def _dates_sql() -> str:
    return ("SELECT CAST(o_orderkey AS VARCHAR) AS account_number, CASE WHEN o_orderkey % 9 <> 7 THEN CAST(o_orderdate AS TIMESTAMP) END "
            "AS transaction_date FROM orders")


def _dates_in_many_forms(spark, sf, slashed: str):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    form = F.col("o_orderkey") % 9
    text = F.date_format("o_orderdate", slashed)
    for i, pattern in enumerate(_DATE_FORMS):
        text = F.when(form == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    text = F.when(form == 7, F.lit("31/31/2024")).otherwise(text)
    return o.select(F.col("o_orderkey").cast("string").alias("AccNo"), text.alias("Date"), F.lit("x").alias("MainDesc"), F.lit("1").alias("Amount"))


@register("ingest_dates", _dates_sql())
def q_ingest_dates(spark, sf):
    return ingest.standardise(_dates_in_many_forms(spark, sf, "M/d/yyyy")).select("account_number", "transaction_date")


@register("ingest_dates_day_first", _dates_sql())
def q_ingest_dates_day_first(spark, sf):
    raw = _dates_in_many_forms(spark, sf, "dd/MM/yyyy")
    return ingest.standardise(raw, date_formats=ingest.date_formats(day_first=True)).select("account_number", "transaction_date")


@register(
    "coercion_failures",
    f"""SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE Date IS NOT NULL AND trim(Date) <> '' AND parsed_date IS NULL) AS date_failures,
               count(*) FILTER (WHERE Amount IS NOT NULL AND trim(Amount) <> '' AND parsed_amount IS NULL) AS amount_failures,
               count(*) FILTER (WHERE parsed_amount IS NULL) AS null_amounts,
               {PCT('count(*) FILTER (WHERE parsed_amount IS NULL)', 'count(*)')} AS null_amount_percentage
        FROM (SELECT *, TRY_CAST(trim(Amount) AS DECIMAL(28,6)) AS parsed_amount,
                     coalesce(try_strptime(trim(Date), '%Y-%m-%d'), try_strptime(trim(Date), '%Y-%m-%d %H:%M:%S'),
                              try_strptime(trim(Date), '%m/%d/%Y')) AS parsed_date
              FROM ({_RAW_ORDERS_SQL}) r) s""",
)
def q_coercion_failures(spark, sf):
    return ingest.coercion_failures(ingest.standardise(raw_orders_statement(spark, sf), keep_raw=True))


@register(
    "load_summary",
    O.with_txn(
        "orders",
        f"""SELECT count(*) AS rows, 10 AS columns, min(transaction_date) AS min_date, max(transaction_date) AS max_date,
                   {FD('max(transaction_date)', 'min(transaction_date)')} AS span_days,
                   count(DISTINCT transaction_date) AS unique_dates, count(DISTINCT account_number) AS accounts
            FROM txn""",
    ),
)
def q_load_summary(spark, sf):
    return ingest.load_summary(orders(spark, sf))


# ---------------------------------------------------------- categorisation

_STOP = ", ".join(f"'{w}'" for w in __import__("ledgerlake.config", fromlist=["x"]).KEYWORD_STOP_WORDS)


def _clean_sql(c: str) -> str:
    from ..config import MERCHANT_NOISE_PATTERNS

    s = f"regexp_replace(upper({c}), '^\\s+|\\s+$', '', 'g')"
    for p in MERCHANT_NOISE_PATTERNS:
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'UNKNOWN' WHEN length({s}) < 2 THEN 'UNKNOWN' ELSE {s} END")


_DESC_CTE = f"d AS (SELECT main_description, count(*) AS description_count, {_clean_sql('main_description')} AS clean_merchant FROM txn GROUP BY 1)"


@register("clean_merchant", O.with_txn("orders", "SELECT * FROM d", extra_ctes=_DESC_CTE))
def q_clean_merchant(spark, sf):
    return C.description_table(orders(spark, sf))


@register(
    "keywords",
    O.with_txn(
        "lineitem",
        f"""SELECT clean_merchant, array_to_string(list_sort(list_distinct(list_filter(
                  list_transform(string_split_regex(regexp_replace(upper(coalesce(clean_merchant, '')), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                 lambda w: regexp_replace(w, '[^\\w]', '', 'g')),
                  lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w) AND NOT regexp_matches(w, '^\\d+$')
                       AND NOT regexp_matches(w, '^\\d+[A-Z]*$')))), ',') AS keywords
            FROM (SELECT DISTINCT clean_merchant FROM d)""",
        extra_ctes=_DESC_CTE,
    ),
)
def q_keywords(spark, sf):
    m = C.description_table(adapters.lineitem_transactions(spark, sf)).select("clean_merchant").distinct()
    return m.select("clean_merchant", F.array_join(T.keywords(F.col("clean_merchant")), ",").alias("keywords"))


@register(
    "frequent_merchants",
    O.with_txn(
        "orders",
        "SELECT clean_merchant, CAST(sum(description_count) AS BIGINT) AS merchant_count FROM d GROUP BY 1 HAVING sum(description_count) >= 5",
        extra_ctes=_DESC_CTE,
    ),
)
def q_frequent_merchants(spark, sf):
    return C.frequent_merchants(orders(spark, sf)).drop("merchant_rank")


@register("similar_pairs", None)
def q_similar_pairs(spark, sf):
    """For each frequent supplier name: how many others resemble it, the one
    that resembles it most and their score."""
    from ..functions.ranges import staged
    from ..functions.similarity import similar_pairs

    # written once, so that no condition on the cleaned name is pushed onto the rows
    m = staged(C.frequent_merchants(adapters.supplier_transactions(spark, sf)).select("clean_merchant"), "frequent")
    left = m.select(F.col("clean_merchant").alias("a"), F.col("clean_merchant").alias("a_text"))
    right = m.select(F.col("clean_merchant").alias("b"), F.col("clean_merchant").alias("b_text"))
    pairs = similar_pairs(left, right, threshold=0.85, left_id="a", left_text="a_text", right_id="b", right_text="b_text", nearest=True)
    return pairs.groupBy(F.col("a").alias("clean_merchant")).agg(
        F.sum("others").alias("similar_merchants"),
        F.min_by("b_text", F.struct(-F.col("score"), F.col("b_text"))).alias("nearest"),
        F.max("score").alias("score"),
    )


def _categorised(spark, sf, source="lineitem", **kw):
    df = adapters.ADAPTERS[source](spark, sf)
    out, cats = C.categorize(df, **kw)
    return df, out, cats


@register("categories", None)
def q_categories(spark, sf):
    df, _out, cats = _categorised(spark, sf)
    return C.category_table(df, cats, descriptions=cats.descriptions)


@register("categories_nogroup", None)
def q_categories_nogroup(spark, sf):
    df, _out, cats = _categorised(spark, sf, source="orders", smart_grouping=False)
    return C.category_table(df, cats, descriptions=cats.descriptions)


@register("categories_supplier", None)
def q_categories_supplier(spark, sf):
    df, _out, cats = _categorised(spark, sf, source="supplier")
    return C.category_table(df, cats, descriptions=cats.descriptions)


@register("assign_categories", None)
def q_assign_categories(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return out


@register("category_members", None)
def q_category_members(spark, sf):
    _df, _out, cats = _categorised(spark, sf)
    return cats.members.select("clean_merchant", "category_name", "category_order", "category_id")


@register("categorisation_stats", None)
def q_categorisation_stats(spark, sf):
    _df, out, cats = _categorised(spark, sf)
    return C.categorisation_stats(out)


@register("category_distribution", None)
def q_category_distribution(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return R.category_distribution_report(out)


@register("category_financials", None)
def q_category_financials(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return R.category_financials(out)


@register("category_expense", None)
def q_category_expense(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return R.category_breakdown(out, side="expense")


@register("category_revenue", None)
def q_category_revenue(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return R.category_breakdown(out, side="revenue")


@register("chart_category_share", None)
def q_chart_category_share(spark, sf):
    _df, out, _cats = _categorised(spark, sf)
    return CH.category_share(out)


# ----------------------------------------------------------------- charts


@register(
    "chart_amount_histogram",
    O.with_txn(
        "orders",
        """SELECT side, bin, lo + bin * ((hi - lo) / 50) AS bin_start, lo + (bin + 1) * ((hi - lo) / 50) AS bin_end, count(*) AS frequency
           FROM (SELECT v.side, b.lo, b.hi, CAST(least(floor((v.x - b.lo) / (b.hi - b.lo) * 50), 49) AS INTEGER) AS bin
                 FROM v JOIN b ON v.side = b.side)
           GROUP BY side, bin, lo, hi""",
        extra_ctes="""v AS (SELECT CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS side, CAST(abs(amount) AS DOUBLE) AS x
                            FROM txn WHERE amount IS NOT NULL AND amount <> 0),
                      b0 AS (SELECT side, min(x) AS lo0, max(x) AS hi0 FROM v GROUP BY 1),
                      b AS (SELECT side, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                                   CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM b0)""",
    ),
)
def q_chart_amount_histogram(spark, sf):
    return CH.amount_histogram(orders(spark, sf))


@register(
    "chart_merchant_frequency",
    O.with_txn(
        "lineitem",
        """SELECT main_description, CASE WHEN length(main_description) > 40 THEN substr(main_description, 1, 40) || '...'
                                       ELSE main_description END AS label, transaction_count
           FROM mc ORDER BY transaction_count DESC, main_description LIMIT 15""",
        extra_ctes=_MC,
    ),
)
def q_chart_merchant_frequency(spark, sf):
    return CH.merchant_frequency_chart(adapters.lineitem_transactions(spark, sf))


@register(
    "chart_monthly_trends",
    O.with_txn(
        "orders",
        f"""SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS year_month, count(amount) AS transaction_count,
                   {MO('coalesce(sum(amount), 0)')} AS total_amount
            FROM txn {_DATED} GROUP BY 1""",
    ),
)
def q_chart_monthly_trends(spark, sf):
    return CH.monthly_trends_chart(orders(spark, sf))


@register(
    "chart_cash_flow",
    O.with_txn(
        "orders",
        f"""SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS year_month,
                   {MO('coalesce(sum(amount) FILTER (WHERE amount > 0), 0)')} AS income,
                   {MO('abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0))')} AS expenses,
                   {MO('coalesce(sum(amount) FILTER (WHERE amount > 0), 0) + coalesce(sum(amount) FILTER (WHERE amount < 0), 0)')} AS net_flow
            FROM txn {_DATED} GROUP BY 1""",
    ),
)
def q_chart_cash_flow(spark, sf):
    return CH.cash_flow_chart(orders(spark, sf))


@register(
    "chart_account_comparison",
    O.with_txn(
        "orders",
        f"""SELECT account_number, transaction_count, {MO('s')} AS total_amount, {M2('s', 'transaction_count')} AS avg_amount
            FROM (SELECT account_number, count(amount) AS transaction_count, coalesce(sum(amount), 0) AS s,
                         count(*) OVER () AS nacc
                  FROM txn WHERE account_number IS NOT NULL GROUP BY 1) WHERE nacc > 1""",
    ),
)
def q_chart_account_comparison(spark, sf):
    return CH.account_comparison(orders(spark, sf))


@register(
    "chart_account_daily_activity",
    O.with_txn(
        "events",
        """SELECT account_number, CAST(transaction_date AS DATE) AS day, count(*) AS transaction_count FROM txn
           WHERE account_number IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2""",
    ),
)
def q_chart_account_daily_activity(spark, sf):
    return CH.account_daily_activity(events(spark, sf))


@register(
    "chart_weekday",
    O.with_txn(
        "orders",
        f"""SELECT CAST(isodow(transaction_date) - 1 AS INTEGER) AS day_of_week,
                   (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[isodow(transaction_date)] AS weekday_name,
                   count(amount) AS transaction_count, {MO('coalesce(sum(amount), 0)')} AS total_amount,
                   {M2('coalesce(sum(amount), 0)', 'count(amount)')} AS avg_amount
            FROM txn {_DATED} GROUP BY 1, 2""",
    ),
)
def q_chart_weekday(spark, sf):
    return CH.weekday_chart(orders(spark, sf))


@register(
    "chart_outliers",
    O.with_txn(
        "orders",
        f"""SELECT row_id,
                   CASE WHEN length(coalesce(main_description, 'Unknown')) > 30
                        THEN substr(coalesce(main_description, 'Unknown'), 1, 30) || '...'
                        ELSE coalesce(main_description, 'Unknown') END AS label,
                   {MO('amount')} AS amount, {MO('abs(amount)')} AS abs_amount,
                   CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS direction
            FROM txn WHERE amount IS NOT NULL ORDER BY abs(amount) DESC, row_id LIMIT 15""",
    ),
)
def q_chart_outliers(spark, sf):
    return CH.outliers_chart(orders(spark, sf))


@register(
    "chart_balance_trend",
    O.with_txn(
        "events",
        f"""SELECT account_number, CAST(transaction_date AS DATE) AS day,
                   {MO('max_by(balance, (transaction_date, row_id))')} AS balance
            FROM txn WHERE account_number IS NOT NULL AND transaction_date IS NOT NULL AND balance IS NOT NULL GROUP BY 1, 2""",
    ),
)
def q_chart_balance_trend(spark, sf):
    return CH.balance_trend(events(spark, sf), daily_close=True)


@register(
    "chart_income_vs_expense",
    O.with_txn(
        "orders",
        f"""SELECT {MO('coalesce(sum(amount) FILTER (WHERE amount > 0), 0)')} AS total_income,
                   {MO('abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0))')} AS total_expenses FROM txn""",
    ),
)
def q_chart_income_vs_expense(spark, sf):
    return CH.income_vs_expense(orders(spark, sf))


# ----------------------------------------------------------------- sheets


@register(
    "sheet_top_merchants",
    O.with_txn(
        "orders",
        "SELECT main_description AS Merchant, transaction_count AS Transaction_Count FROM mc ORDER BY transaction_count DESC, main_description LIMIT 15",
        extra_ctes=_MC,
    ),
)
def q_sheet_top_merchants(spark, sf):
    return R.top_merchants_sheet(orders(spark, sf))


@register(
    "sheet_active_inactive",
    O.with_txn(
        "orders",
        """SELECT account_number, status, total_transactions, recent_transactions_90_days, days_since_last_transaction,
                  strftime(last_transaction_date, '%Y-%m-%d') AS last_transaction_date,
                  strftime(first_transaction_date, '%Y-%m-%d') AS first_transaction_date,
                  total_amount, avg_transaction_amount FROM acc""",
        extra_ctes=_activity_ctes(AS_OF_ORDERS),
    ),
)
def q_sheet_active_inactive(spark, sf):
    return R.activity_sheet(orders(spark, sf), as_of=AS_OF_ORDERS)


@register("sheet_account_analysis", None)
def q_sheet_account_analysis(spark, sf):
    return R.account_sheet(events(spark, sf), as_of=AS_OF_EVENTS)


@register("sheet_executive_summary", None)
def q_sheet_executive_summary(spark, sf):
    return R.executive_summary(orders(spark, sf), analysis_date=AS_OF_ORDERS)


@register("sheet_raw_data", None)
def q_sheet_raw_data(spark, sf):
    return R.export_format(orders(spark, sf))


@register("simple_summary", None)
def q_simple_summary(spark, sf):
    return R.simple_summary(orders(spark, sf))


@register(
    "cover_stats",
    O.with_txn(
        "orders",
        f"""SELECT min(transaction_date) AS period_start, max(transaction_date) AS period_end, count(*) AS total_transactions,
                   count(DISTINCT account_number) AS unique_accounts, {MO('coalesce(sum(abs(amount)), 0)')} AS total_volume FROM txn""",
    ),
)
def q_cover_stats(spark, sf):
    return R.cover_stats(orders(spark, sf))


@register("key_findings", None)
def q_key_findings(spark, sf):
    return R.key_findings(orders(spark, sf))


@register("account_table", None)
def q_account_table(spark, sf):
    return R.account_table(orders(spark, sf), as_of=AS_OF_ORDERS)


@register("completeness_table", None)
def q_completeness_table(spark, sf):
    return R.completeness_table(orders(spark, sf))


@register(
    "per_account_monthly",
    O.with_txn(
        "orders",
        f"""SELECT account_number, CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
                   count(amount) AS transaction_count, {MO('coalesce(sum(amount), 0)')} AS total_amount,
                   {M2('coalesce(sum(amount), 0)', 'count(amount)')} AS avg_amount,
                   count(DISTINCT transaction_date) AS active_days
            FROM txn WHERE transaction_date IS NOT NULL AND account_number IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)
def q_per_account_monthly(spark, sf):
    return R.per_account_reports(orders(spark, sf), as_of=AS_OF_ORDERS)["monthly_summary"]


@register(
    "per_account_top_merchants",
    O.with_txn(
        "orders",
        """SELECT account_number, main_description, transaction_count, CAST(rank AS INTEGER) AS rank FROM (
             SELECT account_number, main_description, count(*) AS transaction_count,
                    row_number() OVER (PARTITION BY account_number ORDER BY count(*) DESC, main_description) AS rank
             FROM txn WHERE main_description IS NOT NULL AND account_number IS NOT NULL GROUP BY 1, 2) WHERE rank <= 15""",
    ),
)
def q_per_account_top_merchants(spark, sf):
    return R.per_account_reports(orders(spark, sf), as_of=AS_OF_ORDERS)["top_merchants"]


# --------------------------------------------------------------- patterns

from ..operators import patterns as P  # noqa: E402


@register(
    "pattern_profile",
    O.with_txn(
        "orders",
        """SELECT count(*) AS total_transactions,
                  count(*) FILTER (WHERE amount > 0) AS positive_count,
                  count(*) FILTER (WHERE amount < 0) AS negative_count,
                  count(*) FILTER (WHERE amount = 0) AS zero_count,
                  coalesce(CAST(sum(amount) FILTER (WHERE amount > 0) AS DOUBLE) / count(amount) FILTER (WHERE amount > 0), 0.0) AS mean_positive,
                  coalesce(CAST(sum(amount) FILTER (WHERE amount < 0) AS DOUBLE) / count(amount) FILTER (WHERE amount < 0), 0.0) AS mean_negative,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.25) AS DECIMAL(38,6)) AS p25,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.5) AS DECIMAL(38,6)) AS p50,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.75) AS DECIMAL(38,6)) AS p75,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.9) AS DECIMAL(38,6)) AS p90,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.95) AS DECIMAL(38,6)) AS p95,
                  CAST(quantile_cont(CAST(amount AS DOUBLE), 0.99) AS DECIMAL(38,6)) AS p99
           FROM txn""",
    ),
)
def q_pattern_profile(spark, sf):
    return P.pattern_profile(orders(spark, sf))


@register(
    "pattern_merchants",
    O.with_txn("lineitem", "SELECT * FROM mc ORDER BY transaction_count DESC, main_description LIMIT 20", extra_ctes=_MC),
)
def q_pattern_merchants(spark, sf):
    return P.pattern_merchants(adapters.lineitem_transactions(spark, sf))


@register(
    "pattern_months",
    O.with_txn("orders", f"SELECT CAST(month(transaction_date) AS INTEGER) AS month, count(*) AS transaction_count FROM txn {_DATED} GROUP BY 1"),
)
def q_pattern_months(spark, sf):
    return P.month_distribution(orders(spark, sf))


@register(
    "pattern_weekdays",
    O.with_txn("events", f"SELECT CAST(isodow(transaction_date) - 1 AS INTEGER) AS day_of_week, count(*) AS transaction_count FROM txn {_DATED} GROUP BY 1"),
)
def q_pattern_weekdays(spark, sf):
    return P.weekday_distribution(events(spark, sf))


@register(
    "merchant_rank",
    O.with_txn(
        "lineitem",
        """SELECT clean_merchant, merchant_count,
                  row_number() OVER (ORDER BY merchant_count DESC, clean_merchant) AS merchant_rank
           FROM (SELECT clean_merchant, CAST(sum(description_count) AS BIGINT) AS merchant_count FROM d GROUP BY 1
                 HAVING sum(description_count) >= 5)""",
        extra_ctes=_DESC_CTE,
    ),
)
def q_merchant_rank(spark, sf):
    return P.merchant_rank(C.frequent_merchants(adapters.lineitem_transactions(spark, sf)).drop("merchant_rank"))


@register("category_summary", None)
def q_category_summary(spark, sf):
    df, _out, cats = _categorised(spark, sf)
    return C.category_summary(df, cats, descriptions=cats.descriptions)


@register("assign_fuzzy", None)
def q_assign_fuzzy(spark, sf):
    """Supplier names, grouping off and 10 categories: the other frequent
    suppliers go through the fuzzy stage (best score, first category on
    ties); distinct (description, category) pairs matched at 0.7."""
    _df, out, _cats = _categorised(spark, sf, source="supplier", smart_grouping=False, max_categories=10)
    return out.where(F.col("category_confidence") == 0.7).select("main_description", "auto_category").distinct()


@register("decimal_compare", O.with_txn(
    "orders",
    """SELECT count(*) FILTER (WHERE coalesce(amount > 100000, false)) AS gt,
              count(*) FILTER (WHERE coalesce(amount <= -100000, false)) AS le,
              count(*) FILTER (WHERE coalesce(amount <> 0, false)) AS ne FROM txn""",
))
def q_decimal_compare(spark, sf):
    from ..functions.money import compare

    df = orders(spark, sf)
    return df.agg(
        F.count_if(compare("amount", 100000, ">")).alias("gt"),
        F.count_if(compare("amount", -100000, "<=")).alias("le"),
        F.count_if(compare("amount", 0, "!=")).alias("ne"),
    )


# ------------------------------------------------- sheet oracles (SQL parity)

def _fin_cte() -> str:
    return f"""fin AS (
      SELECT account_number, count(*) AS transaction_count,
             min(transaction_date) AS first_transaction, max(transaction_date) AS last_transaction,
             {MO("coalesce(sum(amount) FILTER (WHERE amount > 0), 0)")} AS total_credits,
             {MO("coalesce(sum(amount) FILTER (WHERE amount < 0), 0)")} AS total_debits,
             {MO("coalesce(sum(amount), 0)")} AS net_position,
             coalesce({M2("coalesce(sum(amount), 0)", "count(amount)")}, CAST(0 AS DECIMAL(38,2))) AS avg_transaction,
             {MO("max_by(balance, (transaction_date, row_id)) FILTER (WHERE transaction_date IS NOT NULL AND balance IS NOT NULL)")} AS current_balance
      FROM txn WHERE account_number IS NOT NULL GROUP BY 1)"""


def _act_cte(as_of: str) -> str:
    ref = f"CASE WHEN {FD(TS(as_of), 'last_transaction')} > 30 THEN last_transaction ELSE {TS(as_of)} END"
    return f"""l0 AS (SELECT account_number, max(transaction_date) AS last_transaction FROM txn
                      WHERE account_number IS NOT NULL GROUP BY 1),
      l AS (SELECT *, {ref} AS ref FROM l0),
      act AS (
      SELECT l.account_number,
             {FD(TS(as_of), 'l.last_transaction')} AS days_since_last_transaction,
             coalesce({FD(TS(as_of), 'l.last_transaction')} <= 90, false) AS is_active,
             CASE WHEN {FD(TS(as_of), 'l.last_transaction')} > 30 THEN 'data_end' ELSE 'current_date' END AS reference_date_used,
             coalesce({FD(TS(as_of), 'l.last_transaction')} > 30, false) AS is_historical_data,
             count(*) FILTER (WHERE epoch_us(t.transaction_date) > epoch_us(l.ref) - {30 * O.MICROS_PER_DAY}) AS transactions_last_30_days
      FROM txn t JOIN l ON t.account_number = l.account_number
      GROUP BY l.account_number, l.last_transaction, l.ref)"""


attach_oracle(
    "sheet_account_analysis",
    O.with_txn(
        "events",
        "SELECT * FROM fin LEFT JOIN act USING (account_number)",
        extra_ctes=_fin_cte() + ",\n" + _act_cte(AS_OF_EVENTS),
    ),
)

attach_oracle(
    "account_table",
    O.with_txn(
        "orders",
        """SELECT f.account_number, f.transaction_count, f.net_position, f.avg_transaction,
                  CASE WHEN a.is_active THEN 'Active' ELSE 'Inactive' END AS status
           FROM fin f JOIN act a USING (account_number) ORDER BY f.account_number LIMIT 10""",
        extra_ctes=_fin_cte() + ",\n" + _act_cte(AS_OF_ORDERS),
    ),
)

attach_oracle(
    "completeness_table",
    O.with_txn(
        "orders",
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS column_name,
                       round(100.0 - round({PCT(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')}, 2), 2) AS complete_percentage,
                       count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM txn"""
            for c in CANONICAL_COLUMNS
        ),
    ),
)

attach_oracle(
    "sheet_raw_data",
    O.with_txn(
        "orders",
        """SELECT account_number, strftime(transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date, main_description,
                  additional_description, transaction_type, CAST(amount AS DECIMAL(38,2)) AS amount,
                  CAST(balance AS DECIMAL(38,2)) AS balance, spend_category, currency, row_id FROM txn""",
    ),
)


# ------------------------------------------------ per-account categorisation


@register("per_account_categories", None)
def q_per_account_categories(spark, sf):
    """Categories learned inside every supplier account of the lineitem view."""
    df = adapters.lineitem_transactions(spark, sf)
    _out, cats = C.categorize(df, scope=["account_number"])
    return C.category_table(df, cats, descriptions=cats.descriptions)


@register("per_account_categorisation_stats", None)
def q_per_account_categorisation_stats(spark, sf):
    df = adapters.lineitem_transactions(spark, sf)
    out, _cats = C.categorize(df, scope=["account_number"])
    return C.categorisation_stats(out, by=["account_number"])


# ------------------------------------- category table oracle, grouping off
# With grouping off every frequent merchant leads its own group, so the whole
# category table (names from the merchant's own words, distinct-name cap in
# frequency order, last-leader-wins collisions, statistics, keywords and
# confidence) is expressible in SQL.


def _kw_list_sql(expr: str) -> str:
    return f"""list_sort(list_distinct(list_filter(
                  list_transform(string_split_regex(regexp_replace(upper(coalesce({expr}, '')), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                 lambda w: regexp_replace(w, '[^\\w]', '', 'g')),
                  lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w) AND NOT regexp_matches(w, '^\\d+$')
                       AND NOT regexp_matches(w, '^\\d+[A-Z]*$'))))"""


def _nogroup_sql(source: str, cap: int = 100) -> str:
    ctes = _DESC_CTE + f""",
    m AS (SELECT clean_merchant, CAST(sum(description_count) AS BIGINT) AS merchant_count FROM d GROUP BY 1
          HAVING sum(description_count) >= 5),
    r AS (SELECT *, row_number() OVER (ORDER BY merchant_count DESC, clean_merchant) AS rk FROM m),
    w AS (SELECT rk, unnest(string_split(clean_merchant, ' ')) AS word,
                 unnest(range(1, len(string_split(clean_merchant, ' ')) + 1)) AS pos FROM r),
    wc AS (SELECT rk, word, count(*) AS n, min(pos) AS fpos FROM w
           WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1, 2),
    wt AS (SELECT rk, word, row_number() OVER (PARTITION BY rk ORDER BY n DESC, fpos) AS k FROM wc),
    wj AS (SELECT rk, string_agg(word, '_' ORDER BY k) AS words FROM wt WHERE k <= 3 GROUP BY 1),
    nm AS (SELECT r.*, upper(substr(coalesce(wj.words, replace(r.clean_merchant, ' ', '_')), 1, 30)) AS category_name
           FROM r LEFT JOIN wj USING (rk)),
    fl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category_name ORDER BY rk) = 1 THEN 1 ELSE 0 END AS is_new FROM nm),
    cu AS (SELECT *, sum(is_new) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM fl),
    cut AS (SELECT min(rk) AS c FROM cu WHERE cum >= {cap}),
    acc AS (SELECT cu.* FROM cu, cut WHERE cut.c IS NULL OR cu.rk <= cut.c),
    win AS (SELECT *, max(rk) OVER (PARTITION BY category_name) AS last_rk,
                   min(rk) OVER (PARTITION BY category_name) AS first_rk FROM acc),
    cats AS (SELECT *, dense_rank() OVER (ORDER BY first_rk) AS category_order FROM win WHERE rk = last_rk),
    tx AS (SELECT d.clean_merchant, count(*) AS transaction_count,
                  CAST(sum(t.amount) AS DOUBLE) / count(t.amount) AS avg_amount,
                  count(*) FILTER (WHERE t.amount > 0) AS pos, count(*) FILTER (WHERE t.amount < 0) AS neg
           FROM txn t JOIN d ON t.main_description IS NOT DISTINCT FROM d.main_description GROUP BY 1),
    nt AS (SELECT count(*) AS total FROM txn)"""
    body = f"""
    SELECT c.category_name, CAST(c.rk AS BIGINT) AS category_id, CAST(c.category_order AS BIGINT) AS category_order,
           CAST(1 AS BIGINT) AS merchant_count, coalesce(tx.transaction_count, 0) AS transaction_count, tx.avg_amount,
           CASE WHEN tx.transaction_count IS NULL OR tx.transaction_count = 0 THEN 'unknown'
                WHEN tx.pos / tx.transaction_count > 0.8 THEN 'mostly_positive'
                WHEN tx.neg / tx.transaction_count > 0.8 THEN 'mostly_negative'
                ELSE 'mixed' END AS amount_pattern,
           array_to_string(list_slice({_kw_list_sql('c.clean_merchant')}, 1, 10), ',') AS keywords,
           c.merchant_count / nt.total AS frequency_score,
           round(least(CAST(1.0 AS DOUBLE),
                       least(CAST(1.0 AS DOUBLE), c.merchant_count / 50) * CAST(0.4 AS DOUBLE)
                       + (CAST(1.0 AS DOUBLE) / 1) * CAST(0.3 AS DOUBLE)
                       + (CASE WHEN c.clean_merchant <> 'UNKNOWN' AND length(c.clean_merchant) > 2 THEN 1 ELSE 0 END / 1)
                         * CAST(0.3 AS DOUBLE)), 3) AS confidence_score,
           c.clean_merchant AS sample_merchants
    FROM cats c LEFT JOIN tx USING (clean_merchant) CROSS JOIN nt"""
    return O.with_txn(source, body, extra_ctes=ctes)


attach_oracle(
    "categories_nogroup",
    _nogroup_sql("orders"))


@register("categories_nogroup_capped", _nogroup_sql("supplier", cap=40))
def q_categories_nogroup_capped(spark, sf):
    """Supplier names, grouping off, 40 categories: the cap cuts the list."""
    df, _out, cats = _categorised(spark, sf, source="supplier", smart_grouping=False, max_categories=40)
    return C.category_table(df, cats, descriptions=cats.descriptions)


# Orders with grouping off: every frequent merchant gets its own category and
# the cap is not reached, so no frequent merchant is left for the fuzzy stage;
# the labelled rows and the category reports are then plain SQL.

def _labelled_ctes() -> str:
    nog = _nogroup_sql("orders")
    ctes = nog[len("WITH "): nog.index("\n    SELECT c.category_name")]
    return ctes + """,
    lab AS (SELECT t.*, coalesce(c.category_name, 'UNCATEGORIZED') AS auto_category,
                   CASE WHEN c.category_name IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS category_confidence
            FROM txn t LEFT JOIN d ON t.main_description IS NOT DISTINCT FROM d.main_description
            LEFT JOIN cats c ON d.clean_merchant = c.clean_merchant)"""


def _labelled(spark, sf):
    _df, out, _cats = _categorised(spark, sf, source="orders", smart_grouping=False)
    return out


@register("assign_exact", "WITH " + _labelled_ctes() + "\nSELECT * FROM lab")
def q_assign_exact(spark, sf):
    return _labelled(spark, sf)


@register(
    "category_distribution_exact",
    "WITH " + _labelled_ctes() + f"""
    SELECT auto_category, count(*) AS transaction_count,
           (SELECT count(DISTINCT auto_category) FROM lab) AS total_categories,
           {PCT("(SELECT count(*) FILTER (WHERE auto_category = 'UNCATEGORIZED') FROM lab)", "(SELECT count(*) FROM lab)")}
             AS uncategorized_percentage
    FROM lab GROUP BY 1""",
)
def q_category_distribution_exact(spark, sf):
    return R.category_distribution_report(_labelled(spark, sf))


@register(
    "category_financials_exact",
    "WITH " + _labelled_ctes() + f"""
    SELECT auto_category AS category, count(amount) AS count, {MO('coalesce(sum(amount), 0)')} AS sum,
           {M2('coalesce(sum(amount), 0)', 'count(amount)')} AS mean,
           CAST(CAST(stddev_samp(CAST(amount AS DOUBLE)) AS DECIMAL(38,6)) AS DECIMAL(38,2)) AS std,
           {MO('min(amount)')} AS min, {MO('max(amount)')} AS max
    FROM lab GROUP BY 1""",
)
def q_category_financials_exact(spark, sf):
    return R.category_financials(_labelled(spark, sf))


@register(
    "category_expense_exact",
    "WITH " + _labelled_ctes() + f"\nSELECT auto_category, {MO('abs(sum(amount))')} AS expense_amount FROM lab WHERE amount < 0 GROUP BY 1",
)
def q_category_expense_exact(spark, sf):
    return R.category_breakdown(_labelled(spark, sf), side="expense")


@register(
    "categorisation_stats_exact",
    "WITH " + _labelled_ctes() + f"""
    SELECT count(*) AS total_transactions,
           count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS categorized_transactions,
           count(DISTINCT auto_category) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS categories_used,
           count(*) - count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS uncategorized_transactions,
           {PCT("count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED')", "count(*)")} AS categorized_percentage
    FROM lab""",
)
def q_categorisation_stats_exact(spark, sf):
    return C.categorisation_stats(_labelled(spark, sf))


# ------------------------------------------------- formatted summary oracles

_STATS_CTE = f"""st AS (
    SELECT count(*) AS n, count(DISTINCT account_number) AS accounts, count(DISTINCT main_description) AS merchants,
           {FD('max(transaction_date)', 'min(transaction_date)')} AS span_days,
           CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(38,2)) AS credits,
           CAST(coalesce(sum(amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(38,2)) AS debits,
           CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS net
    FROM txn)"""


def _gbp_sql(expr: str) -> str:
    return f"'£' || format('{{:,.2f}}', {expr})"


def _metric_union(pairs: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{k}' AS Metric, {v} AS Value FROM st" for k, v in pairs)


attach_oracle(
    "sheet_executive_summary",
    O.with_txn(
        "orders",
        _metric_union(
            [
                ("Analysis Date", f"'{AS_OF_ORDERS}'"),
                ("Total Records Analyzed", "format('{:,}', n)"),
                ("Unique Accounts", "CAST(accounts AS VARCHAR)"),
                ("Unique Merchants", "CAST(merchants AS VARCHAR)"),
                ("Date Range (Days)", "CAST(span_days AS VARCHAR)"),
                ("Total Credits", _gbp_sql("credits")),
                ("Total Debits", _gbp_sql("debits")),
                ("Net Position", _gbp_sql("net")),
            ]
        ),
        extra_ctes=_STATS_CTE,
    ),
)

attach_oracle(
    "simple_summary",
    O.with_txn(
        "orders",
        _metric_union(
            [
                ("Total Transactions", "CAST(n AS VARCHAR)"),
                ("Total Credits", "CAST(credits AS VARCHAR)"),
                ("Total Debits", "CAST(abs(debits) AS VARCHAR)"),
                ("Net Position", "CAST(net AS VARCHAR)"),
                ("Unique Accounts", "CAST(accounts AS VARCHAR)"),
                ("Unique Merchants", "CAST(merchants AS VARCHAR)"),
            ]
        ),
        extra_ctes=_STATS_CTE,
    ),
)

attach_oracle(
    "key_findings",
    O.with_txn(
        "orders",
        f"""SELECT 0 AS finding_no, 'Analysis covers ' || accounts || ' accounts over ' || span_days || ' days' AS finding FROM st
            UNION ALL SELECT 1, 'Total income: ' || {_gbp_sql('credits')} FROM st
            UNION ALL SELECT 2, 'Total expenses: ' || {_gbp_sql('abs(debits)')} FROM st
            UNION ALL SELECT 3, CASE WHEN net > 0 THEN 'Net positive position of ' || {_gbp_sql('net')}
                                     ELSE 'Net negative position of ' || {_gbp_sql('abs(net)')} END FROM st""",
        extra_ctes=_STATS_CTE,
    ),
)


@register(
    "analysis_metadata",
    O.with_txn(
        "orders",
        f"""SELECT '{AS_OF_ORDERS}' AS analysis_date, count(*) AS dataset_size, true AS date_filter_applied,
                   '{FILTER_START}' AS start_date, '{FILTER_END}' AS end_date
            FROM txn WHERE transaction_date >= {TS(FILTER_START + ' 00:00:00')} AND transaction_date <= {TS(FILTER_END + ' 00:00:00')}""",
    ),
)
def q_analysis_metadata(spark, sf):
    return R.analysis_metadata(orders(spark, sf), as_of=AS_OF_ORDERS, start=FILTER_START, end=FILTER_END)


@register("account_list", O.with_txn("orders", "SELECT DISTINCT account_number FROM txn WHERE account_number IS NOT NULL"))
def q_account_list(spark, sf):
    return accounts.account_list(orders(spark, sf))


@register(
    "transactions_per_account",
    O.with_txn(
        "events",
        "SELECT account_number, count(*) AS transactions FROM txn WHERE account_number IS NOT NULL GROUP BY 1",
    ),
)
def q_transactions_per_account(spark, sf):
    return ingest.transactions_per_account(events(spark, sf))


# ----------------------------------------- oracles of the similarity queries

from . import oracle_categories as OC  # noqa: E402


def _learned_sql(body: str, source: str = "lineitem", **kw) -> str:
    ctes = OC.category_ctes(source, _clean_sql("main_description"), _kw_list_sql, **kw)
    return f"WITH RECURSIVE {ctes}\n{body}"


attach_oracle(
    "similar_pairs",
    f"""WITH RECURSIVE txn AS ({O.TXN['supplier']()}),
    {_DESC_CTE},
    m AS (SELECT clean_merchant FROM d GROUP BY 1 HAVING sum(description_count) >= 5),
    pairs AS (SELECT x.clean_merchant AS a, y.clean_merchant AS b FROM m x JOIN m y ON x.clean_merchant <> y.clean_merchant),
    {OC.similarity_ctes("pairs")}
    SELECT a AS clean_merchant, count(*) AS similar_merchants, arg_min(b, struct_pack(x := -score, y := b)) AS nearest, max(score) AS score
    FROM sim WHERE score > 0.85 GROUP BY a""",
)
for _name, _source in (("categories", "lineitem"), ("categories_supplier", "supplier")):
    attach_oracle(_name, _learned_sql(f"SELECT {OC.CATEGORY_COLUMNS} FROM category_rows", _source))
attach_oracle("assign_categories", _learned_sql("SELECT * FROM lab"))
attach_oracle(
    "category_members",
    _learned_sql("SELECT clean_merchant, category_name, CAST(category_order AS BIGINT) AS category_order, CAST(category_id AS BIGINT) AS category_id FROM members"),
)
_STATS_SELECT = f"""count(*) AS total_transactions,
           count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS categorized_transactions,
           count(DISTINCT auto_category) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS categories_used,
           count(*) - count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED') AS uncategorized_transactions,
           {PCT("count(*) FILTER (WHERE auto_category <> 'UNCATEGORIZED')", "count(*)")} AS categorized_percentage
    FROM lab"""
attach_oracle("categorisation_stats", _learned_sql(f"SELECT {_STATS_SELECT}"))
for _name in ("category_distribution", "category_financials", "category_expense"):
    _exact = REGISTRY[f"{_name}_exact"][1]
    attach_oracle(_name, _learned_sql(_exact[len("WITH " + _labelled_ctes()):]))
attach_oracle(
    "category_revenue",
    _learned_sql(f"SELECT auto_category, {MO('sum(amount)')} AS revenue_amount FROM lab WHERE amount > 0 GROUP BY 1"),
)
attach_oracle(
    "chart_category_share",
    _learned_sql("""SELECT category, CAST(sum(cnt) AS BIGINT) AS transaction_count FROM (
      SELECT CASE WHEN n > 15 AND k >= 15 THEN 'OTHERS' ELSE auto_category END AS category, cnt, n FROM (
        SELECT auto_category, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, auto_category) AS k, count(*) OVER () AS n FROM lab GROUP BY 1))
      WHERE n > 1 GROUP BY 1"""),
)
attach_oracle(
    "category_summary",
    _learned_sql("""SELECT category_name, merchant_count, transaction_count, avg_amount, amount_pattern, frequency_score, sample_merchants
      FROM category_rows"""),
)
attach_oracle(
    "assign_fuzzy",
    _learned_sql("SELECT DISTINCT main_description, auto_category FROM lab WHERE category_confidence = 0.7", "supplier", cap=10, group=False),
)
attach_oracle("per_account_categories", _learned_sql(f"SELECT s AS account_number, {OC.CATEGORY_COLUMNS} FROM category_rows", scoped=True))
attach_oracle(
    "per_account_categorisation_stats",
    _learned_sql(f"SELECT account_number, {_STATS_SELECT} GROUP BY account_number", scoped=True),
)


# ------------------------------------------------ reports of each account

_BY = ["account_number"]


def _quantile_sql(xs: str, p: float) -> str:
    """Linear interpolation in an ordered list of 2-dp decimals, exact."""
    place = f"(CAST(len({xs}) - 1 AS DECIMAL(10,0)) * CAST({p} AS DECIMAL(3,2)))"
    low, high = f"{xs}[CAST(floor({place}) AS BIGINT) + 1]", f"{xs}[CAST(ceil({place}) AS BIGINT) + 1]"
    return f"CAST({low} + ({high} - {low}) * CAST({place} - floor({place}) AS DECIMAL(4,2)) AS DECIMAL(38,6))"


@register(
    "per_account_outliers",
    O.with_txn(
        "orders",
        f"""SELECT account_number, q25, q75, iqr, lower_bound, upper_bound,
                   count(*) FILTER (WHERE abs(amount) > upper_bound) AS outlier_count,
                   {PCT('count(*) FILTER (WHERE abs(amount) > upper_bound)', 'count(*)')} AS outlier_percentage
            FROM txn JOIN b USING (account_number) GROUP BY 1, 2, 3, 4, 5, 6""",
        extra_ctes="""q AS (SELECT account_number, quantile_cont(CAST(abs(amount) AS DECIMAL(18,6)), 0.25) AS lo, quantile_cont(CAST(abs(amount) AS DECIMAL(18,6)), 0.75) AS hi
                             FROM txn WHERE account_number IS NOT NULL GROUP BY 1),
        b AS (SELECT account_number, q25, q75, q75 - q25 AS iqr, CAST(q25 - CAST(1.5 AS DECIMAL(2,1)) * (q75 - q25) AS DECIMAL(38,6)) AS lower_bound,
                     CAST(q75 + CAST(1.5 AS DECIMAL(2,1)) * (q75 - q25) AS DECIMAL(38,6)) AS upper_bound
              FROM (SELECT account_number, CAST(lo AS DECIMAL(38,6)) AS q25, CAST(hi AS DECIMAL(38,6)) AS q75 FROM q))""",
    ),
)
def q_per_account_outliers(spark, sf):
    return outliers.iqr_outliers(orders(spark, sf), by=_BY)


@register(
    "per_account_large_transactions",
    O.with_txn(
        "orders",
        f"""SELECT account_number, threshold, count(*) FILTER (WHERE abs(amount) > threshold) AS large_count,
                   {PCT('count(*) FILTER (WHERE abs(amount) > threshold)', 'count(*)')} AS large_percentage
            FROM txn JOIN (SELECT account_number, {_quantile_sql("xs", 0.95)} AS threshold FROM (
                             SELECT account_number, list(abs(amount) ORDER BY abs(amount)) FILTER (WHERE amount IS NOT NULL) AS xs FROM txn GROUP BY 1)) USING (account_number) GROUP BY 1, 2""",
    ),
)
def q_per_account_large_transactions(spark, sf):
    return outliers.large_transactions(orders(spark, sf), by=_BY)


@register(
    "per_account_top_outliers",
    O.with_txn(
        "events",
        f"""SELECT account_number, row_id, transaction_date AS date, account_number AS account, substr(main_description, 1, 50) AS description,
                   {MO('amount')} AS amount, {MO('abs(amount)')} AS abs_amount
            FROM txn WHERE amount IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY account_number ORDER BY abs(amount) DESC, row_id) <= 10""",
    ),
)
def q_per_account_top_outliers(spark, sf):
    return outliers.top_outliers(events(spark, sf), by=_BY)


@register(
    "per_account_duplicates",
    O.with_txn(
        "orders",
        f"""SELECT account_number, CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS duplicate_count,
                   {PCT('coalesce(sum(c) FILTER (WHERE c > 1), 0)', 'sum(c)')} AS duplicate_percentage
            FROM (SELECT account_number, count(*) AS c FROM txn GROUP BY account_number, transaction_date, amount) GROUP BY 1""",
    ),
)
def q_per_account_duplicates(spark, sf):
    return outliers.duplicates(orders(spark, sf), by=_BY)


@register(
    "per_account_extreme_amounts",
    O.with_txn(
        "orders",
        f"""SELECT account_number, count(*) FILTER (WHERE abs(CAST(amount AS DOUBLE) - mean) > 5.0 * std) AS extreme_count,
                   CAST(round(CAST(5.0 * any_value(std) AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) AS threshold,
                   {PCT('count(*) FILTER (WHERE abs(CAST(amount AS DOUBLE) - mean) > 5.0 * std)', 'count(*)')} AS extreme_percentage
            FROM txn JOIN (SELECT account_number, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean, stddev_samp(CAST(amount AS DOUBLE)) AS std
                           FROM txn GROUP BY 1) USING (account_number) GROUP BY 1""",
    ),
)
def q_per_account_extreme_amounts(spark, sf):
    return quality.extreme_amounts(orders(spark, sf), by=_BY)


@register(
    "per_account_currencies",
    O.with_txn(
        "orders",
        """SELECT account_number, currency, count(*) AS transaction_count,
                  CASE WHEN count(*) OVER (PARTITION BY account_number) > 1 THEN 'Multiple currencies detected' END AS issue
           FROM txn WHERE currency IS NOT NULL GROUP BY 1, 2""",
    ),
)
def q_per_account_currencies(spark, sf):
    return quality.currency_distribution(orders(spark, sf), by=_BY)


@register(
    "per_account_missing_data",
    O.with_txn(
        "orders",
        " UNION ALL ".join(
            f"""SELECT account_number, '{c}' AS column_name, count(*) - count({c}) AS missing_count,
                   round({PCT(f'count(*) - count({c})', 'count(*)')}, 2) AS missing_percentage, count({c}) > 0 AS has_data FROM txn GROUP BY 1"""
            for c in ("main_description", "amount", "balance")),
    ),
)
def q_per_account_missing_data(spark, sf):
    return quality.missing_data(orders(spark, sf), ["main_description", "amount", "balance"], by=_BY)


@register(
    "per_account_patterns",
    O.with_txn(
        "orders",
        """SELECT account_number, count(*) AS total_transactions, count(*) FILTER (WHERE amount > 0) AS positive_count,
                  count(*) FILTER (WHERE amount < 0) AS negative_count, count(*) FILTER (WHERE amount = 0) AS zero_count,
                  coalesce(CAST(sum(amount) FILTER (WHERE amount > 0) AS DOUBLE) / count(*) FILTER (WHERE amount > 0), CAST(0 AS DOUBLE)) AS mean_positive,
                  coalesce(CAST(sum(amount) FILTER (WHERE amount < 0) AS DOUBLE) / count(*) FILTER (WHERE amount < 0), CAST(0 AS DOUBLE)) AS mean_negative,
                  """ + ", ".join(f"{_quantile_sql('any_value(xs)', p)} AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
        + """ FROM txn LEFT JOIN (SELECT account_number, list(amount ORDER BY amount) AS xs FROM txn WHERE amount IS NOT NULL GROUP BY 1) USING (account_number)
           GROUP BY 1""",
    ),
)
def q_per_account_patterns(spark, sf):
    return P.pattern_profile(orders(spark, sf), by=_BY)


@register("per_account_category_financials", _learned_sql(
    f"""SELECT account_number, auto_category AS category, count(amount) AS count, {MO('coalesce(sum(amount), 0)')} AS sum,
           {M2('coalesce(sum(amount), 0)', 'count(amount)')} AS mean,
           CAST(CAST(stddev_samp(CAST(amount AS DOUBLE)) AS DECIMAL(38,6)) AS DECIMAL(38,2)) AS std,
           {MO('min(amount)')} AS min, {MO('max(amount)')} AS max FROM lab GROUP BY 1, 2""", scoped=True))
def q_per_account_category_financials(spark, sf):
    out, _cats = C.categorize(adapters.lineitem_transactions(spark, sf), scope=_BY)
    return R.category_financials(out, by=_BY)


# ------------------------------------------- reports that read one scan's sums


def _register_shared(name: str, source: QueryFn) -> None:
    """The report ``name`` from the shared sums of ``source``; its SQL reads the rows."""

    @register(f"shared_{name}", REGISTRY[name][1])
    def query(spark, sf):
        return shared.reports(shared.summarise(source(spark, sf)))[name]()


for _name in ("basic_statistics", "monthly_summary", "cash_flow_monthly", "cash_flow_summary", "zero_amounts", "missing_data",
              "currency_distribution", "account_distribution", "trend_monthly", "growth_mom"):
    _register_shared(_name, orders)
_register_shared("weekday_patterns", events)
_register_shared("daily_frequency", events)
