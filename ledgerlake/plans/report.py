"""Report bundle: all reports over one input, the sheet tables, and the sinks.

``run_all`` returns DataFrames keyed by report name; the input is persisted once
so every report reads the same materialised canonical table, and reports that
need only sums by date, account, currency or merchant read those of one scan.
Reports are independent: one failing report is recorded in ``errors`` and the
others are still produced. ``write_bundle`` writes one dataset per sheet.
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, TimestampNTZType, TimestampType

from ..config import DEFAULTS, FINDING_TEXTS, UNCATEGORIZED, Settings
from ..functions.money import money_out, pct
from ..operators import accounts, balance, categorize, merchants, outliers, patterns, quality, shared, stats, temporal

# --------------------------------------------------------------- formatting


def export_format(df: DataFrame) -> DataFrame:
    """Timestamps -> 'yyyy-MM-dd HH:mm:ss', decimals/floats -> 2 dp."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, DecimalType):
            c = money_out(c)
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c, 2)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def gbp(c) -> F.Column:
    """'£1,234.56' style money string (negative as '£-1,234.56')."""
    return F.concat(F.lit("£"), F.format_number(c.cast("decimal(38,2)"), 2))


def _metric_rows(pairs: list[tuple[str, F.Column]]) -> list[F.Column]:
    return [F.struct(F.lit(k).alias("Metric"), v.cast("string").alias("Value")) for k, v in pairs]


def executive_summary(
    df: DataFrame, *, analysis_date: str, total_records: int | None = None, records_from: DataFrame | None = None
) -> DataFrame:
    """Metric / Value rows from the overview and amount summary of ``df``.

    "Total Records Analyzed" counts ``records_from`` when given (the unfiltered
    input of a date-filtered run) -- a one-row count joined on, no action."""
    s = stats.basic_statistics(df)
    if records_from is not None:
        s = s.crossJoin(F.broadcast(records_from.agg(F.count(F.lit(1)).alias("_records"))))
        total = F.format_number(F.col("_records"), 0)
    elif total_records is not None:
        total = F.lit(f"{total_records:,}")
    else:
        total = F.format_number(F.col("total_transactions"), 0)
    rows = _metric_rows(
        [
            ("Analysis Date", F.lit(analysis_date)),
            ("Total Records Analyzed", total),
            ("Unique Accounts", F.col("unique_accounts")),
            ("Unique Merchants", F.col("unique_merchants")),
            ("Date Range (Days)", F.col("date_span_days")),
            ("Total Credits", gbp(F.col("total_credits"))),
            ("Total Debits", gbp(F.col("total_debits"))),
            ("Net Position", gbp(F.col("net_position"))),
        ]
    )
    return s.select(F.inline(F.array(*rows)))


def simple_summary(df: DataFrame) -> DataFrame:
    """Simple report summary (debits as an absolute value)."""
    a = F.col("amount")
    s = df.agg(
        F.count(F.lit(1)).alias("n"),
        money_out(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0))).alias("cr"),
        money_out(F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0)))).alias("db"),
        money_out(F.coalesce(F.sum(a), F.lit(0))).alias("net"),
        F.countDistinct("account_number").alias("acc"),
        F.countDistinct("main_description").alias("mer"),
    )
    rows = _metric_rows(
        [
            ("Total Transactions", F.col("n")),
            ("Total Credits", F.col("cr")),
            ("Total Debits", F.col("db")),
            ("Net Position", F.col("net")),
            ("Unique Accounts", F.col("acc")),
            ("Unique Merchants", F.col("mer")),
        ]
    )
    return s.select(F.inline(F.array(*rows)))


def account_sheet(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    """Account financials joined with activity status, one row per account."""
    fin = accounts.account_financials(df)
    act = accounts.account_activity(df, as_of=as_of, active_days=active_days).drop("last_transaction")
    return fin.join(act, on="account_number", how="left")


def top_merchants_sheet(df: DataFrame, *, top_n: int = 15) -> DataFrame:
    return merchants.top_merchants(df, n=top_n).select(
        F.col("main_description").alias("Merchant"), F.col("transaction_count").alias("Transaction_Count")
    )


def category_financials(categorised: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Per category: count, total, mean, sample std, min, max (2 dp)."""
    a = F.col("amount")
    return categorised.groupBy(*by, F.col("auto_category").alias("category")).agg(
        F.count(a).alias("count"),
        money_out(F.coalesce(F.sum(a), F.lit(0))).alias("sum"),
        money_out(F.sum(a) / F.count(a)).alias("mean"),
        money_out(F.stddev_samp(a.cast("double")).cast("decimal(38,6)")).alias("std"),
        money_out(F.min(a)).alias("min"),
        money_out(F.max(a)).alias("max"),
    )


def category_breakdown(categorised: DataFrame, *, side: str, by: Sequence[str] = ()) -> DataFrame:
    """|sum of expenses| or sum of revenue per category."""
    a = F.col("amount")
    cond = a < 0 if side == "expense" else a > 0
    value = F.abs(F.sum(a)) if side == "expense" else F.sum(a)
    return categorised.where(cond).groupBy(*by, "auto_category").agg(money_out(value).alias(f"{side}_amount"))


def category_distribution_report(categorised: DataFrame) -> DataFrame:
    """Rows per category and the UNCATEGORIZED share of all rows."""
    counts = categorised.groupBy("auto_category").agg(F.count(F.lit(1)).alias("transaction_count"))
    tot = categorised.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("auto_category") == UNCATEGORIZED).alias("_u"),
        F.countDistinct("auto_category").alias("total_categories"),
    )
    return counts.crossJoin(F.broadcast(tot)).select(
        "auto_category",
        "transaction_count",
        "total_categories",
        pct(F.col("_u"), F.col("_n")).alias("uncategorized_percentage"),
    )


def activity_sheet(df: DataFrame, *, as_of, active_days: int = 90) -> DataFrame:
    acc = accounts.activity_accounts(df, as_of=as_of, active_days=active_days)
    return acc.select(
        "account_number",
        "status",
        "total_transactions",
        "recent_transactions_90_days",
        "days_since_last_transaction",
        F.date_format("last_transaction_date", "yyyy-MM-dd").alias("last_transaction_date"),
        F.date_format("first_transaction_date", "yyyy-MM-dd").alias("first_transaction_date"),
        "total_amount",
        "avg_transaction_amount",
    )


def cover_stats(df: DataFrame) -> DataFrame:
    """Report cover: period, row count, accounts, total volume (|amount|)."""
    return df.agg(
        F.min("transaction_date").alias("period_start"),
        F.max("transaction_date").alias("period_end"),
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("account_number").alias("unique_accounts"),
        money_out(F.coalesce(F.sum(F.abs("amount")), F.lit(0))).alias("total_volume"),
    )


def key_findings(df: DataFrame, categorised: DataFrame | None = None) -> DataFrame:
    """Up to six text findings: coverage, income, expenses, net sign, categorised share."""
    s = stats.basic_statistics(df)
    net = F.col("net_position")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(FINDING_TEXTS["missing"]))
    findings = [
        F.format_string(FINDING_TEXTS["coverage"], shown(F.col("unique_accounts")), shown(F.col("date_span_days"))),
        F.concat(F.lit(FINDING_TEXTS["income"]), gbp(F.col("total_credits"))),
        F.concat(F.lit(FINDING_TEXTS["expenses"]), gbp(F.abs(F.col("total_debits")))),
        F.when(net > 0, F.concat(F.lit(FINDING_TEXTS["positive"]), gbp(net)))
        .otherwise(F.concat(F.lit(FINDING_TEXTS["negative"]), gbp(F.abs(net)))),
    ]
    out = s.select(F.posexplode(F.array(*findings)).alias("finding_no", "finding"))
    if categorised is not None:
        cat = categorised.agg(
            pct(F.count_if(F.col("auto_category") != UNCATEGORIZED), F.count(F.lit(1))).alias("p")
        ).select(
            F.lit(len(findings)).alias("finding_no"),
            F.format_string(FINDING_TEXTS["categorised"], F.format_number(F.col("p"), 1)).alias("finding"),
        )
        out = out.unionByName(cat)
    return out


def account_table(df: DataFrame, *, as_of, limit: int | None = 10) -> DataFrame:
    """First ``limit`` accounts (None: all): status, count, net, mean."""
    fin = accounts.account_financials(df).select("account_number", "transaction_count", "net_position", "avg_transaction")
    act = accounts.account_activity(df, as_of=as_of).select(
        "account_number", F.when(F.col("is_active"), F.lit("Active")).otherwise(F.lit("Inactive")).alias("status")
    )
    table = fin.join(act, on="account_number").orderBy("account_number")
    return table if limit is None else table.limit(limit)


def completeness_table(df: DataFrame, *, limit: int | None = 10) -> DataFrame:
    """Share of filled values of the first ``limit`` columns (None: all), in column order."""
    md = quality.missing_data(df, df.columns[:limit] if limit is not None else None)
    return md.select("column_name", F.round(F.lit(100.0) - F.col("missing_percentage"), 2).alias("complete_percentage"), "missing_count")


# ----------------------------------------------------------------- run all


def analysis_metadata(df: DataFrame, *, as_of, start=None, end=None) -> DataFrame:
    """One row describing a run: analysis date, analysed rows (after the date
    filter), whether a filter was applied and its bounds."""
    data = stats.date_filter(df, start, end) if (start or end) else df
    return data.agg(F.count(F.lit(1)).alias("dataset_size")).select(
        F.lit(str(as_of)).alias("analysis_date"),
        "dataset_size",
        F.lit(bool(start or end)).alias("date_filter_applied"),
        F.lit(start).cast("string").alias("start_date"),
        F.lit(end).cast("string").alias("end_date"),
    )



def run_all(
    df: DataFrame,
    *,
    as_of=None,
    start=None,
    end=None,
    settings: Settings = DEFAULTS,
    categorised: DataFrame | None = None,
    cats: categorize.Categories | None = None,
    persist: bool = True,
    share: bool = True,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every report over ``df`` (date-filtered when ``start``/``end`` given).

    Returns (reports, errors). ``as_of`` defaults to the driver clock, captured
    once so all reports agree.  With ``share``, sixteen reports read the sums of one
    scan (``operators.shared``), which is written while the reports are built."""
    as_of = as_of or _dt.datetime.now().replace(microsecond=0).isoformat(sep=" ")
    data = stats.date_filter(df, start, end) if (start or end) else df
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    amounts = functools.cache(lambda: outliers.amount_values(data))  # one table for both reports
    builders = {
        "analysis_metadata": lambda: analysis_metadata(df, as_of=as_of, start=start, end=end),
        "filter_impact": lambda: stats.filter_impact(df, start, end),
        "basic_statistics": lambda: stats.basic_statistics(data),
        "account_overview": lambda: accounts.account_overview(data),
        "account_financials": lambda: accounts.account_financials(data),
        "account_activity": lambda: accounts.account_activity(data, as_of=as_of, active_days=settings.active_days),
        "merchant_frequency": lambda: merchants.merchant_frequency(data),
        "top_merchants": lambda: merchants.top_merchants(data, n=settings.top_n),
        "merchant_expense_top": lambda: merchants.merchant_expense_top(data, n=settings.top_n),
        "merchant_revenue_top": lambda: merchants.merchant_revenue_top(data, n=settings.top_n),
        "monthly_summary": lambda: temporal.monthly_summary(data),
        "monthly_cash_flow": lambda: temporal.monthly_cash_flow(data),
        "weekday_patterns": lambda: temporal.weekday_patterns(data),
        "daily_frequency": lambda: temporal.daily_frequency(data),
        "iqr_outliers": lambda: outliers.iqr_outliers(data, values=amounts()),
        "large_transactions": lambda: outliers.large_transactions(data, percentile=settings.large_pct, values=amounts()),
        "top_outliers": lambda: outliers.top_outliers(data),
        "duplicates": lambda: outliers.duplicates(data),
        "cash_flow_summary": lambda: stats.cash_flow_summary(data),
        "cash_flow_monthly": lambda: temporal.cash_flow_monthly(data),
        "balance_check": lambda: balance.balance_check(data),
        "missing_data": lambda: quality.missing_data(data),
        "zero_amounts": lambda: stats.zero_amounts(data),
        "extreme_amounts": lambda: quality.extreme_amounts(data),
        "currency_distribution": lambda: quality.currency_distribution(data),
        "account_distribution": lambda: accounts.account_distribution(data),
        "activity_context": lambda: accounts.activity_context(data, as_of=as_of, active_days=settings.active_days),
        "activity_accounts": lambda: accounts.activity_accounts(data, as_of=as_of, active_days=settings.active_days),
        "activity_summary": lambda: accounts.activity_summary(data, as_of=as_of, active_days=settings.active_days),
        "trend_daily": lambda: temporal.trend_daily(data),
        "trend_weekly": lambda: temporal.trend_weekly(data),
        "trend_monthly": lambda: temporal.trend_monthly(data),
        "growth_mom": lambda: temporal.growth_mom(data),
    }
    if categorised is not None:
        cat = stats.date_filter(categorised, start, end) if (start or end) else categorised
        builders["categorisation_stats"] = lambda: categorize.categorisation_stats(cat, cats=cats)
        builders["category_distribution"] = lambda: category_distribution_report(cat)
        builders["category_financials"] = lambda: category_financials(cat)
        builders["category_expense"] = lambda: category_breakdown(cat, side="expense")
        builders["category_revenue"] = lambda: category_breakdown(cat, side="revenue")
    reports, errors = {}, {}
    if share:
        try:  # if the shared sums can't be written, each report reads the rows itself
            builders |= shared.reports(shared.summarise(data))
        except Exception as e:
            errors["shared_sums"] = f"{type(e).__name__}: {e}"
    for name, build in builders.items():
        try:
            reports[name] = build()
        except Exception as e:  # a failing report must not lose the others
            errors[name] = f"{type(e).__name__}: {e}"
    return reports, errors


def clustered(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in ranges of (account, date, row_id), so a hot account spreads over
    several output partitions, and sorted inside each."""
    cols = ["account_number", "transaction_date", "row_id"]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return ranged.sortWithinPartitions(*cols)


def sheets(
    df: DataFrame,
    *,
    as_of,
    categorised: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    analysis_date: str | None = None,
    start=None,
    end=None,
) -> dict[str, DataFrame]:
    """The six workbook sheets as DataFrames (Category_Analysis only when categorised).

    With ``start``/``end`` the analysis sheets use the date-filtered rows while
    Raw_Data and "Total Records Analyzed" keep every row."""
    analysis_date = analysis_date or str(as_of)
    filtered = bool(start or end)
    analysed = stats.date_filter(df, start, end) if filtered else df
    raw = categorised if categorised is not None else df
    out = {
        "Raw_Data": export_format(clustered(raw)),
        "Executive_Summary": executive_summary(analysed, analysis_date=analysis_date, records_from=df if filtered else None),
        "Account_Analysis": account_sheet(analysed, as_of=as_of, active_days=settings.active_days),
        "Top_Merchants": top_merchants_sheet(analysed, top_n=settings.top_n),
        "Active_Inactive_Accounts": activity_sheet(analysed, as_of=as_of, active_days=settings.active_days),
    }
    if categorised is not None:
        cat = stats.date_filter(categorised, start, end) if filtered else categorised
        out["Category_Analysis"] = category_financials(cat)
    return out


# ------------------------------------------------------------------- sinks


def write_bundle(
    tables: dict[str, DataFrame],
    path: str,
    *,
    fmt: str = "parquet",
    max_rows_per_file: int = DEFAULTS.max_rows_per_file,
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    errors: dict[str, str] | None = None,
) -> dict[str, str]:
    """Write each table to ``path/<name>``; files are capped at
    ``max_rows_per_file`` rows (the workbook's rows-per-sheet limit).

    A table that fails while it is computed does not keep the others from being
    written: it is noted in ``errors`` if given, else the first failure is raised
    once all have been tried.  ``cluster_by`` puts rows of equal keys into the
    same files, sorted by them; the keys stay data columns with their types."""
    written, failed = {}, []
    for name, table in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        try:
            if cluster_by and all(c in table.columns for c in cluster_by):
                table = table.repartition(*cluster_by).sortWithinPartitions(*cluster_by)
            w = table.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file)
            if fmt == "csv":
                w.option("header", True).csv(target)
            else:
                w.format(fmt).save(target)
            written[name] = target
        except Exception as e:  # noqa: BLE001 - noted or raised below
            failed.append(e)
            if errors is not None:
                errors[name] = f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"
    if failed and errors is None:
        raise failed[0]
    return written


def cover_tables(df: DataFrame, *, as_of, categorised: DataFrame | None = None, limit: int | None = 10) -> dict[str, DataFrame]:
    """The tables of the printed report: cover, findings, accounts, completeness
    and the patterns of the transactions."""
    return {
        "cover_stats": cover_stats(df),
        "key_findings": key_findings(df, categorised),
        "account_table": account_table(df, as_of=as_of, limit=limit),
        "completeness_table": completeness_table(df, limit=limit),
        "pattern_merchants": patterns.pattern_merchants(df),
        "pattern_months": patterns.month_distribution(df),
        "pattern_weekdays": patterns.weekday_distribution(df),
    }


def per_account_reports(
    df: DataFrame, *, as_of=None, start=None, end=None, settings: Settings = DEFAULTS, categorised: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Per-account report set: every report grouped by ``account_number`` (no
    per-account loop), over the rows between ``start`` and ``end``; write with
    ``cluster_by=['account_number']``.  ``categorised`` should come from
    ``categorize(df, scope=['account_number'])`` so every account's categories
    are learned from its own rows.  With ``as_of``, the activity reports come too."""
    by = ["account_number"]
    within = lambda d: (stats.date_filter(d, start, end) if (start or end) else d).where(F.col("account_number").isNotNull())
    acc = within(df)
    values = outliers.amount_values(acc, by=by)  # one table for both reports
    out = {
        "basic_statistics": stats.basic_statistics(acc, by=by),
        "cash_flow_summary": stats.cash_flow_summary(acc, by=by),
        "cash_flow_monthly": temporal.cash_flow_monthly(acc, by=by),
        "monthly_summary": temporal.monthly_summary(acc, by=by),
        "monthly_cash_flow": temporal.monthly_cash_flow(acc, by=by),
        "weekday_patterns": temporal.weekday_patterns(acc, by=by),
        "daily_frequency": temporal.daily_frequency(acc, by=by),
        "trend_daily": temporal.trend_daily(acc, by=by),
        "trend_weekly": temporal.trend_weekly(acc, by=by),
        "trend_monthly": temporal.trend_monthly(acc, by=by),
        "growth_mom": temporal.growth_mom(acc, by=by),
        "merchant_frequency": merchants.merchant_frequency(acc, by=by),
        "top_merchants": merchants.top_merchants(acc, n=settings.top_n, by=by),
        "merchant_expense_top": merchants.merchant_expense_top(acc, n=settings.top_n, by=by),
        "merchant_revenue_top": merchants.merchant_revenue_top(acc, n=settings.top_n, by=by),
        "sign_split": stats.sign_split(acc, by=by),
        "zero_amounts": stats.zero_amounts(acc, by=by),
        "account_financials": accounts.account_financials(acc),
        "balance_check": balance.balance_check(acc),
        "iqr_outliers": outliers.iqr_outliers(acc, by=by, values=values),
        "large_transactions": outliers.large_transactions(acc, percentile=settings.large_pct, by=by, values=values),
        "top_outliers": outliers.top_outliers(acc, by=by),
        "duplicates": outliers.duplicates(acc, by=by),
        "missing_data": quality.missing_data(acc, by=by),
        "extreme_amounts": quality.extreme_amounts(acc, by=by),
        "currency_distribution": quality.currency_distribution(acc, by=by),
        "pattern_profile": patterns.pattern_profile(acc, by=by),
    }
    if as_of is not None:
        out["account_activity"] = accounts.account_activity(acc, as_of=as_of, active_days=settings.active_days)
        out["activity_accounts"] = accounts.activity_accounts(acc, as_of=as_of, active_days=settings.active_days)
    if categorised is not None:
        cat = within(categorised)
        out["categorisation_stats"] = categorize.categorisation_stats(cat, by=by)
        out["category_distribution"] = categorize.category_distribution(cat, by=by)
        out["category_financials"] = category_financials(cat, by=by)
        out["category_expense"] = category_breakdown(cat, side="expense", by=by)
        out["category_revenue"] = category_breakdown(cat, side="revenue", by=by)
    return out


__all__ = [
    "run_all",
    "sheets",
    "write_bundle",
    "per_account_reports",
    "executive_summary",
    "simple_summary",
]
