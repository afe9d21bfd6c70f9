"""Several reports from one scan of the rows.

``summarise`` reads the rows once and aggregates them under four grouping sets:
by date, account, currency and merchant.  Partial sums are formed before the
shuffle, so a hot key is one row a task.  The result is written to the shared folder,
a folder for each set; a set has one row for each distinct value (and one for null),
which is what counting distinct values shuffles anyway.  The reports below, and
those of ``temporal`` and ``stats`` that take measures, then read only that table.

No rows give the same results as the reports over rows.  Columns beyond the
canonical ones count in ``missing_data`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import floor_days
from ..functions.measures import Measures, of_rows, of_sums
from ..functions.money import pct
from ..functions.ranges import staged
from . import quality, stats, temporal

KEYS = ("transaction_date", "account_number", "currency", "main_description")
PART = "_grouped_by"


@dataclass(frozen=True)
class Summary:
    table: DataFrame
    columns: tuple[str, ...]  # whose nulls are counted, as _null0, _null1, ...

    def of(self, key: str) -> DataFrame:
        """One row for each value of ``key``, null included."""
        return self.table.where(F.col(PART) == key)

    @property
    def dates(self) -> DataFrame:
        return self.of("transaction_date")

    @property
    def measures(self) -> Measures:
        return of_sums(self.table)


def grouped(df: DataFrame) -> DataFrame:
    """The sums of ``df`` by each of :data:`KEYS`, marked with the key."""
    columns = df.columns
    # texts are reduced to null marks before rows are multiplied by the sets
    marks = [quality.is_null(c).cast("int").alias(f"_null{i}") for i, c in enumerate(columns)]
    rows = df.select(*KEYS, "amount", *marks)
    sums = rows.groupingSets([[k] for k in KEYS], *KEYS).agg(
        F.grouping_id().alias("_id"),
        *of_rows().stored(),
        *[F.sum(f"_null{i}").alias(f"_null{i}") for i in range(len(columns))],
    )
    # a key's bit is 0 in its own set; the first key has the highest bit
    every = 2 ** len(KEYS) - 1
    part = F.lit(None).cast("string")
    for i, k in enumerate(KEYS):
        part = F.when(F.col("_id") == every - 2 ** (len(KEYS) - 1 - i), F.lit(k)).otherwise(part)
    return sums.withColumn(PART, part).drop("_id")


def summarise(df: DataFrame) -> Summary:
    """:func:`grouped`, written to the shared folder."""
    return Summary(staged(grouped(df), "summary", folders=[PART]), tuple(df.columns))


def overview(s: Summary) -> DataFrame:
    # a key is null in the rows of other sets, so counting it counts its values
    found = s.table.agg(
        F.coalesce(F.sum(F.when(F.col(PART) == "transaction_date", F.col("rows"))), F.lit(0)).alias("total_transactions"),
        F.count("account_number").alias("unique_accounts"),
        F.count("main_description").alias("unique_merchants"),
        F.min("transaction_date").alias("earliest_date"),
        F.max("transaction_date").alias("latest_date"),
        F.count("transaction_date").alias("unique_dates"),
    ).withColumn("date_span_days", floor_days(F.col("latest_date"), F.col("earliest_date")))
    codes = s.of("currency").agg(F.array_join(F.array_sort(F.collect_list("currency")), ",").alias("currencies"))
    return found.crossJoin(F.broadcast(codes))


def basic_statistics(s: Summary) -> DataFrame:
    return overview(s).crossJoin(F.broadcast(stats.amount_summary(s.dates, m=s.measures)))


def missing_data(s: Summary) -> DataFrame:
    counts = s.dates.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_null{i}"), F.lit(0)).alias(f"_m{i}") for i in range(len(s.columns))],
    )
    return quality.missing_rows(counts, s.columns)


def account_overview(s: Summary) -> DataFrame:
    return s.of("account_number").agg(F.count("account_number").alias("total_accounts"))


def account_distribution(s: Summary) -> DataFrame:
    per = s.of("account_number").where(F.col("account_number").isNotNull())
    return per.select("account_number", F.col("rows").alias("transaction_count"))


def currency_distribution(s: Summary) -> DataFrame:
    per = s.of("currency").where(F.col("currency").isNotNull()).select("currency", F.col("rows").alias("transaction_count"))
    return quality.with_currency_issue(per, Window.partitionBy())


def reports(s: Summary) -> dict:
    """Name -> builder of every report that needs no row."""
    d, m = s.dates, s.measures
    return {
        "basic_statistics": lambda: basic_statistics(s),
        "account_overview": lambda: account_overview(s),
        "monthly_summary": lambda: temporal.monthly_summary(d, m=m),
        "monthly_cash_flow": lambda: temporal.monthly_cash_flow(d, m=m),
        "weekday_patterns": lambda: temporal.weekday_patterns(d, m=m),
        "daily_frequency": lambda: temporal.daily_frequency(d, m=m),
        "cash_flow_summary": lambda: stats.cash_flow_summary(d, m=m),
        "cash_flow_monthly": lambda: temporal.cash_flow_monthly(d, m=m),
        "missing_data": lambda: missing_data(s),
        "zero_amounts": lambda: stats.zero_amounts(d, m=m),
        "currency_distribution": lambda: currency_distribution(s),
        "account_distribution": lambda: account_distribution(s),
        "trend_daily": lambda: temporal.trend_daily(d, m=m),
        "trend_weekly": lambda: temporal.trend_weekly(d, m=m),
        "trend_monthly": lambda: temporal.trend_monthly(d, m=m),
        "growth_mom": lambda: temporal.growth_mom(d, m=m),
    }
