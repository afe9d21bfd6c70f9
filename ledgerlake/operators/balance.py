"""Running-balance reconstruction and per-account balance validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of
from ..functions.money import money_out
from ..functions.ranges import ordered_ranges, running_totals
from ..functions.windows import running_sum

ACC = "account_number"


def _D():
    return F.col("transaction_date")


def _chunk(grain: str):
    """Ordered chunk key for the two-level running sum (monotone in date)."""
    if grain == "day":
        return day_of(_D())
    if grain in ("hour", "month", "week"):
        return F.date_trunc(grain, _D())
    raise ValueError(f"unknown chunk grain {grain!r}")


def running_balance(df: DataFrame, *, grain: str = "range") -> DataFrame:
    """Per account in (date, row_id) order:
    ``calculated_balance = first balance - first amount + cumulative amount``.

    Undated rows and rows without an account are left out. Rows are dealt out by
    ranges of (account, date, row_id), written once; the sums of an account's
    earlier ranges are added to those within a range, so a dominant account, and
    one heavy day of it, is spread over many tasks. ``grain="day"`` (or hour,
    week, month) is the form without a written table, with one task for each
    account's rows of a day.
    """
    rows = df.where(F.col(ACC).isNotNull() & _D().isNotNull()).select(ACC, "transaction_date", "row_id", "amount", "balance")
    first_key = F.struct(_D(), F.col("row_id"))
    firsts = rows.groupBy(ACC).agg(
        F.min_by(F.col("balance"), first_key).alias("_fb"),
        F.min_by(F.col("amount"), first_key).alias("_fa"),
        F.count(F.lit(1)).alias("account_rows"),
    )
    order = ["transaction_date", "row_id"]
    if grain == "range":
        run = running_totals(ordered_ranges(rows, [ACC, *order]), [ACC], order, F.col("amount"), "_cum")
    else:
        run = running_sum(rows, [ACC], order, F.col("amount"), "_cum", _chunk(grain))
    out = run.join(firsts, on=ACC, how="inner").withColumn(
        "calculated_balance", F.col("_fb") - F.col("_fa") + F.col("_cum")
    )
    return out.select(
        ACC,
        "row_id",
        "transaction_date",
        "amount",
        "balance",
        "calculated_balance",
        F.abs(F.col("balance") - F.col("calculated_balance")).alias("difference"),
        "account_rows",
    )


def balance_check(df: DataFrame, *, grain: str = "range") -> DataFrame:
    """Per account with more than one dated row: max / mean |difference|,
    validity (max < 0.01) and the number of rows off by more than 0.01."""
    diffs = running_balance(df, grain=grain).where(F.col("account_rows") > 1)
    checked = diffs.groupBy(ACC).agg(
        F.count("balance").alias("_nb"),
        money_out(F.max("difference")).alias("max_difference"),
        (F.sum("difference").cast("double") / F.count("difference")).alias("avg_difference"),
        F.coalesce(F.max("difference") < F.lit(0.01).cast("decimal(3,2)"), F.lit(False)).alias("is_valid"),
        F.count_if(F.col("difference") > F.lit(0.01).cast("decimal(3,2)")).alias("error_count"),
    )
    # accounts without any balance value carry nothing to validate (a
    # statement without a balance column gets no balance check at all)
    return checked.where(F.col("_nb") > 0).drop("_nb")
