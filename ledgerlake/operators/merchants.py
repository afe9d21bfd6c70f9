"""Merchant (raw description) frequency and amount rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_out

def _A():
    return F.col("amount")


M = "main_description"


def merchant_counts(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(M).isNotNull()).groupBy(*by, M).agg(F.count(F.lit(1)).alias("transaction_count"))


def merchant_frequency(df: DataFrame, *, by: Sequence[str] = (), frequent_at: int = 5) -> DataFrame:
    """Distinct merchants, single-occurrence and frequent (>= ``frequent_at``) counts."""
    return merchant_counts(df, by=by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_unique_merchants"),
        F.count_if(F.col("transaction_count") == 1).alias("single_occurrence_merchants"),
        F.count_if(F.col("transaction_count") >= frequent_at).alias("frequent_merchants"),
    )


def top_k(df: DataFrame, value: str, key: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows by ``value`` desc, ties by ``key`` asc. Without ``by`` this
    plans as TakeOrderedAndProject (per-partition top-n, then a merge of n rows
    per partition), never a full sort."""
    order = [F.col(value).desc(), F.col(key).asc()]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return df.orderBy(*order).limit(n)


def top_merchants(df: DataFrame, *, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    return top_k(merchant_counts(df, by=by), "transaction_count", M, n, by)


def merchant_expense_top(df: DataFrame, *, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Merchants by |sum of negative amounts|."""
    spend = (
        df.where((_A() < 0) & F.col(M).isNotNull())
        .groupBy(*by, M)
        .agg(money_out(F.abs(F.sum(_A()))).alias("expense_amount"))
    )
    return top_k(spend, "expense_amount", M, n, by)


def merchant_revenue_top(df: DataFrame, *, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Merchants by sum of positive amounts."""
    revenue = (
        df.where((_A() > 0) & F.col(M).isNotNull())
        .groupBy(*by, M)
        .agg(money_out(F.sum(_A())).alias("revenue_amount"))
    )
    return top_k(revenue, "revenue_amount", M, n, by)
