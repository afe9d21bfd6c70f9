"""Views of the driver tables as canonical transaction DataFrames.

Each adapter is a plain projection/join over the given parquet tables, so the
reports run over the whole tables and their work grows with them. Money is
cast to ``decimal(18,2)`` before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_of
from ..functions.windows import running_sum
from ..schema import CANONICAL_COLUMNS

AMOUNT_2DP = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _canonical(df: DataFrame) -> DataFrame:
    return df.select(*CANONICAL_COLUMNS)


def orders_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation: one row per order.

    account = customer, amount = total price (negative for finished orders),
    description = segment + priority + a noise suffix keyed by the order key,
    some descriptions/amounts nulled deterministically; so are zeros, repeats of
    one amount and extreme amounts put in.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    suffix = F.element_at(F.array(F.lit(""), F.lit(" LTD"), F.lit(" PLC"), F.lit(" CD 12")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    price = F.col("o_totalprice").cast(AMOUNT_2DP)
    df = (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        # nation has one row per country: bounded, always broadcast
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_custkey").cast("string").alias("account_number"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("transaction_date"),
            F.when(F.col("o_orderkey") % 89 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("o_orderpriority"), suffix))
            .alias("main_description"),
            F.lit("").alias("additional_description"),
            F.col("o_orderstatus").alias("transaction_type"),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast(AMOUNT_2DP))
            .when(F.col("o_orderkey") % 83 == 0, F.lit(0).cast(AMOUNT_2DP))
            .when(F.col("o_orderkey") % 71 == 0, F.lit(10).cast(AMOUNT_2DP))
            .when(F.col("o_orderkey") % 1999 == 0, (price * 50).cast(AMOUNT_2DP))
            .when(F.col("o_orderstatus") == "F", -price)
            .otherwise(price)
            .alias("amount"),
            F.lit(None).cast(AMOUNT_2DP).alias("balance"),
            F.col("c_mktsegment").alias("spend_category"),
            F.when(F.col("n_regionkey") == 0, F.lit("EUR")).otherwise(F.lit("GBP")).alias("currency"),
            F.col("o_orderkey").cast("bigint").alias("row_id"),
        )
    )
    return _canonical(df)


def events_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions with a reconstructed running balance per user.

    balance = 1000 + running amount per user in (ts, event_id) order, plus a
    deliberate 1.00 error on every 997th event (exercises balance checks).
    """
    e = table(spark, sf_dir, "events")
    value = F.col("value").cast(AMOUNT_2DP)
    base = e.select(
        F.col("user_id").cast("string").alias("account_number"),
        F.col("ts").cast("timestamp_ntz").alias("transaction_date"),
        F.col("event_type").alias("main_description"),
        F.lit("").alias("additional_description"),
        F.lit("UNKNOWN").alias("transaction_type"),
        F.when(F.col("event_type").isin("purchase", "error"), -value).otherwise(value).alias("amount"),
        F.lit("UNCATEGORIZED").alias("spend_category"),
        F.lit("GBP").alias("currency"),
        F.col("event_id").cast("bigint").alias("row_id"),
    )
    with_run = running_sum(
        base,
        keys=["account_number"],
        order=["transaction_date", "row_id"],
        value=F.col("amount"),
        out="_run",
        chunk=day_of(F.col("transaction_date")),
    )
    df = with_run.withColumn(
        "balance",
        (F.lit(1000) + F.col("_run") + F.when(F.col("row_id") % 997 == 0, F.lit(1)).otherwise(F.lit(0))).cast(AMOUNT_2DP),
    )
    return _canonical(df)


def lineitem_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part: volume table (account = supplier, description = part name)."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    price = F.col("l_extendedprice").cast(AMOUNT_2DP)
    df = li.join(p, li.l_partkey == p.p_partkey, "left").select(
        F.col("l_suppkey").cast("string").alias("account_number"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("transaction_date"),
        F.col("p_name").alias("main_description"),
        F.lit("").alias("additional_description"),
        F.col("l_linestatus").alias("transaction_type"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("amount"),
        F.lit(None).cast(AMOUNT_2DP).alias("balance"),
        F.lit("UNCATEGORIZED").alias("spend_category"),
        F.lit("GBP").alias("currency"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_id"),
    )
    return _canonical(df)


def supplier_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ supplier: near-identical supplier names stress the similarity grouping."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    price = F.col("l_extendedprice").cast(AMOUNT_2DP)
    df = li.join(s, li.l_suppkey == s.s_suppkey, "left").select(
        (F.col("l_orderkey") % 10).cast("string").alias("account_number"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("transaction_date"),
        F.col("s_name").alias("main_description"),
        F.lit("").alias("additional_description"),
        F.col("l_linestatus").alias("transaction_type"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("amount"),
        F.lit(None).cast(AMOUNT_2DP).alias("balance"),
        F.lit("UNCATEGORIZED").alias("spend_category"),
        F.lit("GBP").alias("currency"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_id"),
    )
    return _canonical(df)


ADAPTERS = {
    "orders": orders_transactions,
    "events": events_transactions,
    "lineitem": lineitem_transactions,
    "supplier": supplier_transactions,
}
