"""A report of each account is the report of that account's rows; order over a
hot key is spread over tasks."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ledgerlake.functions.quantiles import quantiles, value_counts
from ledgerlake.functions.ranges import PART, ordered_ranges, running_totals
from ledgerlake.operators import balance, outliers, patterns, quality
from ledgerlake.plans import report as R
from ledgerlake.sources import adapters

BY = ["account_number"]
MONEY = "account_number string, amount decimal(18,2)"


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name, make", [
    ("iqr_outliers", lambda d, **k: outliers.iqr_outliers(d, **k)),
    ("large_transactions", lambda d, **k: outliers.large_transactions(d, **k)),
    ("top_outliers", lambda d, **k: outliers.top_outliers(d, **k)),
    ("duplicates", lambda d, **k: outliers.duplicates(d, **k)),
    ("missing_data", lambda d, **k: quality.missing_data(d, **k)),
    ("extreme_amounts", lambda d, **k: quality.extreme_amounts(d, **k)),
    ("currency_distribution", lambda d, **k: quality.currency_distribution(d, **k)),
    ("pattern_profile", lambda d, **k: patterns.pattern_profile(d, **k)),
])
def test_report_by_account_is_the_report_of_that_account(spark, name, make):
    rows = adapters.events_transactions(spark, SF001).where("row_id % 3 <> 0")
    rows = rows.withColumn("amount", F.when(F.col("row_id") % 11 == 0, F.lit(None)).otherwise(F.col("amount"))).cache()
    ids = [r[0] for r in rows.select("account_number").distinct().orderBy("account_number").limit(3).collect()]
    per = make(rows, by=BY).where(F.col("account_number").isin(ids)).cache()
    for i in ids:
        alone = make(rows.where(F.col("account_number") == i))
        assert shown(per.where(F.col("account_number") == i).select(*alone.columns)) == shown(alone), (name, i)


def test_quantiles_of_groups_by_their_definition(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, Decimal(rng.randint(-300, 300)) / 100])) for _ in range(900)] + [("none", None), ("one", Decimal("2.50"))]
    df = spark.createDataFrame(rows, MONEY).repartition(7)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["account_number"]: r["_q"] for r in quantiles(value_counts(df, F.col("amount"), BY), probs, BY).collect()}
    for key in {r[0] for r in rows}:
        values = [float(v) for k, v in rows if k == key and v is not None]
        if not values:
            assert got[key] == [None] * len(probs)
            continue
        assert np.allclose([float(q) for q in got[key]], np.quantile(values, probs), atol=1e-6)
    whole = quantiles(value_counts(df, F.col("amount")), probs).first()["_q"]
    assert np.allclose([float(q) for q in whole], np.quantile([float(v) for _, v in rows if v is not None], probs), atol=1e-6)
    assert quantiles(value_counts(df.where("false"), F.col("amount")), [0.5]).first()["_q"] == [None]


def test_one_accounts_heavy_day_is_spread_over_tasks(spark):
    n, key = 1_000_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")  # a task's size in proportion to these rows
    try:
        _heavy_day(spark, n)
    finally:
        spark.conf.set(key, before)


def _heavy_day(spark, n):
    day = spark.range(n).select(F.lit("hot").alias("account_number"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("transaction_date"),
                                F.col("id").alias("row_id"), F.lit(1).cast("decimal(18,2)").alias("amount"), (F.col("id") + 1).cast("decimal(18,2)").alias("balance"))
    ranged = ordered_ranges(day.select("account_number", "transaction_date", "row_id", "amount"), ["account_number", "transaction_date", "row_id"])
    sizes = [r["count"] for r in ranged.groupBy(PART).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < n / 2
    assert running_totals(ranged, BY, ["transaction_date", "row_id"], F.col("amount"), "s").where("s <> row_id + 1").count() == 0
    check = balance.balance_check(day).first()
    assert check["is_valid"] and check["error_count"] == 0


def test_running_totals_with_null_keys_and_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), i, rng.choice([None, Decimal(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v decimal(10,0)").repartition(5)
    got = {r["i"]: (r["s"], r["t"]) for r in running_totals(ordered_ranges(df, ["k", "i"]), ["k"], ["i"], F.col("v"), "s", "t").collect()}
    for key in ("a", None):
        total, own = 0, [r for r in rows if r[0] == key]
        for _, i, v in own:
            total += v or 0
            assert got[i] == (total, sum(r[2] or 0 for r in own))


def test_per_account_report_set_has_the_reports_of_a_run(spark, g1):
    labelled = g1.withColumn("auto_category", F.lit("x")).withColumn("category_confidence", F.lit(1.0))
    per = R.per_account_reports(g1, as_of="2024-03-10 00:00:00", categorised=labelled)
    whole, errors = R.run_all(g1, as_of="2024-03-10 00:00:00", categorised=labelled, persist=False)
    assert not errors
    # what describes the run or compares accounts has no form for one account
    assert set(whole) - set(per) == {"analysis_metadata", "filter_impact", "account_overview", "account_distribution", "activity_context", "activity_summary"}
    for name in ("category_financials", "category_expense", "category_revenue"):
        one = labelled.where("account_number = '5968'")
        alone = R.category_financials(one) if name == "category_financials" else R.category_breakdown(one, side=name.removeprefix("category_"))
        assert shown(per[name].where("account_number = '5968'").select(*alone.columns)) == shown(alone)
