"""Physical-plan checks: the plans we want at scale, not just right answers."""

from pyspark.sql import functions as F

from conftest import SF001
from ledgerlake.functions.similarity import similar_pairs
from ledgerlake.operators import charts, merchants, stats, temporal
from ledgerlake.sources import adapters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_is_pushed_to_the_scan(spark):
    df = stats.date_filter(adapters.orders_transactions(spark, SF001), "1996-01-01", "1996-12-31")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_column_pruning(spark):
    p = plan(stats.overview(adapters.lineitem_transactions(spark, SF001)))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scan, p
    for unused in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"):
        assert unused not in scan[0], scan[0]


def test_top_n_uses_take_ordered(spark):
    p = plan(merchants.top_merchants(adapters.lineitem_transactions(spark, SF001)))
    assert "TakeOrderedAndProject" in p
    p = plan(temporal.trend_daily(adapters.orders_transactions(spark, SF001)))
    assert "TakeOrderedAndProject" in p


def test_no_cross_or_nested_loop_join_in_similarity_join(spark):
    names = adapters.table(spark, SF001, "supplier").select(F.col("s_name").alias("a"), F.col("s_name").alias("at"))
    other = names.select(F.col("a").alias("b"), F.col("at").alias("bt"))
    p = plan(similar_pairs(names, other, threshold=0.85, left_id="a", left_text="at", right_id="b", right_text="bt"))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_account_comparison_has_no_global_window(spark):
    p = plan(charts.account_comparison(adapters.orders_transactions(spark, SF001)))
    assert "Window" not in p


def test_distinct_overview_stays_on_hash_aggregate(spark):
    p = plan(stats.overview(adapters.lineitem_transactions(spark, SF001)))
    assert "SortAggregate" not in p


def test_category_assignment_broadcasts_the_measured_mapping(spark):
    """Rows are joined to the (small, measured) categorised-description
    mapping: AQE's final plan broadcasts it instead of shuffling the rows."""
    from ledgerlake.operators import categorize as C

    out, _cats = C.categorize(adapters.lineitem_transactions(spark, SF001))
    out.collect()
    final = plan(out)
    assert "isFinalPlan=true" in final
    top_join = [line for line in final.splitlines() if "Join" in line][0]
    assert "BroadcastHashJoin" in top_join and "main_description" in top_join
