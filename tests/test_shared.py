"""Reports over the shared sums are the reports over the rows."""

from pyspark.sql import functions as F

from conftest import SF001
from ledgerlake.operators import accounts, quality, shared, stats, temporal
from ledgerlake.plans import report as R
from ledgerlake.sources import adapters


def shown(df):
    return sorted(map(str, df.collect()))


def same(df):
    built = shared.reports(shared.summarise(df))
    assert len(built) == 16
    for name, build in built.items():
        got, alone = build(), next(getattr(m, name) for m in (stats, temporal, quality, accounts) if hasattr(m, name))(df)
        assert got.dtypes == alone.dtypes, name
        assert shown(got) == shown(alone), name


def test_shared_reports_of_given_tables(spark):
    same(adapters.events_transactions(spark, SF001).cache())


def test_shared_reports_of_odd_rows(spark, g1):
    same(g1.where("false"))
    # null dates, merchants, amounts and balances; columns of the user's own, with names the code uses or must quote
    same(g1.withColumn("rows", F.lit(None).cast("int")).withColumn("_null0", F.lit(1)).withColumn("it`s", F.lit(1)).withColumn("_id", F.lit(2)))


def test_one_scan_feeds_all(spark, tmp_path):
    """Sixteen reports are built from rows that can be read once only."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = adapters.orders_transactions(spark, SF001)
    n = rows.count()
    s = shared.summarise(rows.mapInArrow(count, rows.schema))
    assert seen.value == n
    R.write_bundle({k: b() for k, b in shared.reports(s).items()}, str(tmp_path))
    assert seen.value == n


def test_reports_go_on_without_the_shared_table(spark, g1, monkeypatch):
    def fails(df):
        raise OSError("no room")

    monkeypatch.setattr(shared, "summarise", fails)
    reports, errors = R.run_all(g1, as_of="2024-03-10 00:00:00", persist=False)
    assert list(errors) == ["shared_sums"] and reports["monthly_summary"].count() == 3


def test_a_hot_account_is_combined_before_the_shuffle(spark, g1, tmp_path):
    g1.withColumn("account_number", F.lit("hot")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = shared.grouped(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert "partial_count" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
