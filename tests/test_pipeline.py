"""Ingestion edge cases, the end-to-end job and the streaming ingest."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import G1_CSV
from ledgerlake.plans.pipeline import PipelineOptions, run_pipeline, validate
from ledgerlake.sources import ingest


def test_load_many_skips_bad_sources(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text(G1_CSV)
    missing_cols = tmp_path / "b.csv"
    missing_cols.write_text("AccNo,Date\n1,2024-01-01\n")
    tsv = tmp_path / "c.tsv"
    tsv.write_text("AccNo\tDate\tMainDesc\tAmount\n7\t01/31/2024\tX\t2.5\n")
    df, errors = ingest.load_many(spark, [str(good), str(missing_cols), str(tsv), str(tmp_path / "nope.csv")])
    assert df.count() == 9
    assert sorted(os.path.basename(r.path) for r in errors.collect()) == ["b.csv", "nope.csv"]
    row = df.where(F.col("account_number") == "7").first()
    assert str(row.transaction_date) == "2024-01-31 00:00:00" and float(row.amount) == 2.5
    # currency default applies only to sources that have the column
    assert row.currency is None
    with pytest.raises(ValueError):
        ingest.load_many(spark, [str(missing_cols)])


def test_unsupported_format(spark, tmp_path):
    p = tmp_path / "x.xlsx"
    p.write_text("x")
    with pytest.raises(ValueError):
        ingest.load(spark, str(p))


def test_validate_options():
    with pytest.raises(ValueError):
        validate(PipelineOptions(inputs=["a", "b"], output="o"))
    with pytest.raises(ValueError):
        validate(PipelineOptions(inputs=["a"], output="o", start="2024-02-01", end="2024-01-01"))
    with pytest.raises(ValueError):
        validate(PipelineOptions(inputs=["a"], output="o", start="01/02/2024"))


def test_pipeline_writes_bundle(spark, tmp_path):
    src = tmp_path / "g1.csv"
    src.write_text(G1_CSV)
    out = tmp_path / "out"
    from ledgerlake.config import Settings

    written = run_pipeline(
        spark,
        PipelineOptions(
            inputs=[str(src)], output=str(out), as_of="2024-03-10 00:00:00", separate_accounts=True,
            export_categories=True, settings=Settings(min_frequency=2),
        ),
    )
    for sheet in ("Raw_Data", "Executive_Summary", "Account_Analysis", "Top_Merchants", "Category_Analysis", "Active_Inactive_Accounts"):
        assert os.path.isdir(written[f"sheets/{sheet}"])
    summary = {r.Metric: r.Value for r in spark.read.parquet(written["sheets/Executive_Summary"]).collect()}
    assert summary["Total Credits"] == "£105.00" and summary["Total Debits"] == "£-90.00"
    assert spark.read.parquet(written["reports/category_distribution"]).count() == 3
    per_acc = spark.read.parquet(written["accounts/category_distribution"])
    assert dict(per_acc.dtypes)["account_number"] == "string"
    assert per_acc.where(F.col("account_number") == "3995").count() >= 1
    assert spark.read.parquet(written["reports/categorisation_stats"]).first().categories_created == 2
    for table in ("cover_stats", "key_findings", "account_table", "completeness_table", "pattern_months"):
        assert spark.read.parquet(written[f"cover/{table}"]).count() > 0
    order = [r.transaction_count for r in spark.read.parquet(os.path.join(written["categories"], "category_summary")).collect()]
    assert len(order) == 2


def test_per_account_reports_honour_the_date_filter(spark, g1):
    """A per-account report of one account is the report of its rows, filtered."""
    from ledgerlake.operators import stats, temporal
    from ledgerlake.plans import report as R

    per = R.per_account_reports(g1, as_of="2024-03-10 00:00:00", start="2024-02-01", end="2024-02-28")
    one = stats.date_filter(g1.where("account_number = '5968'"), "2024-02-01", "2024-02-28")
    for name, alone in (("monthly_summary", temporal.monthly_summary(one)), ("basic_statistics", stats.basic_statistics(one)),
                        ("trend_weekly", temporal.trend_weekly(one)), ("sign_split", stats.sign_split(one))):
        mine = per[name].where("account_number = '5968'").drop("account_number")
        assert sorted(map(str, mine.select(*alone.columns).collect())) == sorted(map(str, alone.collect())), name


def test_a_table_that_fails_while_running_loses_no_other(spark, tmp_path):
    from ledgerlake.plans import report as R

    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    errors: dict = {}
    written = R.write_bundle({"a": good, "bad": bad, "c": good}, str(tmp_path / "b"), errors=errors)
    assert sorted(written) == ["a", "c"] and list(errors) == ["bad"]
    with pytest.raises(Exception, match="broken"):
        R.write_bundle({"bad": bad, "d": good}, str(tmp_path / "b2"))
    assert spark.read.parquet(str(tmp_path / "b2" / "d")).count() == 3


def test_every_report_runs_on_no_rows(spark, g1):
    from ledgerlake.plans import report as R

    empty = g1.where("false")
    labelled = empty.withColumn("auto_category", F.lit("x")).withColumn("category_confidence", F.lit(1.0))
    reports, errors = R.run_all(empty, as_of="2024-03-10 00:00:00", categorised=labelled, persist=False)
    assert not errors
    tables = reports | R.cover_tables(empty, as_of="2024-03-10", categorised=labelled) | R.per_account_reports(empty, as_of="2024-03-10")
    for name, table in tables.items():
        table.collect()


def test_row_ids_of_a_union_never_meet(spark):
    rows = spark.range(400).selectExpr("cast(id as string) AccNo", "'2024-01-01' Date", "'x' MainDesc", "'1' Amount")
    both = ingest.union_sources([rows.repartition(200), rows.repartition(200)])
    assert both.count() == both.select("row_id").distinct().count() == 800


@pytest.mark.parametrize("text,month_first,day_first", [
    ("2024-01-15", "2024-01-15 00:00:00", "2024-01-15 00:00:00"), ("2024-01-15T10:00:00", "2024-01-15 10:00:00", "2024-01-15 10:00:00"),
    ("2024-01-15 10:05", "2024-01-15 10:05:00", "2024-01-15 10:05:00"), ("15/01/2024", "2024-01-15 00:00:00", "2024-01-15 00:00:00"),
    ("1/2/2024", "2024-01-02 00:00:00", "2024-02-01 00:00:00"), ("2024/01/15", "2024-01-15 00:00:00", "2024-01-15 00:00:00"),
    ("20240115", "2024-01-15 00:00:00", "2024-01-15 00:00:00"), ("15 Jan 2024", "2024-01-15 00:00:00", "2024-01-15 00:00:00"),
    ("31/31/2024", None, None), ("soon", None, None),
])
def test_date_forms(spark, text, month_first, day_first):
    row = spark.createDataFrame([(text,)], "d string").select(
        ingest.parse_date(F.col("d")).alias("m"), ingest.parse_date(F.col("d"), ingest.date_formats(day_first=True)).alias("d")).first()
    assert (row.m and str(row.m), row.d and str(row.d)) == (month_first, day_first)


def test_streaming_ingest(spark, tmp_path):
    from ledgerlake.streaming.ingest_stream import start_ingest

    land = tmp_path / "landing"
    land.mkdir()
    (land / "g1.csv").write_text(G1_CSV + G1_CSV.splitlines()[1] + "\n")  # a line that repeats
    target = tmp_path / "canonical"
    q = start_ingest(
        spark, str(land), ["AccNo", "Date", "MainDesc", "Amount", "Balance", "Currency"], str(target),
        checkpoint=str(tmp_path / "ckpt"), available_now=True,
    )
    q.awaitTermination(120)
    df = spark.read.parquet(str(target))
    assert df.count() == 9
    assert df.where(F.col("amount").isNull()).count() == 1
    assert df.select("row_id").distinct().count() == 9


def test_filtered_sheets_keep_raw_rows(spark, g1):
    from ledgerlake.plans import report as R

    sh = R.sheets(g1, as_of="2024-03-10 00:00:00", start="2024-02-01", end="2024-03-31")
    assert sh["Raw_Data"].count() == 8
    summary = {r.Metric: r.Value for r in sh["Executive_Summary"].collect()}
    assert summary["Total Records Analyzed"] == "8"
    # only February/March rows (4, 5, 6, 8) feed the analysis sheets
    assert summary["Total Credits"] == "£0.00" and summary["Total Debits"] == "£-60.00"
    raw = sh["Raw_Data"].collect()
    keys = [(r.account_number, r.transaction_date or "", r.row_id) for r in raw]
    assert len(keys) == 8


def test_compare_rejects_unknown_operator_and_nulls_are_false(spark, g1):
    from ledgerlake.functions.money import compare

    with pytest.raises(ValueError):
        compare("amount", 0, "<>")
    # the null amount is neither > nor <= nor != 0
    row = g1.agg(
        F.count_if(compare("amount", 0, ">")).alias("gt"),
        F.count_if(compare("amount", 0, "<=")).alias("le"),
        F.count_if(compare("amount", 0, "!=")).alias("ne"),
    ).first()
    assert (row.gt, row.le, row.ne) == (2, 5, 6)


def test_bundle_caps_rows_per_file_and_exports_categories(spark, g1, tmp_path):
    import glob

    from ledgerlake.operators import categorize as C
    from ledgerlake.plans import report as R

    out = tmp_path / "bundle"
    R.write_bundle({"Raw_Data": R.export_format(g1).coalesce(1)}, str(out), max_rows_per_file=3)
    files = glob.glob(str(out / "Raw_Data" / "*.parquet"))
    assert len(files) == 3  # 8 rows, at most 3 per file
    _lab, cats = C.categorize(g1, min_frequency=2)
    C.export_categories(g1, cats, str(tmp_path / "cats"))
    summary = spark.read.parquet(str(tmp_path / "cats" / "category_summary"))
    assert sorted(r.category_name for r in summary.collect()) == ["ACME", "SHOP"]


def test_cli_simple_and_filtered_runs(spark, tmp_path):
    from ledgerlake.plans.pipeline import main

    src = tmp_path / "g1.csv"
    src.write_text(G1_CSV)
    simple = tmp_path / "simple"
    main([str(src), "--output", str(simple), "--simple"])
    summary = {r.Metric: r.Value for r in spark.read.parquet(str(simple / "Summary")).collect()}
    assert summary["Total Transactions"] == "8" and summary["Total Debits"] == "90.00"
    assert (simple / "reports" / "monthly_summary").exists()  # the simple export comes in addition
    full = tmp_path / "full"
    main([str(src), "--output", str(full), "--start-date", "2024-02-01", "--end-date", "2024-03-31",
          "--skip-charts", "--as-of", "2024-03-10 00:00:00"])
    assert not (full / "charts").exists()
    meta = spark.read.parquet(str(full / "reports" / "analysis_metadata")).first()
    assert meta.date_filter_applied and meta.dataset_size == 4
    with pytest.raises(ValueError):
        main([str(src), str(src), "--output", str(tmp_path / "x")])  # several inputs need --merge


def test_minimal_statement_runs_every_stage(spark, tmp_path):
    """Only the four required columns: optional columns become typed nulls and
    the whole job (reports, sheets, charts, categories) still runs."""
    src = tmp_path / "min.csv"
    src.write_text("AccNo,Date,MainDesc,Amount\n1,2024-01-01,Acme Ltd,-5.00\n1,2024-01-02,Acme,-6.00\n2,2024-01-03,Pay,10.00\n")
    df = ingest.load(spark, str(src))
    assert df.columns[:10] == ["account_number", "transaction_date", "main_description", "additional_description",
                               "transaction_type", "amount", "balance", "spend_category", "currency", "row_id"]
    from ledgerlake.config import Settings

    written = run_pipeline(spark, PipelineOptions(inputs=[str(src)], output=str(tmp_path / "out"),
                                                  as_of="2024-02-01 00:00:00", settings=Settings(min_frequency=2)))
    assert spark.read.parquet(written["sheets/Executive_Summary"]).count() == 8
    assert spark.read.parquet(written["reports/balance_check"]).count() == 0
