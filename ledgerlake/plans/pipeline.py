"""End-to-end job: load -> filter -> categorise -> reports -> charts -> sinks.

Run with spark-submit (``python -m ledgerlake.plans.pipeline --help``) or
call ``run_pipeline`` from a notebook. Every stage is a Spark job over the
whole input; the driver only handles option checks and table names.
"""

from __future__ import annotations

import argparse
import datetime as _dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..config import DEFAULTS, Settings
from ..operators import categorize as C
from ..operators import charts as CH
from ..session import configure, ensure_checkpoint_dir
from ..sources import ingest
from ..operators import stats
from . import report as R


@dataclass
class PipelineOptions:
    inputs: list[str]
    output: str
    fmt: str = "parquet"
    merge: bool = False
    start: str | None = None
    end: str | None = None
    accounts: list[str] | None = None
    skip_categorization: bool = False
    skip_charts: bool = False
    simple: bool = False
    export_categories: bool = False
    separate_accounts: bool = False
    filter_scope: str = "analysis"  # "analysis": categories/charts/raw use all rows
    as_of: str | None = None
    day_first: bool = False
    settings: Settings = field(default_factory=lambda: DEFAULTS)


def _section(name: str, paths: dict[str, str]) -> dict[str, str]:
    return {f"{name}/{k}": v for k, v in paths.items()}


def validate(opts: PipelineOptions) -> None:
    if not opts.inputs:
        raise ValueError("no input given")
    if len(opts.inputs) > 1 and not opts.merge:
        raise ValueError("several inputs need merge=True")
    for label, value in (("start", opts.start), ("end", opts.end)):
        if value is not None:
            _dt.date.fromisoformat(value)  # raises on non-ISO dates
    if opts.start and opts.end and opts.start > opts.end:
        raise ValueError("start date is after end date")
    if opts.filter_scope not in ("analysis", "all"):
        raise ValueError("filter_scope must be 'analysis' or 'all'")


def run_pipeline(spark: SparkSession, opts: PipelineOptions) -> dict[str, str]:
    """Run every stage and write the bundle; returns dataset -> path."""
    validate(opts)
    configure(spark)
    ensure_checkpoint_dir(spark)
    as_of = opts.as_of or _dt.datetime.now().replace(microsecond=0).isoformat(sep=" ")
    formats = opts.settings.date_formats or ingest.date_formats(opts.day_first or opts.settings.day_first)
    out = f"{opts.output.rstrip('/')}"
    # each source is written once: its row ids are settled, its checks observed on
    # the way, and a source that breaks loses no other
    loaded = ingest.load_sources(spark, opts.inputs, folder=f"{out}/sources", date_formats=formats)
    df = loaded.transactions
    if opts.accounts:
        df = stats.account_filter(df, opts.accounts)
    if opts.filter_scope == "all" and (opts.start or opts.end):
        df = stats.date_filter(df, opts.start, opts.end)
    written: dict[str, str] = {}
    failed: dict[str, str] = {}
    # every report reads its columns and date range from the canonical files
    df.sortWithinPartitions("transaction_date").write.mode("overwrite").parquet(f"{out}/canonical")
    written["canonical"] = f"{out}/canonical"
    df = spark.read.parquet(f"{out}/canonical")
    written.update(R.write_bundle({"load_errors": loaded.errors, "load_checks": loaded.checks}, out, fmt=opts.fmt))
    if opts.simple:
        simple = {"Transaction_Data": R.export_format(df), "Summary": R.simple_summary(df)}
        written.update(R.write_bundle(simple, out, fmt=opts.fmt, errors=failed))
    categorised, cats = None, None
    if not opts.skip_categorization:
        s = opts.settings
        categorised, cats = C.categorize(
            df,
            min_frequency=s.min_frequency,
            similarity=s.similarity,
            smart_grouping=s.smart_grouping,
            max_categories=s.max_categories,
            exclude_one_off=s.exclude_one_off,
        )
        categorised = categorised.persist(StorageLevel.MEMORY_AND_DISK)
        if opts.export_categories:
            C.export_categories(df, cats, f"{out}/categories", fmt=opts.fmt)
            written["categories"] = f"{out}/categories"
    reports, report_errors = R.run_all(
        df, as_of=as_of, start=opts.start, end=opts.end, settings=opts.settings, categorised=categorised, cats=cats, persist=False
    )
    failed |= report_errors
    written.update(_section("reports", R.write_bundle(reports, f"{out}/reports", fmt=opts.fmt, errors=failed)))
    within = lambda d: stats.date_filter(d, opts.start, opts.end) if d is not None and (opts.start or opts.end) else d
    cover = R.cover_tables(within(df), as_of=as_of, categorised=within(categorised))
    written.update(_section("cover", R.write_bundle(cover, f"{out}/cover", fmt=opts.fmt, errors=failed)))
    sheets = R.sheets(df, as_of=as_of, categorised=categorised, settings=opts.settings, start=opts.start, end=opts.end)
    written.update(_section("sheets", R.write_bundle(sheets, f"{out}/sheets", fmt=opts.fmt, max_rows_per_file=opts.settings.max_rows_per_file, errors=failed)))
    if not opts.skip_charts:
        written.update(_section("charts", R.write_bundle(CH.chart_data(df, categorised, errors=failed), f"{out}/charts", fmt=opts.fmt, errors=failed)))
    # one account's reports are the reports above
    if opts.separate_accounts and df.where("account_number IS NOT NULL").select("account_number").distinct().limit(2).count() > 1:
        per_cat = None
        if not opts.skip_categorization:
            s = opts.settings
            per_cat, per_cats = C.categorize(
                df,
                scope=["account_number"],
                min_frequency=s.min_frequency,
                similarity=s.similarity,
                smart_grouping=s.smart_grouping,
                max_categories=s.max_categories,
                exclude_one_off=s.exclude_one_off,
            )
            summary = {"category_summary": C.category_summary(df, per_cats)}
            written.update(_section("accounts", R.write_bundle(summary, f"{out}/accounts", fmt=opts.fmt, cluster_by=["account_number"], errors=failed)))
        per = R.per_account_reports(df, as_of=as_of, start=opts.start, end=opts.end, settings=opts.settings, categorised=per_cat)
        written.update(_section("accounts", R.write_bundle(per, f"{out}/accounts", fmt=opts.fmt, cluster_by=["account_number"], errors=failed)))
    if failed:
        err = spark.createDataFrame(sorted(failed.items()), "report string, error string")
        written.update(R.write_bundle({"report_errors": err}, out, fmt=opts.fmt))
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Transaction analytics job")
    ap.add_argument("inputs", nargs="+")
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--merge", action="store_true")
    ap.add_argument("--start-date")
    ap.add_argument("--end-date")
    ap.add_argument("--accounts", nargs="*")
    ap.add_argument("--skip-categorization", action="store_true")
    ap.add_argument("--skip-charts", action="store_true")
    ap.add_argument("--simple", action="store_true")
    ap.add_argument("--export-categories", action="store_true")
    ap.add_argument("--separate-accounts", action="store_true")
    ap.add_argument("--as-of")
    ap.add_argument("--day-first", action="store_true", help="read 01/02/2024 as 1 February")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    run_pipeline(
        spark,
        PipelineOptions(
            inputs=a.inputs,
            output=a.output,
            fmt=a.format,
            merge=a.merge,
            start=a.start_date,
            end=a.end_date,
            accounts=a.accounts,
            skip_categorization=a.skip_categorization,
            skip_charts=a.skip_charts,
            simple=a.simple,
            export_categories=a.export_categories,
            separate_accounts=a.separate_accounts,
            as_of=a.as_of,
            day_first=a.day_first,
        ),
    )


if __name__ == "__main__":
    main()
