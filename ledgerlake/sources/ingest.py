"""Ingestion: statement files or tables -> canonical transactions.

* ``read_raw``: CSV (header, every column a string, records over several lines;
  see ``records``), TSV, parquet or a table.
* ``resolve_columns``: first alias present wins (exact, case-sensitive);
  unmapped source columns are carried through unchanged.
* ``standardise``: date parsing over an ordered format list (failures ->
  null), ``try_cast`` of money to decimal (failures -> null), description
  trimming ('' and 'nan' -> null), defaults for optional columns present in
  the source, ``row_id`` for deterministic "first/last row" semantics: a row's
  place over the source's files (in the order of their paths), so it stays the
  same however the files are split and planned; a union's sources follow each
  other.  Rows of a catalog table have no place; their ids hold for one plan.
* ``load``: one source, lazy column expressions.
* ``load_sources`` / ``load_many``: a union of sources, each written by a job of
  its own to the shared folder, so a source that cannot be found, lacks columns
  or breaks while it is read is skipped and reported; failing only when none
  loads.  Row counts, ranges and values that did not parse are observed while a
  source is written, without another scan.

No rows pass through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COLUMN_ALIASES, DATE_FORMATS, DEFAULT_VALUES, REQUIRED_COLUMNS, SLASHED_DATES
from ..functions.money import pct
from ..functions.text import clean_text
from ..schema import CANONICAL_COLUMNS
from ..session import ensure_checkpoint_dir
from .records import ROW, read_records

MONEY_TYPE = "decimal(28,6)"


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Scan one source. ``fmt`` defaults from the suffix: .csv, .tsv, .parquet;
    ``table:<name>`` reads a catalog table."""
    return _scan(spark, path, fmt).drop(ROW)


def _scan(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The source's columns and, but for tables, each row's place ``ROW``."""
    if path.startswith("table:"):
        return spark.table(path[len("table:") :])
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if fmt == "csv":
        return read_records(spark, path)
    if fmt == "tsv":
        return read_records(spark, path, sep="\t")
    if fmt == "parquet":
        return _placed(spark.read.parquet(path))
    raise ValueError(f"unsupported file format: {fmt!r} ({path})")


def _placed(df: DataFrame) -> DataFrame:
    """Rows of a parquet source with their place over all its files: the row's
    index in its file, after the rows of the files before it."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = rows.groupBy("_file").agg((F.max("_index") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(ROW, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")


def resolve_columns(columns: Sequence[str], aliases: dict[str, list[str]] = COLUMN_ALIASES) -> dict[str, str]:
    """canonical name -> source column (first alias present, exact match)."""
    present = set(columns)
    out = {}
    for std, names in aliases.items():
        for n in names:
            if n in present:
                out[std] = n
                break
    return out


def check_required(mapping: dict[str, str], required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in mapping]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def date_formats(day_first: bool = False) -> list[str]:
    """The accepted formats in order; ``day_first`` reads 01/02/2024 as 1 February."""
    return [*DATE_FORMATS, *(reversed(SLASHED_DATES) if day_first else SLASHED_DATES)]


def parse_date(c: Column, formats: Sequence[str] | None = None) -> Column:
    """First format that parses wins; nothing parses -> null. Typed timestamps
    pass through."""
    s = F.trim(c.cast("string"))
    formats = date_formats() if formats is None else formats
    if not formats:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_money(c: Column, source_type: str) -> Column:
    """String money -> decimal; unparsable values ('1,5', '£5', '(12)') -> null."""
    if source_type.startswith(("string", "varchar")):
        return F.trim(c).try_cast(MONEY_TYPE)
    return c.try_cast(MONEY_TYPE)


def standardise(
    raw: DataFrame,
    *,
    aliases: dict[str, list[str]] = COLUMN_ALIASES,
    date_formats: Sequence[str] | None = None,
    keep_raw: bool = False,
    row_id: Column | None = None,
) -> DataFrame:
    """Canonical columns (+ unmapped extras); ``keep_raw`` adds the raw date /
    amount / balance strings for coercion-failure counts."""
    mapping = resolve_columns(raw.columns, aliases)
    check_required(mapping)
    types = dict(raw.dtypes)
    src = {std: F.col(f"`{col}`") for std, col in mapping.items()}
    out: dict[str, Column] = {}
    date_src = src["transaction_date"]
    if types[mapping["transaction_date"]] in ("timestamp", "timestamp_ntz", "date"):
        out["transaction_date"] = date_src.cast("timestamp_ntz")
    else:
        out["transaction_date"] = parse_date(date_src, date_formats)
    out["account_number"] = F.trim(src["account_number"].cast("string"))
    out["main_description"] = clean_text(src["main_description"])
    out["amount"] = parse_money(src["amount"], types[mapping["amount"]])
    if "balance" in src:
        out["balance"] = parse_money(src["balance"], types[mapping["balance"]])
    if "additional_description" in src:
        out["additional_description"] = clean_text(src["additional_description"])
    for std in ("transaction_type", "spend_category", "currency"):
        if std in src:
            out[std] = src[std].cast("string")
    # defaults only for optional columns the source has
    for std, default in DEFAULT_VALUES.items():
        if std in out:
            out[std] = F.coalesce(out[std], F.lit(default))
    # streams pass their own id because monotonically_increasing_id is batch-only
    if row_id is None:
        row_id = F.col(ROW) if ROW in raw.columns else F.monotonically_increasing_id()
    out["row_id"] = row_id.cast("bigint")
    cols = [out[c].alias(c) for c in CANONICAL_COLUMNS if c in out]
    used = set(mapping.values())
    extras = [F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns if c not in used and c not in out and c != ROW]
    raws = []
    if keep_raw:
        raws = [date_src.cast("string").alias("_raw_date"), src["amount"].cast("string").alias("_raw_amount")]
        if "balance" in src:
            raws.append(src["balance"].cast("string").alias("_raw_balance"))
    return raw.select(*cols, *extras, *raws)


def to_canonical(df: DataFrame) -> DataFrame:
    """Add absent canonical columns as typed nulls, in canonical order first."""
    types = {
        "account_number": "string",
        "transaction_date": "timestamp_ntz",
        "main_description": "string",
        "additional_description": "string",
        "transaction_type": "string",
        "amount": MONEY_TYPE,
        "balance": MONEY_TYPE,
        "spend_category": "string",
        "currency": "string",
        "row_id": "bigint",
    }
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in CANONICAL_COLUMNS]
    extras = [F.col(f"`{c}`") for c in df.columns if c not in CANONICAL_COLUMNS]
    return df.select(*cols, *extras)


def load(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """One source as canonical transactions (absent optional columns are
    typed nulls, so every report can run on a minimal statement)."""
    _check_path(path)
    return to_canonical(standardise(_scan(spark, path, fmt), **kw))


def _check_path(path: str) -> None:
    if not path.startswith("table:") and not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(path)


def union_sources(frames: Sequence[DataFrame], **kw) -> DataFrame:
    """Standardise several raw frames and union them by name (missing columns
    become null; defaults were applied per source before the union)."""
    return _numbered_union([standardise(f, **kw) for f in frames])


def _numbered_union(frames: Sequence[DataFrame]) -> DataFrame:
    """The frames' rows one after the other, with row ids of the union (whose
    partitions are those of the frames in order)."""
    out = frames[0].drop("row_id")
    for f in frames[1:]:
        out = out.unionByName(f.drop("row_id"), allowMissingColumns=True)
    return to_canonical(out.withColumn("row_id", F.monotonically_increasing_id()))


@dataclass(frozen=True)
class LoadedSources:
    """``transactions``: the union; ``errors``: (path, error) of the sources that
    were left out; ``checks``: a row for each source, see ``observed``."""

    transactions: DataFrame
    errors: DataFrame
    checks: DataFrame


def observed() -> list[Column]:
    """Metrics of standardised rows (with ``keep_raw``) for ``DataFrame.observe``."""
    present = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    unparsed = lambda raw, c: F.count_if(present(raw) & F.col(c).isNull())
    return [
        F.count(F.lit(1)).alias("total_rows"),
        unparsed("_raw_date", "transaction_date").alias("date_failures"),
        unparsed("_raw_amount", "amount").alias("amount_failures"),
        F.count_if(F.col("amount").isNull()).alias("null_amounts"),
        unparsed("_raw_balance", "balance").alias("balance_failures"),
        F.min("transaction_date").alias("min_date"),
        F.max("transaction_date").alias("max_date"),
        F.max("row_id").alias("last_row_id"),
    ]


CHECKS = ("path string, total_rows long, date_failures long, amount_failures long, null_amounts long, balance_failures long, "
          "min_date timestamp_ntz, max_date timestamp_ntz")
_RAW = ("_raw_date", "_raw_amount", "_raw_balance")


def write_observed(std: DataFrame, path: str) -> dict:
    """Write rows standardised with ``keep_raw`` (without the raw strings);
    returns what was observed on the way."""
    if "_raw_balance" not in std.columns:
        std = std.withColumn("_raw_balance", F.lit(None).cast("string"))
    seen = Observation()
    to_canonical(std).observe(seen, *observed()).drop(*_RAW).write.mode("overwrite").parquet(path)
    return seen.get


def checks_table(spark: SparkSession, seen: Sequence[tuple[str, dict]]) -> DataFrame:
    """One row for each loaded source."""
    names = [c.split()[0] for c in CHECKS.split(", ")][1:]
    return spark.createDataFrame([(path, *[m[n] for n in names]) for path, m in seen], CHECKS)


def load_sources(spark: SparkSession, paths: Iterable[str], fmt: str | None = None, folder: str | None = None, **kw) -> LoadedSources:
    """Union of every source that can be read to its end, written to ``folder``
    (default: a new one below the checkpoint folder) source by source."""
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/sources-{uuid.uuid4().hex}"
    union, errors, seen, ids = None, [], [], 0
    for i, p in enumerate(paths):
        at = f"{folder}/{i}"
        try:
            _check_path(p)
            metrics = write_observed(standardise(_scan(spark, p, fmt), keep_raw=True, **kw), at)
        except Exception as e:  # skip a failing source, keep the rest
            errors.append((p, f"{type(e).__name__}: {e}"))
            continue
        rows = spark.read.parquet(at).withColumn("row_id", F.col("row_id") + F.lit(ids).cast("bigint"))
        ids += (metrics["last_row_id"] if metrics["last_row_id"] is not None else -1) + 1
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
        seen.append((p, metrics))
    if union is None:
        raise ValueError(f"no source could be loaded: {errors}")
    return LoadedSources(to_canonical(union), spark.createDataFrame(errors, "path string, error string"), checks_table(spark, seen))


def load_many(spark: SparkSession, paths: Iterable[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(transactions, load_errors) of ``load_sources``."""
    loaded = load_sources(spark, paths, **kw)
    return loaded.transactions, loaded.errors


# ------------------------------------------------------------- load checks


def coercion_failures(std: DataFrame) -> DataFrame:
    """Values present in the source that did not parse (needs ``keep_raw``)."""
    present = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    aggs = [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(present("_raw_date") & F.col("transaction_date").isNull()).alias("date_failures"),
        F.count_if(present("_raw_amount") & F.col("amount").isNull()).alias("amount_failures"),
        F.count_if(F.col("amount").isNull()).alias("null_amounts"),
    ]
    if "_raw_balance" in std.columns:
        aggs.append(F.count_if(present("_raw_balance") & F.col("balance").isNull()).alias("balance_failures"))
    out = std.agg(*aggs)
    return out.withColumn("null_amount_percentage", pct(F.col("null_amounts"), F.col("total_rows")))


def load_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, date range and unique dates, accounts."""
    d = F.col("transaction_date")
    from ..functions.dates import floor_days

    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(d).alias("min_date"),
        F.max(d).alias("max_date"),
        F.countDistinct(d).alias("unique_dates"),
        F.countDistinct("account_number").alias("accounts"),
    ).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "min_date",
        "max_date",
        floor_days(F.col("max_date"), F.col("min_date")).alias("span_days"),
        "unique_dates",
        "accounts",
    )


def transactions_per_account(df: DataFrame) -> DataFrame:
    return df.where(F.col("account_number").isNotNull()).groupBy("account_number").agg(F.count(F.lit(1)).alias("transactions"))
