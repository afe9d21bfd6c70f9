"""Delimited files with records over several lines, sources that break while
they are read, and row ids that do not depend on the split size."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import ingest, records

HEAD = "AccNo,Date,MainDesc,Amount\n"


@pytest.fixture
def split_size(spark):
    """Sets the size of a split for one test."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def set_to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "10")

    yield set_to
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def odd_frame(seed, rows):
    rng = random.Random(seed)
    texts = ["plain", "a,b", "two\nlines", 'three\n\n"quoted" lines\n,x', '"', '""', '5" pipe', "", "é\r\nz", "NA", " pad ", "\n", "nan", "x" * 300, '"\n"']
    return pd.DataFrame([[str(i), rng.choice(texts), rng.choice(["1.5", "", 'x"y'])] for i in range(rows)], columns=["Id", "Main Desc", "Amount"])


@pytest.mark.parametrize("sep", [",", "\t"])
def test_records_as_a_sequential_reader_reads_them(spark, tmp_path, split_size, sep):
    for k in range(2):
        odd_frame(k, 300).to_csv(tmp_path / f"f{k}.csv", index=False, sep=sep, lineterminator="\r\n" if k else "\n")
    want = pd.concat([pd.read_csv(tmp_path / f"f{k}.csv", dtype=object, sep=sep) for k in range(2)], ignore_index=True)
    want = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    for size in (1 << 20, 700, 97):  # whole files, and records that cross many splits
        split_size(size)
        found = records.read_records(spark, str(tmp_path), sep=sep)
        got = [tuple(r) for r in found.orderBy(records.ROW).collect()]
        assert [g[-1] for g in got] == list(range(600))
        assert [g[:-1] for g in got] == want


def test_blank_lines_marks_and_odd_records(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿Id,Desc\n\n1,a\n   \n2,\"b\n\n\"\n3\n4,x,y\n5,in \"side\" field\n", encoding="utf-8")
    found = records.read_records(spark, str(p), corrupt=True).orderBy(records.ROW).collect()
    assert [(r["Id"], r["Desc"]) for r in found] == [("1", "a"), ("2", "b\n\n"), ("3", None), ("4", "x"), ("5", 'in "side" field')]
    assert [r[records.CORRUPT] for r in found] == [None, None, "3", "4,x,y", None]


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "open.csv").write_text('Id,Desc\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        records.read_records(spark, str(tmp_path / "open.csv"))
    (tmp_path / "empty.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no header"):
        records.read_records(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("Id,Desc\n")
    assert records.read_records(spark, str(tmp_path / "head.csv")).collect() == []


@pytest.mark.parametrize("line, quoted, after", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,b"', False, False), ('"a""', False, True), ('"a"""', False, False),
    ('x",y', True, False), ("x,y", True, True), ('"",y', True, True), ('x","y', True, True), ('"', True, False), ("", True, True), ("", False, False),
    ('"a"b"c', False, False)])
def test_whether_a_field_is_open_after_a_line(line, quoted, after):
    assert records.ends_open(line, quoted, ",") is after


def test_row_ids_are_places_whatever_the_splits(spark, tmp_path, split_size):
    for k in range(3):
        odd_frame(k, 80).rename(columns={"Id": "AccNo", "Main Desc": "MainDesc"}).assign(Date="2024-01-01").to_csv(tmp_path / f"f{k}.csv", index=False)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("AccNo"), F.lit("2024-01-01").alias("Date"), F.lit("m").alias("MainDesc"), F.lit("1").alias("Amount"))
    rows.repartition(5).write.parquet(str(tmp_path / "p.parquet"))
    for path, fmt in ((str(tmp_path / "f*.csv"), "csv"), (str(tmp_path / "p.parquet"), "parquet")):
        seen = []
        for size in (1 << 22, 300):
            split_size(size)
            df = ingest.to_canonical(ingest.standardise(ingest._scan(spark, path, fmt)))
            seen.append(sorted((r["row_id"], r["account_number"], r["main_description"] or "") for r in df.collect()))
        assert seen[0] == seen[1] and [r[0] for r in seen[0]] == list(range(len(seen[0])))


def test_a_source_that_breaks_while_it_is_read_is_left_out(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(HEAD + '1,2024-01-01,"two\nlines",5.0\n2,bad,x,"1,5"\n')
    parquet = tmp_path / "damaged.parquet"
    spark.range(4000).select(F.col("id").cast("string").alias("AccNo"), F.lit("2024-01-01").alias("Date"), F.col("id").cast("string").alias("MainDesc"),
                             F.lit("1").alias("Amount")).coalesce(1).write.parquet(str(parquet))
    part = next(parquet.glob("part-*.parquet"))
    body = bytearray(part.read_bytes())
    body[4:2000] = b"\xff" * 1996  # the footer is whole, the pages are not
    part.write_bytes(bytes(body))
    for crc in parquet.glob(".*.crc"):
        crc.rename(tmp_path / crc.name)
    loaded = ingest.load_sources(spark, [str(parquet), str(good), str(good)])
    rows = loaded.transactions.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2, 3] and rows[0]["main_description"] == "two\nlines"
    assert [r["path"] for r in loaded.errors.collect()] == [str(parquet)]
    check = loaded.checks.collect()[0]
    assert (check["total_rows"], check["date_failures"], check["amount_failures"], check["null_amounts"], check["balance_failures"]) == (2, 1, 1, 1, 0)
    with pytest.raises(ValueError, match="no source"):
        ingest.load_sources(spark, [str(parquet)])


def test_written_records_come_back(spark, tmp_path):
    frame = odd_frame(9, 60)
    buffer = io.StringIO()
    frame.to_csv(buffer, index=False)
    (tmp_path / "a.csv").write_text(buffer.getvalue())
    records.read_records(spark, str(tmp_path / "a.csv")).drop(records.ROW).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(tmp_path / "b.csv"))
    one, two = (records.read_records(spark, str(tmp_path / f"{x}.csv")).drop(records.ROW).toPandas().astype(str) for x in "ab")
    assert sorted(map(tuple, one.values)) == sorted(map(tuple, two.values))
