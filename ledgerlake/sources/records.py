"""Delimited files whose records may run over lines, read in parallel.

A quoted field may hold line breaks, so a line begins either a record or the rest
of a quoted field, depending on everything before it.  Spark's own multi-line
reader therefore gives a whole file to one task.  Here a file stays splittable:

1. every split is scanned once under both assumptions (it begins a record, or it
   begins inside a quoted field), which yields, for each, the records that begin
   in it and whether it ends inside a quoted field;
2. going over the splits of each file in order, one entry a split, tells which
   assumption holds and the number of each split's first record;
3. a second scan puts records together.  The pieces of a record that crosses a
   split are joined by its number; only those are shuffled.

Quotes count only where a field begins (a mark inside an unquoted field is text)
and two in a row inside a quoted field are one.  Lines without a quote, nearly
all, are handled a batch at a time.  Blank lines are no records, each file's first
record is its header, values listed as missing become null, and a record with
another number of fields than the header is kept and marked.  A file that ends
inside a quoted field is an error, as is one without a header.

Records are numbered from 0 over all files in the order of their paths, so the
numbers do not depend on how files are split or on the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CSV_MISSING
from ..session import python_workers_ready

#: the number of a record over all files of a source
ROW = "_source_row"
#: the text of a record that has too many or too few fields
CORRUPT = "_corrupt_record"


def ends_open(line: str, quoted: bool, sep: str) -> bool:
    """Whether a quoted field is open after ``line``; ``quoted``: before it."""
    at, first = 0, not quoted
    while True:
        if quoted:
            close = line.find('"', at)
            if close < 0:
                return True
            at = close + 1
            if line.startswith('"', at):  # two marks stand for one
                at += 1
                continue
            quoted = first = False
        if first and line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at, first = at + len(sep), True


@dataclass
class _Lines:
    """A run of lines of one split, ready to be walked from quote to quote."""

    values: pa.StringArray
    sep: str

    def __post_init__(self) -> None:
        self.marked = np.flatnonzero(pc.greater(pc.count_substring(self.values, '"'), 0).to_numpy(zero_copy_only=False))
        blank = " \r" if "\t" in self.sep else " \t\r"
        self.full = pc.not_equal(pc.utf8_length(pc.utf8_trim(self.values, characters=blank)), 0).to_numpy(zero_copy_only=False)

    def starts(self, quoted: bool) -> tuple[np.ndarray, bool]:
        """(whether each line begins a record, whether a field is open at the end)."""
        begins = np.zeros(len(self.values), bool)
        at = 0
        for i in self.marked:
            begins[at : i + 1] = not quoted
            quoted = ends_open(self.values[i].as_py(), quoted, self.sep)
            at = i + 1
        begins[at:] = not quoted
        return begins & self.full, quoted


def _runs(batches: Iterable[pa.RecordBatch], sep: str) -> Iterator[tuple[tuple[str, int], _Lines]]:
    """The lines of each batch by split (file, block), in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        cuts = [0, *(i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), len(files)]
        for a, b in zip(cuts, cuts[1:]):
            values = batch.column("value").slice(a, b - a)
            if blocks[a] == 0 and a == 0 and values[0].as_py().startswith("﻿"):
                values = pa.concat_arrays([pa.array([values[0].as_py().removeprefix("﻿")], values.type), values.slice(1)])
            yield (files[a], int(blocks[a])), _Lines(values, sep)


def _scan(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}  # a few splits make a task
        for key, lines in _runs(batches, sep):
            at = found.setdefault(key, [0, False, 0, True])
            for h in (0, 2):
                begins, at[h + 1] = lines.starts(at[h + 1])
                at[h] += int(begins.sum())
        rows = [(*key, *at) for key, at in found.items()]
        names = ["file", "block", "n_plain", "open_plain", "n_quoted", "open_quoted"]
        yield pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(names)},
                                         pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_plain", pa.int64()), ("open_plain", pa.bool_()),
                                                    ("n_quoted", pa.int64()), ("open_quoted", pa.bool_())]))

    return run


_OUT = pa.schema([("row", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])


def _assemble(sep: str, splits: dict[tuple[str, int], tuple[bool, int, int]]):
    """``splits``: for each, whether it begins inside a field, the number of the
    first record that begins in it and the number of its file's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quoted, row, header = None, False, 0, 0
        held: list[str] = []  # lines of a record that is still open
        head = False  # whether that record began in an earlier split

        def batch(rows: list[tuple[int, int, bool, str]]) -> pa.RecordBatch:
            rows = [r for r in rows if r[0] != header]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

        for own, lines in _runs(batches, sep):
            if own != key:
                if held:
                    yield batch([(row - 1, key[1], False, "\n".join(held))])
                key, held = own, []
                quoted, row, header = splits[own]
                head = quoted
            begins, after = lines.starts(quoted)
            if not quoted and not len(lines.marked):  # each line a record
                values = lines.values.filter(pa.array(begins))
                rows = np.arange(row, row + len(values))
                row += len(values)
                keep = pa.array(rows != header)
                values = pc.utf8_rtrim(values, characters="\r").filter(keep)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()).filter(keep), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool)), values], schema=_OUT)
                continue
            out: list[tuple[int, int, bool, str]] = []
            marked, state = set(lines.marked.tolist()), quoted
            for i, line in enumerate(lines.values.to_pylist()):
                if not state and not begins[i]:
                    continue  # blank
                if not state:
                    row += 1
                held.append(line)
                if i in marked:
                    state = ends_open(line, state, sep)
                if not state:
                    out.append((row - 1, key[1], not head, "\n".join(held).removesuffix("\r")))
                    held, head = [], False
            quoted = state
            yield batch(out)
        if held:
            yield batch([(row - 1, key[1], False, "\n".join(held))])

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_records(spark: SparkSession, path: str, *, sep: str = ",", corrupt: bool = False) -> DataFrame:
    """All columns as strings, and ``_source_row``; with ``corrupt`` also the
    text of records whose fields do not fit the header."""
    python_workers_ready(spark)
    lines = _lines(spark, path)
    found = lines.mapInArrow(_scan(sep), "file string, block long, n_plain long, open_plain boolean, n_quoted long, open_quoted boolean")
    splits: dict[tuple[str, int], tuple[bool, int, int]] = {}
    row, file, quoted, header, crossing = 0, None, False, 0, False
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["block"])):  # one row for each split
        if r["file"] != file:
            if quoted:
                raise ValueError(f"quoted field not closed: {file}")
            file, quoted, header = r["file"], False, row
        splits[r["file"], r["block"]] = (quoted, row, header)
        crossing |= quoted
        row += r["n_quoted"] if quoted else r["n_plain"]
        quoted = r["open_quoted"] if quoted else r["open_plain"]
    if quoted:
        raise ValueError(f"quoted field not closed: {file}")
    if not row:
        raise ValueError(f"no header: {path}")
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.options(**options, header=True, multiLine=True).csv(path).columns
    pieces = lines.mapInArrow(_assemble(sep, splits), "row long, part long, whole boolean, value string")
    records = pieces.where("whole").select("row", "value")
    if crossing:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "\n")
        joined = pieces.where("NOT whole").groupBy("row").agg(text.alias("value"))
        records = records.unionByName(joined.select("row", F.regexp_replace("value", "\r$", "").alias("value")))
    # files' headers took numbers, too: a record's own number is less by its file's place
    headers = sorted({header for _, _, header in splits.values()})
    if len(headers) == 1:
        number = F.col("row") - 1
    else:
        starts = spark.createDataFrame([(h, headers[i + 1] if i + 1 < len(headers) else row, i + 1) for i, h in enumerate(headers)], "first long, after long, less long")
        records = records.join(F.broadcast(starts), (F.col("row") > F.col("first")) & (F.col("row") < F.col("after")))  # one row for each file
        number = F.col("row") - F.col("less")
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    parsed = records.select(number.alias(ROW), F.from_csv("value", fields, options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}).alias("r"))
    missing = lambda c: F.when(c.isin(*CSV_MISSING), F.lit(None).cast("string")).otherwise(c)
    out = [missing(F.col("r").getField(n)).alias(n) for n in names]
    return parsed.select(*out, *([F.col("r").getField(CORRUPT).alias(CORRUPT)] if corrupt else []), ROW)
