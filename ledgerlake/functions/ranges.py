"""Order over a whole table without one task that holds a key.

Rows are dealt out by ranges of (key, order), sorted in their range and written
to the shared folder, so that the ranges stay as they are for every later step.
What a row needs from the rows before it in its key then comes in two parts: from
its own range, and a total of the earlier ranges, which is one row for each key
and range.  A key that holds a third of all rows is spread over a third of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: the number of a row's range
PART = "_range"


def staged(df: DataFrame, label: str, folders: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back, a folder for each value of ``folders``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` never sent whole to the driver for a join.

    A written table counts as large as its files; columns of few values compress a
    hundredfold, so a table of millions of rows would pass for one to broadcast."""
    return df.hint("merge")


def ordered_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with the number of the range of ``order`` that a row lies in."""
    return staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()), "ranges")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null equal to null; with no keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    cond = None
    for i, k in enumerate(keys):
        same = left[k].eqNullSafe(named[f"_k{i}"])
        cond = same if cond is None else cond & same
    return left.join(named, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def running_totals(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``ranged`` with ``out``, the sum of ``value`` (null as 0) over the key's rows
    up to and with this one, and ``total``, that over all of them."""
    keys = list(keys)
    v = F.coalesce(value, F.lit(0))
    sums = ranged.groupBy(*keys, PART).agg(F.sum(v).alias("_here"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_here").over(Window.partitionBy(*keys)).alias(total)] if total else []
    starts = sums.select(*keys, PART, F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), *extra)
    within = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = join_on(ranged.withColumn("_within", F.sum(v).over(within)), starts, [*keys, PART])
    return found.withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")
