"""Helpers shared by the operators: staging, column views, held-out folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir

#: Rows of one Arrow batch handed to Python; texts may be long, so batches are short.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small: a text row may be megabytes long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """The two columns an operator reads, under fixed names, and named extras."""
    return df.select(
        column(id_col).cast("long").alias("doc_id"),
        column(text_col).cast("string").alias("text"),
        *(c.alias(name) for name, c in more.items()),
    )


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def text_rows(frames: Iterable, column: str = "text") -> Iterator[tuple]:
    """(frame, list of texts with null as empty) for each pandas frame."""
    for frame in frames:
        yield frame, [t if isinstance(t, str) else "" for t in frame[column]]
