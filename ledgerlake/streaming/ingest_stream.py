"""Incremental ingestion: statement files landing in a folder are
standardised and appended to the canonical transactions table.

This is the streaming form of the multi-file load: each micro-batch takes the
new files, applies the same column mapping, parsing and defaults as the batch
loader, and writes them to its own partition (``ingest_batch``) of a parquet
table that the reports read; a batch that is run again replaces its partition.
Row ids go on from the largest of the batches before. The checkpoint must sit in
shared storage on a cluster; it defaults to ``<spark.checkpoint.dir>/ingest-<name>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ensure_checkpoint_dir
from ..sources.ingest import standardise, to_canonical


def start_ingest(
    spark: SparkSession,
    source_dir: str,
    columns: Sequence[str],
    target: str,
    *,
    name: str = "statements",
    fmt: str = "csv",
    checkpoint: str | None = None,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream. ``columns`` is the statement header (every column is
    read as a string, as the batch CSV reader does)."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True)
    if fmt == "tsv":
        reader = reader.option("sep", "\t")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(source_dir)
    std = to_canonical(standardise(raw, row_id=F.lit(None)))

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        base = 0
        if batch_id:
            before = session.read.parquet(target).where(F.col("ingest_batch") < batch_id).agg(F.max("row_id")).first()[0]
            base = 0 if before is None else before + 1
        rows = batch.withColumn("row_id", F.monotonically_increasing_id() + F.lit(base))
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/ingest_batch={batch_id}")

    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{name}"
    writer = std.writeStream.foreachBatch(append).option("checkpointLocation", ckpt).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.queryName(f"ingest_{name}").start()
