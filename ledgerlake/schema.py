"""Canonical transaction schema."""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

CANONICAL_COLUMNS = [
    "account_number",
    "transaction_date",
    "main_description",
    "additional_description",
    "transaction_type",
    "amount",
    "balance",
    "spend_category",
    "currency",
    "row_id",
]

CANONICAL_SCHEMA = StructType(
    [
        StructField("account_number", StringType()),
        StructField("transaction_date", TimestampNTZType()),
        StructField("main_description", StringType()),
        StructField("additional_description", StringType()),
        StructField("transaction_type", StringType()),
        StructField("amount", DecimalType(28, 6)),
        StructField("balance", DecimalType(28, 6)),
        StructField("spend_category", StringType()),
        StructField("currency", StringType()),
        StructField("row_id", LongType()),
    ]
)

OPTIONAL_COLUMNS = ["additional_description", "transaction_type", "balance", "spend_category", "currency"]
