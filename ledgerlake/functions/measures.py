"""The additive measures of reports, over rows or over groups already summed.

A report written with these has one definition for both inputs.  Amount sums are
null where there is nothing to sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: measures that a summed table stores, in this order
SUMS = ("total", "credits", "debits", "absolute")
COUNTS = ("rows", "amounts", "positive", "negative", "zero")


@dataclass(frozen=True)
class Measures:
    rows: Column
    amounts: Column  # rows with an amount
    positive: Column
    negative: Column
    zero: Column
    total: Column
    credits: Column
    debits: Column
    absolute: Column
    largest_credit: Column
    largest_debit: Column
    dates: Column  # distinct dates

    def stored(self) -> list[Column]:
        names = (*COUNTS, *SUMS, "largest_credit", "largest_debit")
        return [getattr(self, n).alias(n) for n in names]


def of_rows() -> Measures:
    a = F.col("amount")
    credit, debit = F.when(a > 0, a), F.when(a < 0, a)
    return Measures(
        rows=F.count(F.lit(1)), amounts=F.count(a),
        positive=F.count_if(a > 0), negative=F.count_if(a < 0), zero=F.count_if(a == 0),
        total=F.sum(a), credits=F.sum(credit), debits=F.sum(debit), absolute=F.sum(F.abs(a)),
        largest_credit=F.max(credit), largest_debit=F.min(debit), dates=F.countDistinct("transaction_date"),
    )


def of_sums(table: DataFrame) -> Measures:
    """Over groups that hold :meth:`Measures.stored`, one for each date.  Sums keep
    their stored type, so means divide as they do over rows."""
    kept = {n: F.sum(n).cast(table.schema[n].dataType) for n in SUMS}
    counted = {n: F.coalesce(F.sum(n), F.lit(0)) for n in COUNTS}
    return Measures(**counted, **kept, largest_credit=F.max("largest_credit"), largest_debit=F.min("largest_debit"), dates=F.count("transaction_date"))
