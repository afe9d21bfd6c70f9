"""Money expressions: exact decimal maths, HALF_UP rounding, null-safe comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Canonical money type of ingested data and the 2-dp output type.
MONEY = DecimalType(28, 6)
MONEY_OUT = DecimalType(38, 2)


def money_out(c: Column) -> Column:
    """Round a decimal to 2 dp, HALF_UP (Spark decimal casts round half up)."""
    return c.cast(MONEY_OUT)


def mean_2dp(total: Column, count: Column) -> Column:
    """``total / count`` rounded HALF_UP to 2 dp, null when ``count`` is 0."""
    return F.when(count > 0, (total / count).cast(MONEY_OUT))


def mean_double(total: Column, count: Column) -> Column:
    """Unrounded mean as a double (sum converted once, then divided)."""
    return F.when(count > 0, total.cast("double") / count)


def pct(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0 when ``whole`` is 0."""
    return F.when(whole > 0, part.cast("double") * 100 / whole).otherwise(F.lit(0.0))


_OPS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def compare(c: Column | str, value, op: str) -> Column:
    """Null-safe comparison predicate: null operands give ``false`` (never null)."""
    if op not in _OPS:
        raise ValueError(f"unsupported comparison operator: {op!r}")
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_OPS[op](col, F.lit(value)), F.lit(False))


def sign_label(amount: Column) -> Column:
    return (
        F.when(amount > 0, F.lit("credit"))
        .when(amount < 0, F.lit("debit"))
        .when(amount == 0, F.lit("zero"))
    )
