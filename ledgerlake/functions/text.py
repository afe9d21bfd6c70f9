"""Text expressions: description trimming, merchant cleaning, keyword sets.

All are Catalyst expressions (no Python), so they run inside whole-stage
codegen next to the scan. ``(?U)`` makes ``\\s``/``\\d``/``\\w`` Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KEYWORD_STOP_WORDS, MERCHANT_NOISE_PATTERNS, UNKNOWN_MERCHANT


def strip_ws(c: Column) -> Column:
    """Trim leading/trailing Unicode whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Trimmed text; blank or the literal ``nan`` become null."""
    s = strip_ws(c.cast("string"))
    return F.when((s == "") | (s == "nan"), F.lit(None).cast("string")).otherwise(s)


def clean_merchant(c: Column) -> Column:
    """Normalised merchant name used for grouping."""
    s = strip_ws(F.upper(c))
    for pattern in MERCHANT_NOISE_PATTERNS:
        s = F.regexp_replace(s, "(?U)" + pattern, " ")
    s = strip_ws(F.regexp_replace(s, r"(?U)\s+", " "))
    return (
        F.when(c.isNull() | (c == ""), F.lit(UNKNOWN_MERCHANT))
        .when(F.length(s) < 2, F.lit(UNKNOWN_MERCHANT))
        .otherwise(s)
    )


def keywords(c: Column) -> Column:
    """Sorted distinct keyword array of a description (empty for null/blank)."""
    stop = F.array(*[F.lit(w) for w in KEYWORD_STOP_WORDS])
    words = F.split(strip_ws(F.upper(F.coalesce(c, F.lit("")))), r"(?U)\s+")
    cleaned = F.transform(words, lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    kept = F.filter(
        cleaned,
        lambda w: (F.length(w) >= 3)
        & ~F.array_contains(stop, w)
        & ~w.rlike(r"(?U)^\d+$")
        & ~w.rlike(r"(?U)^\d+[A-Z]*$"),
    )
    return F.array_sort(F.array_distinct(kept))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
