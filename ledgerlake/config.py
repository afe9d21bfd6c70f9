"""Tunables and fixed values.

Every report takes its tunables as keyword arguments; ``Settings`` carries the
defaults so a pipeline run can override them in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as listed for results to match the
# behaviour this library reproduces.
# ---------------------------------------------------------------------------

# Canonical column -> accepted source column names (first present wins, exact case).
COLUMN_ALIASES: dict[str, list[str]] = {
    "account_number": ["AccNo"],
    "transaction_date": ["Date"],
    "main_description": ["MainDesc"],
    "additional_description": ["AddDesc"],
    "transaction_type": ["TransactionType"],
    "amount": ["Amount"],
    "balance": ["Balance"],
    "spend_category": ["SpendCategory"],
    "currency": ["Currency"],
}

REQUIRED_COLUMNS = ["account_number", "transaction_date", "main_description", "amount"]

# Defaults imputed for optional columns present in a source.
DEFAULT_VALUES: dict[str, str] = {
    "currency": "GBP",
    "transaction_type": "UNKNOWN",
    "spend_category": "UNCATEGORIZED",
    "additional_description": "",
}

# Noise patterns removed from merchant names, applied in this order, each
# replaced by a single space. The first three are literal backslash escapes.
MERCHANT_NOISE_PATTERNS = [
    r"\\n",
    r"\\t",
    r"\\r",
    r"\s+CD\s+\d+",
    r"\s+T/A\s+",
    r"\s+LTD$",
    r"\s+LIMITED$",
    r"\s+PLC$",
    r"\s+INC$",
    r"\s+CORP$",
    r"\s+-\s+",
    r"\s+\d{2}/\d{2}\s+",
    r"\s+\d{4}\s+",
]

# Words never used as merchant keywords.
KEYWORD_STOP_WORDS = [
    "THE", "AND", "OR", "BUT", "IN", "ON", "AT", "TO", "FOR", "OF", "WITH",
    "BY", "FROM", "UP", "ABOUT", "INTO", "OVER", "AFTER", "LTD", "LIMITED",
    "PLC", "CORP", "INC", "CO", "COMPANY", "PAYMENT", "TRANSFER", "ONLINE",
    "CARD", "DEBIT", "CREDIT", "TRANSACTION", "PURCHASE",
]

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

UNKNOWN_MERCHANT = "UNKNOWN"
UNCATEGORIZED = "UNCATEGORIZED"

# Texts of the key findings.
FINDING_TEXTS = {
    "coverage": "Analysis covers %s accounts over %s days",
    "missing": "N/A",
    "income": "Total income: ",
    "expenses": "Total expenses: ",
    "positive": "Net positive position of ",
    "negative": "Net negative position of ",
    "categorised": "Successfully categorized %s%% of transactions automatically",
}

# Default accepted date formats, tried in order (Spark datetime patterns; one
# letter also takes two digits).
DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d H:mm",
    "yyyy-M-d'T'H:mm:ss",
    "yyyy-M-d'T'H:mm:ss.SSS",
    "yyyy-M-d'T'H:mm",
    "yyyy/M/d",
    "yyyyMMdd",
    "d MMM yyyy",
    "d-MMM-yyyy",
]
# Month first, then day first (``day_first`` turns the two round).
SLASHED_DATES = ["M/d/yyyy", "d/M/yyyy"]


@dataclass(frozen=True)
class Settings:
    # categorisation
    min_frequency: int = 5
    similarity: float = 0.85
    smart_grouping: bool = True
    max_categories: int = 100
    exclude_one_off: bool = True
    # analysis
    large_pct: float = 95.0
    active_days: int = 90
    top_n: int = 15
    # ingestion
    date_formats: list[str] | None = None  # None: ingest.date_formats(day_first)
    day_first: bool = False
    # sinks
    max_rows_per_file: int = 1_000_000


DEFAULTS = Settings()

# fixed values: what a delimited file writes for a missing value
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
