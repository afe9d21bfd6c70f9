"""Merchant cleaning (FIXTURES.md §4) and keyword extraction."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import clean_merchant, keywords

CASES = [
    ("Acme Ltd", "ACME"),
    ("FOO LIMITED LTD", "FOO LIMITED"),
    ("FOO LTD LIMITED", "FOO LTD"),
    ("Tesco Stores 3297 London", "TESCO STORES LONDON"),
    ("Tesco Stores 3297", "TESCO STORES 3297"),
    ("J Smith T/A Cafe", "J SMITH CAFE"),
    ("A - B", "A B"),
    ("PAY 01/02 REF", "PAY REF"),
    ("Shop CD 1234", "SHOP"),
    ("x", "UNKNOWN"),
    ("", "UNKNOWN"),
    (None, "UNKNOWN"),
]


def test_clean_merchant(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES], "d string")
    got = [r.c for r in df.select(clean_merchant(F.col("d")).alias("c")).collect()]
    assert got == [b for _, b in CASES]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Amazon Online Payment REF12 12345 2024AB the", ["AMAZON", "REF12"]),
        ("  tesco-stores  ltd ", ["TESCOSTORES"]),
        (None, []),
    ],
)
def test_keywords(spark, text, expected):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(keywords(F.col("d")).alias("k")).first().k == expected


def _names(seed, tokens, n, separators=(" ",)):
    import random

    rnd = random.Random(seed)
    return [rnd.choice(separators).join(rnd.choice(tokens) for _ in range(rnd.randint(0, 6))) for _ in range(n)]


NAME_TOKENS = ["acme", "Tesco", "LTD", "ltd", "Limited", "PLC", "inc", "Corp", "CD", "1234", "12/05", "2024",
               "T/A", "-", "–", "x", "café", "Stores", " ", "  ", "\t", "\n", "99", "A"]


def test_clean_merchant_properties_on_random_names(spark):
    names = _names(7, NAME_TOKENS, 2000, (" ", "  ", "", "\t"))
    df = spark.createDataFrame([(n,) for n in names], "d string")
    d = F.col("d")
    rows = df.select(
        "d", clean_merchant(d).alias("c"), clean_merchant(F.lower(d)).alias("low"), clean_merchant(F.concat(F.lit("  "), d, F.lit(" \t"))).alias("padded"),
        clean_merchant(F.concat(d, F.lit(" Shop LTD"))).alias("suffixed"), clean_merchant(F.concat(d, F.lit(" Shop"))).alias("shop"),
    ).collect()
    for r in rows:
        assert r.c == "UNKNOWN" or (len(r.c) >= 2 and r.c == " ".join(r.c.split()) and r.c == r.c.upper())
        assert r.low == r.c and r.padded == r.c  # case and outer white space play no part
        assert r.suffixed == r.shop  # a legal form at the end goes
        assert set(r.c.split()) <= {"UNKNOWN", *r.d.upper().split()} or "" in r.d  # words only ever go


def test_keyword_properties_on_random_descriptions(spark):
    from ledgerlake.config import KEYWORD_STOP_WORDS

    tokens = ["Amazon", "the", "PAYMENT", "ref12", "12345", "2024AB", "tesco-stores", "O'Neil", "café", "a_b_c",
              "x", "UK", "Ltd.", "card", "99p", "£5", "foo/bar", "\t", "", "naïve", "ABC123"]
    left, right = _names(8, tokens, 1000), _names(9, tokens, 1000)
    df = spark.createDataFrame(list(zip(left, right)), "a string, b string")
    rows = df.select(keywords(F.col("a")).alias("a"), keywords(F.col("b")).alias("b"), keywords(F.concat_ws(" ", "a", "b")).alias("both")).collect()
    for r in rows:
        assert list(r.both) == sorted(set(r.a) | set(r.b))  # each word by itself
        for w in r.both:
            assert len(w) >= 3 and w == w.upper() and w not in KEYWORD_STOP_WORDS and not w[0].isdigit()


@pytest.mark.parametrize("word,kept", [
    ("Amazon", "AMAZON"), ("the", None), ("PAYMENT", None), ("ref12", "REF12"), ("12345", None), ("2024AB", None),
    ("tesco-stores", "TESCOSTORES"), ("O'Neil", "ONEIL"), ("a_b_c", "A_B_C"), ("x", None), ("UK", None), ("Ltd.", None),
    ("99p", None), ("£5", None), ("foo/bar", "FOOBAR"), ("ABC123", "ABC123"),
])
def test_keyword_of_one_word(spark, word, kept):
    got = spark.createDataFrame([(word,)], "d string").select(keywords(F.col("d")).alias("k")).first().k
    assert list(got) == ([kept] if kept else [])
