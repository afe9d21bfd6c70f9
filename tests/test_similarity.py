"""Similarity (FIXTURES.md §5) and the exact prefix-filter similarity join."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import similarity
from ledgerlake.functions.similarity import py_ratio, ratios, similar_pairs


@pytest.mark.parametrize(
    "a,b,score",
    [
        ("AMAZON UK", "AMAZON UKS", 0.947368),
        ("TESCO STORES", "TESCO STORE", 0.956522),
        ("AMAZON MARKETPLACE", "AMAZON MARKETPLAC", 0.971429),
        ("TESCO STORES 3297", "TESCO STORES 4410", 0.764706),
        ("SUPPLIER#000000015", "SUPPLIER#000000099", 0.888889),
        ("tide", "diet", 0.25),
        ("diet", "tide", 0.5),
    ],
)
def test_ratio(a, b, score):
    assert py_ratio(a, b) == pytest.approx(score, abs=1e-6)


def _names(n, seed):
    rnd = random.Random(seed)
    base = ["AMAZON", "TESCO", "STORE", "MARKET", "CAFE", "SHELL", "UBER", "NETFLIX", "SPOTIFY", "ACME"]
    out = set()
    while len(out) < n:
        w = " ".join(rnd.sample(base, rnd.randint(1, 3)))
        if rnd.random() < 0.5:
            w += "".join(rnd.choice("ABCXYZ0123 ") for _ in range(rnd.randint(0, 3)))
        w = w.strip()
        if len(w) >= 2:
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_matches_brute_force(spark, seed):
    names = _names(120, seed)
    df = spark.createDataFrame([(n,) for n in names], "s string")
    left = df.selectExpr("s AS a", "s AS at")
    right = df.selectExpr("s AS b", "s AS bt")
    got = {(r.a, r.b) for r in similar_pairs(left, right, threshold=0.85, left_id="a", left_text="at", right_id="b", right_text="bt").collect()}
    want = {(x, y) for x in names for y in names if SequenceMatcher(None, x, y).ratio() > 0.85}
    assert got == want


def _dense_names(seed, n, alphabet, lo, hi):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add("".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi))))
    return sorted(out)


@pytest.mark.parametrize(
    "seed,alphabet,lo,hi",
    [
        (11, "AB", 1, 6),          # tiny alphabet, repeated characters, short strings
        (12, "AB C1", 2, 12),       # spaces and digits, many near-duplicates
        (13, "ABCDEFGH ", 200, 230),  # >= 200 characters: difflib's autojunk applies
    ],
)
def test_similar_pairs_exact_on_dense_inputs(spark, seed, alphabet, lo, hi):
    names = _dense_names(seed, 60, alphabet, lo, hi)
    if lo >= 200:
        # near-copies of long names so that some pairs do exceed the threshold
        rnd = random.Random(seed)
        names = sorted(set(names + [n[:-3] + "XYZ" for n in names[:20]] + [n[1:] for n in names[20:40]]))
    df = spark.createDataFrame([(x,) for x in names], "s string")
    left = df.selectExpr("s AS a", "s AS at")
    right = df.selectExpr("s AS b", "s AS bt")
    got = {(r.a, r.b) for r in similar_pairs(left, right, threshold=0.85, left_id="a", left_text="at", right_id="b", right_text="bt").collect()}
    want = {(x, y) for x in names for y in names if SequenceMatcher(None, x, y).ratio() > 0.85}
    assert got == want and len(want) > len(names)


def test_many_scores_at_once():
    rnd = random.Random(5)
    for alphabet, lo, hi in (("AB", 0, 8), ("ABC 1", 1, 30), ("AB\0\U0001f600é", 1, 64), ("ABCDEFGH ", 60, 70), ("AB", 195, 210)):
        some = lambda: ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi))) for _ in range(120)]
        a, b = some(), some()
        b[:60] = [x[:-2] + "Q" + x[-1:] for x in a[:60]]
        assert list(ratios(np.array(a, dtype=object), np.array(b, dtype=object))) == [py_ratio(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("keyed", [False, True])
def test_crowded_tokens_match_brute_force(spark, monkeypatch, keyed):
    # strings of one token are compared in blocks; F1 to F3: under keys, too
    monkeypatch.setattr(similarity, "CROWD", 20)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    names = [f"SUPPLIER#{i:04d}" for i in range(0, 900, 11)] + _names(40, 3) + ["", "A", "AB", "X" * 70 + "1", "X" * 70 + "2"]
    groups = ["p", "q"] if keyed else [""]
    rows = [(g, n) for g in groups for i, n in enumerate(names) if g != "q" or i % 3]
    want = {(g, x, y) for g, x in rows for h, y in rows if g == h and x and y and py_ratio(x, y) > 0.85}
    df = spark.createDataFrame(rows, "g string, s string")
    for most in (0, 1 << 40) if keyed else (8,):
        monkeypatch.setattr(similarity, "PAIRS_A_ROW", most)
        pairs = similar_pairs(df.selectExpr("g", "s AS a", "s AS at"), df.selectExpr("g", "s AS b", "s AS bt"), threshold=0.85,
                              keys=["g"] if keyed else [], left_id="a", left_text="at", right_id="b", right_text="bt")
        found = [(r.g if keyed else "", r.a, r.b) for r in pairs.collect()]
        assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("head", ["", "SUPPLIER#00", "AAAA", "ABAB", "0000000000"])
def test_blocks_compare_as_difflib_does(monkeypatch, head):
    # common starts, few patterns of short windows, texts of any length, right sides in parts
    rnd = random.Random(7)
    for alphabet, lo, hi in (("01", 1, 6), ("0123456789", 6, 6), ("AB\0\U0001f600é", 1, 12), ("ABC 1", 25, 40), ("ABCDEF ", 50, 70)):
        a, b = ([head + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi))) for _ in range(40)] for _ in "ab")
        b[:20] = [x[:-2] + "Q" + x[-1:] for x in a[:20]]
        b[20:30] = [x[1:] or "A" for x in a[20:30]]
        left, right = (np.array(x, dtype=object) for x in (a, b))
        for held in (1 << 26, 1):
            monkeypatch.setattr(similarity, "HELD", held)
            got = [(i, j, s) for x in similarity._close(left, None, right, None, 0.85) for i, j, s in zip(*(y.tolist() for y in x))]
            scores = {(i, j): py_ratio(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
            assert len(got) == len(set(got)) and set(got) == {(i, j, s) for (i, j), s in scores.items() if s > 0.85}


def _compare_all(monkeypatch):
    for name, value in (("CROWD", 20), ("BLOCK", 16), ("RANGES", 4), ("WIDE", 2), ("PAIRS_A_ROW", 0), ("DEAL", 30)):
        monkeypatch.setattr(similarity, name, value)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("nearest", [False, True])
def test_names_that_mostly_resemble_each_other(spark, monkeypatch, keyed, nearest):
    # their pairs are compared once and summed up where they are found
    _compare_all(monkeypatch)
    names = [f"SUPPLIER#{i:04d}" for i in range(0, 900, 9)]
    rows = [("p", n, i) for i, n in enumerate(names)] + [("p", names[3], 1000), ("p", None, 1001), ("p", "", 1002)]
    if keyed:
        rows += [("q", n, i) for i, n in enumerate(names) if i % 3] + [("r", n, i) for i, n in enumerate(_names(30, 3))] + [(None, n, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "g string, s string, n int")
    assert not similarity._whole(*(df.where("s > ''").selectExpr("g", "n", "s") for _ in "ab"),
                                 df.where("s > ''").groupBy("g").agg(F.count("s").alias("_nl")).withColumn("_nr", F.col("_nl")), ["g"]).isEmpty()
    found = similar_pairs(df.selectExpr("g", "n AS a", "s AS at"), df.selectExpr("g", "n AS b", "s AS bt"), threshold=0.85, keys=["g"] if keyed else [],
                          left_id="a", left_text="at", right_id="b", right_text="bt", nearest=nearest).collect()
    scored = [(g, a, x, b, y, py_ratio(x, y)) for g, x, a in rows for h, y, b in rows if g == h and g and x and y]
    scored = [r for r in scored if r[-1] > 0.85]
    if not nearest:
        got = [(r.g if keyed else "p", r.a, r["at"], r.b, r.bt, r.score) for r in found]
        assert len(got) == len(set(got)) and set(got) == set(scored)
        return
    want: dict = {}
    for g, a, x, _b, y, s in scored:
        if x != y:
            n, best = want.get((g, a, x), (0, (0.0, "")))
            want[g, a, x] = n + 1, min(best, (-s, y))
    got = {}
    for r in found:
        at = (r.g if keyed else "p", r.a, r["at"])
        n, best = got.get(at, (0, (0.0, "")))
        got[at] = n + r.others, min(best, (-r.score, r.bt))
    assert {k: (v, want.get(k)) for k, v in got.items() if v != want.get(k)} == {} and got == want and len(scored) > 2 * len(rows)


def test_compared_pairs_are_not_dealt_out_again(spark, monkeypatch):
    # no join, no distinct and no exchange over the pairs
    _compare_all(monkeypatch)
    df = spark.createDataFrame([(f"SUPPLIER#{i:04d}",) for i in range(0, 900, 9)], "s string")
    pairs = similar_pairs(df.selectExpr("s AS a", "s AS at"), df.selectExpr("s AS b", "s AS bt"), threshold=0.85, left_id="a", left_text="at", right_id="b", right_text="bt")
    steps = pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups")
    assert len(steps) == 2 and "Join" not in steps[0] + steps[1] and "Exchange" not in steps[0] and "Aggregate" not in steps[0]
