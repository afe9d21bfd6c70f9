"""Distributed blocked greedy grouping against the definition of the grouping."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from ledgerlake.operators import categorize as C
from ledgerlake.sources import adapters


def assert_grouping(counts, leaders, members, min_frequency=5, threshold=0.85, cap=100, grouping=True):
    """The grouping by its definition, checked on the result.  Frequent names
    stand in order (most rows first, then by name).  A name is a leader if and
    only if no earlier leader matches it, until the leaders have ``cap`` category
    names; any other name belongs to the earliest leader that matches it.  Of
    leaders with one category name the last has its members."""
    order = sorted((m for m, c in counts.items() if c >= min_frequency), key=lambda m: (-counts[m], m))
    place = {m: i for i, m in enumerate(order)}
    category = dict(leaders)
    last_of = {c: x for x, c in sorted(leaders, key=lambda t: place[t[0]])}
    assert len(last_of) <= cap and len(category) == len(leaders)
    end = max(map(place.get, category), default=-1)
    expected = set()
    for name in order:
        earlier = (x for x in order[: place[name]] if x in category and grouping and SequenceMatcher(None, x, name).ratio() > threshold)
        leader = next(earlier, None)
        if leader is None:
            if name not in category:
                assert len(last_of) == cap and place[name] > end, name
                continue
            leader = name
        else:
            assert name not in category, name
        if last_of[category[leader]] == leader:
            expected.add((category[leader], name))
    assert set(members) == expected and len(members) == len(expected)


def counts_of(df):
    return {r.clean_merchant: r.merchant_count for r in C.merchant_table(df).collect()}


def check(df, **kw):
    cats = C.learn_categories(df, **kw)
    leaders = [(r.leader, r.category_name) for r in cats.leaders.collect()]
    members = [(r.category_name, r.clean_merchant) for r in cats.members.collect()]
    rule = {"max_categories": "cap", "smart_grouping": "grouping"}
    assert_grouping(counts_of(df), leaders, members, **{rule[k]: v for k, v in kw.items() if k in rule})
    return members


@pytest.mark.parametrize("source", ["lineitem", "supplier", "orders"])
def test_grouping_follows_its_definition(spark, source):
    check(adapters.ADAPTERS[source](spark, SF001))


def _fixture(spark, names_counts):
    rows = []
    i = 0
    for name, c in names_counts:
        for _ in range(c):
            rows.append(("1", name, -1.0, i))
            i += 1
    return spark.createDataFrame(rows, "account_number string, main_description string, amount double, row_id bigint").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)")
    )


def test_chain_names_and_small_blocks(spark):
    # B matches A, C matches B but not A: C leads a group of its own
    data = [
        ("AMAZON MARKETPLACE", 20), ("AMAZON MARKETPLAC", 15), ("AMAZON MARKETPL", 12),
        ("SHELL GARAGE", 11), ("GARAGE SHELL", 10), ("TESCO", 9), ("TESCOS", 8), ("UBER", 7), ("NETFLIX", 6), ("AB 12", 5), ("RARE", 4),
    ]
    df = _fixture(spark, data)
    by_hand = {
        "AMAZON_MARKETPLACE_MARKETPLAC": {"AMAZON MARKETPLACE", "AMAZON MARKETPLAC", "AMAZON MARKETPL"},
        "SHELL_GARAGE": {"SHELL GARAGE"}, "GARAGE_SHELL": {"GARAGE SHELL"}, "TESCO_TESCOS": {"TESCO", "TESCOS"},
        "UBER": {"UBER"}, "NETFLIX": {"NETFLIX"}, "AB_12": {"AB 12"},
    }
    for block in (2, 256):
        got = {}
        for category, name in check(df, block=block):
            got.setdefault(category, set()).add(name)
        assert got == by_hand


def test_cap(spark):
    data = [(f"SHOP{chr(65 + i)}{chr(65 + j)} X{i}{j}", 5 + (i * 7 + j) % 3) for i in range(12) for j in range(12)]
    check(_fixture(spark, data), max_categories=10, block=16)


def test_no_grouping(spark):
    check(adapters.lineitem_transactions(spark, SF001), smart_grouping=False)


def test_fuzzy_stage_takes_the_best_known_merchant(spark):
    """Uncategorised frequent merchants take the category of their best-scoring
    known merchant (> threshold; first in category order on equal scores)."""
    df = adapters.supplier_transactions(spark, SF01)
    out, cats = C.categorize(df, smart_grouping=False, max_categories=10)
    members = sorted(
        ((r.category_order, r.merchant_rank, r.clean_merchant, r.category_name) for r in cats.members.collect()),
        key=lambda t: (t[0], t[1]),
    )
    known = [(m, cat) for _, _, m, cat in members]
    counts = counts_of(df)
    expected = {}
    for m, c in counts.items():
        if c < 5 or any(m == k for k, _ in known):
            continue
        best, score = None, 0.85
        for k, cat in known:
            s = SequenceMatcher(None, m, k).ratio()
            if s > score:
                best, score = cat, s
        if best:
            expected[m] = best
    got = {}
    for r in C.with_clean_merchant(out).where(F.col("category_confidence") == 0.7).select("clean_merchant", "auto_category").distinct().collect():
        got[r.clean_merchant] = r.auto_category
    assert got == expected and len(got) > 0


@pytest.mark.parametrize("block,cap", [(256, 100), (8, 12)])
def test_per_account_scope_follows_the_definition_per_account(spark, block, cap):
    """Categories learned per account obey the rule on that account's rows alone
    (RPT-1), including the per-account cap and the fuzzy stage."""
    df = adapters.lineitem_transactions(spark, SF001)
    out, cats = C.categorize(df, scope=["account_number"], block=block, max_categories=cap)
    counts, leaders, members = {}, {}, {}
    for r in C.merchant_table(df, scope=["account_number"]).collect():
        counts.setdefault(r.account_number, {})[r.clean_merchant] = r.merchant_count
    for r in cats.leaders.collect():
        leaders.setdefault(r.account_number, []).append((r.leader, r.category_name))
    for r in cats.members.collect():
        members.setdefault(r.account_number, []).append((r.category_name, r.clean_merchant))
    for account, own in counts.items():
        assert_grouping(own, leaders.get(account, []), members.get(account, []), cap=cap)
    # every row keeps its account and gets a label
    assert out.count() == df.count()
    assert out.where(F.col("auto_category").isNull()).count() == 0


@pytest.mark.parametrize("seed,block,cap", [(21, 16, 100), (22, 7, 25)])
def test_random_name_sets_follow_the_definition(spark, seed, block, cap):
    """Random families of near-duplicate names (<= 200 distinct), small blocks:
    multi-round absorption and the cap."""
    import random

    rnd = random.Random(seed)
    stems = ["AMAZON MARKET", "TESCO STORES", "SHELL GARAGE", "UBER TRIP", "NETFLIX COM", "CAFE NERO",
             "BOOTS CHEMIST", "ARGOS LTD", "PRET A MANGER", "WAITROSE"]
    data = {}
    while len(data) < 180:
        base = rnd.choice(stems)
        edit = rnd.random()
        if edit < 0.3:
            name = base
        elif edit < 0.6:
            name = base + rnd.choice(["S", "X", " UK", " 1", "E"])
        elif edit < 0.8:
            i = rnd.randrange(len(base))
            name = base[:i] + rnd.choice("ABCDEFGH") + base[i + 1:]
        else:
            name = base + " " + "".join(rnd.choice("QRSTUVWXYZ") for _ in range(rnd.randint(2, 6)))
        data[name] = rnd.randint(5, 12)
    check(_fixture(spark, sorted(data.items())), block=block, max_categories=cap)


def test_names_are_cleaned_once_a_description(spark, tmp_path):
    # a condition on the cleaned name must not be pushed onto the rows (F5, F7, F8, F9)
    path = str(tmp_path / "rows")
    _fixture(spark, [("ACME LTD", 9), ("TESCO", 7)]).write.parquet(path)
    df = spark.read.parquet(path)
    cats = C.learn_categories(df)
    written = C.category_table(df, cats)
    assert not [f for f in written.inputFiles() if f.startswith(f"file://{path}")]
    _out, learned = C.categorize(df)
    again = C.category_table(df, learned, descriptions=learned.descriptions)
    assert not [f for f in again.inputFiles() if f.startswith(f"file://{path}")]
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, again.collect()))
    assert {(r.category_name, r.transaction_count) for r in again.collect()} == {("ACME", 9), ("TESCO", 7)}


def test_written_tables_are_not_broadcast(spark):
    # F1 to F3: millions of rows of few values are small files, and were sent to the driver
    rows = [(s, n, (-c, n)) for s in ("p", "q") for n, c in (("TESCO", 9), ("TESCOS", 8), ("UBER", 7))]
    batch = spark.createDataFrame(rows, f"account_number string, clean_merchant string, merchant_rank {C.RANK_TYPE}")
    grouped = C._grouped(batch, similarity=0.85, smart_grouping=True, scope=["account_number"])
    assert "Broadcast" not in grouped._jdf.queryExecution().executedPlan().toString()
    found = {(r.account_number, r.clean_merchant, r.leader_rank.name) for r in grouped.collect()}
    assert found == {(s, n, lead) for s in ("p", "q") for n, lead in (("TESCO", "TESCO"), ("TESCOS", "TESCO"), ("UBER", "UBER"))}
