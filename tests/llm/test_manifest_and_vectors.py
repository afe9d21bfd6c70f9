"""Merkle manifest, vector codes and embedding near-duplicates, each against a
direct version of its definition."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import itq, merkle, part_codes, queries

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, id long, digest string, `a.b` string, shown int"


# --- merkle ------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    for nodes in levels[:-1]:
        other = i ^ 1
        yield (other & 1, nodes[other]) if other < len(nodes) else None
        i >>= 1


def manifest_rows(rows):
    """The contract's columns by its words, for (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, row_leaf(*r), r))
    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    levels = {v: tree_levels([x[2] for x in sorted(trees[v], key=lambda x: x[:3])]) for v in order}
    top = tree_levels([levels[v][-1][0] for v in order])
    out = []
    for place, v in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[v], key=lambda x: x[:3])):
            steps = [*path(levels[v], i), *path(top, place)]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = row_leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for s in steps:
                node = sha(node) if s is None else sha(node, s[1]) if s[0] else sha(s[1], node)
            proof = sha(*(s[1] for s in steps if s))
            out.append((r[0], leaf, levels[v][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def manifest_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", "z", 1) for r in rows], DOCS).repartition(3)


def shown(docs, **kw):
    found = merkle.proofs(merkle.build(docs, carry={"shown": merkle.tampered_fields()}, **kw))
    found = found.withColumn("folded", merkle.folded(F.col("shown"), F.col("steps")))
    return found.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof"), "folded", (F.col("folded") == F.col("root")).alias("ok"))


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_by_its_definition(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, i]), rng.choice(["a", None, ""]), rng.choice(["en", "de", "", "é", None, "en"]), rng.choice([None, 0, 17]),
             rng.choice([None, "", "w" * 9, "中" * 40])) for i in range(150)] + [(5, "s", "en", 1, "same")] * 9 + [(6, "s", "one", 1, "t" * 500_000)]
    got = [tuple(r) for r in shown(manifest_frame(spark, rows), height=height).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(manifest_rows(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert shown(manifest_frame(spark, [])).collect() == []
    one = [(3, None, None, None, None)]
    assert [tuple(r) for r in shown(manifest_frame(spark, one)).collect()] == manifest_rows(one)


def test_log_is_in_postorder_and_positions_are_closed_form(spark):
    docs = queries.table(spark, SF01, "documents")
    made = merkle.build(docs, height=4)
    for (tree, n), rows in itertools.groupby(
        merkle.log_nodes(made.trees).join(made.trees.items.select("tree", "n").distinct(), "tree").orderBy("tree", "pos").collect(), lambda r: (r["tree"], r["n"])):
        rows = list(rows)
        assert [r["pos"] for r in rows] == list(range(merkle.subtree_size(merkle.levels(n), n)))
        below = {}
        for r in rows:  # a node comes after its children, right after the last
            level, i = r["level"], r["idx"]
            children = [below[level - 1, j] for j in (2 * i, 2 * i + 1) if (level - 1, j) in below] if level else []
            if level:
                assert children and r["digest"] == sha(*(c["digest"] for c in children)) and children[-1]["pos"] == r["pos"] - 1
            below[level, i] = r
        assert (merkle.levels(n), 0) in below


def test_positions_do_not_move_when_rows_are_appended():
    for n in range(1, 70):
        leaves = [str(i).encode() for i in range(n)]
        log = merkle.postorder(leaves, merkle.levels(n))
        assert len(log) == merkle.subtree_size(merkle.levels(n), n)
        for level in range(merkle.levels(n) + 1):
            for i in range(n >> level):  # full nodes
                assert merkle.position(level, i, n) == merkle.position(level, i, n + 5)
        assert [log[merkle.position(0, i, n)] for i in range(n)] == leaves


# --- vector codes ------------------------------------------------------------

def direct_codes(rows, entries=256, parts=4, rounds=4):
    """(vec_id, label, integers) to codes and errors by comparing all."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    q = np.array([r[2] for r in rows], np.int64)
    cut = [q.shape[1] * i // parts for i in range(parts + 1)]
    split = [q[:, a:b] for a, b in zip(cut, cut[1:])]
    books = [s[:entries].copy() for s in split]

    def assign(s, b):
        d = ((s[:, None, :] - b[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for s, b in zip(split, books):
            at, _ = assign(s, b)
            for e in set(at.tolist()):
                b[e] = s[at == e].sum(axis=0) // (at == e).sum()
    last = [assign(s, b) for s, b in zip(split, books)]
    error = sum(d for _, d in last)
    return [(r[0], r[1], "".join(f"{a[i]:02x}" for a, _ in last), int(error[i])) for i, r in enumerate(rows)], books


def test_codes_by_their_definition(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 1, (700, 10)), 1)  # few values: ties, shared prefixes, repeated parts
    values[:200] = values[0]
    rows = [(i if i % 50 else None, None if i % 9 == 0 else int(i % 4), v.tolist()) for i, v in enumerate(values)] + [(3, 1, values[5].tolist())]
    bad = [(9001, 1, None), (9002, 1, [None] * 10), (9003, 1, [float("nan")] * 10), (9004, 1, [float("inf")] + [0.0] * 9), (9005, 1, [1.0]), (9006, 1, [])]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + bad], "vec_id long, label int, embedding array<double>, q string, pos int, `a.b` string").repartition(4)
    codes = part_codes.encode(frame)
    want, books = direct_codes([(i, k, [int(np.floor(1024 * x)) for x in v]) for i, k, v in rows])
    key = lambda r: tuple(str(x) for x in r)
    got = part_codes.with_label_error(codes).collect()
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert all((a == b).all() for a, b in zip(codes.books, books))
    for r in got:
        assert r["label_error"] == sum(w[3] for w in want if w[1] == r["label"])


def test_codes_of_few_or_extreme_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = part_codes.encode(spark.createDataFrame([], schema))
    assert part_codes.with_label_error(none).collect() == []
    got = part_codes.with_label_error(part_codes.encode(spark.createDataFrame([(2, None, [3e38, -3e38, 0.5, -0.0004]), (1, None, [0.0] * 4)], schema))).collect()
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got} == {(1, "00000000", 0, 0), (2, "01010101", 0, 0)}


@pytest.mark.parametrize("spread", [0, 1, 2, 500])
def test_trie_finds_the_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    parts = rng.integers(-spread, spread + 1, (900, 7))
    parts = parts[np.lexsort(parts.T[::-1])]
    entries = rng.integers(-spread, spread + 1, (40, 7))
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for subtrie in (1, 8, 256):
        best, least = part_codes.nearest(parts, entries, subtrie)
        assert (best == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


# --- embedding near-duplicates -----------------------------------------------

def direct_links(ids, x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(ids)).min(axis=1, initial=len(ids)))
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in zip(ids, label):
        least[k] = min(least.get(k, i), i)
    return near, [(i, int(n), least[k], i == least[k]) for i, n, k in zip(ids, near.sum(axis=1), label)]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], "vec_id long, embedding array<double>, v string, node int, t int, m int, `a.b` string").repartition(3)


def planted(seed, singles=800, groups=60):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    out = [rng.normal(size=48) for _ in range(singles)]
    for g in range(groups):
        centre = unit(rng.normal(size=48))
        for _ in range(1 + g % 4):
            away = rng.normal(size=48)
            away = unit(away - (away @ centre) * centre)
            s = rng.uniform(0.9005, 0.94)  # just above the threshold
            out.append(rng.uniform(0.5, 3) * (s * centre + np.sqrt(1 - s * s) * away))
        out.append(centre)
    return np.array(out)


def test_recall_just_above_the_threshold_and_no_false_links(spark):
    x = planted(5)
    near, want = direct_links(list(range(len(x))), x)
    got = {r["vec_id"]: tuple(r) for r in itq.near_duplicates(frame_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert len(got) == len(x)
    assert all(got[i][1] <= w[1] for i, w in enumerate(want))
    assert sum(r[1] for r in got.values()) >= 0.95 * near.sum()


def test_copies_hot_groups_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    x = [centre + rng.normal(0, 0.02, 16) for _ in range(90)] + [centre] * 40 + list(rng.normal(size=(40, 16)))
    odd = [(1001, None), (1002, [0.0] * 16), (1003, [None] * 16), (1004, [float("nan")] * 16), (1005, [1.0]), (1006, [float("inf")] * 16), (1007, []), (None, None)]
    _, want = direct_links(list(range(len(x))), np.array(x))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    for block in (1024, 16):  # whole buckets, and parts that meet pairwise
        got = itq.near_duplicates(frame_of(spark, rows + odd), params=itq.Quantising(block=block)).collect()
        assert sorted(tuple(r) for r in got if r["vec_id"] is not None and r["vec_id"] < 1000) == want
        assert sorted((tuple(r) for r in got if r["vec_id"] is None or r["vec_id"] > 1000), key=str) == sorted(((i, 0, i, True) for i, _ in odd), key=str)
    repeated = itq.near_duplicates(frame_of(spark, [(4, rows[0][1]), (4, rows[0][1]), (None, rows[0][1])])).collect()
    assert sorted((tuple(r) for r in repeated), key=str) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False)]
    assert itq.near_duplicates(frame_of(spark, [])).collect() == []


def test_learned_bits_are_balanced_and_lose_less():
    rng = np.random.default_rng(2)
    x = itq.unit(rng.normal(size=(600, 24)) @ rng.normal(size=(24, 24)))
    model = itq.learn(x, 600)
    share = ((x - model.mean) @ model.turn > model.cut).mean(axis=0)
    assert (abs(share - 0.5) < 0.01).all()
    y = x - x.mean(axis=0)
    loss = lambda turn: np.square(np.where(y @ turn > 0, 1, -1) - y @ turn).sum()
    assert loss(itq.rotation(y, np.random.default_rng(1), 20)) < loss(itq.rotation(y, np.random.default_rng(1), 0))
