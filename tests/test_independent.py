"""The ordered independent set against going through the nodes one by one."""

import math
import random

from ledgerlake.functions.independent import first_independent_set


def one_by_one(n, edges):
    earlier = {}
    for a, b in edges:
        earlier.setdefault(b, []).append(a)
    chosen = set()
    for i in range(n):
        if not any(a in chosen for a in earlier.get(i, ())):
            chosen.add(i)
    return chosen


def test_set_and_rounds(spark):
    rng = random.Random(4)
    graphs = {"sparse": (400, 500), "dense": (60, 900), "none": (20, 0), "chain": (12, None)}
    nodes, edges, want = [], [], set()
    for name, (n, m) in graphs.items():
        own = {(i, i + 1) for i in range(n - 1)} if m is None else {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        nodes += [(name, i) for i in range(n)]
        edges += [(name, a, b) for a, b in own]
        want |= {(name, i) for i in one_by_one(n, own)}
    chosen, rounds = first_independent_set(spark.createDataFrame(nodes, "g string, node int"), spark.createDataFrame(edges, "g string, before int, after int"), ["g"])
    got = [tuple(r) for r in chosen.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rounds <= 2 * math.log2(len(nodes))


def test_rounds_grow_slowly(spark):
    rng = random.Random(9)
    n = 3000
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(4 * n)}
    chosen, rounds = first_independent_set(spark.createDataFrame([(i,) for i in range(n)], "node int"), spark.createDataFrame(list(edges), "before int, after int"))
    assert {r["node"] for r in chosen.collect()} == one_by_one(n, edges)
    assert rounds <= 2 * math.log2(n)
