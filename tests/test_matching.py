import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import matching


def loop(pairs, cap, used=None):
    used, out = dict(used or {}), []
    for a, b in pairs:
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b))
    return out, used


def graph(seed, n=14, density=0.4):
    rng = random.Random(seed)
    return {(g, a, b): round(rng.random(), 1) for g in range(3) for a in range(n) for b in range(a + 1, n) if rng.random() < density}


@pytest.mark.parametrize(("seed", "cap"), [(1, 1), (2, 2), (3, 3)])
def test_greedy_equals_loop(spark, seed, cap):
    pairs = graph(seed)
    df = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "grp int, a int, b int, sim double")
    got = {(r.grp, r.a, r.b) for r in matching.greedy(df, cap, [F.desc("sim"), F.col("a"), F.col("b")]).collect()}
    want = {(g, a, b) for g in range(3) for a, b in loop([k[1:] for k in sorted((k for k in pairs if k[0] == g), key=lambda k: (-pairs[k], k[1:]))], cap)[0]}
    assert got == want


def test_chains_hot_items_and_empty_tables(spark):
    chain = [(0, i, i + 1, i / 30) for i in range(12)] + [(1, 0, i, 1 / i) for i in range(1, 300)]  # a chain that gets better, an item in all pairs
    df = spark.createDataFrame(chain, "grp int, a int, b int, sim double")
    got = {(r.grp, r.a, r.b) for r in matching.greedy(df, 1, [F.desc("sim"), F.col("a"), F.col("b")]).collect()}
    assert got == {(0, i, i + 1) for i in (11, 9, 7, 5, 3, 1)} | {(1, 0, 1)}
    assert matching.sample_pairs(df.limit(0), 3, 5).count() == 0


def test_sampling_equals_loop(spark):
    pairs = graph(5)
    df = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "grp int, a int, b int, sim double")
    got = {(r.grp, r.a, r.b): r.sampled_as for r in matching.sample_pairs(df, 6, 10).collect()}
    want = {}
    for g in range(3):
        own = sorted((k[1:] for k in pairs if k[0] == g), key=lambda p: (-pairs[g, *p], p))
        first = loop(own, 2)[0][:6]
        _, used = loop(first, 2)
        rest = sorted((p for p in own if p not in first), key=lambda p: hashlib.md5(f"7|{p[0]}|{p[1]}".encode()).hexdigest())
        want |= {(g, *p): "top_similarity" for p in first} | {(g, *p): "random_eligible" for p in loop(rest, 2, used)[0][: 10 - len(first)]}
    assert got == want
