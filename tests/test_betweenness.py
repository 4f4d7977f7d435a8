import itertools
import random
from fractions import Fraction

import pytest

from veriloom.operators import graph, pairs


def plainly(edges, normalized):
    """Betweenness by listing all shortest paths."""
    near = {}
    for a, b, d in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = min(d, near.get(x, {}).get(y, d))
    nodes = sorted(near)
    dist = {(x, y): Fraction(0) if x == y else near[x].get(y) for x in nodes for y in nodes}
    for k, i, j in itertools.product(nodes, repeat=3):
        if dist[i, k] is not None and dist[k, j] is not None and (dist[i, j] is None or dist[i, k] + dist[k, j] < dist[i, j]):
            dist[i, j] = dist[i, k] + dist[k, j]

    def paths(s, t):
        return [[s]] if s == t else [p + [t] for x in near[t] if dist[s, x] is not None and dist[s, x] + near[t][x] == dist[s, t] for p in paths(s, x)]

    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if dist[s, t] is not None:
            found = paths(s, t)
            for p in found:
                for x in p[1:-1]:
                    score[x] += 1 / len(found)
    n = len(nodes)
    return {x: v * (2 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1) for x, v in score.items()}


@pytest.mark.parametrize("normalized", [False, True])
def test_weighted_betweenness_equals_listing_paths(spark, monkeypatch, normalized):
    rng = random.Random(9)
    graphs = {g: [(a, b, Fraction(rng.choice([1, 2, 2, 3, 4]), 8)) for a in range(n) for b in range(a, n) if rng.random() < p] for g, n, p in ((1, 9, 0.4), (2, 8, 0.25), (3, 2, 1), (4, 7, 0.9))}
    graphs[1] += [(3, 1, Fraction(1, 8)), (1, 3, Fraction(5, 8))]  # repeated edges
    df = spark.createDataFrame([(g, a, b, float(d)) for g, es in graphs.items() for a, b, d in es], "graph_id long, src long, dst long, far double")
    for sources in (256, 2):  # all sources in one task, and two in each
        monkeypatch.setattr(graph, "SOURCES", sources)
        got = {}
        for r in graph.betweenness(df, length="far", normalized=normalized).collect():
            got.setdefault(r.graph_id, {})[r.node] = r.betweenness
        assert got == {g: pytest.approx(plainly(es, normalized)) for g, es in graphs.items()}


def test_pairs_in_groups(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rows = [(i, i // 7, [1.0, float(i % 5)]) for i in range(30)] + [(90, 0, None)]
    df = spark.createDataFrame(rows, "id long, grp long, v array<double>")
    got = {(r.a, r.b) for r in pairs.group_pairs(df, 3.0).collect()}
    assert got == {(a, b) for a in range(30) for b in range(a + 1, 30) if a // 7 == b // 7 and 1 + (a % 5) * (b % 5) >= 3}
