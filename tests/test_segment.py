"""Cuts of documents against loops."""

import random

import numpy as np
import pytest

from tests.helpers import rows
from veriloom.operators import segment


def loop_cuts(depth, least, floor=0.05, factor=0.5):
    """Take the deepest gap left as long as all segments keep the least size, sorting all cuts anew each time."""
    n, cuts = len(depth) + 1, []
    cutoff = max(floor, float(np.mean(depth) + factor * np.std(depth)))
    for k in sorted(range(len(depth)), key=lambda k: (-depth[k], k)):
        edges = sorted([-1, n - 1, *cuts, k])
        if depth[k] >= cutoff and all(b - a >= least for a, b in zip(edges, edges[1:], strict=False)):
            cuts.append(k)
    return sorted(cuts)


@pytest.mark.parametrize("least", [1, 2, 4, 7])
def test_boundaries_equal_loop(spark, least):
    """Documents from one gap to hundreds, with equally deep gaps and long runs of deep ones."""
    rng = random.Random(least)
    docs = {d: [rng.choice([0.0, 0.1, 0.5, rng.random()]) for _ in range(n)] for d, n in enumerate([1, 2, 5, 7, 8, 15, 60, 400])}
    docs[90], docs[91] = [1.0] * 50 + [0.0] * 80, [0.0] * 30
    df = spark.createDataFrame([(d, g, x) for d, s in docs.items() for g, x in enumerate(s)], "doc_id long, gap long, depth double")
    got = {d: [] for d in docs}
    for r in rows(segment.boundaries(df, least), "doc_id", "gap"):
        got[r["doc_id"]].append(r["gap"])
    assert got == {d: loop_cuts(s, least) for d, s in docs.items()}
    assert len(got[7]) > 5


def test_no_gaps_no_cuts(spark):
    assert segment.boundaries(spark.createDataFrame([], "doc_id long, gap long, depth double")).count() == 0


def loop_parts(v, tokens, most, least=4):
    """Each part's whole curve anew, its deepest valley by climbing."""

    def climbed(s, i, step):
        top = s[i]
        while 0 <= i + step < len(s) and s[i + step] >= s[i]:
            i += step
            top = s[i]
        return top

    def split(a, b):
        if b - a < 2 or sum(tokens[a:b]) <= most:
            return [b - a]
        s = []
        for g in range(a, b - 1):
            x, y = v[max(a, g - 2) : g + 1].mean(axis=0), v[g + 1 : min(b, g + 4)].mean(axis=0)
            s.append(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)))
        small = max(1, min(least, (b - a) // 2))
        best = max((k for k in range(len(s)) if k + 1 >= small and b - a - k - 1 >= small), key=lambda k: (climbed(s, k, -1) + climbed(s, k, 1) - 2 * s[k], -s[k]))
        return split(a, a + best + 1) + split(a + best + 1, b)

    return [k for k, n in enumerate(split(0, len(v))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_split_oversize_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    docs = {d: (rng.normal(size=(n, 5)), rng.integers(0, 400, n)) for d, n in enumerate([1, 2, 3, 9, 40, 150])}
    docs[6] = (np.ones((20, 5)), np.full(20, 300))
    data = [(d, i, int(n), x.tolist()) for d, (v, t) in docs.items() for i, (x, n) in enumerate(zip(v, t, strict=True))]
    got = rows(segment.split_oversize(spark.createDataFrame(data, "doc_id long, i long, n_tokens long, v array<double>"), 900), "doc_id", "i")
    for d, (v, t) in docs.items():
        assert [r["part"] for r in got if r["doc_id"] == d] == loop_parts(v, t, 900)
