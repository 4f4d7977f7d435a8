import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.operators import metric, pairs


def table(spark, v, start=0, kind="double"):
    return spark.createDataFrame([(i + start, i % 3, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], f"id long, grp int, v array<{kind}>")


def clustered(seed, n, clusters=12, d=16, spread=0.05, unit=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    v = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1)[:, None] * (1 if unit else rng.uniform(0.2, 3, size=(n, 1)))


def plainly(x, y, floor, start=0):
    sims = x @ y.T
    return {(i, j + start) for i, j in zip(*np.nonzero(sims >= floor), strict=True) if i != j + start}


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("floor", [0.97, 0.6, 0.2, -0.3])
def test_indexed_join_equals_all_pairs(spark, monkeypatch, floor, unit):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    x, y = clustered(1, 260, unit=unit), clustered(1, 310, unit=unit)
    got = pairs.blocked_join(table(spark, x), table(spark, y, 1000), floor, same_group=None, index=True)
    assert {(r.a, r.b) for r in got.collect()} == plainly(x, y, floor, 1000)


def test_indexed_join_of_a_table_with_itself_and_groups(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 40)
    x = clustered(2, 300)
    x[200:280] = x[0]  # one very common vector
    df = table(spark, x)
    got = [(r.a, r.b) for r in pairs.blocked_join(df, df, 0.9, same_group=False, unordered=True, index=True).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in plainly(x, x, 0.9) if a < b and a % 3 != b % 3}


@pytest.mark.parametrize("unit", [True, False])
def test_indexed_nearest_equals_sorting(spark, monkeypatch, unit):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    x = np.concatenate([clustered(3, 290, unit=unit), np.zeros((3, 16))])
    x[100:120] = x[7]
    df = table(spark, x)
    best = {}
    for r in pairs.top_per_row(pairs.nearest(df, df, 4, index=True), 4).collect():
        best.setdefault(r.a, []).append((round(-r.sim, 9), r.b))
    sims = x @ x.T
    for i in range(len(x)):
        want = sorted((round(-sims[i, j], 9), j) for j in range(len(x)) if j != i)[:4]
        assert [s for s, _ in sorted(best[i])] == pytest.approx([s for s, _ in want]), i


def test_work_is_saved_where_vectors_cluster_and_nowhere_else(spark):
    shares = {}
    for n in (500, 1_000, 2_000):
        for name, v in (("clustered", clustered(4, n, clusters=60)), ("random", clustered(4, n, clusters=n, d=64, spread=1.0))):
            df = table(spark, v)
            rings = metric.fit(df, n)
            for floor in (0.95, 0.3):
                done = metric.work(rings, df.withColumn("floor", F.lit(floor)))
                shares[name, floor, n] = round(done["pairs"] / n**2, 3)
                print(name, floor, n, done, shares[name, floor, n])
    assert  shares["clustered", 0.95, 2_000] < 0.15
    assert shares["random", 0.3, 2_000] > 0.9  # a floor that low excludes nothing among random vectors


def test_null_empty_and_ragged_vectors(spark):
    df = table(spark, [[1, 0], None, [1, 0], [], [0.9, 0.1]])
    for index in (None, True):
        assert {(r.a, r.b) for r in pairs.blocked_join(df, df, 0.5, same_group=None, unordered=True, index=index).collect()} == {(0, 2), (0, 4), (2, 4)}
        assert {r.a for r in pairs.nearest(df, df, 1, index=index).collect()} == {0, 2, 4}
        holed = spark.createDataFrame([(1, 0, [1.0, None]), (2, 0, [1.0, 2.0]), (3, 0, [2.0, 1.0])], "id long, grp int, v array<double>")
        assert {(r.a, r.b) for r in pairs.blocked_join(holed, holed, 0.5, same_group=None, unordered=True, index=index).collect()} == {(2, 3)}
        none = df.where("v is null")
        assert pairs.blocked_join(none, df, 0.5, same_group=None, index=index).count() == pairs.blocked_join(df, none, 0.5, same_group=None, index=index).count() == 0
        with pytest.raises(Exception, match="dimensions"):
            pairs.blocked_join(table(spark, [[1, 0], [1, 0, 0]]), df, 0.5, same_group=None, index=index).count()
