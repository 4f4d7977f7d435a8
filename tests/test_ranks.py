import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators.ranks import numbered


def test_numbered_equals_sorting(spark):
    rng = random.Random(1)
    values = [(rng.choice([None, *range(40)]), i) for i in range(3_000)]
    got = numbered(spark.createDataFrame(values, "v int, i int").repartition(7), [F.asc_nulls_first("v"), F.desc("i")], "at")
    want = sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))
    assert [(r.v, r.i) for r in sorted(got.collect(), key=lambda r: r["at"])] == want and sorted(r["at"] for r in got.collect()) == list(range(3_000))


def test_numbered_empty_ties_and_clashing_names(spark):
    assert numbered(spark.range(0), [F.col("id")]).count() == 0
    same = spark.range(500).select(F.lit(1).alias("part"), F.lit(2).alias("count"))
    assert sorted(r.place for r in numbered(same, [F.col("part")]).collect()) == list(range(500))


def test_quantiles_and_shares_equal_windows(spark):
    import numpy as np

    from veriloom.operators.ranks import quantiles, share_below

    rng = random.Random(2)
    values = [(i, rng.choice(["a", "b", None, "one"]) if i else "one", rng.choice([None, 1, 2, 2, 5, 9, rng.random()])) for i in range(400)]
    values = [(i, "x" if g == "one" and i else g, None if v is None else float(v)) for i, g, v in values]
    df = spark.createDataFrame(values, "i int, g string, v double").repartition(5)
    got = {r.g: (r.q1, r.med, r.top) for r in quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "top": 1.0}).collect()}
    groups = {g: [v for _, x, v in values if x == g and v is not None] for g in {g for _, g, _ in values}}
    assert {g: [pytest.approx(float(np.quantile(v, q))) for q in (0.25, 0.5, 1.0)] for g, v in groups.items() if v} == {g: list(x) for g, x in got.items()}
    low = lambda v: (v is not None, v or 0)
    want = {i: sum(h == g and low(w) < low(v) for _, h, w in values) / sum(h == g for _, h, _ in values) for i, g, v in values}
    assert {r.i: r.share for r in share_below(df, "g", "v").collect()} == want
    assert quantiles(df.limit(0), ["g"], "v", {"med": 0.5}).count() == share_below(df.limit(0), "g", "v").count() == 0
