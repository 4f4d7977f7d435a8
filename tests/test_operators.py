import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows

from veriloom.config import Config, ConfigError, apply, override
from veriloom.operators import dialogue, graph, merge, pairs, periods, resolve, segment
from veriloom.sources import checkpoint, ingest
from veriloom.streaming.incremental import process_folder


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, grp int, v array<double>")


def test_blocked_join_equals_all_pairs(spark, monkeypatch):
    v, df = vectors(spark, 40, 1)
    monkeypatch.setattr(pairs, "BLOCK", 16)
    got = {(r.a, r.b) for r in pairs.blocked_join(df, df, 0.2).collect()}
    want = {(i, j) for i in range(40) for j in range(40) if i % 3 != j % 3 and v[i] @ v[j] >= 0.2}
    assert got == want


def test_top_per_row_and_budget(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.9), (1, 2, 0.1)], "a long, b long, sim double")
    assert {(r.a, r.b) for r in pairs.top_per_row(df, 2).collect()} == {(0, 3), (0, 1), (1, 2)}
    kept = pairs.budget(df.withColumn("doc_id", F.lit(1)), 2, ["doc_id"])
    assert {(r.a, r.b) for r in kept.collect()} == {(0, 3), (0, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_greedy_keep_equals_loop(spark, seed):
    rng = random.Random(seed)
    links = {(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25} or {(0, 1)}
    kept = []
    for n in range(12):
        if not any((k, n) in links for k in kept):
            kept.append(n)
    got = merge.greedy_keep(spark.range(12).withColumnRenamed("id", "node"), spark.createDataFrame(list(links), "a long, b long"))
    assert sorted(r.node for r in got.where("kept").collect()) == kept


def climb(s, i, step):
    top = s[i]
    j = i + step
    while 0 <= j < len(s) and s[j] >= top:
        top = s[j]
        j += step
    return top


def test_depths_equal_climbing(spark):
    rng = random.Random(3)
    series = {d: [round(rng.random(), 1) for _ in range(20)] for d in range(4)}
    df = spark.createDataFrame([(d, i, x) for d, s in series.items() for i, x in enumerate(s)], "doc_id long, gap long, sim double")
    for r in segment.depths(df).collect():
        s = series[r.doc_id]
        assert r.depth == pytest.approx(climb(s, r.gap, -1) + climb(s, r.gap, 1) - 2 * s[r.gap])


def test_boundaries_keep_least_size(spark):
    df = spark.createDataFrame([(0, i, 1.0 if i in (2, 5, 9) else 0.1, 1.0 if i in (2, 5, 9) else 0.1) for i in range(13)], "doc_id long, gap long, sim double, depth double")
    cuts = sorted(r.gap for r in segment.boundaries(df).collect())
    edges = [-1, *cuts, 13]
    assert cuts == [5, 9]
    assert all(b - a >= 4 for a, b in zip(edges, edges[1:], strict=False))


def test_split_oversize(spark):
    df = spark.createDataFrame([(0, i, 100, [float(i < 7), float(i >= 7)]) for i in range(14)], "doc_id long, i long, n_tokens long, v array<double>")
    assert [r["part"] for r in rows(segment.split_oversize(df, 900), "i")] == [0] * 7 + [1] * 7


def test_resolution_order_and_margin(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.9, 0.8, 0.2), (0, 2, 3, 0.8, 0.9, 0.1), (0, 4, 5, 0.7, 0.5, 0.5), (0, 6, 7, 0.6, 0.1, 0.25)], "doc_id long, a long, b long, score double, support_a double, support_b double")
    assert [r["resolution"] for r in rows(resolve.resolve(df), "a")] == ["kept_a", "superseded", "unresolved", "kept_b"]


def test_pack_by_budget(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([30, 40, 10, 5, 5, 5, 5, 90])], "doc_id long, i long, n long")
    assert merge.pack_by_budget(df, 60, 4).first().groups == [0, 1, 1, 1, 1, 2, 2, 3]


def test_periods(spark):
    df = spark.createDataFrame([("Revenue in second quarter of fiscal 2026 vs 2025 Q4.",), ("v2.1 of March 31, 2026",), ("none",)], "t string")
    got = [r.m for r in df.select(F.transform(periods.markers(F.col("t")), lambda m: F.concat_ws(":", m["kind"], m["a"], m["b"])).alias("m")).collect()]
    assert got[0] == ["Q:2026:2", "FY:2026:", "Q:2025:4", "Q::4"]
    assert got[1] == ["V:2.1:", "M:2026:3"]
    assert got[2] == []


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "T", "sections": [{"title": "One", "text": "x"}, {"text": " "}]}')
    (tmp_path / "b.json").write_text('{"text": "x", "document": "y"}')
    (tmp_path / "c.txt").write_bytes("﻿hé\r\nyo".encode())
    (tmp_path / "d.md").write_bytes(b"a\x00b")
    (tmp_path / "e.xls").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "g.pdf").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.read_files(spark, str(tmp_path)).collect()}
    assert got["a.json"].text == "# T\n\n## One\n\nx"
    assert got["b.json"].text is None and "exactly one" in got["b.json"].error
    assert got["c.txt"].text == "hé\nyo"
    assert got["d.md"].error == "binary data"
    assert got["e.xls"].error.startswith("unsupported")
    assert got["f.txt"].error == "not UTF-8"
    assert got["g.pdf"].error == "not a PDF file"


def test_checkpoint_skips_damage(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"key": "k1", "section_index": 1, "generated": "x"}\n{"key": "k2", "sec\n')
    good, damaged = checkpoint.read(spark, str(path))
    assert [r.key for r in good.collect()] == ["k1"]
    assert damaged.count() == 1
    path.write_text('{"key": "k1", "section_index": 1, "generated": "old"}\nnot json\n{"key": "k1", "section_index": 2, "generated": "new"}\n')
    good, damaged = checkpoint.read(spark, str(path))
    assert [(r.section_index, r.generated) for r in good.collect()] == [(2, "new")] and [r.damaged for r in damaged.collect()] == ["not json"]
    checkpoint.append(good, str(tmp_path / "more"))
    assert checkpoint.read(spark, str(tmp_path / "more"))[0].count() == 1


def test_stream_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    step = lambda df: df.select("doc_id", F.length("text").alias("n"))
    for i in range(2):
        spark.createDataFrame([(i, "x" * i)], "doc_id long, text string").write.mode("append").parquet(source)
        process_folder(spark, source, sink, state, step).awaitTermination(120)
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(sink).collect()) == [(0, 0), (1, 1)]


def test_config_is_strict():
    assert override(Config(), "contradiction.threshold=1").contradiction.threshold == 1.0
    for bad in ("contradiction.nope=1", "contradiction.candidate_top_k=true", "contradiction.action=burn", "threshold=1"):
        with pytest.raises(ConfigError):
            override(Config(), bad)
    with pytest.raises(ConfigError):
        apply(Config(), {"x": {}})


def test_dialogue(spark):
    turns = spark.createDataFrame([(1, 0, "Ann Lee", "Good morning everyone. We expect that our sales will rise by 5 percent. Thank you. Will growth last through the whole fiscal year 2026?"), (1, 1, "Operator", "Hello.")], "conv_id long, turn long, speaker string, text string")
    got = rows(dialogue.describe(turns), "turn")
    assert got[0]["text"] == "Ann Lee said that the company expects that the company's sales will rise by 5 percent. Ann Lee asked: Will growth last through the whole fiscal year 2026?"
    assert (got[0]["kept"], got[0]["dropped"]) == (2, 2)
    assert (got[1]["text"], got[1]["kept"], got[1]["dropped"]) == ("", 0, 1)


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "graph_id long, src long, dst long")
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()} == {1: 0, 2: 2, 3: 2, 4: 0}


def cosines(sets, floor):
    near = {}
    for (d, i), x in sets.items():
        for (e, j), y in sets.items():
            if d == e and i != j and x and y and len(x & y) / (len(x) * len(y)) ** 0.5 >= floor - 1e-12:
                near[d, i, j] = len(x & y)
    return near


@pytest.mark.parametrize("block", [4, 1024])
def test_lexical_joins_equal_all_pairs_and_move_rows_once(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(pairs, "LEXICAL_BLOCK", block)
    sets = {(d, i): {f"w{rng.randrange(9)}" for _ in range(rng.randrange(6))} for d in range(3) for i in range(13)}
    df = spark.createDataFrame([(d, i, i % 4, sorted(x)) for (d, i), x in sets.items()], "doc_id long, id long, section_index long, tokens array<string>")
    want = cosines(sets, 0.5)
    got = pairs.lexical_pairs(df, 0.5, carry=["tokens"])
    assert {(r.doc_id, r.a, r.b, r.common, tuple(r.a_tokens), tuple(r.b_tokens)) for r in got.collect()} == {(d, i, j, n, tuple(sorted(sets[d, i])), tuple(sorted(sets[d, j]))) for (d, i, j), n in want.items() if i < j and i % 4 != j % 4}
    assert got.count() == sum(i < j and i % 4 != j % 4 for _, i, j in want)
    matched = pairs.lexical_matches(df.where("id % 2 = 0"), df.where("id % 3 = 0").withColumn("id", F.struct("id")), 0.5)
    both = {(d, i, i) for (d, i), x in sets.items() if x} | set(want)
    assert sorted((r.doc_id, r.id, r.other.id) for r in matched.collect()) == sorted((d, i, j) for d, i, j in both if i % 2 == 0 and j % 3 == 0)
    # words of rows aren't dealt out one by one
    assert "explode(tokens" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [4, 1024])
def test_lexical_nearest_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(11)
    docs = [(d, i, rng.sample("abcdefgh", rng.randint(1, 5)), rng.random() < 0.4, i // 3) for d in range(3) for i in range(5 + 4 * d)]
    df = spark.createDataFrame(docs, "doc_id long, id long, tokens array<string>, head boolean, section long")
    monkeypatch.setattr(pairs, "LEXICAL_BLOCK", block)
    for most, asking, across in ((None, "head", None), (2, "head", None), (2, None, "section")):
        got = pairs.lexical_nearest(df, 0.3, most, asking, across, carry=["section"])
        got = pairs.top_per_row(got.withColumn("sim", F.round("sim", 9)), most or 99, ["doc_id"]).select("doc_id", "a", "b", "a_section", "b_section")
        want = set()
        for d, i, x, head, s in docs:
            near = [(-round(len(set(x) & set(y)) / (len(x) * len(y)) ** 0.5, 9), j, t) for e, j, y, _, t in docs if d == e and i != j and (not across or s != t)]
            near = sorted(n for n in near if n[0] <= -0.3)[:most]
            want |= {(d, i, j, s, t) for _, j, t in near if head or not asking}
        assert {tuple(r) for r in got.collect()} == want


def test_what_joins_keep_equals_brute_force(spark, monkeypatch):
    v, df = vectors(spark, 60, 5)
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "BATCHES", (8, 16))
    sims = v @ v.T
    near = {i: sorted((-sims[i, j], j) for j in range(60) if i % 3 != j % 3 and sims[i, j] >= 0.1)[:3] for i in range(60)}
    found = pairs.blocked_join(df, df, 0.1, most=3)
    # three of each of at most eight blocks, not all
    assert found.groupBy("a").count().agg(F.max("count")).first()[0] <= 24
    assert {(r.a, r.b) for r in pairs.top_per_row(found, 3).collect()} == {(i, j) for i, x in near.items() for _, j in x}
    assert {r.id: r.links for r in pairs.link_totals(df, 0.1).collect()} == {i: n for i in range(60) if (n := sum(sims[i, j] >= 0.1 for j in range(60) if j != i))}
    kept = []
    for i in range(60):
        if all(sims[i, j] < 0.4 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in pairs.first_kept(df, 0.4).collect()) == kept
