"""Segmentation of whole documents, reports, monitors, sweeps, generated documents and planting."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from veriloom import report
from veriloom.config import Config
from veriloom.functions import text as T
from veriloom.operators import monitor, pairs, resolve, segment
from veriloom.sources import generate, ingest


def plain_embedding(sentence):
    return [float(len(sentence)), float(sentence.count("a")), 1.0]


def embed(c):
    return F.array(F.length(c).cast("double"), F.length(F.regexp_replace(c, "[^a]", "")).cast("double"), F.lit(1.0))


def test_segments_by_headings(spark):
    text = "# One\nFirst. Second.\n# Two\n\n# Three\nThird."
    got = rows(segment.segment_documents(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string")), "section_index")
    assert [(r["title"], r["origin"], r["sentence_offset"], r["sentences"]) for r in got] == [("One", "heading", 0, ["First.", "Second."]), ("Two > Three", "heading", 2, ["Third."])]


def test_segments_without_headings_equal_loop(spark):
    import numpy as np

    sentences = [("aaaa " * (1 if i // 6 % 2 else 9) + f"w{i}.").strip() for i in range(24)]
    got = rows(segment.segment_documents(spark.createDataFrame([(5, " ".join(sentences))], "doc_id long, text string"), embed=embed), "section_index")
    v = np.array([plain_embedding(s) for s in sentences])
    sims = []
    for g in range(len(v) - 1):
        a, b = v[max(0, g - 2) : g + 1].mean(axis=0), v[g + 1 : g + 4].mean(axis=0)
        sims.append(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9))
    depth = []
    for g in range(len(sims)):
        left = right = g
        while left > 0 and sims[left - 1] >= sims[left]:
            left -= 1
        while right < len(sims) - 1 and sims[right + 1] >= sims[right]:
            right += 1
        depth.append(sims[left] - sims[g] + sims[right] - sims[g])
    cuts, cutoff = [], max(0.05, np.mean(depth) + 0.5 * np.std(depth))
    for g in sorted(range(len(sims)), key=lambda i: -depth[i]):
        if depth[g] < cutoff:
            break
        edges = [0, *sorted(c + 1 for c in [*cuts, g]), len(v)]
        if min(b - a for a, b in zip(edges, edges[1:], strict=False)) >= 4:
            cuts.append(g)
    edges = [0, *sorted(c + 1 for c in cuts), len(v)]
    assert len(edges) > 2
    assert [r["sentences"] for r in got] == [sentences[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    assert {r["origin"] for r in got} == {"embedding"}


def test_oversize_sections_are_cut_again(spark):
    text = "# Long\n" + " ".join(f"Word a b c d{i}." for i in range(40)) + "\n# Short\nOne."
    got = rows(segment.segment_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), embed=embed, most_tokens=60), "section_index")
    assert len(got) > 3 and got[0]["title"] == "Long (part 1)" and got[0]["origin"] == "heading+split"
    assert got[-1]["title"] == "Short" and got[-1]["origin"] == "heading"
    assert [s for r in got for s in r["sentences"]] == [f"Word a b c d{i}." for i in range(40)] + ["One."]
    assert [r["sentence_offset"] for r in got] == [sum(len(x["sentences"]) for x in got[:k]) for k in range(len(got))]


def test_resolution_budget_and_notes(spark):
    flags = spark.createDataFrame([(0, 1, 2, 0.9, 0.8, 0.2), (0, 2, 3, 0.8, 0.9, 0.1), (0, 4, 5, 0.7, 0.5, 0.5), (0, 6, 7, 0.6, 0.9, 0.1)], "doc_id long, a long, b long, score double, support_a double, support_b double")
    some = resolve.within_budget(resolve.ranked(flags), spark.createDataFrame([(0, 1)], "doc_id long, sections long"), 1, 3)
    got = resolve.resolve(some)
    assert [r["resolution"] for r in rows(got, "a")] == ["kept_a", "superseded", "unresolved", "unscored"]
    claims = spark.createDataFrame([(0, i, i, f"t{i}") for i in range(1, 8)], "doc_id long, id long, section_index long, text string")
    noted = resolve.notes(got, claims)
    assert [(r["id"], r["rejected"], r["note"]) for r in rows(noted, "id")] == [(2, True, "rejected for section 1: t1"), (4, False, "open conflict with section 5: t5"), (5, False, "open conflict with section 4: t4")]
    assert sorted(r.id for r in resolve.apply_decisions(claims, noted, "remove").collect()) == [1, 3, 4, 5, 6, 7]
    one = resolve.resolve(flags.withColumn("support_a", F.lit(0.1)).withColumn("support_b", F.lit(0.9)), one_sided=True)
    assert [r["resolution"] for r in rows(one, "a")] == ["kept_b"] * 4
    assert [r["note"] for r in rows(resolve.notes(one, claims, one_sided=True), "id")][0] == "rejected against source of section 2: t2"


def test_entailed_by_any(spark):
    schema = "doc_id long, id long, words array<string>, tokens array<string>"
    h = spark.createDataFrame([(0, 1, ["a", "b"], ["a", "b"]), (0, 2, ["x"], ["x"])], schema)
    p = spark.createDataFrame([(0, 7, ["a", "b", "c"], ["a", "b", "c"]), (1, 8, ["x"], ["x"])], schema)
    assert [(r.id, r.pid) for r in pairs.entailed_by_any(h, p, 0.75, 0.5).collect()] == [(1, 7)]


def test_report():
    text = report.result("Tides", {"sections": 1, "sentences": 2, "flags": 3, "final": 1}, [{"text": "It rose.", "status": "supported", "cited": "p. 1", "flags": ["disputed"], "notes": []}], [{"stage": "s", "limit": "l", "hit": False, "detail": "d"}, {"stage": "t", "limit": "l", "hit": True, "detail": "e"}], evidence=True)
    assert "1 section with 2 sentences was read." in text and "3 conflicts found" in text
    assert text.index("[HIT] t l: e") < text.index("[ok] s l: d")
    assert "1. [supported] It rose." in text and "! disputed" in text
    assert max(map(len, text.splitlines())) <= report.WIDTH
    assert report.counted(1, "box", "boxes") == "1 box" and report.counted(2, "box", "boxes") == "2 boxes"


def test_monitor_progress_counts_and_sweep(spark):
    watch = monitor.StageMonitor()
    with watch.stage("one"):
        sum(range(1000))
    assert watch.stages["one"]["seconds"] >= 0 and watch.stages["one"]["peak_mb"] > 0
    said, now = [], iter([0.0, 1.0, 2.0, 40.0, 41.0])
    report_ = monitor.progress("pairs", said.append, every=100, seconds=30, clock=lambda: next(now))
    for done in (1, 2, 3, 1000):
        report_(done, 1000)
    assert len(said) == 2 and said[1].startswith("pairs: 1,000 of 1,000")
    df, seen = monitor.counted(spark.range(10), n=F.count(F.lit(1)))
    df.collect()
    assert seen.get == {"n": 10}
    got = monitor.sweep(Config(), {"contradiction.threshold": [0.4, 0.6], "merging.mode": ["abstractive"]}, lambda c: {"t": c.contradiction.threshold, "m": c.merging.mode})
    assert [(r["t"], r["m"]) for r in got] == [(0.4, "extractive"), (0.6, "extractive"), (0.5, "abstractive")]


def test_generated_documents_hold_their_truth(spark):
    texts, truth = generate.documents(spark, 3)
    by = {r.doc_id: r.text for r in texts.collect()}
    found = truth.collect()
    assert len(found) == 6 and all(r.claim in by[r.doc_id] and r.counter_claim in by[r.doc_id] for r in found)
    again, _ = generate.documents(spark, 3)
    assert {r.doc_id: r.text for r in again.collect()} == by
    sections = segment.segment_documents(texts).groupBy("doc_id").count().collect()
    assert {r["count"] for r in sections} == {10}


def test_plant(spark):
    long = " ".join(f"w{i}" for i in range(16))
    d = spark.createDataFrame([(1, f"{long} a\n# {long}\nshort\n{long} b"), (2, "short")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "COUNTER."), (2, "COUNTER.")], "doc_id long, counter_claim string")
    got = rows(generate.plant(d, c), "doc_id")
    assert got[0]["text"].endswith(f"{long} b COUNTER.") and got[0]["planted"]
    assert got[1] == {"doc_id": 2, "text": "short", "planted": False}


def test_frozen_inputs_and_text_layers(spark, tmp_path):
    (tmp_path / "a.json").write_text("x")
    digest = ingest.frozen(spark, str(tmp_path)).first().sha256
    ingest.verify_frozen(spark, str(tmp_path), {"a.json": digest})
    with pytest.raises(ValueError, match="a.json"):
        ingest.verify_frozen(spark, str(tmp_path), {"a.json": "0"})
    assert ingest.text_layer(["x" * 150, "y" * 60]) == "x" * 150 + "\f" + "y" * 60
    with pytest.raises(ValueError, match="text layer"):
        ingest.text_layer(["x" * 210] + [""] * 20)
    assert spark.range(1).select(ingest.rejoin(F.lit("a har-\nbour, A-\nB")).alias("t")).first().t == "a harbour, A-\nB"


def test_embedding_is_a_unit_vector(spark):
    from veriloom.functions import models

    v = spark.range(1).select(models.embed(F.lit("The tide turned at six")).alias("v")).first().v
    assert len(v) == 32 and sum(x * x for x in v) == pytest.approx(1, abs=1e-6)
    assert T.count_tokens is not None
