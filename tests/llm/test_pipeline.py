"""The pipeline against a plain version of its stages, and its stages on odd tables."""

import math
import random
import re

import corpus_pipeline
import pytest

from tests.llm.test_dedup import plain_groups, plain_words
from veriloom.llm import decontamination, exact_dedup, near_dedup, quality, sentencepiece_sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key int"


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() + ("." if i % 9 == 8 else "") for i in range(n))
    items = [(i, prose(16)) for i in range(3)]
    texts = [prose(rng.randrange(60, 140)) for _ in range(24)]
    texts += [" ".join(rng.choice(["$$", "!!", "|", "@@@", "%%"]) for _ in range(60)) for _ in range(12)]
    texts += [texts[0].upper(), texts[1], texts[1]]
    near = texts[2].split()
    near[10], near[40] = "changed", "words"
    texts += [" ".join(near), f"{prose(30)} {items[0][1]} {prose(30)}", f"{prose(30)} {items[1][1].upper().replace('.', '!')[:-1]} {prose(30)}", None, ""]
    labels = [(i, 1 if i < 24 else 0, 0) for i in range(36)]
    return [(i, t, "en", "s", len(t or ""), "clash", 0) for i, t in enumerate(texts)], items, labels


def tables(spark, path, docs, items, labels):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def fewest_edits(item, text):
    """Fewest edits between an item and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def plain_pipeline(docs, items, model):
    """Ids that each stage leaves, stage by stage in plain loops."""
    good = {}
    for doc, text, *_ in docs:
        x = quality.features((text or "").encode())
        strength = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=True))
        z = model.slope * (strength - model.cut) + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
        if 1 / (1 + math.exp(-max(-30, min(30, z)))) >= quality.THRESHOLD:
            good[doc] = text
    newest = {}
    for doc, text in good.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        newest[low] = max(newest.get(low, doc), doc)
    exact = {doc: good[doc] for doc in newest.values()}
    groups = plain_groups(sorted(exact.items()))
    near = {doc: t for doc, t in exact.items() if groups[doc] == doc}
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    budget = lambda m: min(int(m * decontamination.EDIT_RATE), max(0, (m - decontamination.Q) // decontamination.Q))
    framed = [f"{fold(t)} " for _, t in items]
    clean = {doc: t for doc, t in near.items() if not any(fewest_edits(i.strip(), fold(t)) <= budget(len(i.strip())) for i in framed)}
    return [sorted(x) for x in (good, exact, near, clean)]


def test_pipeline_equals_plain_version(spark, tmp_path):
    docs, items, labels = corpus()
    path = tables(spark, tmp_path, docs, items, labels)
    model = quality.fitted(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    good, exact, near, clean = plain_pipeline(docs, items, model)
    assert len(docs) > len(good) > len(exact) > len(near) > len(clean) > 15
    kept = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, exact, near, clean), strict=True):
        kept = stage(spark, kept, path)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "key"]
        assert sorted(r.doc_id for r in kept.collect()) == want, name
    out = corpus_pipeline.run(spark, path)
    assert sorted({r.doc_id for r in out.collect()}) == clean
    back = sentencepiece_sampling.decoded(out).collect()
    text = {d[0]: d[1] or "" for d in docs}
    assert all(r.text == text[r.doc_id] for r in back)


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_on_tables_almost_empty(spark, tmp_path, n):
    path = tables(spark, tmp_path, [(None, "a small text of some words", "en", None, 3, "x", 1)][:n], [(1, "other words that stand nowhere")], [(9, 1, None)])
    assert corpus_pipeline.run(spark, path).select("doc_id").distinct().count() == n


def test_stages_on_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1, "x", 1), (1, "a b c d e f", "en", "s", 1, "x", 2), (1, "other", "en", "s", 1, "x", 3), (2, long, "en", "s", 1, "x", 4), (3, long + " end", "en", "s", 1, "x", 5), (None, None, None, None, None, None, None)], SCHEMA)
    exact = exact_dedup.keep_one(docs)
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in exact.collect()) == sorted([(1, 11), (1, 5), (2, len(long)), (3, len(long) + 4), (0, 0)])
    near = near_dedup.keep_one(docs)
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in near.collect()) == sorted([(1, 11), (1, 5), (2, len(long)), (0, 0)])
    assert len(plain_words(long)) == 60_000
