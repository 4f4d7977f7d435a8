import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators import tagger


@pytest.fixture(scope="module")
def model(spark):
    return tagger.train(tagger.labelled(spark))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, k = rng.integers(1, 6), rng.integers(1, 5)
        first, follow, gives = np.log(rng.random(k)), np.log(rng.random((k, k))), np.log(rng.random((n, k)))
        value = lambda p: first[p[0]] + gives[0, p[0]] + sum(follow[a, b] + gives[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False)))  # noqa: E731, B023
        best = max(itertools.product(range(k), repeat=int(n)), key=value)
        assert value(tagger.viterbi(first, follow, gives)) == pytest.approx(value(best))
    assert tagger.viterbi(np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))) == [0, 0, 0, 0]


def test_many_sentences_equal_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    first, follow, gives = np.log(rng.random(5)), np.log(rng.random((5, 5))), np.log(rng.random((30, 5)))
    lengths = rng.integers(1, 9, size=40)
    words = rng.integers(0, 30, size=(40, 8))
    got = tagger.viterbi_many(first, follow, gives, words, lengths)
    assert [list(got[i, :n]) for i, n in enumerate(lengths)] == [tagger.viterbi(first, follow, gives[words[i, :n]]) for i, n in enumerate(lengths)]


def test_steps_of_any_size_tag_alike(model, monkeypatch):
    texts = ["The ferry left.", None, "", "SHE WILL SIGN THE LEASE", "word " * 300, "Odo Marsh with Harbour News", *[f"Crew {i} sailed for {i} hours" for i in range(50)]]
    whole = tagger.tags_of_many(model, texts)
    monkeypatch.setattr(tagger, "STEP_WORDS", 20)
    assert tagger.tags_of_many(model, texts) == whole == [tagger.tags_of(model, t) for t in texts] and [len(t) for t in whole[:6]] == [3, 0, 0, 5, 300, 5]


def test_decoding_is_the_likeliest_of_all_taggings(model):
    for words in (["The", "crew", "sailed"], ["Odd", "zuppings", "4"], ["they", "may"]):
        tags = [tagger.TAGS.index(t) for t in tagger.tags_of(model, " ".join(words))]
        assert tagger.log_of(model, words, tags) == pytest.approx(max(tagger.log_of(model, words, list(p)) for p in itertools.product(range(7), repeat=len(words))))


def test_accuracy_on_held_out_sentences(spark):
    """Five folds: the tag of a word, and whether a sentence asserts something."""
    rows = tagger.labelled(spark)
    right = n = sure = sentences = 0
    order = list(range(115))
    random.Random(3).shuffle(order)
    for fold in range(5):
        held = order[fold::5]
        model = tagger.train(rows.where(~F.col("sentence").isin(held)))
        for s in held:
            words = sorted((r.place, r.word, r.tag) for r in rows.where(F.col("sentence") == s).collect())
            got, want = tagger.tags_of(model, " ".join(w for _, w, _ in words)), "".join(t for _, _, t in words)
            right, n = right + sum(a == b for a, b in zip(got, want, strict=True)), n + len(want)
            sure, sentences = sure + (any(x in tagger.ASSERTS for x in got) == any(x in tagger.ASSERTS for x in want)), sentences + 1
    whole = rows.groupBy("sentence").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("place", "word")))["word"]).alias("text"), F.max(F.col("tag").isin(*tagger.ASSERTS)).alias("asserts"))
    listed = whole.where(T.has_verb_or_number(F.col("text")) == F.col("asserts")).count() / 115
    print(f"tags right {right / n:.3f} of {n}, assertions {sure / sentences:.3f} of {sentences}, by the word list {listed:.3f}")
    # measured: 0.79 and 0.84 (the word list: 0.72); half of a held-out sentence's words are new to a set this small
    assert right / n > 0.78 and sure / sentences > 0.83 and sure / sentences > listed


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The harbour closed early.", True), ("Odo Marsh with Harbour News.", False), ("The northern side of the old bridge.", False), ("Costs up 12% this year.", True), ("Roughly sixty enterprise accounts.", True),
        ("THE TENANT SHALL PAY THE FEE.", True), ("THE OLD BRIDGE OVER THE RIVER", False), ("It isn’t late.", True), ("You may.", True), ("", False), (None, None), ("...", False),
    ],
)
def test_asserts(spark, model, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tagger.asserts(model)(df.t)).first()[0] == want


def test_tags_of_a_table_and_claims(spark, model):
    df = spark.createDataFrame([(1, "The harbour closed.", "x"), (2, None, "y"), (3, "", "z"), (4, "w " * 2_000, "v")], "id int, text string, `odd name` string")
    got = {r.id: r.tags for r in tagger.tagged(df, model).collect()}
    assert got[1] == "FNV" and got[2] == got[3] == "" and len(got[4]) == 2_000
    sentences = spark.createDataFrame([("Odo Marsh of Harbour News, northern office.",), ("Northern harbour crews sailed.",)], "s string")
    assert [r.s.split()[0] for r in sentences.where(T.is_claim(F.col("s"), verb=tagger.asserts(model))).collect()] == ["Northern"]
    assert tagger.train(tagger.labelled(spark).limit(0)).gives("x", 1).shape == (7,)


def test_query_equals_plain_tagging(spark, model):
    from veriloom import catalog
    from veriloom.operators.sentences import sentences

    want = {}
    for r in sentences(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect():
        n = want.setdefault(r.doc_id, [0, 0])
        n[0] += 1
        words = [w.lower() for w in __import__("re").findall("[A-Za-z]+", r.text)]
        n[1] += any(c in "0123456789" for c in r.text) or any(w in T.NUMBER_WORDS for w in words) or any(x in tagger.ASSERTS for x in tagger.tags_of(model, r.text))
    assert {r.doc_id: [r.sentences, r.asserting] for r in catalog.QUERIES["txt_asserting"](spark, "/root/testdata/sf0.001").collect()} == want
