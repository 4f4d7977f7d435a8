"""What is made once, or where it is read, in place of again for each step."""

import random

from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_boundaries import labelled
from tests.test_moves import moved_schemas
from veriloom import catalog
from veriloom.operators import abstractive, boundaries, generation, tagger
from veriloom.operators.sentences import sentences
from veriloom.plans import text_plans

SF = "/root/testdata/sf0.001"


def counting(spark, change=lambda s: s):
    """A function of texts and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def called(s):
        calls.add(1)
        return change(s)

    return F.udf(called, "string").asNondeterministic(), calls


def test_learned_words_are_looked_for_where_sentences_end(spark):
    """A word that stands after a quotation mark only, or in capitals, is known too."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled(1, 600))], "doc_id long, text string")
    learned = boundaries.learn(docs)
    new = spark.createDataFrame([(1, 'The so-called"capt. Marsh sailed. He left.'), (2, "The CAPT. Marsh sailed. He left."), (3, "The capt. Ships sank.")], "doc_id long, text string")
    got = {}
    for r in rows(sentences(new, learned), "doc_id", "sentence_id"):
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {1: ['The so-called"capt. Marsh sailed.', "He left."], 2: ["The CAPT. Marsh sailed.", "He left."], 3: ["The capt.", "Ships sank."]}


def test_sections_are_made_once(spark, tmp_path):
    made, calls = counting(spark)
    texts = spark.createDataFrame([(i, 0, f"w{i} " * 60) for i in range(20)], "doc_id long, section_index long, text string").select("doc_id", "section_index", made("text").alias("text"))
    assert len(generation.summarize_sections(texts, str(tmp_path / "c")).collect()) == 20 and calls.value == 20


def test_sections_stay_where_they_are_read(spark):
    for name in ("sum_finish", "sum_lengths"):
        assert moved_schemas(catalog.QUERIES[name](spark, SF)) == []


def test_new_tokens_in_place_equal_those_by_shuffle(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(["harbour ", "Harbour's ", "berth7 ", "the ", "1998 ", "quay. ", "crane! ", "pilots ", "\n", " "]) for _ in range(rng.randrange(40)))
    docs = spark.createDataFrame([(i, text() if i % 9 else None) for i in range(300)], "doc_id long, text string")
    here = text_plans._new_in_place(docs)
    assert moved_schemas(here) == []
    found = rows(here, "doc_id", "sentence_id")
    assert found and found == rows(text_plans._new_by_shuffle(sentences(docs)), "doc_id", "sentence_id")


def test_asserting_is_asked_as_the_tags_say(spark, monkeypatch):
    model = tagger.train(tagger.labelled(spark))
    texts = ["The ferry left.", None, "", "SHE WILL SIGN THE LEASE", "Odo Marsh with Harbour News", *[f"Crew {'anchor ' * (i % 7)}sailed for {i} hours" for i in range(40)]]
    for step, held in ((100_000, 100_000), (20, 3)):
        monkeypatch.setattr(tagger, "STEP_WORDS", step)
        monkeypatch.setattr(tagger, "HELD", held)
        assert list(tagger.any_of_many(model, texts)) == [any(x in tagger.ASSERTS for x in t) for t in tagger.tags_of_many(model, texts)]


def test_rounds_are_made_once(spark):
    made, calls = counting(spark)
    rows_ = spark.createDataFrame([(1, s, 0, f"Berth {s} has {s + 3} large cranes.") for s in range(9)], "doc_id long, section_index long, local_index long, text string")
    none = spark.createDataFrame([], "doc_id long, id long, text string")
    got = abstractive.merge_documents(rows_, none, rules=abstractive.Rules(most_blocks=2), summarise=lambda text, least, most: made(text))
    n = got.rounds.count()
    assert [t.count() for t in got][1] == n and calls.value == n
