"""Final sentences meet claims and sources where documents are read."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_in_place import exchanges
from tests.test_moves import plan_of
from veriloom import catalog
from veriloom.operators import pairs as P
from veriloom.operators import storage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [None, 8])
def test_sides_and_lone_rows_in_place(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(P, "LEXICAL_BLOCK", block)
    rng = random.Random(6)
    made = [(d, i, sorted(rng.sample([f"w{k}" for k in range(9)], rng.randint(0, 4))), s) for d, n in enumerate([30, 1, 0, 12]) for s in (False, True) for i in range(n)]
    both = spark.createDataFrame(made, "doc_id long, id long, tokens array<string>, second boolean").coalesce(1)
    got = P.lexical_sides(both, 0.6, "second", together=True)
    want = rows(P.lexical_sides(both, 0.6, "second"), "doc_id", "id", "other")
    assert exchanges(got) == 0 and rows(got, "doc_id", "id", "other") == want and any(r["id"] == r["other"] for r in want)

    one = both.where("NOT second").withColumns({"asks": F.col("id") % 2 == 0, "size": F.size("tokens")})
    lone = lambda together: rows(P.lexical_nearest(one, 0.6, None, "asks", None, ["size"], together, lone=True), "doc_id", "a", "b")
    assert lone(True) == lone(False) and {(r["doc_id"], r["a"]) for r in lone(True)} == {(d, i) for d, i, _, s in made if not s and i % 2 == 0}


@pytest.mark.parametrize("name", ["jn_conflict_notes", "prv_flags", "jn_truth_matches"])
def test_long_documents_give_the_same_rows(spark, monkeypatch, name):
    kept = rows(catalog.QUERIES[name](spark, SF), "doc_id")
    key = lambda r: tuple(map(str, r.values()))
    monkeypatch.setattr(P, "LONG_TEXT", 500)
    storage.forget(spark, SF)
    again = rows(catalog.QUERIES[name](spark, SF), "doc_id")
    storage.forget(spark, SF)
    assert kept and sorted(again, key=key) == sorted(kept, key=key)


def test_final_sentences_move_no_words(spark):
    for name in ("jn_conflict_notes", "prv_flags"):
        df = catalog.QUERIES[name](spark, SF)
        assert df.count() and "source-rows" not in plan_of(df) and "near-sentences" not in plan_of(df)
