"""What is made where documents are read, without a shuffle, gives the rows that moved ones give."""

import random

from tests.helpers import rows as listed

from veriloom.operators import pairs as P


def claims(spark, sizes, seed=5):
    rng = random.Random(seed)
    made = [(d, i, i // 3, [f"w{w}" for w in sorted(rng.sample(range(30), rng.randint(0, 6)))], i % 2 == 0) for d, n in enumerate(sizes) for i in rng.sample(range(n), n)]
    # one task, so that a document's rows follow each other
    return spark.createDataFrame(made, "doc_id long, id long, section_index long, tokens array<string>, odd boolean").coalesce(1)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_in_place(spark, monkeypatch):
    rows = claims(spark, [40, 1, 0, 7, 25])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for block in (P.LEXICAL_BLOCK, 8):
            monkeypatch.setattr(P, "LEXICAL_BLOCK", block)
            for across in ("section_index", None):
                got = P.lexical_pairs(rows, 0.4, across, ["odd"], together=True)
                want = listed(P.lexical_pairs(rows, 0.4, across, ["odd"]), "doc_id", "a", "b")
                assert listed(got, "doc_id", "a", "b") == want and len(want) > 50
                assert exchanges(got) == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_documents_move(spark, monkeypatch):
    monkeypatch.setattr(P, "LONG_TEXT", 20)
    docs = spark.createDataFrame([(1, "short"), (2, "x" * 20), (3, None), (4, "")], "doc_id long, text string")
    seen = P.by_length(docs, lambda some, together: some.selectExpr("doc_id", f"{together} AS together"))
    assert listed(seen, "doc_id") == [{"doc_id": i, "together": i != 2} for i in (1, 2, 3, 4)]


def test_entity_gate_moves_counts_only(spark):
    from veriloom import catalog

    plan = catalog.QUERIES["flt_entity_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    _, short, long = plan.split("MapInArrow")
    assert "Exchange" not in short and "Exchange" in long
