"""What moves between tasks: texts, once, and no words made of them."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows

from veriloom import catalog
from veriloom.operators import dialogue
from veriloom.plans import audit_plans

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_schemas(df):
    """The types of the columns that each shuffle of a plan moves."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan(), df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Exchange" in node.nodeName():
            found.append(node.schema().catalogString())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.inputPlan())
    return found


def test_support_moves_texts(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("rain coast harbour fell rose not ship grain sank late".split()) for _ in range(rng.randint(1, 6)))
    source = [(d, i, i // 4, text()) for d in range(3) for i in range(11)]
    asked = [(d, 100 + i, i % 3, text()) for d in range(3) for i in range(6)]
    got = audit_plans.support(spark.createDataFrame(asked, "doc_id long, id long, home long, text string"), spark.createDataFrame(source, "doc_id long, sid long, section_index long, text string"))
    assert not [s for s in moved_schemas(got) if "array" in s]

    def entails(premise, claim):
        p, h = set(premise.split()), set(claim.split())
        mismatch, common, size = ("not" in p) != ("not" in h), len(p & h - {"not"}), len(h - {"not"})
        return (0.05 if mismatch else 0.95) if size and common == size else 0.05

    want = []
    for d, id_, home, claim in asked:
        own = {sid: t for e, sid, section, t in source if (e, section) == (d, home)}
        words = lambda t: set(t.split()) - {"not"}
        sim = lambda t, h=words(claim): round(len(h & words(t)) / (len(h) * len(words(t))) ** 0.5, 9) if h and words(t) else 0.0
        near = sorted(own, key=lambda sid: (-sim(own[sid]), sid))[:3]
        runs = {(1, s) for s in near} | {(2, s - 1) for s in near if s - 1 in own} | {(2, s) for s in near if s + 1 in own}
        score = lambda run: entails(" ".join(own[run[1] + i] for i in range(run[0])), claim)
        best = min(runs, key=lambda run: (-score(run), run))
        want.append({"doc_id": d, "id": id_, "support": score(best), "evidence": best[1], "size": best[0]})
    assert rows(got, "doc_id", "id") == want


@pytest.mark.parametrize("name", ["res_corrected_claims", "res_one_sided"])
def test_resolutions_look_up_no_claims(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() and not [s for s in moved_schemas(df) if "array<string>" in s]


def test_pages_are_made_once(spark):
    plan = plan_of(catalog.QUERIES["src_pdf_cleaning"](spark, SF))
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1


def test_turns_are_split_once(spark):
    """The words of a turn are made once, not again for each of them."""
    df = spark.createDataFrame([("we see it",)], "s string").select(dialogue.rewrite(F.col("s"), F.lit("Ann"), "Acme").alias("t"))
    assert rows(df) == [{"t": "Acme sees it"}]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    long = spark.range(1).select(F.repeat(F.lit("we expect rain, I see our ship "), 3000).alias("s")).select(dialogue.rewrite(F.col("s"), F.lit("Ann"), "Acme").alias("t"))
    assert long.first()[0].startswith("Acme expects rain, Ann sees Acme's ship Acme expects")


def test_a_sentence_is_embedded_once(spark):
    from veriloom.functions import models

    df = spark.createDataFrame([("rain fell and rain rose",), ("",)], "s string").select(models.embed(F.col("s"), 4).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    got = [r["v"] for r in df.collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] == [0.0] * 4
