import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.helpers import rows
from veriloom.llm import common, fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, spm=80):
    """The transformation by matching every unit."""
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return {"doc_id": doc_id, "n": n, "form": "plain", "output": text, "prefix_chars": None, "middle_chars": None}
    a, b = sorted(d % (n + 1) for d in draws[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if draws[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return {"doc_id": doc_id, "n": n, "form": form, "output": output, "prefix_chars": len(p), "middle_chars": len(m)}


def test_scan_equals_matching_units(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "EVENTS", 3)
    rng = random.Random(5)
    for _ in range(2_000):
        text = "".join(rng.choice(["a", "é", "😀", " ", "\x00", " ", "\n", "\x0b", "<", "P>", "<S", "<P>", "<M>"][: rng.choice((6, 9, 13))]) for _ in range(rng.randrange(30)))
        ends, marked = fill_in_middle.scan(text)
        assert ends.tolist() == [m.end() for m in UNIT.finditer(text)] and marked == any(x in text for x in ("<P>", "<S>", "<M>"))


def test_forms_nulls_sentinels_and_round_trip(spark):
    rng = random.Random(6)
    texts = ["", None, "   ", "one", " one two ", "with <S> inside", "<P", "S> <M", "é 😀 x \t y", "word " * 50_000, " " * 300_000, "x" * 300_000]
    pairs = [(i, texts[i % len(texts)] if i < 60 else "".join(rng.choice("ab <>PSM\n") for _ in range(rng.randrange(40)))) for i in range(400)] + [(None, "no id at all"), (7, "an id again"), (7, "an id again"), (-3, "below nought")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in pairs], "doc_id long, text string, form string, output string")
    made = fill_in_middle.fill_in_middle(common.docs_of(docs)).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["output"])
    want = sorted((plainly(i, t) | {"again": t or ""} for i, t in pairs), key=key)
    assert sorted(rows(made), key=key) == want
    assert {r["form"] for r in want} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(common.docs_of(docs.limit(0))).count() == 0


def test_rates(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    forms = lambda **x: {r["form"] for r in fill_in_middle.fill_in_middle(docs, **x).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm=0) == {"psm"} and forms(rate=100, spm=100) == {"spm"}
