"""Fixtures of the four document layouts."""

import json

from pyspark.sql import functions as F

from veriloom.sources import layouts as L

LONG = "This paragraph says enough about its subject to stay in the text."


def made(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_blocks(spark):
    page = '<html><HEAD><title>no</title></HEAD><body><DIV>a<p class="x">b <b>bold</b> &amp; c<p>d<br>e</div>f<pre>g</pre><script>"<p>"</script><!-- <p>z --><h2\nid=1>T</h2><p></p>\x01h</body>'
    got = [(b.kind, b.text) for b in made(spark, page, L.blocks)]
    assert got == [("", "a"), ("p", "b bold & c"), ("p", "d e"), ("", "f"), ("", "g"), ("h2", "T"), ("", "h")]
    assert made(spark, None, L.blocks) is None and made(spark, "", L.blocks) == []
    assert [b.text for b in made(spark, "<p>" + "word " * 200_000, L.blocks)] == [("word " * 200_000).strip()]


def test_research(spark):
    page = f'<h1>On Boats</h1><h2 class="t">1 Hulls</h2><p id="a" class="ltx_p">{LONG}<cite class="c">[3]</cite> <math>x<p>y</math></p><p>Short.</p><h3>1.2.3 Of wood</h3><p>{LONG}</p><section class="ltx_bibliography"><p>{LONG} Not this.</p>'
    assert made(spark, page, L.research) == f"# On Boats\n\n## Hulls\n\n{LONG}\n\n## Of wood\n\n{LONG}"


def test_financial(spark):
    page = f'<p>Above, {LONG}</p><div id="article"><p><strong>Staff Review</strong><br> {LONG}</p><p>{LONG}</p><p>Policy Actions</p><p>Tiny.</p><p>Voting for this action: all.</p><p>{LONG} Not this.</p></div>'
    build = lambda x: L.financial(x, ["Staff Review", "Policy Actions"])
    assert made(spark, page, build) == f"## Staff Review\n\n{LONG}\n\n{LONG}\n\n## Policy Actions"
    assert made(spark, "<p>Attendance of many people at the long meeting.</p>", build) == ""
    assert made(spark, f"<p>{LONG}</p>", build) == LONG


def test_transcript(spark):
    text = "CHAIR LEE. Good afternoon to all of you; infla-\ntion has come\ndown.\nPage 2 of 9\nANN O'NEIL. May I ask a question now?\nIt is a\nlong one.\nTIM RAY. No."
    assert made(spark, text, L.transcript) == "CHAIR LEE. Good afternoon to all of you; inflation has come down.\n\nANN O'NEIL. May I ask a question now? It is a long one."


def test_contract(spark):
    raw = json.dumps({"data": [{"title": "A", "paragraphs": [{"context": "first"}]}, {"title": "B", "paragraphs": [{"context": "the deal"}, {"context": "more"}]}]})
    assert made(spark, raw, lambda x: L.contract(x, "B")) == "the deal"
    assert made(spark, raw, lambda x: L.contract(x, "C")) is None and made(spark, "no", lambda x: L.contract(x, "B")) is None
