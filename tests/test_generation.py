import pytest
from pyspark.sql import functions as F

from veriloom.operators import generation
from veriloom.sources import checkpoint


def sections(spark, n=60):
    rows = [(i % 7, i, " ".join(f"w{(i * j) % 13}" + ("." if j % 9 == 8 else "") for j in range(1, 20 + (i % 9) * 25))) for i in range(n)]
    return spark.createDataFrame([*rows, (90, 0, None), (91, 0, ""), (92, 0, rows[8][2])], "doc_id long, section_index long, text string")


def one_by_one(rows):
    out = {}
    for r in rows:
        text = r.text or ""
        n = len(text.split())
        if n <= 45:
            out[r.doc_id, r.section_index] = text
        else:
            part = n * 6 // 10
            least = min(20, min(110, part) // 2)
            out[r.doc_id, r.section_index] = generation.leading_words([text], least, max(least + 5, min(110, part)))[0]
    return out


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_batches_equal_one_by_one(spark, tmp_path, batch):
    df = sections(spark)
    got = generation.summarize_sections(df, f"{tmp_path}/c", batch=batch).collect()
    assert {(r.doc_id, r.section_index): r.summary for r in got} == one_by_one(df.collect())
    assert {r.origin for r in got} == {"verbatim", "generated"}
    again = generation.summarize_sections(df, f"{tmp_path}/c", generator=fails).collect()  # everything is there already
    assert {r.origin for r in again} == {"verbatim", "restored"} and {(r.doc_id, r.section_index, r.summary) for r in again} == {(r.doc_id, r.section_index, r.summary) for r in got}


def fails(inputs, least, most):
    raise RuntimeError("no generator here")


def test_batches_never_mix_bounds_and_fill_up(spark):
    from itertools import pairwise

    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), F.col("id").alias("section_index"), F.lit("x").alias("input"), (F.col("id") % 2 * 5).cast("long").alias("least"), F.lit(9).cast("long").alias("most")).coalesce(1)
    tell = lambda inputs, least, most: [f"{len(inputs)} of {least}" for _ in inputs]
    got = {r.key: r.generated for r in generation.generated(rows, tell, 8).collect()}
    assert len(got) == 40 and all(v.endswith(f" of {int(k) % 2 * 5}") for k, v in got.items()) and max(int(v.split()[0]) for v in got.values()) <= 8
    assert all(a <= b for a, b in pairwise(sorted(int(v.split()[0]) for v in got.values())))
    with pytest.raises(Exception, match="texts for"):
        generation.generated(rows, lambda inputs, least, most: [], 8).collect()


def test_a_run_that_died_goes_on(spark, tmp_path):
    df = sections(spark)
    path, poison = f"{tmp_path}/c", df.where("section_index = 53").first().text

    def dies(inputs, least, most):
        if poison in inputs:
            raise RuntimeError("out of memory")
        return generation.leading_words(inputs, least, most)

    with pytest.raises(Exception, match="out of memory"):
        generation.summarize_sections(df, path, dies, batch=1, waves=8)
    had = {r.key for r in checkpoint.known(spark, path).collect()}
    assert had
    got = generation.summarize_sections(df, path, waves=8).collect()
    assert {(r.doc_id, r.section_index): r.summary for r in got} == one_by_one(df.collect())
    lines = spark.read.json(path)
    assert lines.count() == lines.select("key").distinct().count() > len(had)
    assert {r.origin for r in got} == {"verbatim", "restored", "generated"}


def test_appending_again_leaves_no_second_row(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 2, "y")], "key string, section_index long, generated string")
    for _ in range(3):
        checkpoint.append(rows, f"{tmp_path}/c")
    assert sorted(r.key for r in spark.read.json(f"{tmp_path}/c").collect()) == ["a", "b"]
    assert checkpoint.known(spark, f"{tmp_path}/none").count() == 0
