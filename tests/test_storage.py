import os

from veriloom.operators import storage


def test_saved_follows_its_input(spark, tmp_path):
    where = f"{tmp_path}/t.parquet"
    read = lambda: storage.saved(spark, str(tmp_path), "kept", lambda: spark.read.parquet(where)).count()
    spark.range(5).coalesce(1).write.parquet(where)
    assert read() == read() == 5
    spark.range(0).write.mode("overwrite").parquet(where)
    assert read() == 0
    spark.range(3).coalesce(1).write.mode("append").parquet(where)
    assert read() == 3


def test_forget_deletes_the_tables_of_one_input(spark, tmp_path):
    for d in ("x", "y"):
        spark.range(2).write.parquet(f"{tmp_path}/{d}/t.parquet")
    tables = {d: storage.saved(spark, f"{tmp_path}/{d}", "kept", lambda d=d: spark.read.parquet(f"{tmp_path}/{d}/t.parquet")) for d in ("x", "y")}
    at = {d: os.path.dirname(t.inputFiles()[0]).removeprefix("file:").replace("///", "/") for d, t in tables.items()}
    assert storage.forget(spark, f"{tmp_path}/x") == 1 and not os.path.exists(at["x"]) and os.path.exists(at["y"])
    assert storage.saved(spark, f"{tmp_path}/x", "kept", lambda: spark.range(9).toDF("id")).count() == 9
