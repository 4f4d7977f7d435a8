"""A table of generated texts by key, so that a run that stopped goes on from what it had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, section_index long, generated string, damaged string"


def generation_key(least: Column, most: Column, text: Column) -> Column:
    """SNK3: what a generation depends on."""
    return F.sha2(F.concat_ws("|", least.cast("string"), most.cast("string"), text), 256)


def file_name(document: Column, settings: Column) -> Column:
    return F.concat(F.substring(F.sha2(document, 256), 1, 16), F.lit("-"), F.substring(F.sha2(settings, 256), 1, 12), F.lit(".jsonl"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK2: the rows of a JSON-lines checkpoint, the last of each key, and its damaged lines."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("place")).where(F.trim("value") != "")
    rows = lines.select("place", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"}).alias("r")).select("place", "r.*")
    sound = F.col("damaged").isNull() & F.col("key").isNotNull() & F.col("generated").isNotNull()
    good = rows.where(sound).groupBy("key").agg(F.max_by(F.struct("section_index", "generated"), "place").alias("last")).select("key", "last.section_index", "last.generated")
    return good, rows.where(~sound).select("damaged")


def pending(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs (key, ...) that the checkpoint doesn't have."""
    return inputs.join(cache.select("key"), "key", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def known(spark: SparkSession, path: str) -> DataFrame:
    """(key, section_index, generated) of a checkpoint that may not be there yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, section_index long, generated string")
    return read(spark, path)[0]


def append(rows: DataFrame, path: str) -> None:
    """Add the rows whose key the checkpoint doesn't have, one of each key: doing it again, or again after half of it, leaves no second row."""
    rows = rows.select("key", F.col("section_index").cast("long").alias("section_index"), "generated").dropDuplicates(["key"])
    pending(rows, known(rows.sparkSession, path)).write.mode("append").json(path)
