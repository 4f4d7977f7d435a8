"""Places in an order over a whole table, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


def numbered(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in the order ``by``; rows that tie in all of it come in any order.

    Rows are sorted in ranges, and a range's place is the number of rows in the ranges before it: the driver reads one
    number for each task.  The result is a table in the shared folder, so places don't change when it is read again.
    """
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "numbered")
    task, within = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy(task.alias("part")).count().collect()):
        offsets.append((part, before))
        before += n
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    return placed.join(shift, task == F.col("__part")).withColumn(name, F.col("__before") + within).drop("__part", "__before")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The interpolated quantiles of ``value`` in each group, one column for each of ``shares``; nulls don't count.

    Rows are numbered over the whole table and the two at a quantile's place are looked up, so no task holds a group.
    """
    placed = numbered(df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v")), [*map(F.col, group), F.col("__v")], "__at")
    spans = placed.groupBy(*group).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    wanted = spans.select(*group, "__start", "__n", F.posexplode(F.array(*map(F.lit, shares.values()))).alias("__i", "__q"))
    wanted = wanted.withColumn("__place", F.col("__q") * (F.col("__n") - 1)).withColumn("__part", F.col("__place") - F.floor("__place"))
    sides = wanted.withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__at", F.col("__start") + F.when(F.col("__side") == 0, F.floor("__place")).otherwise(F.ceil("__place")))
    found = sides.join(placed.select("__at", "__v"), "__at").groupBy(*group, "__i", "__part").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("lo"), F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("hi"))
    one = F.col("lo") + F.col("__part") * (F.col("hi") - F.col("lo"))
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("__i") == i, one)).alias(name) for i, name in enumerate(shares)))


def share_below(df: DataFrame, group: str, value: str, name: str = "share") -> DataFrame:
    """``df`` with the share of its group's rows that are strictly less in ``value`` (nulls are the least); no task holds a group."""
    placed = numbered(df, [F.col(group), F.asc_nulls_first(value)], "__at")
    spans = placed.groupBy(F.col(group).alias("__g")).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    ties = placed.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.min("__at").alias("__first"))
    known = ties.join(spans.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).select("__g", "__v", ((F.col("__first") - F.col("__start")) / F.col("__n")).alias(name))
    return placed.drop("__at").join(known, placed[group].eqNullSafe(F.col("__g")) & placed[value].eqNullSafe(F.col("__v"))).drop("__g", "__v")
