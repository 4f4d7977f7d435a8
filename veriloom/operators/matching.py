"""Choosing pairs so that no item is in more than a few: greedy matching with capacities, and sampling by it.

Greedy takes pairs best first while both items have room.  A pair that is among the best open ones of both its items,
as many as they have room for, is one that greedy takes whatever else happens, so a round takes all such pairs at once;
then items without room and their pairs are left out, and the next round follows.  The best open pair of all is always
among them, so rounds end; there are few unless pairs get steadily better along a long chain.  An item's best pairs are
found with a limit inside each task before anything is shuffled, so an item in very many pairs is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

PAIR = ["grp", "a", "b"]


def _counts(taken: DataFrame) -> DataFrame:
    """grp, item, used: how many taken pairs each item is in."""
    return taken.select("grp", F.explode(F.array("a", "b")).alias("item")).groupBy("grp", "item").agg(F.count("*").alias("used"))


def greedy(pairs: DataFrame, cap: int, order: list[Column], before: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs`` (grp, a, b, ..., each pair once, a and b different) that greedy takes in ``order``, ``cap`` at most for each item of a group.

    ``order`` has to tell all pairs of a group apart; ``before`` (grp, a, b) were taken already and use up room.
    """
    open_ = checkpointed(pairs)
    taken = open_.limit(0)
    earlier = before.select(*PAIR) if before is not None else pairs.select(*PAIR).limit(0)
    used = checkpointed(_counts(earlier))
    while True:
        full = used.where(F.col("used") >= cap).select("grp", "item")
        for side in ("a", "b"):
            open_ = open_.join(full.withColumnRenamed("item", side), ["grp", side], "left_anti")
        open_ = checkpointed(open_.select(*pairs.columns))
        if open_.isEmpty():
            return taken
        place = F.row_number().over(Window.partitionBy("grp", "item").orderBy(*order))
        sides = open_.withColumn("item", F.explode(F.array("a", "b"))).withColumn("place", place).where(F.col("place") <= cap)
        room = sides.join(used, ["grp", "item"], "left").where(F.col("place") <= cap - F.coalesce("used", F.lit(0)))
        sure = checkpointed(room.groupBy(*PAIR).agg(F.count("*").alias("n")).where("n = 2").select(*PAIR))
        taken = checkpointed(taken.unionByName(open_.join(sure, PAIR, "left_semi").select(*pairs.columns)))
        open_ = open_.join(sure, PAIR, "left_anti")
        used = checkpointed(_counts(taken.select(*PAIR).unionByName(earlier)))


def sample_pairs(pairs: DataFrame, top: int, most: int, cap: int = 2, seed: int = 7) -> DataFrame:
    """SRT8: ``pairs`` (grp, a, b, sim) chosen for labelling, with ``sampled_as``.

    Of each group the ``top`` most similar that greedy takes, then others in a seeded order up to ``most``; no item is in more than ``cap``.
    Pairs that tie in similarity go by their items.
    """
    pairs = checkpointed(pairs.select(*PAIR, "sim"))
    best = [F.desc("sim"), F.col("a"), F.col("b")]
    of_group = Window.partitionBy("grp")
    first = checkpointed(greedy(pairs, cap, best).withColumn("place", F.row_number().over(of_group.orderBy(*best))).where(F.col("place") <= top).drop("place"))
    drawn = [F.md5(F.concat_ws("|", F.lit(str(seed)), "a", "b").cast("binary")), F.col("a"), F.col("b")]
    rest = greedy(pairs.join(first, PAIR, "left_anti").select(*PAIR, "sim"), cap, drawn, first)
    left = first.groupBy("grp").agg(F.count("*").alias("had"))
    rest = rest.withColumn("place", F.row_number().over(of_group.orderBy(*drawn))).join(left, "grp", "left").where(F.col("place") <= most - F.coalesce("had", F.lit(0)))
    return first.withColumn("sampled_as", F.lit("top_similarity")).unionByName(rest.select(*PAIR, "sim", F.lit("random_eligible").alias("sampled_as")))
