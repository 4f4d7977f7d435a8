"""SUM1: texts from a generator, in batches, with a checkpoint that a stopped run goes on from.

A generation is known by its key: the two length bounds and the input.  What the checkpoint has is taken from it; the
rest is dealt to tasks by key, so inputs of one pair of bounds go to all tasks, and each task sorts its own by bounds:
a batch holds inputs of one pair only, since a generator applies its bounds to a whole batch.  Keys are generated in
waves, each written before the next begins, so a run that dies loses one wave at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import checkpoint as C
from .storage import stored

#: (inputs, least, most) -> one text for each input.
Generator = Callable[[list[str], int, int], list[str]]

#: Sections of up to so many tokens pass through.
VERBATIM = 45


def bounds(n: Column) -> tuple[Column, Column]:
    """SUM3: the least and most tokens of a summary of ``n`` tokens."""
    part = F.floor(n * F.lit(0.6).cast("decimal(2,1)")).cast("long")
    least = F.least(F.lit(20), F.floor(F.least(F.lit(110), part) / 2)).cast("long")
    return least, F.greatest(least + 5, F.least(F.lit(110), part))


def leading_words(inputs: list[str], least: int, most: int) -> list[str]:
    """The stand-in for a model: the leading words, cut after their last full stop."""
    out = []
    for text in inputs:
        head = " ".join(re.split(r"[ \t\n\x0b\f\r]+", text.strip(" "))[:most])
        out.append(head[: head.rfind(".") + 1] if "." in head else head)
    return out


def generated(rows: DataFrame, generator: Generator, batch: int = 8) -> DataFrame:
    """(key, section_index, generated) of rows (key, section_index, input, least, most): one call for each batch of equal bounds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            texts = generator([r[2] for r in held], held[0][3], held[0][4])
            if len(texts) != len(held):
                raise ValueError(f"{len(texts)} texts for {len(held)} inputs")
            out = pd.DataFrame([(r[0], r[1], t) for r, t in zip(held, texts, strict=True)], columns=["key", "section_index", "generated"])
            held.clear()
            return out

        for frame in frames:
            for row in frame[["key", "section_index", "input", "least", "most"]].itertuples(index=False, name=None):
                if held and (len(held) >= batch or held[0][3:] != row[3:]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    dealt = rows.select("key", "section_index", "input", "least", "most").repartition("key").sortWithinPartitions("least", "most", "key")
    return dealt.mapInPandas(run, "key string, section_index long, generated string")


def summarize_sections(sections: DataFrame, path: str, generator: Generator = leading_words, batch: int = 8, waves: int = 4, verbatim: int = VERBATIM) -> DataFrame:
    """(doc_id, section_index, summary, origin) for sections (doc_id, section_index, text); ``path`` is the checkpoint's.

    Short sections pass through (origin verbatim); others are restored from the checkpoint or generated.  Equal inputs are generated
    once.  A null text counts as empty.  Origins are told by what the checkpoint held at the start.
    """
    spark = sections.sparkSession
    text = F.coalesce("text", F.lit(""))
    n = T.count_tokens(text)
    least, most = bounds(n)
    keyed = sections.select("doc_id", "section_index", text.alias("text"), (n <= verbatim).alias("passes"), least.alias("least"), most.alias("most")).withColumn("key", C.generation_key(F.col("least"), F.col("most"), F.col("text")))
    # written once: each wave reads its own part, and texts and keys aren't made again for it
    keyed = stored(keyed, "keyed-sections")
    open_ = keyed.where("NOT passes").groupBy("key").agg(F.min("section_index").alias("section_index"), F.first("text").alias("input"), F.first("least").alias("least"), F.first("most").alias("most"))
    restored = stored(C.known(spark, path).select("key", F.lit(True).alias("was")), "restored-keys")
    for wave in range(waves):
        mine = open_.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        C.append(generated(C.pending(mine, C.known(spark, path)), generator, batch), path)
    texts = C.known(spark, path).select("key", "generated")
    full = keyed.join(texts, "key", "left").join(restored, "key", "left")
    origin = F.when(F.col("passes"), "verbatim").when(F.col("was"), "restored").otherwise("generated")
    return full.select("doc_id", "section_index", F.when(F.col("passes"), F.col("text")).otherwise(F.col("generated")).alias("summary"), origin.alias("origin"))
