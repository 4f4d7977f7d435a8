"""Segmentation: gap similarity, depth, boundaries and the splitting of long sections."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import text as T
from . import boundaries as B


def gap_similarities(rows: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, gap, sim) for rows (doc_id, i, v): cosine of the mean vectors on both sides of each gap.

    Sliding frames hold the few vectors on either side, whose means are arrays: a row stays one row, whatever its dimensions.
    """
    w = Window.partitionBy("doc_id").orderBy("i")
    near = lambda first, last: F.collect_list("v").over(w.rowsBetween(first, last))
    sides = rows.where(F.col("v").isNotNull()).select("doc_id", "i", near(1 - window, 0).alias("l"), near(1, window).alias("r")).where(F.size("r") > 0)
    total = lambda vs: F.aggregate(F.slice(vs, 2, window), F.transform(F.get(vs, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    sums = sides.select("doc_id", "i", *[total(F.col(c)).alias(f"sum_{c}") for c in "lr"], *[F.size(c).alias(f"n_{c}") for c in "lr"])
    mean = lambda c: F.transform(f"sum_{c}", lambda x: x / F.col(f"n_{c}")).alias(c)
    means = sums.select("doc_id", "i", mean("l"), mean("r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sums = means.select("doc_id", F.col("i").alias("gap"), dot("l", "r").alias("lr"), dot("l", "l").alias("ll"), dot("r", "r").alias("rr"))
    return sums.select("doc_id", "gap", (F.col("lr") / (F.sqrt("ll") * F.sqrt("rr") + 1e-9)).alias("sim"))


def depths(gaps: DataFrame) -> DataFrame:
    """(doc_id, gap, sim, depth): how far each gap lies below the peaks to its left and right.

    Climbing left goes on while values don't fall, so it ends where a run that never rises towards the right
    begins; such runs are islands of one window pass, and their first value is the peak.
    """
    w = Window.partitionBy("doc_id").orderBy("gap")
    runs = gaps.withColumn("new_left", F.when(F.lag("sim").over(w) < F.col("sim"), 1).otherwise(0)).withColumn("new_right", F.when(F.lead("sim").over(w) < F.col("sim"), 1).otherwise(0))
    runs = runs.withColumn("left_run", F.sum("new_left").over(w)).withColumn("right_run", F.sum("new_right").over(Window.partitionBy("doc_id").orderBy(F.desc("gap"))))
    peak_left = F.first("sim").over(Window.partitionBy("doc_id", "left_run").orderBy("gap"))
    peak_right = F.first("sim").over(Window.partitionBy("doc_id", "right_run").orderBy(F.desc("gap")))
    return runs.select("doc_id", "gap", "sim", (peak_left - F.col("sim") + peak_right - F.col("sim")).alias("depth"))


def least_size(n, least: int = 4, most_sections: int = 2000):
    """The smallest segment, grown so that a document has at most ``most_sections``."""
    return F.greatest(F.lit(least), F.ceil(n / F.lit(most_sections))).cast("long")


def _taken(gaps: Iterable[int], least: int) -> list[int]:
    """The gaps that no gap taken before lies closer than ``least`` to; a cell of ``least`` gaps holds one taken at most, so three cells are looked at."""
    cells: dict[int, int] = {}
    for g in gaps:
        near = (cells.get(g // least + d) for d in (-1, 0, 1))
        if all(t is None or abs(t - g) >= least for t in near):
            cells[g // least] = g
    return sorted(cells.values())


def boundaries(deep: DataFrame, least: int = 4, floor: float = 0.05, factor: float = 0.5) -> DataFrame:
    """(doc_id, gap): cuts taken deepest first while every segment keeps its least size; gaps count from 0 in each document.

    Cuts hinder each other only when closer than ``least``.  So the gaps that are deep enough and far enough from both
    ends fall into stretches at least ``least`` apart, which are cut independently, in time linear in their gaps once sorted.
    Equally deep gaps go in order; a document under twice the least size has no cut.
    """
    whole = deep.groupBy("doc_id").agg(F.greatest(F.lit(floor), F.avg("depth") + factor * F.stddev_pop("depth")).alias("cutoff"), (F.count("*") + 1).alias("n"))
    open_gaps = deep.join(whole, "doc_id").where((F.col("depth") >= F.col("cutoff")) & (F.col("gap") + 1 >= least) & (F.col("n") - 1 - F.col("gap") >= least))
    w = Window.partitionBy("doc_id").orderBy("gap")
    apart = F.when(F.col("gap") - F.lag("gap").over(w) < least, 0).otherwise(1)
    stretches = open_gaps.select("doc_id", "gap", "depth", apart.alias("apart")).withColumn("stretch", F.sum("apart").over(w)).groupBy("doc_id", "stretch")
    ordered = stretches.agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("height"), F.col("gap").cast("long").alias("gap"))))["gap"].alias("gaps"))

    @F.pandas_udf("array<long>")
    def take(many: pd.Series) -> pd.Series:
        return many.map(lambda gaps: _taken(gaps.tolist(), least))

    return ordered.select("doc_id", F.explode(F.when(F.size("gaps") == 1, F.col("gaps")).otherwise(take("gaps"))).alias("gap"))


def _curve(v: np.ndarray, a: int, b: int, gaps: Iterable[int], window: int = 3) -> list[float]:
    """The similarity at each of ``gaps`` within rows a to b."""
    out = []
    for g in gaps:
        x, y = v[max(a, g - window + 1) : g + 1].mean(axis=0), v[g + 1 : min(b, g + 1 + window)].mean(axis=0)
        out.append(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)))
    return out


def _peaks(s: np.ndarray) -> np.ndarray:
    """The value that climbing left from each place ends at: the first of its run without a rise to the right."""
    first = np.concatenate([[True], s[:-1] < s[1:]])
    return s[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]


def split_oversize(rows: DataFrame, most: int, least: int = 4, window: int = 3) -> DataFrame:
    """(doc_id, i, part): sections cut at their deepest valley until each has ``most`` tokens at most; rows (doc_id, i, n_tokens, v).

    A cut changes the similarity only of gaps less than ``window`` away from it, so only these are worked out again.
    """

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        v, before = np.array(frame["v"].tolist(), float), np.concatenate([[0], np.cumsum(frame["n_tokens"].to_numpy())])
        part, todo, starts = np.zeros(len(frame), np.int64), [(0, len(frame))], []
        sims = np.array(_curve(v, 0, len(frame), range(len(frame) - 1), window))
        while todo:
            a, b = todo.pop()
            if b - a < 2 or before[b] - before[a] <= most:
                starts.append(a)
                continue
            s = sims[a : b - 1]
            depth = _peaks(s) - s + _peaks(s[::-1])[::-1] - s
            small = max(1, min(least, (b - a) // 2))
            inner = slice(small - 1, b - a - small)
            g = a + small - 1 + int(np.lexsort((s[inner], -depth[inner]))[0])
            for x, y in ((a, g + 1), (g + 1, b)):
                touched = sorted({*range(x, min(x + window - 1, y - 1)), *range(max(x, y - window), y - 1)})
                sims[touched] = _curve(v, x, y, touched, window)
                todo.append((x, y))
        part[sorted(starts)[1:]] = 1
        return pd.DataFrame({"doc_id": frame["doc_id"], "i": frame["i"], "part": part.cumsum()})

    return rows.groupBy("doc_id").applyInPandas(cut, "doc_id long, i long, part long")


def fold_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, block, title, body) for lines (doc_id, i, line, title): a heading without body leads into the next one's title."""
    w = Window.partitionBy("doc_id").orderBy("i")
    is_head = F.col("title").isNotNull()
    marked = lines.withColumn("head", is_head.cast("int")).withColumn("has_body", (~is_head & (F.trim("line") != "")).cast("int"))
    # a block starts at a heading that follows a body, or at the first heading
    seen = marked.withColumn("n_head", F.sum("head").over(w))
    body = seen.groupBy("doc_id", "n_head").agg(F.max("has_body").alias("full"), F.max("title").alias("title"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("i", "line"))))["line"], "\n").alias("body"))
    v = Window.partitionBy("doc_id").orderBy("n_head")
    starts = body.withColumn("new", F.when((F.lag("full").over(v) == 0) & (F.lag("title").over(v).isNotNull()), 0).otherwise(1)).withColumn("block", F.sum("new").over(v))
    return starts.groupBy("doc_id", "block").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("n_head", "title"))))["title"], " > ").alias("title"), F.max_by("body", "n_head").alias("body"))


def segment_documents(docs: DataFrame, embed: Callable[[Column], Column] = M.embed, count: Callable[[Column], Column] = T.count_tokens, least_headings: int = 2, most_tokens: int = 900, least: int = 4, learned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """SEG1: (doc_id, section_index, title, origin, sentence_offset, sentences) for docs (doc_id, text).

    A document with enough headings is cut at them, any other where neighbouring sentences differ most; ``embed`` makes
    a vector of a sentence and ``count`` its tokens.  Sections over ``most_tokens`` are cut again at their deepest
    valleys, their titles numbered.  A text without sentences has no section.  ``learned`` is as in ``sentences``.
    """
    docs = docs.select("doc_id", "text")
    split = T.sentences if learned is None else B.learned_sentences
    own = [] if learned is None else ["own_short", "own_starts"]
    docs = docs if learned is None else B.with_own_words(docs, *learned)
    lines = docs.where("text IS NOT NULL").select("doc_id", *own, F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("title", T.heading(F.col("line")))
    headed = lines.groupBy("doc_id").agg((F.count("title") >= least_headings).alias("headed"))
    lines = lines.join(headed, "doc_id")
    folded = fold_headings(lines.where("headed").drop("headed", *own))
    folded = folded if learned is None else folded.join(docs.drop("text"), "doc_id")
    blocks = folded.select("doc_id", "block", F.when(F.col("title") != "", F.col("title")).alias("title"), F.posexplode(split(F.col("body"))).alias("j", "text"))
    structured = blocks.select("doc_id", F.col("block").cast("long").alias("part"), "j", "title", F.lit("heading").alias("origin"), "text")

    flat = lines.where("NOT headed").select("doc_id", "i", F.posexplode(split(F.col("line"))).alias("k", "text"))
    flat = flat.withColumn("j", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "k")) - 1).select("doc_id", F.col("j").cast("long").alias("j"), "text")
    cuts = boundaries(depths(gap_similarities(flat.select("doc_id", F.col("j").alias("i"), embed(F.col("text")).alias("v")))), least)
    starts = flat.join(cuts.select("doc_id", (F.col("gap") + 1).alias("j"), F.lit(1).alias("cut")), ["doc_id", "j"], "left")
    w = Window.partitionBy("doc_id")
    plain = starts.withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(w.orderBy("j"))).withColumn("cuts", F.count("cut").over(w))
    plain = plain.select("doc_id", F.col("part").cast("long").alias("part"), F.col("j").cast("int").alias("j"), F.lit(None).cast("string").alias("title"), F.when(F.col("cuts") > 0, "embedding").otherwise("single").alias("origin"), "text")

    rows = structured.unionByName(plain).withColumn("n", count(F.col("text"))).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id", "part")))
    named = rows.withColumn("key", F.xxhash64("doc_id", "part"))
    split = split_oversize(named.where(F.col("total") > most_tokens).select(F.col("key").alias("doc_id"), F.col("j").cast("long").alias("i"), F.col("n").alias("n_tokens"), embed(F.col("text")).alias("v")), most_tokens, least)
    split = split.select(F.col("doc_id").alias("key"), F.col("i").cast("int").alias("j"), F.col("part").alias("piece"))
    full = named.join(split, ["key", "j"], "left").withColumn("piece", F.coalesce("piece", F.lit(0).cast("long"))).withColumn("pieces", F.max("piece").over(Window.partitionBy("doc_id", "part")) + 1)
    sections = full.groupBy("doc_id", "part", "piece", "pieces").agg(F.first("title").alias("title"), F.first("origin").alias("origin"), F.transform(F.array_sort(F.collect_list(F.struct("j", "text"))), lambda x: x["text"]).alias("sentences"))
    order = Window.partitionBy("doc_id").orderBy("part", "piece")
    many = F.col("pieces") > 1
    return sections.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("section_index"), F.when(many & F.col("title").isNotNull(), F.concat("title", F.lit(" (part "), (F.col("piece") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"),
        F.when(many, F.concat("origin", F.lit("+split"))).otherwise(F.col("origin")).alias("origin"), F.coalesce(F.sum(F.size("sentences")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("sentence_offset"), "sentences",
    )
