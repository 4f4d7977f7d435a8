"""Documents as sections and sentences with explicit ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import boundaries as B


def sentences(docs: DataFrame, learned: tuple[DataFrame, DataFrame] | None = None, head: bool = False) -> DataFrame:
    """doc_id, sentence_id, section_index, local_index, text[, head]: every sentence; each line of a document is a section, whose first sentence is its ``head``.

    Ordinals come from the arrays themselves, so no window and no shuffle is needed.  ``learned`` are the corpus's
    own abbreviations and sentence starters (see ``boundaries.learn``), beside those known without learning.
    """
    split = T.sentences
    if learned:
        docs = B.with_own_words(docs, *learned)
        split = B.learned_sentences
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.struct(i.alias("section"), split(line).alias("sentences")))
    with_lines = F.filter(lines, lambda x: F.size(x["sentences"]) > 0)
    flat = F.flatten(F.transform(with_lines, lambda x: F.transform(x["sentences"], lambda s, j: F.struct(x["section"].alias("section_index"), j.alias("local_index"), s.alias("text"), *([F.get(x["sentences"], F.lit(0)).alias("head")] if head else [])))))
    return docs.select("doc_id", F.posexplode(flat).alias("sentence_id", "s")).select("doc_id", F.col("sentence_id").cast("long"), F.col("s.section_index").cast("long").alias("section_index"), F.col("s.local_index").cast("long").alias("local_index"), F.col("s.text").alias("text"), *([F.col("s.head").alias("head")] if head else []))


SENTENCES_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS section_index FROM documents),
parts AS (SELECT doc_id, section_index, unnest(x) AS text, unnest(range(len(x))) AS local_index FROM (SELECT doc_id, section_index, {T.sentences_sql("line")} AS x FROM lines)),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, local_index) - 1 AS sentence_id, section_index, local_index, text FROM parts)
"""
