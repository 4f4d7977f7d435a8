"""Made-up documents with planted contradictions, for timing and catch rates; rows depend on their number and the seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the made-up sentences.
SUBJECTS = ("The harbour", "The ferry line", "The museum", "The orchard", "The library", "The quarry", "The observatory", "The bakery")
VERBS = ("opened", "moved", "sold", "repaired", "counted", "measured", "planted", "painted")
OBJECTS = ("boats", "crates", "maps", "trees", "shelves", "stones", "lenses", "ovens")


def documents(spark: SparkSession, n: int, sections: int = 10, sentences: int = 8, planted: int = 2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """SRC13: (doc_id, text) and the truth (doc_id, claim, counter_claim): headed sections of templated prose.

    Each document's first ``planted`` sections open with a claim whose negation ends as many of the last sections.
    """
    pick = lambda words, *key: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(len(words))) + 1).cast("int"))
    number = lambda *key: (F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(900)) + 100).cast("string")

    def sentence(doc: Column, section: Column, k: Column) -> Column:
        return F.concat(pick(SUBJECTS, doc, section, F.lit(0)), F.lit(" "), pick(VERBS, doc, section, k), F.lit(" "), number(doc, section, k), F.lit(" "), pick(OBJECTS, doc, section, k, F.lit(1)), F.lit(" in year "), (1900 + section).cast("string"), F.lit("."))

    doc = F.col("doc_id")
    claim = lambda p: F.concat(F.lit("Claim "), (p + 1).cast("string"), F.lit(": the tower of town "), doc.cast("string"), F.lit(" has "), number(doc, p, F.lit("t")), F.lit(" steps."))
    counter = lambda p: F.concat(F.lit("Claim "), (p + 1).cast("string"), F.lit(": the tower of town "), doc.cast("string"), F.lit(" has not "), number(doc, p, F.lit("t")), F.lit(" steps."))

    def section(s: Column) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sentences - 1)), lambda k: sentence(doc, s, k)), " ")
        first = F.when(s < planted, F.concat(claim(s), F.lit(" "))).otherwise("")
        last = F.when(s >= sections - planted, F.concat(F.lit(" "), counter(F.lit(sections - 1) - s))).otherwise("")
        return F.concat(F.lit("## Section "), (s + 1).cast("string"), F.lit("\n"), first, body, last)

    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    texts = rows.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), section), "\n\n").alias("text"))
    truth = rows.crossJoin(F.broadcast(spark.range(planted).select(F.col("id").cast("int").alias("p")))).select("doc_id", claim(F.col("p")).alias("claim"), counter(F.col("p")).alias("counter_claim"))
    return texts, truth


def plant(docs: DataFrame, counters: DataFrame, least_words: int = 15) -> DataFrame:
    """SRC14: (doc_id, text, planted): each counter-claim (doc_id, counter_claim) put at the end of a paragraph.

    That is the first of ``least_words`` words or more that is no heading, from halfway round the document on; a document
    without one stays as it is.  A paragraph is a line.
    """
    lines = F.split("text", "\n")
    n = F.size(lines)
    fits = lambda x: (F.size(F.filter(F.split(x, " "), lambda w: w != "")) >= least_words) & ~x.startswith("#")
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(i + F.floor(n / 2).cast("int"), n))
    place = F.get(F.filter(order, lambda i: fits(F.get(lines, i))), F.lit(0))
    found = docs.join(counters, "doc_id").withColumn("place", place)
    text = F.array_join(F.transform(lines, lambda x, i: F.when(i == F.col("place"), F.concat(x, F.lit(" "), "counter_claim")).otherwise(x)), "\n")
    return found.select("doc_id", F.when(F.col("place").isNull(), F.col("text")).otherwise(text).alias("text"), F.col("place").isNotNull().alias("planted"))
