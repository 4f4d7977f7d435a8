"""Dialogue to description: turns without substance go, the first statement of a turn names its speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Contractions and what they stand for, then pronouns and verbs that change with the person.
CONTRACTIONS = (
    (r"\b([Ww]e)['’]re\b", "$1 are"), (r"\b([Ww]e)['’]ve\b", "$1 have"), (r"\b([Ww]e)['’]ll\b", "$1 will"), (r"\b([Ww]e)['’]d\b", "$1 would"),
    (r"\bI['’]m\b", "I am"), (r"\bI['’]ve\b", "I have"), (r"\bI['’]ll\b", "I will"), (r"\bI['’]d\b", "I would"),
)
IRREGULAR = {"are": "is", "am": "is", "have": "has", "do": "does", "go": "goes", "were": "was"}


def third_person(verb: Column) -> Column:
    """DLG3: the verb as it follows he or she."""
    low = F.lower(verb)
    out = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in IRREGULAR.items()], F.when(low.rlike("(s|sh|ch|x|z|o)$"), F.concat(low, F.lit("es"))), F.when(low.rlike("[^aeiou]y$"), F.regexp_replace(low, "y$", "ies")), F.concat(low, F.lit("s")))
    return F.when(F.substring(verb, 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)


def third_person_sql(verb: str) -> str:
    low = f"lower({verb})"
    out = "CASE " + " ".join(f"WHEN {low} = '{k}' THEN '{v}'" for k, v in IRREGULAR.items()) + f" WHEN regexp_matches({low}, '(s|sh|ch|x|z|o)$') THEN {low} || 'es' WHEN regexp_matches({low}, '[^aeiou]y$') THEN regexp_replace({low}, 'y$', 'ies') ELSE {low} || 's' END"
    return f"CASE WHEN regexp_matches(substr({verb}, 1, 1), '[A-Z]') THEN upper(substr({out}, 1, 1)) || substr({out}, 2) ELSE {out} END"


def rewrite(s: Column, speaker: Column, organisation: str) -> Column:
    """DLG2: first person to third, word by word; a plain verb right after the new subject agrees with it."""
    for pattern, to in CONTRACTIONS:
        s = F.regexp_replace(s, pattern, to)
    bare = lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))

    def one(words: Column, w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1)).otherwise("")
        subject = (F.lower(before) == "we") | (before == "I")
        verb = bare(w).isin(*IRREGULAR) | bare(w).isin("see", "expect", "believe", "think", "plan", "want", "need", "know", "continue", "remain", "make")
        end = F.regexp_extract(w, "([^A-Za-z]*)$", 1)
        return F.when(subject & verb, F.concat(third_person(F.regexp_replace(w, "[^A-Za-z]*$", "")), end)).when((bare(w) == "we") | (bare(w) == "us"), F.concat(F.lit(organisation), end)).when(F.regexp_replace(w, "[^A-Za-z]*$", "") == "I", F.concat(speaker, end)).when(bare(w).isin("our", "ours"), F.concat(F.lit(f"{organisation}'s"), end)).when(bare(w) == "me", F.concat(speaker, end)).when(bare(w) == "my", F.concat(speaker, F.lit("'s"), end)).otherwise(w)

    # words are bound once, as the element of an array: each looks at the one before it, and would split the text again
    out = F.transform(F.array(F.split(s, " ")), lambda words: F.array_join(F.transform(words, lambda w, i: one(words, w, i)), " "))
    return F.get(F.transform(out, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), F.lit(0))


def describe(turns: DataFrame, organisation: str = "the company") -> DataFrame:
    """(conv_id, turn, text, kept, dropped) for turns (conv_id, turn, speaker, text)."""
    said = turns.select("conv_id", "turn", "speaker", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    marked = said.withColumn("act", F.coalesce(T.speech_act(F.col("s")), F.when(T.is_pleasantry(F.col("s")), "pleasantry"))).withColumn("asks", T.is_question(F.col("s")))
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    kept = marked.where("act IS NULL").withColumn("nth", F.sum(F.when(~F.col("asks"), 1).otherwise(0)).over(w))
    kept = kept.withColumn("plain", F.when(~F.col("asks"), rewrite(F.col("s"), F.col("speaker"), organisation)))
    plain = F.col("plain")
    lower = F.when(F.col("s").rlike("^[A-Z]{2,}|^I "), plain).otherwise(F.concat(F.lower(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))))
    text = F.when(F.col("asks"), F.concat("speaker", F.lit(" asked: "), "s")).when(F.col("nth") == 1, F.concat("speaker", F.lit(" said that "), lower)).otherwise(plain)
    rendered = kept.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", text.alias("t"))))["t"], " ").alias("text"), F.count("*").alias("kept"))
    counts = marked.groupBy("conv_id", "turn").agg(F.count_if(F.col("act").isNotNull()).alias("dropped"))
    return turns.select("conv_id", "turn").join(rendered, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
