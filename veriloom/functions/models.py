"""Deterministic stand-ins for the neural models, as native columns: similarity, inference and summaries.

Real models plug in by the same shapes: a similarity in [0, 1], a triple (contradiction, entailment, neutral) for
a premise and a hypothesis, and a text for a text and two length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The rule scorer's triples (contradiction, entailment, neutral).
OPPOSED, ENTAILED, OPPOSED_PART, UNRELATED = (0.9, 0.05, 0.05), (0.02, 0.95, 0.03), (0.85, 0.05, 0.10), (0.05, 0.05, 0.90)


def words(s: Column) -> Column:
    """Distinct words without stop words, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*T.STOPWORDS) | w.isin(*T.NEGATIONS))))


def words_sql(s: str) -> str:
    return f"list_sort(list_distinct([w FOR w IN regexp_extract_all(lower({s}), '[a-z0-9]+') IF w NOT IN {T.words_sql(T.STOPWORDS)} OR w IN {T.words_sql(T.NEGATIONS)}]))"


def core(s: Column) -> Column:
    """The words without negations: what the lexical similarity compares."""
    return plain(words(s))


def plain(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*T.NEGATIONS))


def core_sql(s: str) -> str:
    return f"[w FOR w IN {words_sql(s)} IF w NOT IN {T.words_sql(T.NEGATIONS)}]"


def embed(s: Column, dimensions: int = 32) -> Column:
    """A unit vector of a text: how many of its words fall to each hash value."""
    places = F.transform(words(s), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    # words, counts and norm are each bound once, as the element of an array: every dimension reads them
    counts = F.transform(F.array(places), lambda ps: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long")), lambda d: F.size(F.filter(ps, lambda p: p == d)).cast("double")))
    norm = lambda cs: F.array(F.aggregate(cs, F.lit(0.0), lambda n, x: n + x * x, lambda n: F.sqrt(n) + 1e-9))
    return F.flatten(F.flatten(F.transform(counts, lambda cs: F.transform(norm(cs), lambda n: F.transform(cs, lambda x: x / n)))))


def infer(premise: Column, hypothesis: Column) -> Column:
    """Struct (contradiction, entailment, neutral) from two word arrays: a subset entails, a lone negation turns it."""
    negations = F.array(*[F.lit(w) for w in T.NEGATIONS])
    p, h = F.array_except(premise, negations), F.array_except(hypothesis, negations)
    return infer_counts(F.size(F.array_intersect(p, h)), F.size(h), negated(premise) != negated(hypothesis))


def negated(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in T.NEGATIONS]))


def infer_counts(common: Column, size: Column, mismatch: Column) -> Column:
    """``infer`` by the number of words other than negations that both have and that the hypothesis has, and by whether one alone is negated."""
    triple = lambda x: F.struct(*[F.lit(v).alias(c) for v, c in zip(x, ("contradiction", "entailment", "neutral"), strict=True)])
    subset = (size > 0) & (common == size)
    return F.when(subset & mismatch, triple(OPPOSED)).when(subset, triple(ENTAILED)).when((common >= 0.6 * F.greatest(size, F.lit(1))) & mismatch, triple(OPPOSED_PART)).otherwise(triple(UNRELATED))


def infer_sql(premise: str, hypothesis: str, what: str) -> str:
    i = ("contradiction", "entailment", "neutral").index(what)
    p, h = f"[w FOR w IN {premise} IF w NOT IN {T.words_sql(T.NEGATIONS)}]", f"[w FOR w IN {hypothesis} IF w NOT IN {T.words_sql(T.NEGATIONS)}]"
    negated = lambda x: f"(len([w FOR w IN {x} IF w IN {T.words_sql(T.NEGATIONS)}]) > 0)"
    mismatch, common = f"({negated(premise)} <> {negated(hypothesis)})", f"len(list_intersect({p}, {h}))"
    subset = f"(len({h}) > 0 AND {common} = len({h}))"
    return f"CASE WHEN {subset} AND {mismatch} THEN {OPPOSED[i]}::DOUBLE WHEN {subset} THEN {ENTAILED[i]}::DOUBLE WHEN {common} >= 0.6 * greatest(len({h}), 1) AND {mismatch} THEN {OPPOSED_PART[i]}::DOUBLE ELSE {UNRELATED[i]}::DOUBLE END"


def lead(s: Column, most: int) -> Column:
    """A summary: the leading words, cut after their last full stop."""
    head = T.truncate(s, most)
    return F.when(F.instr(head, ".") > 0, F.regexp_extract(head, r"^(.*\.)", 1)).otherwise(head)


def lead_sql(s: str, most: int) -> str:
    head = rf"array_to_string(regexp_split_to_array(trim({s}), '\s+')[1:{most}], ' ')"
    return rf"CASE WHEN contains({head}, '.') THEN regexp_extract({head}, '^(.*\.)', 1) ELSE {head} END"
