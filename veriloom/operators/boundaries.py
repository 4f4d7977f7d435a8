"""Learning from a corpus, without labels, which words are abbreviations and which start sentences.

An abbreviation is a word that hardly comes without a full stop, is short, and may hold full stops of its own; a
sentence starter is a capital word that follows a sentence's end far more often than its share of all words.  Both
are log-likelihood ratios over counts, so learning is three aggregations by word, whatever the corpus's size, and two
numbers are all that the driver sees.  The published method is Kiss and Strunk's "Unsupervised Multilingual Sentence
Boundary Detection" (2006).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import stored

TOKEN, AROUND = r"[^ \t\n\f\r]+", r"^[\"'“‘(\[]+|[\"'”’)\],;:!?]+$"
#: A token that may end a sentence and the token after it, which may itself be the first of such a pair; for Java's regular expressions.
AFTER_STOP = r"(?<![^ \t\n\f\r])(?=([^ \t\n\f\r.!?]*+[.!?][^ \t\n\f\r]*+[ \t\n\f\r]++[^ \t\n\f\r]++))[^ \t\n\f\r]++"
#: Where sentences may end: a token that holds a full stop, and the word after one.
DOTTED = r"(?<![^ \t\n\f\r])(?=([^ \t\n\f\r.]*+\.[^ \t\n\f\r]*+))[^ \t\n\f\r]++"
FIRST_WORDS = rf"\.{T.CLOSING}*{T.BLANK}+{T.OPENING}*([^ \t\n\f\r.,;:!?\"'”’)\]]+)"
#: Scores from which a word counts as an abbreviation, or as a starter.
ABBREVIATION, STARTER = 0.3, 30.0


def _words(rows: DataFrame) -> DataFrame:
    """Rows with a ``token`` as word in small letters, whether it is followed by a full stop (stop) and begins with a capital, and the other columns; what is no word goes."""
    t = F.regexp_replace("token", AROUND, "")
    rows = rows.withColumn("x", F.explode(F.array(t))).withColumn("stop", F.col("x").endswith("."))
    # exploded, so that the conditions read the word rather than make it again
    rows = rows.withColumn("word", F.explode(F.array(F.lower(F.when(F.col("stop"), F.expr("substr(x, 1, length(x) - 1)")).otherwise(F.col("x"))))))
    return rows.where(F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"[0-9]")).withColumn("capital", F.col("x").rlike(r"^\p{Lu}")).drop("token", "x")


def _after_stops(docs: DataFrame) -> DataFrame:
    """word, stop, capital and the token ``before`` in small letters, for words after a token that holds ``.``, ``!`` or ``?``: few of a text's words."""
    pairs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(AFTER_STOP), F.lit(1))
    rows = docs.select(F.explode(pairs).alias("pair"))
    parts = F.split("pair", "[ \t\n\f\r]+")
    return _words(rows.select(F.lower(F.regexp_replace(F.get(parts, F.lit(0)), AROUND, "")).alias("before"), F.get(parts, F.lit(1)).alias("token")))


def _stops(docs: DataFrame) -> DataFrame:
    """word, with_stop, without: how often each word comes with a full stop, and without; tokens are counted as they stand before words are made of them."""
    tokens = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \t\n\f\r]+")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("token <> ''")
    counted = lambda with_: F.coalesce(F.sum(F.when(with_, F.col("n"))), F.lit(0).cast("long"))
    return stored(_words(tokens).groupBy("word").agg(counted(F.col("stop")).alias("with_stop"), counted(~F.col("stop")).alias("without")), "word-stops")


def abbreviations(docs: DataFrame, least: float = ABBREVIATION, counts: DataFrame | None = None) -> DataFrame:
    """word, with_stop, without, score of each word of docs (doc_id, text) that scores ``least`` or more."""
    counts = _stops(docs) if counts is None else counts
    stops, n = counts.agg(F.sum("with_stop"), F.sum(F.col("with_stop") + F.col("without"))).first()
    share = min(max((stops or 0) / max(n or 0, 1), 1e-9), 1 - 1e-9)
    by_chance = F.col("with_stop") * F.log(F.lit(share)) + F.col("without") * F.log(F.lit(1 - share))
    bound = F.col("with_stop") * F.log(F.lit(0.99)) + F.col("without") * F.log(F.lit(0.01))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    score = 2 * (bound - by_chance) * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters, -F.col("without").cast("double"))
    return counts.where("with_stop > 0").withColumn("score", score).where(F.col("score") >= least)


def starters(docs: DataFrame, short: DataFrame, least: float = STARTER, counts: DataFrame | None = None) -> DataFrame:
    """word, after_end, everywhere, score of each word that comes after ends of sentences (``short`` are the abbreviations) significantly often."""
    everywhere = (_stops(docs) if counts is None else counts).select("word", (F.col("with_stop") + F.col("without")).alias("everywhere"))
    # only words after an end can count, which leaves few of a text's words to be joined
    rows = _after_stops(docs).where(F.col("before").rlike(r"[.!?]$")).withColumn("prior", F.when(F.col("before").endswith("."), F.expr("substr(before, 1, length(before) - 1)")))
    rows = rows.join(short.select(F.col("word").alias("prior"), F.lit(True).alias("is_short")), "prior", "left").where("is_short IS NULL")
    after = stored(rows.groupBy("word").agg(F.count_if("capital").alias("after_end"), F.count("*").alias("after")), "word-starts")
    breaks, n = after.agg(F.sum("after")).first()[0] or 0, everywhere.agg(F.sum("everywhere")).first()[0] or 0
    after = after.where("after_end > 0").join(everywhere, "word")
    if not 0 < breaks < n:
        return after.select("word", "after_end", "everywhere", F.lit(0.0).alias("score")).where("false")
    held = lambda k, m, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (m - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    k, c = F.col("after_end").cast("double"), F.col("everywhere").cast("double")
    p, inside, outside = c / n, k / breaks, (c - k) / (n - breaks)
    score = 2 * (held(k, F.lit(float(breaks)), inside) + held(c - k, F.lit(float(n - breaks)), outside) - held(k, F.lit(float(breaks)), p) - held(c - k, F.lit(float(n - breaks)), p))
    return after.withColumn("score", score).where((F.col("score") >= least) & (inside > p)).select("word", "after_end", "everywhere", "score")


def with_own_words(docs: DataFrame, short: DataFrame, starting: DataFrame) -> DataFrame:
    """``docs`` with the learned words that each of them holds where sentences may end, as they are written there, as arrays own_short and own_starts: no table is held whole anywhere."""
    text = F.coalesce("text", F.lit(""))
    found = lambda pattern, kind, word: F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda t: F.struct(word(t).alias("form"), F.lit(kind).alias("kind")))
    last = found(DOTTED, "s", lambda t: F.regexp_extract(F.concat(t, F.lit(" ")), T.LAST_WORD, 1))
    forms = docs.select("doc_id", F.explode(F.concat(last, found(FIRST_WORDS, "b", lambda t: t))).alias("x")).select("doc_id", "x.*", F.lower("x.form").alias("word"))
    learned = short.select("word", F.lit("s").alias("kind")).union(starting.select("word", F.lit("b")))
    own = forms.join(learned, ["word", "kind"], "left_semi").groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("form"))).alias(c) for k, c in (("s", "own_short"), ("b", "own_starts"))])
    none = F.array().cast("array<string>")
    return docs.join(own, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("own_short", "own_starts")})


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Abbreviations and sentence starters of docs (doc_id, text), as tables of their own: small ones are broadcast where they are joined."""
    counts = _stops(docs)
    short = stored(abbreviations(docs, counts=counts), "abbreviations")
    return short, stored(starters(docs, short, counts=counts), "starters")


def learned_sentences(text):
    """``sentences`` of a text of ``with_own_words`` by the words known and the learned ones."""
    return T.sentences(text, "own_short", "own_starts")


def learned_sql(docs: str) -> str:
    """CTEs abbr, starter and learned (one row: lists ab and st) over rows (doc_id, text)."""
    log = lambda k, m, p: f"({k} * ln(greatest({p}, 1e-12)) + ({m} - {k}) * ln(greatest(1 - {p}, 1e-12)))"
    n_b, n_o = "breaks::DOUBLE", "(n - breaks)::DOUBLE"
    inside, outside, p = "(k / breaks)", "((c - k) / (n - breaks))", "(c / n)"
    starter = f"2 * ({log('k', n_b, inside)} + {log('(c - k)', n_o, outside)} - {log('k', n_b, p)} - {log('(c - k)', n_o, p)})"
    return rf"""
tok AS (SELECT doc_id, unnest(ts) AS t, unnest(list_prepend('', ts)[1:len(ts)]) AS before FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), {T.q(TOKEN)}), lambda t: regexp_replace(t, {T.q(AROUND)}, '', 'g')) AS ts FROM ({docs}))),
tk AS (SELECT * FROM (SELECT doc_id, lower(CASE WHEN ends_with(t, '.') THEN left(t, length(t) - 1) ELSE t END) AS word, ends_with(t, '.') AS stop, regexp_matches(t, '^\p{{Lu}}') AS capital, lower(before) AS before FROM tok) WHERE regexp_matches(word, '\p{{L}}') AND NOT regexp_matches(word, '[0-9]')),
cw AS (SELECT word, count(*) FILTER (stop) AS with_stop, count(*) FILTER (NOT stop) AS without FROM tk GROUP BY word),
sh AS (SELECT least(greatest(sum(with_stop) / greatest(sum(with_stop + without), 1), 1e-9), 1 - 1e-9) AS share FROM cw),
abbr AS (SELECT * FROM (SELECT word, with_stop, without, 2 * (with_stop * ln(0.99::DOUBLE) + without * ln(0.01::DOUBLE) - with_stop * ln(share) - without * ln(1 - share)) * exp(-length(replace(word, '.', ''))::DOUBLE) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', ''))::DOUBLE, -without::DOUBLE) AS score FROM cw, sh WHERE with_stop > 0) WHERE score >= {ABBREVIATION}),
sw AS (SELECT tk.*, regexp_matches(before, '[.!?]$') AND abbr.word IS NULL AS after FROM tk LEFT JOIN abbr ON ends_with(before, '.') AND abbr.word = left(before, length(before) - 1)),
sc AS (SELECT word, count(*) FILTER (after AND capital) AS after_end, count(*) AS everywhere, count(*) FILTER (after) AS after FROM sw GROUP BY word),
st AS (SELECT word, after_end, everywhere, after_end::DOUBLE AS k, everywhere::DOUBLE AS c, (SELECT sum(after) FROM sc)::DOUBLE AS breaks, (SELECT sum(everywhere) FROM sc)::DOUBLE AS n FROM sc WHERE after_end > 0),
starter AS (SELECT * FROM (SELECT word, after_end, everywhere, {starter} AS score FROM st WHERE {inside} > {p}) WHERE score >= {STARTER}),
learned AS (SELECT (SELECT coalesce(list(word), []) FROM abbr) AS ab, (SELECT coalesce(list(word), []) FROM starter) AS st)"""
