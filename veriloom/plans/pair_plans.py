"""Queries of similarity joins, pair selection and contradiction flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import text as T
from ..operators import pairs as P
from ..operators.matching import sample_pairs
from ..operators.sentences import SENTENCES_SQL, sentences
from .registry import query, table

FLOOR, TOP_K, MAX_PAIRS, THRESHOLD = 0.20, 30, 40_000, 0.50
_VEC = "v AS (SELECT vec_id AS id, label AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_JOINED = f"{_VEC}, j AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim FROM v x JOIN v y ON x.grp <> y.grp WHERE list_dot_product(x.v, y.v) >= {FLOOR})"
_RANKED = f"{_JOINED}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM j)"
_PAIRS = f"{_RANKED}, p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM r WHERE rank <= {TOP_K} GROUP BY ALL)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))


@query("jn_vector_pairs", f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM p ORDER BY sim DESC, a, b LIMIT {MAX_PAIRS}")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN3, WIN5, SET6, SRT2: pairs across groups worth comparing, within the pair budget."""
    v = vectors(spark, sf_dir)
    kept = P.one_copy(P.top_per_row(P.blocked_join(v, v, FLOOR, most=TOP_K), TOP_K))
    return kept.orderBy(F.desc("sim"), "a", "b").limit(MAX_PAIRS).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    "agg_pair_accounts",
    f"WITH {_PAIRS}, g AS (SELECT grp, count(*) AS n FROM v GROUP BY grp) SELECT CAST((sum(n) * (sum(n) - 1) - sum(n * (n - 1))) / 2 AS BIGINT) AS pairs_total, (SELECT count(*) FROM j WHERE a < b) AS above_floor, (SELECT count(*) FROM j WHERE a < b) - (SELECT count(*) FROM p) AS skipped_top_k, (SELECT greatest(count(*) - 2000, 0) FROM p) AS skipped_budget, (SELECT least(count(*), 2000) FROM p) AS checked, 2 * (SELECT least(count(*), 2000) FROM p) AS calls FROM g",
)
def pair_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG3: what selection keeps and skips, and the scorer's calls, two for each checked pair, under a budget of 2,000 pairs."""
    v = vectors(spark, sf_dir)
    # a pair is kept if it is among the closest of either of its rows; the others are only counted
    kept = P.one_copy(P.top_per_row(P.blocked_join(v, v, FLOOR, most=TOP_K), TOP_K)).agg(F.count("*").alias("kept"))
    counts = P.link_totals(v, FLOOR, same_group=False).agg((F.coalesce(F.sum("links"), F.lit(0)) / 2).cast("long").alias("above_floor")).join(kept)
    totals = P.pair_totals(v.withColumn("doc", F.lit(0)), ["doc"], "grp").select("pairs_total")
    checked = F.least(F.col("kept"), F.lit(2000).cast("long"))
    # one row each
    return totals.join(counts).select("pairs_total", "above_floor", (F.col("above_floor") - F.col("kept")).alias("skipped_top_k"), (F.col("kept") - checked).alias("skipped_budget"), checked.alias("checked"), (2 * checked).alias("calls"))


@query("jn_asymmetric_pairs", f"WITH {_VEC}, j AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim FROM v x JOIN v y ON x.grp <> y.grp WHERE x.id % 7 = 0 AND y.id % 7 <> 0 AND list_dot_product(x.v, y.v) >= {FLOOR}), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM j) SELECT a, b, round(sim, 6) AS sim, rank FROM r WHERE rank <= {TOP_K}")
def asymmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: claims of one kind against source rows of another."""
    v = vectors(spark, sf_dir)
    got = P.top_per_row(P.blocked_join(v.where("id % 7 = 0"), v.where("id % 7 <> 0"), FLOOR, most=TOP_K), TOP_K)
    return got.select("a", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("jn_indexed_pairs", f"WITH {_VEC} SELECT x.id AS a, y.id AS b, round(list_dot_product(x.v, y.v), 6) AS sim FROM v x JOIN v y ON x.grp <> y.grp AND x.id < y.id WHERE list_dot_product(x.v, y.v) >= 0.25")
def indexed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: pairs across groups, by the metric index where it pays, whatever the table's size."""
    v = vectors(spark, sf_dir)
    return P.blocked_join(v, v, 0.25, unordered=True, index="try").select("a", "b", F.round("sim", 6).alias("sim"))


@query("jn_indexed_nearest", f"WITH {_VEC}, r AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) DESC, y.id) AS rank FROM v x JOIN v y ON x.id <> y.id WHERE x.id % 100 = 0) SELECT a, b, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10")
def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3, GRF1: the ten nearest rows of all, for each row whose id 100 divides, in two rounds over the metric index where that pays."""
    v = vectors(spark, sf_dir)
    return P.top_per_row(P.nearest(v.where("id % 100 = 0"), v, 10, index="try"), 10).select("a", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("jn_context_retrieval", f"WITH {_VEC}, j AS (SELECT x.grp, y.id AS b, max(list_dot_product(x.v, y.v)) AS sim FROM v x JOIN v y ON x.grp <> y.grp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sim DESC, b) AS rank FROM j WHERE sim >= 0.35) SELECT grp, b, round(sim, 6) AS sim, rank FROM r WHERE rank <= 3")
def context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, AGG5: for each group, the three rows of other groups closest to any of its own."""
    v = vectors(spark, sf_dir)
    # what is among a group's three closest is among the three closest of the row that it is closest to
    joined = P.blocked_join(v, v, 0.35, most=3).join(v.select(F.col("id").alias("a"), "grp"), "a").groupBy("grp", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("grp").orderBy(F.desc("sim"), "b")
    return joined.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("grp", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("agg_centroids", "WITH d AS (SELECT label AS grp, i, avg(CAST(e AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL), n AS (SELECT grp, sqrt(sum(m * m)) AS norm FROM d GROUP BY grp) SELECT d.grp, i, round(m / (norm + 1e-9), 6) AS value FROM d JOIN n USING (grp)")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: mean vectors, made unit vectors again, dimension by dimension."""
    dims = vectors(spark, sf_dir).select("grp", F.posexplode("v").alias("i", "e")).groupBy("grp", F.col("i").cast("long").alias("i")).agg(F.avg(F.col("e").cast("double")).alias("m"))
    norms = dims.groupBy("grp").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return dims.join(norms, "grp").select("grp", "i", F.round(F.col("m") / (F.col("norm") + 1e-9), 6).alias("value"))


@query("srt_central_rows", f"WITH {_VEC}, c AS (SELECT x.grp, x.id, round(avg(list_dot_product(x.v, y.v)), 6) AS mean_sim FROM v x JOIN v y ON x.grp = y.grp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mean_sim DESC, id) AS rank FROM c) SELECT grp, id, mean_sim FROM r WHERE rank <= 5")
def central_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, SRT4: rows of the highest mean similarity in their group; the mean of products is a product with the mean."""
    v = vectors(spark, sf_dir)
    mean = v.select("grp", F.posexplode("v").alias("i", "e")).groupBy("grp", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    mean = mean.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    w = Window.partitionBy("grp").orderBy(F.desc("mean_sim"), "id")
    scored = v.join(mean, "grp").select("grp", "id", F.round(P.dot(F.col("v"), F.col("mean")), 6).alias("mean_sim"))
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5").drop("rank")


# Claims of documents, compared by words.
_CLAIMS = f"{SENTENCES_SQL}, claims AS (SELECT doc_id, sentence_id AS id, section_index, text, {M.words_sql('text')} AS words, {M.core_sql('text')} AS tokens FROM sentences WHERE {T.is_claim_sql('text')})"
_LEX = f"""{_CLAIMS}, lex AS (SELECT x.doc_id, x.id AS a, y.id AS b, len(list_intersect(x.tokens, y.tokens)) AS common, len(list_intersect(x.tokens, y.tokens)) / sqrt(len(x.tokens)::DOUBLE * len(y.tokens)) AS sim,
    x.words AS xw, y.words AS yw FROM claims x JOIN claims y ON x.doc_id = y.doc_id AND x.id < y.id AND x.section_index <> y.section_index WHERE len(list_intersect(x.tokens, y.tokens)) / sqrt(len(x.tokens)::DOUBLE * len(y.tokens)) >= {FLOOR} - 1e-12)"""
_FLAGS = f"""{_LEX}, scored AS (SELECT doc_id, a, b, common, sim, {M.infer_sql('xw', 'yw', 'contradiction')} AS score_ab, {M.infer_sql('yw', 'xw', 'contradiction')} AS score_ba FROM lex),
flags AS (SELECT *, (score_ab + score_ba) / 2 AS score FROM scored WHERE (score_ab + score_ba) / 2 >= {THRESHOLD})"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1: sentences that assert something, with their words."""
    return claims_of(table(spark, sf_dir, "documents"))


def claims_of(docs: DataFrame, *also: str) -> DataFrame:
    """The claims of some documents; ``also`` are further columns of ``sentences``."""
    rows = sentences(docs, head="head" in also).where(T.is_claim(F.col("text")))
    return rows.select("doc_id", F.col("sentence_id").alias("id"), "section_index", *also, "text", M.words(F.col("text")).alias("words"), M.core(F.col("text")).alias("tokens"))


def scored_pairs(rows: DataFrame, floor: float = FLOOR) -> DataFrame:
    return P.scored_pairs(rows, floor)


def scored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.by_length(table(spark, sf_dir, "documents"), lambda docs, together: P.scored_pairs(claims_of(docs), FLOOR, together))


@query("jn_lexical_pairs", f"WITH {_LEX} SELECT doc_id, a, b, common, round(sim, 6) AS sim FROM lex")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: pairs of claims across sections by shared words."""
    found = P.by_length(table(spark, sf_dir, "documents"), lambda docs, together: P.lexical_pairs(claims_of(docs), FLOOR, together=together))
    return found.select("doc_id", "a", "b", "common", F.round("sim", 6).alias("sim"))


@query("flags", f"WITH {_FLAGS} SELECT doc_id, a, b, round(sim, 6) AS sim, score_ab, score_ba, score FROM flags")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, NLI1, AGG1, FLT8, SRT1: contradiction flags between claims of different sections."""
    return scored_claims(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id", "a", "b", F.round("sim", 6).alias("sim"), "score_ab", "score_ba", "score")


@query("agg_score_combiners", f"WITH {_LEX}, s AS (SELECT doc_id, {M.infer_sql('xw', 'yw', 'contradiction')} AS f, {M.infer_sql('yw', 'xw', 'contradiction')} AS r FROM lex) SELECT doc_id, count(*) AS pairs, count(*) FILTER (greatest(f, r) >= 0.5) AS by_max, count(*) FILTER (least(f, r) >= 0.5) AS by_min, count(*) FILTER ((f + r) / 2 >= 0.5) AS by_mean FROM s GROUP BY doc_id")
def combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1: how many pairs each way of combining the directions flags."""
    scored = scored_claims(spark, sf_dir)
    f, r = F.col("score_ab"), F.col("score_ba")
    return scored.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.greatest(f, r) >= 0.5).alias("by_max"), F.count_if(F.least(f, r) >= 0.5).alias("by_min"), F.count_if((f + r) / 2 >= 0.5).alias("by_mean"))


@query("flt_entity_gate", f"WITH {_LEX.replace('claims AS (SELECT', 'claims AS (SELECT ' + T.entity_tokens_sql('text') + ' AS entities,').replace('x.words AS xw', 'len(list_intersect(x.entities, y.entities)) > 0 AS shared, ' + T.comparative_framing_sql('x.text') + ' IS NOT NULL OR ' + T.comparative_framing_sql('y.text') + ' IS NOT NULL AS framed, x.words AS xw').replace(' AS entities,', ' AS entities, ' + T.content_tokens_sql('text') + ' AS topics,').replace(' AS shared,', ' AS shared, len(list_intersect(x.topics, y.topics)) > 0 AS on_topic,')} SELECT doc_id, count(*) AS pairs, count(*) FILTER (shared) AS kept_entity, count(*) FILTER (on_topic) AS kept_topic, count(*) FILTER (NOT framed) AS kept_plain FROM lex GROUP BY doc_id")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3, FLT4, FLT5: pairs that the comparison, entity and topic gates let through; a gate that needs no partner could be pushed below the join."""
    text = F.col("text")

    def found(docs: DataFrame, together: bool) -> DataFrame:
        marked = claims_of(docs).withColumns({"e": T.entity_tokens(text), "t": T.content_tokens(text), "c": T.comparative_framing(text).isNotNull()})
        return P.lexical_pairs(marked, FLOOR, carry=["e", "t", "c"], together=together)

    both = P.by_length(table(spark, sf_dir, "documents"), found)
    return both.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.arrays_overlap("a_e", "b_e")).alias("kept_entity"), F.count_if(F.arrays_overlap("a_t", "b_t")).alias("kept_topic"), F.count_if(~(F.col("a_c") | F.col("b_c"))).alias("kept_plain"))


_SAMPLE = f"""
{_VEC}, e AS (SELECT floor(x.id / 100)::BIGINT AS grp, x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim FROM v x JOIN v y ON x.id // 100 = y.id // 100 AND x.id < y.id AND x.grp <> y.grp WHERE list_dot_product(x.v, y.v) >= {FLOOR}),
s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sim DESC, a, b) AS n FROM e),
f AS (
  SELECT DISTINCT grp, 0::BIGINT AS n, []::BIGINT[] AS used, 0 AS chosen, false AS took FROM s
  UNION ALL SELECT grp, n, CASE WHEN take THEN used || [a, b] ELSE used END, chosen + take::INT, take
  FROM (SELECT f.grp, s.n, used, chosen, a, b, len(list_filter(used, lambda x: x = a)) < 2 AND len(list_filter(used, lambda x: x = b)) < 2 AS take FROM f JOIN s ON s.grp = f.grp AND s.n = f.n + 1 WHERE chosen < 12)
),
first AS (SELECT s.* FROM s JOIN f USING (grp, n) WHERE took),
had AS (SELECT grp, count(*) AS had, flatten(list([a, b])) AS used FROM first GROUP BY grp),
t AS (SELECT grp, a, b, sim, row_number() OVER (PARTITION BY grp ORDER BY md5('7|' || a || '|' || b), a, b) AS n FROM s WHERE NOT EXISTS (FROM first WHERE first.grp = s.grp AND first.n = s.n)),
r AS (
  SELECT grp, 0::BIGINT AS n, used, had AS chosen, false AS took FROM had
  UNION ALL SELECT grp, n, CASE WHEN take THEN used || [a, b] ELSE used END, chosen + take::INT, take
  FROM (SELECT r.grp, t.n, used, chosen, a, b, len(list_filter(used, lambda x: x = a)) < 2 AND len(list_filter(used, lambda x: x = b)) < 2 AS take FROM r JOIN t ON t.grp = r.grp AND t.n = r.n + 1 WHERE chosen < 20)
)
SELECT grp, a, b, round(sim, 6) AS sim, 'top_similarity' AS sampled_as FROM first UNION ALL SELECT t.grp, a, b, round(sim, 6), 'random_eligible' FROM t JOIN r USING (grp, n) WHERE took"""


@query("srt_pair_sample", f"WITH RECURSIVE {_SAMPLE}")
def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT8: pairs of each hundred rows to label, the 12 most similar and others up to 20, no row in more than two."""
    v = vectors(spark, sf_dir)
    rows = v.select("id", F.floor(F.col("id") / 100).cast("long").alias("grp"), "v")
    groups = v.select("id", F.col("grp").alias("label"))
    near = P.blocked_join(rows, rows, FLOOR, same_group=True, unordered=True)
    near = near.join(groups.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(groups.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    chosen = sample_pairs(near.select(F.floor(F.col("a") / 100).cast("long").alias("grp"), "a", "b", "sim"), 12, 20)
    return chosen.select("grp", "a", "b", F.round("sim", 6).alias("sim"), "sampled_as")
