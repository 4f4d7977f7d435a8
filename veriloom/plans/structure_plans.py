"""Queries of segmentation, merging, graphs, periods, premises and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import text as T
from ..operators import graph as G
from ..operators import merge as R
from ..operators import pairs as P
from ..operators import periods as D
from ..operators import segment as S
from ..operators.sentences import SENTENCES_SQL, sentences
from ..operators.storage import saved
from .pair_plans import _CLAIMS, claims, claims_of, vectors
from .registry import ORACLE_SQL, query, table

# Rows of one label in order of their id stand for a document's sentences.
_ROWS = "rows AS (SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS v FROM embeddings)"
_GAPS = f"""{_ROWS}, dims AS (SELECT doc_id, i, unnest(v)::DOUBLE AS x, unnest(range(64)) AS d FROM rows),
sides AS (SELECT doc_id, i, d, avg(x) OVER (PARTITION BY doc_id, d ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l, avg(x) OVER (PARTITION BY doc_id, d ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM dims),
gaps AS (SELECT doc_id, i AS gap, sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r)) + 1e-9) AS sim FROM sides WHERE r IS NOT NULL GROUP BY doc_id, i)"""
_DEPTHS = f"""{_GAPS}, f AS (SELECT *, CASE WHEN lag(sim) OVER w < sim THEN 1 ELSE 0 END AS nl, CASE WHEN lead(sim) OVER w < sim THEN 1 ELSE 0 END AS nr FROM gaps WINDOW w AS (PARTITION BY doc_id ORDER BY gap)),
g AS (SELECT *, sum(nl) OVER (PARTITION BY doc_id ORDER BY gap) AS lr, sum(nr) OVER (PARTITION BY doc_id ORDER BY gap DESC) AS rr FROM f),
depths AS (SELECT doc_id, gap, sim, first_value(sim) OVER (PARTITION BY doc_id, lr ORDER BY gap) - sim + first_value(sim) OVER (PARTITION BY doc_id, rr ORDER BY gap DESC) - sim AS depth FROM g)"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("embedding").alias("v"))


@query("win_gap_similarity", f"WITH {_GAPS} SELECT doc_id, gap, round(sim, 6) AS sim FROM gaps")
def gap_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_similarities(label_rows(spark, sf_dir)).select("doc_id", "gap", F.round("sim", 6).alias("sim"))


@query("win_depth_scores", f"WITH {_DEPTHS} SELECT doc_id, gap, round(depth, 6) AS depth FROM depths")
def depth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depths(S.gap_similarities(label_rows(spark, sf_dir))).select("doc_id", "gap", F.round("depth", 6).alias("depth"))


@query("win_adaptive_cutoff", f"WITH {_DEPTHS} SELECT doc_id, round(greatest(0.05, avg(depth) + 0.5 * stddev_pop(depth)), 6) AS cutoff, greatest(4, CAST(ceil((count(*) + 1) / 2000.0) AS BIGINT)) AS least FROM depths GROUP BY doc_id")
def cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4, SEG4."""
    deep = S.depths(S.gap_similarities(label_rows(spark, sf_dir)))
    return deep.groupBy("doc_id").agg(F.round(F.greatest(F.lit(0.05), F.avg("depth") + 0.5 * F.stddev_pop("depth")), 6).alias("cutoff"), S.least_size(F.count("*") + 1).alias("least"))


_CUTS = f"""{_DEPTHS}, least AS (SELECT doc_id, greatest(0.05, avg(depth) + 0.5 * stddev_pop(depth)) AS cutoff, count(*) + 1 AS n FROM depths GROUP BY doc_id),
deep AS MATERIALIZED (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC, gap) AS k FROM depths JOIN least USING (doc_id) WHERE depth >= cutoff AND gap + 1 >= 4 AND n - 1 - gap >= 4),
cuts AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS k, []::BIGINT[] AS gaps FROM deep
  UNION ALL SELECT c.doc_id, d.k, CASE WHEN len(list_filter(gaps, lambda x: abs(x - gap) < 4)) = 0 THEN gaps || [gap] ELSE gaps END FROM cuts c JOIN deep d ON d.doc_id = c.doc_id AND d.k = c.k + 1
)"""


@query("seg_boundaries", f"WITH RECURSIVE {_CUTS} SELECT doc_id, unnest(arg_max(gaps, k)) AS gap FROM cuts GROUP BY doc_id")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG2."""
    return S.boundaries(S.depths(S.gap_similarities(label_rows(spark, sf_dir))))


@query("seg_split_oversize")
def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG3: recursive halving, so there is no SQL."""
    return S.split_oversize(label_rows(spark, sf_dir).withColumn("n_tokens", F.lit(100)), 900)


@query("seg_documents")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1 over all documents, every other one with headings put in; greedy and recursive, so tests hold it against loops."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    given = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text"))
    return S.segment_documents(given).select("doc_id", "section_index", "title", "origin", "sentence_offset", F.size("sentences").alias("n"))


_HEADED = "CASE WHEN section_index % 4 = 0 THEN '## Part ' || section_index WHEN section_index % 8 = 1 THEN '# Topic ' || section_index ELSE text END"


@query(
    "seg_fold_headings",
    f"""WITH {SENTENCES_SQL}, l AS (SELECT doc_id, sentence_id AS i, {_HEADED} AS line FROM sentences), h AS (SELECT *, {T.heading_sql('line')} AS title FROM l),
    s AS (SELECT *, sum(CASE WHEN title IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h),
    b AS (SELECT doc_id, n, max(title) AS title, count(*) FILTER (title IS NULL) AS full_lines FROM s GROUP BY ALL),
    c AS (SELECT *, CASE WHEN lag(full_lines) OVER w = 0 AND lag(title) OVER w IS NOT NULL THEN 0 ELSE 1 END AS nb FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    d AS (SELECT *, sum(nb) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM c)
    SELECT doc_id, CAST(block AS BIGINT) AS block, coalesce(string_agg(title, ' > ' ORDER BY n), '') AS title, CAST(sum(full_lines) AS BIGINT) AS n_lines FROM d GROUP BY ALL""",
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6, FLT11: headings without body fold into the next."""
    lines = sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence_id").alias("i"), F.expr(_HEADED).alias("line"))
    folded = S.fold_headings(lines.withColumn("title", T.heading(F.col("line"))))
    return folded.select("doc_id", "block", "title", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("n_lines"))


_LINKS = "links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_dot_product(x.v, y.v) >= 0.4)"
_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    "mrg_greedy_dedup",
    f"""WITH RECURSIVE {_VEC}, {_LINKS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v), near AS (SELECT b, list(a) AS before FROM links GROUP BY b),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT walk.k + 1, CASE WHEN len(list_intersect(kept, coalesce(near.before, []::BIGINT[]))) > 0 THEN kept ELSE list_append(kept, o.id) END FROM walk JOIN o ON o.k = walk.k + 1 LEFT JOIN near ON near.b = o.id)
    SELECT id AS node, list_contains((SELECT kept FROM walk ORDER BY k DESC LIMIT 1), id) AS kept FROM v""",
)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG1: removed iff close to an earlier row that stays."""
    v = vectors(spark, sf_dir)
    kept = P.first_kept(v, 0.4).withColumn("kept", F.lit(True))
    return v.join(kept, "id", "left").select(F.col("id").alias("node"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("mrg_pack_by_cap", f"WITH {SENTENCES_SQL} SELECT doc_id, CAST(floor(sentence_id / 5) AS BIGINT) AS group_id, count(*) AS n, max(text) AS last_text FROM sentences GROUP BY ALL")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9 with a row cap only."""
    rows = sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence_id").alias("i"), "text")
    return R.pack(rows, 5).groupBy("doc_id", "group_id").agg(F.count("*").alias("n"), F.max("text").alias("last_text"))


@query(
    "mrg_pack_by_budget",
    rf"""WITH RECURSIVE {SENTENCES_SQL}, n AS (SELECT doc_id, sentence_id AS i, len(regexp_split_to_array(trim(text), '\s+')) AS n FROM sentences),
    walk AS (SELECT doc_id, i, n AS used, 1 AS held, 0 AS g FROM n WHERE i = 0 UNION ALL SELECT n.doc_id, n.i, CASE WHEN used + n.n > 60 OR held >= 5 THEN n.n ELSE used + n.n END, CASE WHEN used + n.n > 60 OR held >= 5 THEN 1 ELSE held + 1 END, CASE WHEN used + n.n > 60 OR held >= 5 THEN g + 1 ELSE g END FROM walk JOIN n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1)
    SELECT doc_id, i, CAST(g AS BIGINT) AS group_id FROM walk""",
)
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: the fold with a token budget."""
    rows = sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence_id").alias("i"), T.count_tokens(F.col("text")).alias("n"))
    return R.pack_by_budget(rows, 60, 5).select("doc_id", F.posexplode("groups").alias("i", "group_id")).select("doc_id", F.col("i").cast("long").alias("i"), "group_id")


_KNN = f"{_VEC}, s AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim FROM v x JOIN v y ON x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM s), e AS (SELECT src, dst, max(weight) AS weight FROM (SELECT a AS src, b AS dst, greatest(sim, 1e-6) AS weight FROM r WHERE k <= 10 UNION ALL SELECT b, a, greatest(sim, 1e-6) FROM r WHERE k <= 10) GROUP BY ALL)"


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.knn_graph(vectors(spark, sf_dir), 10)


@query("grf_knn", f"WITH {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM e")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


def _rank_sql(rounds: int) -> str:
    steps = [f"{_KNN}, t AS (SELECT src, sum(weight) AS total FROM e GROUP BY src)", "k0 AS (SELECT src AS node, 1.0 / (SELECT count(*) FROM t) AS rank FROM t)"]
    steps += [f"k{i} AS MATERIALIZED (SELECT dst AS node, 0.15 / (SELECT count(*) FROM t) + 0.85 * sum(rank * weight / total) AS rank FROM e JOIN t ON e.src = t.src JOIN k{i - 1} ON k{i - 1}.node = e.src GROUP BY dst)" for i in range(1, rounds + 1)]
    return f"WITH {', '.join(steps)} SELECT node, round(rank, 7) AS rank FROM k{rounds}"


@query("grf_pagerank", _rank_sql(10))
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF3: weighted PageRank, ten rounds."""
    return G.pagerank(knn(spark, sf_dir), 10).select("node", F.round("rank", 7).alias("rank"))


@query("grf_neighbour_jaccard", f"WITH {_KNN}, n AS (SELECT src, list(dst) AS near FROM e GROUP BY src) SELECT e.src AS a, e.dst AS b, round(len(list_intersect(x.near, y.near)) / len(list_distinct(list_concat(x.near, y.near))), 6) AS jaccard FROM e JOIN n x ON x.src = e.src JOIN n y ON y.src = e.dst WHERE e.src < e.dst")
def neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_jaccard(knn(spark, sf_dir)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("grf_hops", f"WITH RECURSIVE {_KNN}, w AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 4) SELECT node, min(hops) AS hops FROM w GROUP BY node")
def hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hops(knn(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 4)


@query("grf_betweenness")
def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF3: betweenness, by lengths of 1 - similarity, in the graph of each 50 rows and their three nearest; no SQL."""
    rows = vectors(spark, sf_dir).withColumn("grp", F.floor(F.col("id") / 50).cast("long"))
    near = P.group_pairs(rows, -1.0)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    kept = P.one_copy(P.top_per_row(both, 3)).select(F.floor(F.col("a") / 50).cast("long").alias("graph_id"), F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), (1 - F.greatest("sim", F.lit(1e-6))).alias("length"))
    return G.betweenness(kept, length="length", normalized=True)


#: Added to the ids of planted rows: a text has fewer sentences and lines than this, since a string has under 2^31 bytes.
PLANTED = 1 << 32
_DATED = "CASE sentence_id % 6 WHEN 0 THEN 'In Q2 2026 ' || text WHEN 1 THEN text || ' as of March 31, 2026' WHEN 2 THEN 'The second quarter of fiscal 2025: ' || text WHEN 3 THEN 'FY 2024 and version 2.1, ' || text WHEN 4 THEN '2023 Q4 - Amendment No. 3 ' || text ELSE text END"


def _marker_sql(text: str) -> str:
    names = "CASE lower({x}) " + " ".join(f"WHEN '{m}' THEN '{i}'" for group in (D.MONTHS, D.ORDINALS) for i, m in enumerate(group, 1)) + " ELSE lower({x}) END"
    one = []
    for i, (kind, p, year, number) in enumerate(D.FAMILIES):
        part = lambda g, p=p: f"regexp_extract(m, {T.q(p)}, {g})" if g else "''"
        chars = lambda x: f"coalesce(list_sum([len(y) FOR y IN {x}]), 0)"
        place = f"{chars('parts[1:k]')} + {chars('found[1:k - 1]')} + 1"
        one.append(f"SELECT doc_id, sentence_id, CAST({place} AS BIGINT) AS place, {i} AS family, '{kind}' AS kind, {part(year)} AS a, {names.format(x=part(number))} AS b FROM (SELECT *, found[k] AS m FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, sentence_id, regexp_extract_all(t, {T.q(p)}) AS found, regexp_split_to_array(t, {T.q(p)}) AS parts FROM ({text}))))")
    return " UNION ALL ".join(one)


@query("per_markers", f"WITH {SENTENCES_SQL}, m AS ({_marker_sql(f'SELECT doc_id, sentence_id, {_DATED} AS t FROM sentences')}) SELECT doc_id, sentence_id, kind, a, b, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY place, family, kind, a, b) AS rank FROM m")
def period_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PER1."""
    rows = sentences(table(spark, sf_dir, "documents")).select("doc_id", "sentence_id", F.expr(_DATED).alias("t")).select("doc_id", "sentence_id", F.posexplode(D.markers(F.col("t"))).alias("rank", "m"))
    return rows.select("doc_id", "sentence_id", F.col("m.kind").alias("kind"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), (F.col("rank") + 1).cast("long").alias("rank"))


@query("agg_document_period", f"WITH {SENTENCES_SQL}, m AS ({_marker_sql(f'SELECT doc_id, sentence_id, {_DATED} AS t FROM sentences')}), c AS (SELECT doc_id, kind, a, b, count(*) AS n, min([sentence_id, place]) AS seen FROM m WHERE a <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'Q' THEN 0 WHEN 'FY' THEN 1 WHEN 'M' THEN 2 ELSE 3 END, n DESC, seen, a, b) AS k FROM c) SELECT doc_id, kind, a, b, n FROM r WHERE k = 1")
def document_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: the most frequent dated marker of the best kind, ties to the earliest."""
    m = sentences(table(spark, sf_dir, "documents")).select("doc_id", "sentence_id", F.expr(_DATED).alias("t")).select("doc_id", "sentence_id", F.explode(D.markers(F.col("t"))).alias("m")).where("m.a <> ''")
    counts = m.groupBy("doc_id", F.col("m.kind").alias("kind"), F.col("m.a").alias("a"), F.col("m.b").alias("b")).agg(F.count("*").alias("n"), F.min(F.struct("sentence_id", "m.place")).alias("at"))
    order = F.when(F.col("kind") == "Q", 0).when(F.col("kind") == "FY", 1).when(F.col("kind") == "M", 2).otherwise(3)
    w = Window.partitionBy("doc_id").orderBy(order, F.desc("n"), "at", "a", "b")
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", "kind", "a", "b", "n")


_SUMMARY = f"summary AS (SELECT doc_id, sentence_id AS id, {M.core_sql('text')} AS tokens, {M.words_sql('text')} AS words FROM sentences WHERE local_index = 0)"
_CAND = f"""{SENTENCES_SQL}, src AS (SELECT doc_id, sentence_id AS sid, section_index, {M.core_sql('text')} AS tokens, {M.words_sql('text')} AS words FROM sentences), {_SUMMARY},
cand AS (SELECT s.doc_id, s.id, src.sid, src.section_index, len(list_intersect(s.tokens, src.tokens)) / sqrt(len(s.tokens)::DOUBLE * len(src.tokens)) AS sim, s.words AS hw, src.words AS pw FROM summary s JOIN src ON s.doc_id = src.doc_id WHERE s.id <> src.sid AND len(s.tokens) > 0 AND len(src.tokens) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY round(sim, 9) DESC, sid) AS rank FROM cand WHERE sim >= 0.3 - 1e-12)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: the three closest source sentences of each summary sentence (its section's first), other than itself, and how far each entails it."""
    rows = sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence_id").alias("id"), "section_index", (F.col("local_index") == 0).alias("head"), M.words(F.col("text")).alias("words"))
    # inference reads the numbers of words and the negations alone, so no text has to move
    rows = rows.select("doc_id", "id", "section_index", "head", M.plain(F.col("words")).alias("tokens"), M.negated(F.col("words")).alias("negated"))
    found = P.lexical_nearest(rows.withColumn("size", F.size("tokens").cast("long")), 0.3, 3, "head", carry=["section_index", "negated", "size"])
    ent = M.infer_counts(F.col("common"), F.col("a_size"), F.col("a_negated") != F.col("b_negated"))["entailment"]
    heads = found.select("doc_id", F.col("a").alias("id"), F.col("b").alias("sid"), F.col("b_section_index").alias("section_index"), "sim", ent.alias("ent"))
    w = Window.partitionBy("doc_id", "id").orderBy(F.desc(F.round("sim", 9)), "sid")
    return heads.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("jn_premise_windows", f"WITH {_CAND}, b AS (SELECT doc_id, section_index, min(sentence_id) AS lo, max(sentence_id) AS hi FROM sentences GROUP BY ALL) SELECT DISTINCT t.doc_id, t.id, t.section_index, sid - d AS first_id, size FROM top t JOIN b USING (doc_id, section_index), (VALUES (1, 0), (2, 0), (2, 1)) AS s(size, d) WHERE rank <= 3 AND sid - d >= lo AND sid - d + size - 1 <= hi")
def premise_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7: runs of one or two sentences around each candidate of JN6, inside its section, once for each summary sentence."""
    bounds = sentences(table(spark, sf_dir, "documents")).groupBy("doc_id", "section_index").agg(F.min("sentence_id").alias("lo"), F.max("sentence_id").alias("hi"))
    found = candidates(spark, sf_dir).select("doc_id", "id", "sid", "section_index").join(bounds, ["doc_id", "section_index"])
    sized = found.withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("first_id", F.explode(F.sequence(F.col("sid") - F.col("size") + 1, F.col("sid"))))
    return sized.where("first_id >= lo AND first_id + size - 1 <= hi").select("doc_id", "id", "section_index", "first_id", "size").distinct()


@query("prv_top_candidates", f"WITH {_CAND} SELECT doc_id, id, sid, round(sim, 6) AS sim, rank FROM top WHERE rank <= 3")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("doc_id", "id", "sid", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(
    "prv_provenance",
    f"WITH {_CAND}, e AS (SELECT doc_id, id, sid, rank, {M.infer_sql('pw', 'hw', 'entailment')} AS ent FROM top WHERE rank <= 3), b AS (SELECT doc_id, id, max(ent) AS entailment, arg_min(sid, rank - ent * 1000) AS cited FROM e GROUP BY ALL) SELECT s.doc_id, s.id, entailment, cited, CASE WHEN entailment >= 0.7 THEN 'supported' WHEN entailment >= 0.35 THEN 'weak' ELSE 'unsupported' END AS status FROM summary s LEFT JOIN b ON s.doc_id = b.doc_id AND s.id = b.id",
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV1, SRT6, JN8: each summary sentence with its best premise and its status."""
    best = candidates(spark, sf_dir).groupBy("doc_id", "id").agg(F.max("ent").alias("entailment"), F.min_by("sid", F.col("rank") - F.col("ent") * 1000).alias("cited"))
    heads = sentences(table(spark, sf_dir, "documents")).where("local_index = 0").select("doc_id", F.col("sentence_id").alias("id"))
    status = F.when(F.col("entailment") >= 0.7, "supported").when(F.col("entailment") >= 0.35, "weak").otherwise("unsupported")
    return heads.join(best, ["doc_id", "id"], "left").select("doc_id", "id", "entailment", "cited", status.alias("status"))


@query("jn_claim_grounding", f"WITH {SENTENCES_SQL} SELECT doc_id, sentence_id, CASE WHEN local_index = 0 THEN '' ELSE lag(text) OVER (PARTITION BY doc_id ORDER BY sentence_id) END AS antecedent FROM sentences")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: the sentence before, inside the section."""
    w = Window.partitionBy("doc_id").orderBy("sentence_id")
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "sentence_id", F.when(F.col("local_index") == 0, "").otherwise(F.lag("text").over(w)).alias("antecedent"))


# Counter-claims planted beside the claims, so that resolution has something to resolve.
def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_words(planted_texts(spark, sf_dir))


def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, section_index, text, home): claims and counter-claims; home is the section of the claim itself."""
    return saved(spark, sf_dir, "planted-claims", lambda: _planted(claims(spark, sf_dir)))


def with_words(rows: DataFrame) -> DataFrame:
    # words are made from the text where they are read: written or moved, they take several times its room
    return rows.withColumn("words", M.words(F.col("text"))).withColumn("tokens", M.plain(F.col("words")))


def _planted(rows: DataFrame, *also: str, shared: tuple[str, ...] = ()) -> DataFrame:
    """The rows, a counter-claim right after its claim; ``also`` are further columns, null for counter-claims, ``shared`` those that both have."""
    kinds = {c: rows.schema[c].dataType for c in also}
    one = lambda id_, section, text, more: F.struct(id_.alias("id"), section.alias("section_index"), text.alias("text"), *(m.alias(c) for c, m in more.items()))
    id_, text = F.col("id"), F.col("text")
    own = F.array(one(id_, F.col("section_index"), text, {c: F.col(c) for c in also}))
    against = F.array(one(id_ + PLANTED, F.lit(PLANTED).cast("long"), F.concat(F.lit("Not "), text), {c: F.lit(None).cast(k) for c, k in kinds.items()}))
    each = F.explode(F.when(id_ % 5 == 0, F.concat(own, against)).otherwise(own)).alias("x")
    return rows.select("doc_id", F.col("section_index").alias("home"), *shared, each).select("doc_id", "x.*", "home", *shared)


@query("flags_planted", f"WITH {_CLAIMS.replace('claims AS (', 'claims0 AS (')}, claims AS (SELECT * FROM claims0 UNION ALL SELECT doc_id, id + {PLANTED}, {PLANTED}, 'Not ' || text, list_sort(list_distinct(list_append(words, 'not'))), tokens FROM claims0 WHERE id % 5 = 0), p AS (SELECT x.doc_id, x.id AS a, y.id AS b, {M.infer_sql('x.words', 'y.words', 'contradiction')} AS f, {M.infer_sql('y.words', 'x.words', 'contradiction')} AS r FROM claims x JOIN claims y ON x.doc_id = y.doc_id AND x.id < y.id AND x.section_index <> y.section_index WHERE len(list_intersect(x.tokens, y.tokens)) / sqrt(len(x.tokens)::DOUBLE * len(y.tokens)) >= 0.5) SELECT doc_id, a, b, (f + r) / 2 AS score FROM p WHERE (f + r) / 2 >= 0.5")
def planted_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14, JN1, NLI1: planted counter-claims are found."""
    return planted_flag_rows(spark, sf_dir).select("doc_id", "a", "b", "score")


def planted_flag_rows(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, a, b, score, a_*, b_*) of the flags, with columns of their claims.

    ``local_index`` and ``head`` (its section's first sentence) are null for counter-claims; ``first`` is the number of the home section's first sentence.
    """

    def found(docs: DataFrame, together: bool) -> DataFrame:
        also = [c for c in ("local_index", "head") if c in carry]
        own = claims_of(docs, *dict.fromkeys(["local_index", *also])).withColumn("first", F.col("id") - F.col("local_index"))
        return P.scored_pairs(with_words(_planted(own, *also, shared=("first",))), 0.5, together, carry)

    pairs = P.by_length(table(spark, sf_dir, "documents"), found)
    return pairs.where("score >= 0.5").select("doc_id", "a", "b", "score", *[f"{p}_{c}" for p in "ab" for c in carry])


@query(
    "jn_cross_reference_protection",
    f"""WITH {_CAND}, ctx AS (SELECT DISTINCT t.doc_id, t.sid, t.section_index FROM top t JOIN src h ON h.doc_id = t.doc_id AND h.sid = t.id WHERE rank <= 3 AND h.section_index <> t.section_index),
    heads AS (SELECT src.doc_id, src.section_index, src.tokens FROM src JOIN summary s ON s.doc_id = src.doc_id AND s.id = src.sid),
    cov AS (SELECT c.doc_id, c.sid, c.section_index, coalesce(len(list_intersect(x.tokens, y.tokens)) / nullif(sqrt(len(x.tokens)::DOUBLE * len(y.tokens)), 0), 0) AS sim FROM ctx c JOIN src x ON x.doc_id = c.doc_id AND x.sid = c.sid JOIN heads y ON y.doc_id = c.doc_id AND y.section_index = c.section_index)
    SELECT doc_id, section_index, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS protected FROM cov WHERE sim < 0.7 - 1e-12 GROUP BY ALL""",
)
def protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, FLT10: sentences that another section drew on and their own section's summary doesn't cover, in order."""
    rows = sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("sentence_id").alias("sid"), "section_index", "local_index", M.core(F.col("text")).alias("tokens"))
    asks = rows.select("doc_id", F.col("sid").alias("id"), F.col("section_index").alias("asking"))
    drawn = candidates(spark, sf_dir).select("doc_id", "id", "sid", "section_index").join(asks, ["doc_id", "id"]).where("asking <> section_index").select("doc_id", "sid", "section_index").distinct()
    heads = rows.where("local_index = 0").select("doc_id", "section_index", F.col("tokens").alias("head"))
    both = drawn.join(rows.select("doc_id", "sid", "tokens"), ["doc_id", "sid"]).join(heads, ["doc_id", "section_index"])
    sim = F.coalesce(F.try_divide(F.size(F.array_intersect("tokens", "head")).cast("double"), F.sqrt(F.size("tokens").cast("double") * F.size("head"))), F.lit(0.0))
    return both.where(sim < 0.7 - 1e-12).groupBy("doc_id", "section_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("sid")), lambda x: x.cast("string")), ",").alias("protected"))


@query("agg_faithfulness", ORACLE_SQL["prv_provenance"].replace("SELECT s.doc_id, s.id, entailment", "SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'supported') AS supported, round(avg(CASE WHEN status = 'supported' THEN 1.0 ELSE 0.0 END), 6) AS faithfulness FROM (SELECT s.doc_id, s.id, entailment") + ") GROUP BY doc_id")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: the share of summary sentences that their sources entail."""
    ok = F.col("status") == "supported"
    return provenance(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("supported"), F.round(F.avg(ok.cast("double")), 6).alias("faithfulness"))
