"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source gets a target in words.  Blocks of equal length are seats: a source's share of all seats goes by the
highest quotients target / (2k + 1), and its seats go to its shards in the same way by their words, so every shard has
an integer quota before any block is picked.  A shard is a run of its documents in the order of a seeded digest, cut
into blocks; all its blocks are taken as often as the quota allows, and one time more the blocks of the smallest
digests of seed, source, shard and block.  A block is taken at most twice, which bounds what a document gives.

Seats of sources are found as the threshold that just enough quotients reach: passes over the table of sources count
the quotients above 63 thresholds at once, so no task and no driver holds the sources; ties go by the source's place.
Shards hold about ``SHARD_WORDS`` words or rows, and a source's shards are apportioned in one task as three numbers each.

Null texts count as empty and null ids as an id of their own; a null source is one source, after all others.  Rows that
share id and text share their digest and are taken in any order among themselves (their results are the same pairs);
documents without words take nothing.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import join_groups, stash, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
#: Words and rows of a shard, on average: one task's working set.
SHARD_WORDS = 262_144
#: The mix holds this many words for each two of the input, and no source more than twice its size.
SHARE_OF_2, MOST = 3, 2


# -- highest quotients


def _seats_at(weight: np.ndarray, most: np.ndarray, x: float) -> np.ndarray:
    """How many of the quotients weight / (2k + 1), k < most, are x or more."""
    with np.errstate(over="ignore"):
        k = np.floor(np.minimum(weight / (2 * x) + 0.5, most)).astype(np.int64)
    k += weight / (2 * k + 1) >= x
    k -= weight / (2 * np.maximum(k, 1) - 1) < x
    return np.clip(k, 0, most)


def _seats_column(weight: Column, most: Column, x: Column) -> Column:
    k = F.floor(F.least(weight / (2 * x) + 0.5, most.cast("double")))
    k = k + F.when(weight / (2 * k + 1) >= x, 1).otherwise(0)
    k = k - F.when(weight / (2 * F.greatest(k, F.lit(1)) - 1) < x, 1).otherwise(0)
    return F.least(F.greatest(k, F.lit(0)), most)


def _bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


LEAST = _bits(np.finfo(np.float64).tiny)


def apportion(weight: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), ``most`` at most each; quotients that tie go by place."""
    weight, most = np.asarray(weight, np.float64), np.asarray(most, np.int64)
    if seats <= 0 or not (weight > 0).any():
        return np.zeros(len(weight), np.int64)
    low, high = LEAST, _bits(float(weight.max())) + 1
    if _seats_at(weight, most, _double(low)).sum() <= seats:
        return _seats_at(weight, most, _double(low))
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _seats_at(weight, most, _double(middle)).sum() >= seats else (low, middle)
    sure = _seats_at(weight, most, _double(high))
    tied = np.flatnonzero(_seats_at(weight, most, _double(low)) > sure)[: seats - int(sure.sum())]
    sure[tied] += 1
    return sure


def apportion_table(items: DataFrame, seats: int, guess: float) -> DataFrame:
    """``items`` (place, weight, most, ...) with their seats, as ``apportion`` gives them; ``guess`` is about the least quotient that gets a seat."""
    top = items.agg(F.max("weight")).first()[0] or 0.0
    if seats <= 0 or top <= 0:
        return items.withColumn("seats", F.lit(0).cast("long"))
    seats_at = lambda x: _seats_column(F.col("weight"), F.col("most"), x)

    def narrowed(low: int, high: int, points: list[int]) -> tuple[int, int]:
        points = sorted({p for p in points if low < p < high})
        if points:
            each = F.transform(F.array(*(F.lit(_double(p)) for p in points)), seats_at)
            counts = dict(items.select(F.posexplode(each).alias("at", "n")).groupBy("at").agg(F.sum("n")).collect())
            enough = [p for i, p in enumerate(points) if counts[i] >= seats]
            low, high = max([low, *enough]), min([high, *points[len(enough) :]])
        return low, high

    around = _bits(guess)
    low, high = narrowed(LEAST, _bits(top) + 1, [around + sign * (1 << j) for j in range(21, 53) for sign in (-1, 1)])
    while high - low > 1:
        low, high = narrowed(low, high, [low + (high - low) * i // 64 for i in range(1, 64)])
    found = stash(items.withColumn("_sure", seats_at(F.lit(_double(high)))).withColumn("_more", F.greatest(seats_at(F.lit(_double(low))) - F.col("_sure"), F.lit(0))), "mix-seats")
    sure, more = found.agg(F.sum("_sure"), F.sum("_more")).first()
    if sure + more <= seats:
        return found.withColumn("seats", F.col("_sure") + F.col("_more")).drop("_sure", "_more")
    picked = numbered(found.where("_more > 0").select(F.col("place").alias("_tied")), [F.col("_tied")], "_rank").where(F.col("_rank") < seats - sure)
    return found.join(picked, F.col("place") == F.col("_tied"), "left").withColumn("seats", F.col("_sure") + F.when(F.col("_rank").isNotNull(), 1).otherwise(0)).drop("_sure", "_more", "_tied", "_rank")


# -- targets


def with_targets(sources: DataFrame, total: int) -> DataFrame:
    """``sources`` (source_size, weight in ``share``, ...) with target: shares of ``SHARE_OF_2`` / 2 of all words, stopped at ``MOST`` times a source's size.

    What is above the stop goes to the others by weight, until none is above: each round is one sum over the sources.
    """
    held, stopped = -1, F.lit(False)
    number, weights = SHARE_OF_2 * total, 2 * (sources.agg(F.sum("share")).first()[0] or 0)
    while weights:
        stopped = F.col("source_size").cast("double") * MOST * F.lit(float(weights)) < F.col("share").cast("double") * F.lit(float(number))
        size, open_ = sources.agg(F.sum(F.when(stopped, F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("share")))).first()
        if size == held or not open_:
            break
        held, number, weights = size, SHARE_OF_2 * total - 2 * MOST * size, 2 * open_
    level = (F.col("share") * F.lit(number)).cast("double") / F.lit(float(max(weights, 1)))
    return sources.withColumn("target", F.when(stopped, F.col("source_size") * float(MOST)).otherwise(level))


# -- blocks


def _shard_seats(rows: pa.Table, block: int) -> pa.Table:
    rows = rows.sort_by("shard")
    words = rows.column("words").to_numpy()
    seats = apportion(words, MOST * -(-words // block), rows.column("seats")[0].as_py())
    return pa.table({"place": rows.column("place"), "shard": rows.column("shard"), "quota": seats})


def times_taken(seed: int, place: int, shard: int, blocks: int, quota: int) -> np.ndarray:
    """How often each block of a shard is taken."""
    if not blocks:
        return np.zeros(0, np.int64)
    times, more = np.full(blocks, quota // blocks, np.int64), quota % blocks
    if more:
        drawn = np.fromiter((int.from_bytes(hashlib.sha256(b"%d:%d:%d:%d" % (seed, place, shard, i)).digest()[:8], "big") for i in range(blocks)), np.uint64, blocks)
        times[np.argsort(drawn, kind="stable")[:more]] += 1
    return times


_TAKEN = "doc_id long, size long, source_size long, target double, taken long, spans array<struct<start: long, stop: long, times: long>>"


def _take(docs: pa.Table, quota: pa.Table, seed: int, block: int, spans: bool) -> pa.Table:
    docs = docs.sort_by([("d1", "ascending"), ("d2", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    size = docs.column("size").to_numpy()
    stop = np.cumsum(size)
    start, words, (row,) = stop - size, int(stop[-1]), quota.to_pylist()
    times = times_taken(seed, row["place"], row["shard"], -(-words // block), row["quota"])
    before = np.concatenate([[0], np.cumsum(times * block)])
    repeats = np.append(times, 0)
    # all words taken before a word of the shard: whole blocks, and part of its own
    until = lambda at: before[at // block] + repeats[at // block] * (at % block)
    out = {"doc_id": docs.column("doc_id"), "size": size, "source_size": np.full(len(size), row["source_size"]), "target": np.full(len(size), row["target"]), "taken": until(stop) - until(start)}
    made = []
    for a, b in zip(start, stop, strict=True) if spans else ():
        first, last = a // block, -(-b // block) if b > a else a // block
        edges = np.flatnonzero(np.diff(times[first:last], prepend=-1, append=-1)) + first
        made.append([{"start": int(max(x * block, a) - a), "stop": int(min(y * block, b) - a), "times": int(times[x])} for x, y in zip(edges[:-1], edges[1:], strict=True) if times[x]])
    return pa.table(out | {"spans": pa.array(made if spans else [None] * len(size), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("times", pa.int64())])))})


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, spans: bool = True) -> DataFrame:
    """doc_id, size, source_size, target (the source's), taken and spans for every row of docs (doc_id, source, text).

    ``spans`` are the runs of the document's words, from 0, that the mix takes, and how often it takes them (null where not asked for).
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"), 256)
    # a key that is never null, so that the null source joins like any other
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    sized = docs.select("doc_id", "source", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"))
    part = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    sized = stash(sized.select("doc_id", "source", "key", "size", part(1).alias("d1"), part(16).alias("d2")), "mix-sizes")

    totals = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    shares = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("long")
    sources = stash(numbered(totals, [F.asc_nulls_last("source")]).withColumn("share", shares), "mix-sources")
    total, rows = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    sources = with_targets(sources, total).withColumn("shards", F.ceil((F.col("source_size") + F.col("rows")) / shard_words).cast("long"))

    dealt = join_groups(sized.drop("source"), sources.select("key", "place", "shards", "rows"), ["key"], "rows", rows)
    dealt = stash(dealt.select("doc_id", "size", "d1", "d2", "place", (F.col("d1") % F.col("shards")).alias("shard")), "mix-dealt")
    shards = stash(dealt.groupBy("place", "shard").agg(F.sum("size").alias("words")), "mix-shards")
    blocks = shards.groupBy("place").agg(F.sum(MOST * F.ceil(F.col("words") / block)).cast("long").alias("most"))
    seats = (SHARE_OF_2 * total + block) // (2 * block)
    items = sources.select("place", "source_size", "target", F.col("target").alias("weight")).join(blocks, "place")
    items = apportion_table(stash(items, "mix-items"), seats, SHARE_OF_2 * total / 4 / max(seats, 1)).select("place", "source_size", "target", "seats")

    quotas = shards.join(items.select("place", "seats"), "place").groupBy("place").applyInArrow(lambda rows: _shard_seats(rows, block), "place long, shard long, quota long")
    quotas = quotas.join(items.drop("seats"), "place")
    by = ("place", "shard")
    return dealt.groupBy(*by).cogroup(quotas.groupBy(*by)).applyInArrow(lambda left, right: _take(left, right, seed, block, spans), _TAKEN)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return mix(docs, spans=False).drop("spans")


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, sha256('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS share
  FROM d GROUP BY source
),
-- sources by what stops them: the first k stop where the level that the others share is above their stop
o AS (SELECT *, sum(source_size) OVER () AS total, sum(source_size) OVER w - source_size AS held, sum(share) OVER () - (sum(share) OVER w - share) AS open_share FROM s WINDOW w AS (ORDER BY source_size / share, place ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT * FROM (SELECT 3 * total - 4 * held AS number, 2 * open_share AS weights, held, row_number() OVER (ORDER BY source_size / share, place) AS r FROM o WHERE source_size * 2.0 * (2 * open_share) >= share * (3.0 * total - 4 * held)) ORDER BY r LIMIT 1),
t AS (
  SELECT s.*, CASE WHEN source_size * 2.0 * weights < share * number::DOUBLE THEN source_size * 2.0 ELSE (share * number)::DOUBLE / weights::DOUBLE END AS target, ceil((source_size + n) / {SHARD_WORDS}.0)::BIGINT AS shards
  FROM s, lvl
),
dealt AS (SELECT d.doc_id, d.size, place, source_size, target, ('0x' || substr(h, 1, 15))::BIGINT % shards AS shard, h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
spot AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS stop FROM dealt),
shard AS (SELECT place, shard, any_value(target) AS target, sum(size)::BIGINT AS words, ceil(sum(size) / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM dealt GROUP BY ALL),
most AS (SELECT place, any_value(target) AS target, (2 * sum(blocks))::BIGINT AS most FROM shard GROUP BY place),
seat AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r FROM (SELECT place, target, unnest(range(most)) AS k FROM most WHERE target > 0)),
seats AS (SELECT place, count(*) AS seats FROM seat WHERE r <= (SELECT (3 * sum(source_size) + {BLOCK_WORDS}) // {2 * BLOCK_WORDS} FROM s) GROUP BY place),
part AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k + 1) DESC, shard) AS r FROM (SELECT place, shard, words, unnest(range(2 * blocks)) AS k FROM shard)),
quota AS (SELECT place, shard, count(*) AS quota FROM part JOIN seats USING (place) WHERE r <= seats GROUP BY ALL),
block AS (SELECT place, shard, blocks, unnest(range(blocks)) AS b FROM shard),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place, shard ORDER BY sha256('42:' || place || ':' || shard || ':' || b)) AS r FROM block),
times AS (SELECT place, shard, b, quota // blocks + (r <= quota % blocks)::INT AS times FROM ranked JOIN quota USING (place, shard)),
taken AS (
  SELECT spot.place, spot.shard, spot.h, spot.stop, spot.size, sum(times * (least(stop, (b + 1) * {BLOCK_WORDS}) - greatest(stop - size, b * {BLOCK_WORDS})))::BIGINT AS taken
  FROM spot JOIN times ON spot.place = times.place AND spot.shard = times.shard AND b >= (stop - size) // {BLOCK_WORDS} AND b * {BLOCK_WORDS} < stop WHERE size > 0 GROUP BY ALL
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM spot LEFT JOIN taken USING (place, shard, h, stop, size)
"""
