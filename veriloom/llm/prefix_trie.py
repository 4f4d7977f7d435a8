"""Conversation prefix trie by mergeable partial tries.

A node is a distinct sequence of first turns; its name is the sum of one 124-bit hash for each turn and its place, so
names of prefixes are running sums.  Turns are sorted by conversation in ranges: a task adds up its own range, and a
conversation that goes over several ranges gets what came before from one row a range.  Each range is a partial trie,
whose rows are combined by node before they are shuffled; partial tries then merge ``FAN`` at a time, keyed by node,
which sums members and ends and keeps the smallest member.  Lists of conversations that end at a node stay in the order
of the ranges, as blocks of bounded size, and are digested in a stream.  The rollup goes bottom-up in doubling strides:
a node adds its sums to the ancestor 1, 2, 4, ... levels above, so a trie of depth d takes log2(d) rounds.  Only nodes
with two members or more take part; below one with a single member there is only a chain of one leaf that saves nothing.

Rows without conv_id belong to no conversation.  A null turn comes first; rows that tie in conversation and turn go by
role, then by the SHA-256 of role and text, and equal rows all count.  Null roles and texts are empty.  An empty table has no
conversation and gives no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import join_groups, mix, narrow_batches, stash, table

WORD = r"[^\x20\x09-\x0D]+"
#: Partial tries that one merge takes together.
FAN = 32
#: Characters of a block of an end list.
BLOCK_CHARS = 65_536
#: Names have two lanes of 62 bits, so that adding two never overflows.
LANE = (1 << 62) - 1
NODE = ["depth", "a", "b"]
PARENT = ["up_depth", "up_a", "up_b"]


def turn_of(role: Column, text: Column) -> Column:
    """16 bytes that name a turn's role and text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


# -- names of prefixes


_PREFIXES = "conv_id long, depth long, a long, b long, da long, db long, words long, last boolean, part int"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the prefixes of rows sorted by conversation and depth; those of a range's first conversation start at nought."""
    conv, held = None, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
        turn = np.frombuffer(b"".join(batch.column("turn").to_pylist()), "<u8").reshape(-1, 2)
        starts = np.concatenate([[convs[0] != conv], np.diff(convs) != 0])
        start = np.maximum.accumulate(np.where(starts, np.arange(len(convs)), -1))
        out = []
        with np.errstate(over="ignore"):
            for lane in range(2):
                own = mix(turn[:, lane] ^ mix(depth.astype(np.uint64) * np.uint64(2) + np.uint64(lane)))
                own[depth == 0] = 0
                total = np.cumsum(own, dtype=np.uint64)
                # what was there before a row's conversation; a conversation of the batch before goes on at its last entry, -1
                before = np.append(total - own, np.uint64(-held[lane] % (1 << 64)))
                out.append(((total - before[start]) & np.uint64(LANE), own & np.uint64(LANE)))
        conv, held = convs[-1], tuple(int(x[0][-1]) for x in out)
        lanes = {n: pa.array(x.astype(np.int64)) for n, x in zip(("a", "b", "da", "db"), (out[0][0], out[1][0], out[0][1], out[1][1]), strict=True)}
        yield pa.record_batch({"conv_id": batch.column("conv_id"), "depth": batch.column("depth")} | lanes | {c: batch.column(c) for c in ("words", "last", "part")})


def _plus(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(F.lit(LANE))


def named_prefixes(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, depth, turn, words, last), one of depth 0 for each conversation, with their node and its parent.

    depth, a, b name the node, up_depth, up_a, up_b its parent; ``part`` is the range, and ranges are in the order of conv_id.
    """
    spark = turns.sparkSession
    ranges = turns.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("part", F.spark_partition_id())
    rows = stash(narrow_batches(ranges).mapInArrow(_running, _PREFIXES), "trie-prefixes")
    # one row for each range: its last conversation with the sums so far, and its first
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("head"), F.max(F.struct("conv_id", "depth", "a", "b")).alias("tail")).collect()
    carried, conv, sums = [], None, (0, 0)
    for e in sorted(edges, key=lambda e: e["part"]):
        over = e["head"] == conv
        if over:
            carried.append((e["part"], conv, *sums))
        sums = tuple(((s if over and e["tail"]["conv_id"] == conv else 0) + x) & LANE for s, x in zip(sums, (e["tail"]["a"], e["tail"]["b"]), strict=True))
        conv = e["tail"]["conv_id"]
    carry = F.broadcast(spark.createDataFrame(carried, "part int, conv_id long, ca long, cb long"))
    whole = rows.join(carry, ["part", "conv_id"], "left").withColumns({x: _plus(F.col(x), F.coalesce(f"c{x}", F.lit(0))) for x in ("a", "b")})
    up = {"up_depth": F.when(F.col("depth") > 0, F.col("depth") - 1)} | {f"up_{x}": F.when(F.col("depth") > 0, (F.col(x) - F.col(f"d{x}")).bitwiseAND(F.lit(LANE))) for x in ("a", "b")}
    return whole.withColumns(up).select("part", "conv_id", "words", "last", *NODE, *PARENT)


# -- partial tries


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """One row a node of the partial tries' rows (part, node, up, conv_id, n_convs, n_ends, words), merged ``FAN`` at a time."""
    while True:
        parts = -(-parts // FAN)
        partial = partial.groupBy(*NODE, (F.col("part") / FAN).cast("int").alias("part")).agg(
            *(F.min(c).alias(c) for c in PARENT), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.max("words").alias("words")
        )
        if parts <= 1:
            return partial.drop("part")


_BLOCKS = "depth long, a long, b long, part int, first long, n long, ids string"


def _end_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows sorted by node and id as blocks of comma-joined ids."""
    node, part, ids, length = None, None, [], 0

    def block():
        return pa.record_batch([[x] for x in (*node, part, ids[0], len(ids), ",".join(map(str, ids)))], names=[*NODE, "part", "first", "n", "ids"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (*NODE, "part", "conv_id")]
        for *key, p, conv in zip(*cols, strict=True):
            if key != node or p != part or length >= BLOCK_CHARS:
                if ids:
                    yield block().cast(_BLOCK_TYPES)
                node, part, ids, length = key, p, [], 0
            ids.append(conv)
            length += len(str(conv)) + 1
    if ids:
        yield block().cast(_BLOCK_TYPES)


_BLOCK_TYPES = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node of blocks sorted by node, range and first id; a block at a time is held."""
    node, digest, done = None, None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
        for *key, ids in zip(*cols, strict=True):
            if key != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) >= 1_000:
            yield _digest_rows(done)
            done = []
    if node:
        done.append((*node, digest.hexdigest()))
    if done:
        yield _digest_rows(done)


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(zip(*done, strict=True))], names=[*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids that end at each node, of rows (part, node, conv_id)."""
    blocks = ends.repartition("part", *NODE).sortWithinPartitions(*NODE, "part", "conv_id").mapInArrow(_end_blocks, _BLOCKS)
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


# -- rollup


def rolled_up(shared: DataFrame) -> DataFrame:
    """Nodes (node, up, leaves, saved) with leaves and saved summed over their subtrees, their ancestors included in ``shared``."""
    state, stride = stash(shared.select(*NODE, *PARENT, "leaves", "saved"), "trie-rollup"), 1
    deepest = state.agg(F.max("depth")).first()[0] or 0
    while stride <= deepest:
        sums = state.where(F.col("up_depth").isNotNull()).groupBy(*PARENT).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("below"))
        added = state.join(sums.select(*(F.col(u).alias(c) for u, c in zip(PARENT, NODE, strict=True)), "more_leaves", "more_saved", "below"), NODE, "left")
        added = stash(added.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved"), "trie-added")
        # where a node's ancestor has an ancestor as far above, that is next; many nodes can have the same
        far = F.col("up_depth") >= stride
        above = added.where("below > 0 AND up_depth IS NOT NULL").select(*(F.col(c).alias(u) for c, u in zip(NODE, PARENT, strict=True)), *(F.col(u).alias(f"far_{u}") for u in PARENT), "below")
        rows = added.drop("below")
        jumps = join_groups(rows.where(far), above, PARENT, "below", rows.count()).select(*NODE, *(F.col(f"far_{u}").alias(u) for u in PARENT), "leaves", "saved")
        rest = rows.where(~F.coalesce(far, F.lit(False))).select(*NODE, *(F.lit(None).cast("long").alias(u) for u in PARENT), "leaves", "saved")
        state, stride = stash(jumps.unionByName(rest), "trie-rollup"), 2 * stride
    return state.select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of ``turns`` (conv_id, depth, turn, words, last): its name (depth, a, b), its parent's, and its figures.

    ``turns`` has depth 0 and, from 1 on, one row a turn for each conversation; ``turn`` are 16 bytes that name role and text, and
    ``last`` marks the row of the greatest depth.  (conv_id, depth) finds a turn with the node's role and text.
    """
    rows = stash(named_prefixes(turns), "trie-rows")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    partial = rows.select("part", *NODE, *PARENT, "conv_id", F.lit(1).alias("n_convs"), F.col("last").cast("long").alias("n_ends"), "words")
    nodes = stash(merged(partial, parts), "trie-nodes")
    below = nodes.where(F.col("up_depth").isNotNull()).groupBy(*PARENT).agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("lone"))
    below = stash(below.select(*(F.col(u).alias(c) for u, c in zip(PARENT, NODE, strict=True)), "n_children", "lone"), "trie-below")
    counted = nodes.join(below, NODE, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "lone")})
    shared = counted.where("n_convs > 1").select(*NODE, *PARENT, (F.col("lone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    parents = nodes.join(below, NODE).select(*(F.col(c).alias(u) for c, u in zip(NODE, PARENT, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    known = join_groups(nodes.where(F.col("up_depth").isNotNull()).select(*NODE, *PARENT), parents, PARENT, "n_children", nodes.count()).select(*NODE, "parent_conv_id")
    full = counted.join(known, NODE, "left").join(rolled_up(shared), NODE, "left").join(end_digests(rows.where("last").select("part", *NODE, "conv_id")), NODE, "left")
    return full.select(
        *NODE, *PARENT, "conv_id", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "n_ends",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


# -- the query's conversations

#: Conversations of a family share the first turns of its first one.
FAMILY, SHARES = 20, 4


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (a place in the order of conversation and turn), turn, words for every turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), role.alias("role"), turn_of(role, text).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(rows, [F.col("conv_id"), F.asc_nulls_first("at"), F.col("role"), F.col("turn")], "place").select("conv_id", F.col("place").alias("at"), "turn", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, depth, turn, words, last) of every conversation with the first h turns of its family's first one in place of its own."""
    rows = ordered_turns(conversations)
    heads = rows.groupBy("conv_id").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES).alias("h")
    convs = stash(heads.select("conv_id", "from", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h), "trie-convs")
    n_rows = rows.count()
    firsts = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.posexplode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(SHARES - 1)).cast("int") - 1)).alias("i", "_"), (F.col("from") + F.col("i")).alias("at"))
    given = rows.join(firsts, "at").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "turn", "words"))).alias("given"))  # SHARES - 1 at most
    known = convs.join(given, "base", "left").withColumn("own", F.col("conv_id") == F.col("base"))
    taken = F.when(F.col("own"), 0).otherwise(F.least(F.col("h"), F.coalesce(F.size("given"), F.lit(0)))).cast("long")
    skip = F.when(F.col("own"), 0).otherwise(F.col("h")).cast("long")
    known = stash(known.withColumns({"taken": taken, "skip": skip}).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))), "trie-known")

    nought = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(bytes(16)).alias("turn"), F.lit(0).cast("long").alias("words"))
    front = F.transform(F.slice(F.coalesce("given", F.array()), F.lit(1), F.col("taken").cast("int")), lambda x: F.struct((x["i"] + 1).cast("long").alias("depth"), x["turn"].alias("turn"), x["words"].alias("words")))
    shared = known.select("conv_id", "length", F.explode(F.concat(F.array(nought), front)).alias("x")).select("conv_id", "x.depth", "x.turn", "x.words", (F.col("x.depth") == F.col("length")).alias("last"))
    own = join_groups(rows, known.select("conv_id", "from", "n", "skip", "taken", "length"), ["conv_id"], "n", n_rows).where(F.col("at") - F.col("from") >= F.col("skip"))
    depth = F.col("at") - F.col("from") - F.col("skip") + F.col("taken") + 1
    return shared.unionByName(own.select("conv_id", depth.alias("depth"), "turn", "words", (depth == F.col("length")).alias("last")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = "xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))), 4294967295::BIGINT))"
SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS o
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {SHARES} AS h FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT c.conv_id, 0 AS half, o, role, text FROM c JOIN t ON t.conv_id = c.base WHERE o < h
  UNION ALL SELECT c.conv_id, 1 AS half, o, role, text FROM c JOIN t USING (conv_id) WHERE o >= h
),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, o) AS depth, md5(length(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '{WORD}')) AS words FROM r),
p AS (SELECT conv_id, depth, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM e GROUP BY path),
k AS (SELECT up.path, count(*) AS n_children FROM n JOIN n up ON n.depth > 0 AND up.path = left(n.path, 32 * (n.depth - 1)::INT) GROUP BY up.path),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
-- a node lies in the subtrees of the prefixes of its smallest member
s AS (SELECT p.path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n up ON f.depth > 0 AND up.path = left(f.path, 32 * (f.depth - 1)::INT)
"""
