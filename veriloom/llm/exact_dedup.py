"""Exact dedup with a minimal perfect hash over historical distinct digests.

Rows with the higher half of the ids are the history: their distinct digests, dealt by hash to shards of
bounded size, get one minimal perfect hash a shard, whose slots hold the full digest, the locator of the
winning row and the number of rows.  Distinct digests of the other rows are looked up there and compared byte for
byte: members are repeats of the slot's winner and add to its rows; nonmembers group among themselves.  What the
shards answer, slots and nonmembers, is the list of groups; rows take their group's answer by digest, those of
very large groups from a broadcast list of a thousand groups at most.

Null texts count as empty, and all empty texts are equal.  A null id counts as smaller than any other and
leaves ``kept`` false unless all ids of the group are null.  Rows that share text and id are one document and
share one decision.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, join_groups, keep_rows, mix, stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct digests of a shard, on average; a shard is one task's working set (some 60 bytes a digest).
SHARD_DIGESTS = 4_000
LEVELS = 40


def digest_of(text: Column) -> Column:
    """SHA-256, as bytes, of the text with A-Z lower-cased."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def _key(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32) if len(column) else np.zeros((0, 32), np.uint8)


class MinimalPerfectHash:
    """Slots 0 to n-1 for n distinct 64-bit keys, in levels of bit arrays; the slot is a bit's rank.

    Each level gives a bit to every key that is alone at its place; the rest go on to the next level, and
    whatever is left after the last level is kept sorted.
    """

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 for b in bits]
        self.before = np.concatenate([[0], np.cumsum([int(b.sum()) for b in bits])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(1, len(keys))
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, bits, np.sort(keys))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(level + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot of each key; a key outside the set gets any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits, strict=True)):
            at = self._place(keys[open_], level, size)
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


_INDEX = "shard long, sizes array<int>, bits binary, rest binary, digests binary, locators binary, counts binary"


def _build(group: pa.Table) -> pa.Table:
    digests = _matrix(group.column("digest").combine_chunks())
    keys = _key(digests)
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    if same.any():  # digests that agree in their first 8 bytes: tell them apart by the rest
        keys = keys ^ mix(np.ascontiguousarray(digests[:, 8:16]).view(np.uint64).ravel())
    mph = MinimalPerfectHash.build(keys)
    at = mph.slots(keys)
    slots, locators, counts = np.zeros_like(digests), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    slots[at], locators[at], counts[at] = digests, group.column("locator").to_numpy(), group.column("n").to_numpy()
    row = {"shard": [group.column("shard")[0].as_py()], "sizes": [mph.sizes + [int(same.any())]], "bits": [np.packbits(np.concatenate([*mph.bits, np.zeros(0, bool)])).tobytes()], "rest": [mph.rest.tobytes()], "digests": [slots.tobytes()], "locators": [locators.tobytes()], "counts": [counts.tobytes()]}
    return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "rest", "digests", "locators", "counts"))]))


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    """A shard's groups: its slots, with the asked rows that they answer, and the asked digests that are in no slot."""
    digests, own, n = _matrix(asked.column("digest").combine_chunks()), asked.column("locator").to_numpy(), asked.column("n").to_numpy()
    member, slots, winners, counts = np.zeros(len(own), bool), np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if index.num_rows:
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        *sizes, longer = row["sizes"]
        flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        mph = MinimalPerfectHash(sizes, np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [], np.frombuffer(row["rest"], np.uint64))
        slots, winners, counts = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), np.frombuffer(row["locators"], np.int64), np.frombuffer(row["counts"], np.int64).copy()
        if len(own):
            keys = _key(digests)
            if longer:
                keys = keys ^ mix(np.ascontiguousarray(digests[:, 8:16]).view(np.uint64).ravel())
            at = mph.slots(keys)
            member = (at >= 0) & (slots[np.maximum(at, 0)] == digests).all(axis=1)
            counts[at[member]] += n[member]  # asked digests are distinct, so no slot comes twice
    return pa.table({"digest": pa.array([d.tobytes() for d in np.concatenate([slots, digests[~member]])], pa.binary()), "keep_id": np.concatenate([winners, own[~member]]), "group_size": np.concatenate([counts, n[~member]])})


def exact_groups(digests: DataFrame) -> tuple[DataFrame, int]:
    """(digest, keep_id, group_size) of the table (doc_id, digest), and the number of its rows."""
    low, high, n = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    pivot = low + (high - low) // 2 if low is not None else 0
    shards = max(1, -(-n // SHARD_DIGESTS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    counted = lambda rows: rows.groupBy("digest").agg(F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("locator"), F.count("*").alias("n")).select(shard, "digest", "locator", "n")
    index = counted(digests.where(F.col("doc_id") > pivot)).groupBy("shard").applyInArrow(_build, _INDEX)
    asked = counted(digests.where(F.col("doc_id").isNull() | (F.col("doc_id") <= pivot)))
    groups = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_look_up, "digest binary, keep_id long, group_size long")
    return groups.withColumn("keep_id", F.when(F.col("keep_id") != -(2**63), F.col("keep_id"))), n


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and key (the digest) for every row of docs (doc_id, text)."""
    digests = stash(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    groups, n = exact_groups(digests)
    joined = join_groups(digests, stash(groups, "digest-groups"), ["digest"], "group_size", n)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("key"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    return decisions(docs).withColumn("text_sha256", F.lower(F.hex("key"))).drop("key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: exactly one of each set of equal texts."""
    return keep_rows(docs, decisions(docs_of(docs)), lambda rows: rows.withColumn("key", digest_of(F.col("text"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(docs_of(table(spark, sf_dir, "documents")))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
