"""Near-duplicate detection by Order MinHash.

Two texts are near-duplicates if banded alignment of their words needs at most a fifth of the longer one's words in
edits: an edit similarity of ``SIMILARITY``.  Candidates come from Order MinHash: a text's five-word shingles are
labelled with their occurrence number; each of ``SKETCHES`` hash orders picks the smallest few and keeps them in text
order; texts that agree on one such pick share a bucket.  Texts of up to ``SHORT`` words have few shingles, all of
which a single edit can change, so they get sketches of word pairs, too, and those of up to ``SHORTEST`` of single words.

In a bucket, every member is first held against the most central one.  Buckets whose members are then all joined by
chains of links are closed.  What other buckets leave open is settled pair by pair, inside tasks that each hold two
blocks of a bucket: a pair belongs to the first key that its texts share, in one of several orders, and is aligned there unless links join
it by then, or lengths or words rule it out.  So any two texts of a bucket are joined, or compared, or can't be
similar: no candidate is left open.  Only links leave the tasks; the work of a bucket grows with its members times those
that the central one doesn't join with the rest.

Texts with the same words are one class and are compared once.  Words are folded: ASCII letters in lower
case, and only letters, digits and characters beyond ASCII count.  A text of one to three words has no partner but
those of equal words; texts without words (null ones too) are one class.  Classes are told apart by 128 bits and named by
64 of them.  A null id counts as the smallest.  Rows that share id and words are one document and share one answer;
``keep_one`` keeps one of them.  Texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, docs_of, folded, join_groups, keep_rows, map_slices, mix, stash, table, word_hashes
from .graph import components

SHINGLE, SIMILARITY, SHORT, SHORTEST = 5, 0.8, 48, 12
SKETCHES = 32
#: Bits that tell which words a text has.
WORD_BITS = 512
#: Orders of the keys by which pairs belong to one of those that their texts share.
ORDERS = 8
#: Members of an open bucket in one block, on average.
BLOCK = 512
#: Pairs of one leader that one task takes at most, on average.
LEADER_PAIRS = 256
_NO_ID = -(2**63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Family:
    """Sketches of ``picked`` shingles of ``size`` words, for texts of ``least`` to ``most`` words."""

    size: int
    picked: int
    least: int
    most: int


#: One of 32 picks of three agrees with 0.986 where half of the shingles do, as after edits of a tenth of the words in runs.
FAMILIES = (Family(SHINGLE, 3, SHINGLE, 2**62), Family(2, 2, 4, SHORT), Family(1, 3, 4, SHORTEST))


def shingles(words: np.ndarray, starts: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of every text, in text order, and where each text's shingles start."""
    count = np.maximum(np.diff(starts) - length + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(first[-1]) - first[doc] + starts[doc]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = out * _STEP + words[at + i]
        out = mix(out)
        mixed = mix(out ^ mix(doc.astype(np.uint64)))
        order = np.argsort(mixed, kind="stable")
        ranked = mixed[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        run = np.arange(len(ranked)) - np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
        seen = np.zeros(len(ranked), np.uint64)
        seen[order] = run
        again = seen > 0
        out[again] = mix(out[again] + seen[again] * _STEP)
    return out, first


def sketch(labelled: np.ndarray, first: np.ndarray, picked: int, sketches: int = SKETCHES) -> np.ndarray:
    """The bucket keys of every text: one for each hash order."""
    n_docs, count = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    # on average four times as many as are picked come below a text's limit
    share = np.minimum(1.0, 4 * picked / np.maximum(count, 1))
    limit = np.where(share < 1, share * 2.0**64, 0).astype(np.uint64)
    limit[share >= 1] = np.uint64(2**64 - 1)
    limits, keys = limit[doc], np.zeros((n_docs, sketches), np.uint64)
    for h in range(sketches):
        with np.errstate(over="ignore"):
            value = labelled * (mix(h + 1) | np.uint64(1))
        low = np.flatnonzero(value <= limits)
        short = np.flatnonzero(np.bincount(doc[low], minlength=n_docs) < np.minimum(count, picked))
        if len(short):
            low = np.concatenate([low[~np.isin(doc[low], short)], *(np.arange(first[d], first[d + 1]) for d in short)])
        low = low[np.lexsort((low, value[low], doc[low]))]
        owner = doc[low]
        begins = np.searchsorted(owner, np.arange(n_docs))
        rank = np.arange(len(low)) - begins[owner]
        low, owner = low[rank < picked], owner[rank < picked]
        order = np.argsort(low)  # text order; shingles of a text are in one run
        low, owner = low[order], owner[order]
        begins = np.searchsorted(owner, np.arange(n_docs))
        place = np.arange(len(low)) - begins[owner]
        picks = np.zeros((n_docs, picked), np.uint64)
        picks[owner, place] = labelled[low]
        with np.errstate(over="ignore"):
            key = np.full(n_docs, h + 1, np.uint64)
            for i in range(picked):
                key = mix(key * _STEP + picks[:, i])
        keys[:, h] = key
    return keys


def bucket_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of all texts, text by text, and where each text's begin."""
    size, texts, keys = np.diff(starts), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, family in enumerate(FAMILIES):
        some = (size >= family.least) & (size <= family.most)
        own = words if some.all() else words[np.repeat(some, size)]
        labelled, first = shingles(own, np.concatenate([[0], np.cumsum(size[some])]), family.size)
        keys.append(mix(sketch(labelled, first, family.picked) ^ np.uint64(k)).ravel())
        texts.append(np.repeat(np.flatnonzero(some), SKETCHES))
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(texts, kind="stable")
    return keys[order], np.searchsorted(texts[order], np.arange(len(size) + 1))


def class_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a text's word sequence."""
    size, place = np.diff(starts), np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    total = []
    for salt in (1, 2):
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words ^ mix(place * 2 + salt)), dtype=np.uint64)])
            total.append(mix(sums[starts[1:]] - sums[starts[:-1]] + size.astype(np.uint64) * _STEP + np.uint64(salt)).view(np.int64))
    return total[0], total[1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Runs:
    """How far two sequences agree from given places on, by fingerprints of stretches; both end in symbols of their own."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.power = _powers(0xD6E8FEB86659FD93, max(len(a), len(b)))
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x) * self.power[: len(x)], dtype=np.uint64)]) for x in (a, b)]

    def length(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (a, b), power = self.sums, self.power
        done, step = np.zeros(len(i), np.int64), 1 << (len(power) - 1).bit_length()
        with np.errstate(over="ignore"):
            while step:
                far = done + step
                ok = np.flatnonzero((i + far < len(a)) & (j + far < len(b)))
                x, y, n = i[ok], j[ok], far[ok]
                same = (a[x + n] - a[x]) * power[y] == (b[y + n] - b[y]) * power[x]
                done[ok[same]] = n[same]
                step >>= 1
        return done


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits between two word sequences, or None if more than ``most``.

    The furthest reach on each diagonal of a band that widens with each edit, all diagonals at once.
    """
    if abs(len(a) - len(b)) > most:
        return None
    for _ in range(2):  # equal ends
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        k = int(differ[0]) if len(differ) else k
        a, b = a[k:][::-1], b[k:][::-1]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    code = code.astype(np.int64) + 2
    common = np.minimum(np.bincount(code[:n], minlength=int(code.max()) + 1), np.bincount(code[n:], minlength=int(code.max()) + 1)).sum()
    if max(n, m) - common > most:  # words that only one side has
        return None
    a, b = np.append(code[:n], 0), np.append(code[n:], 1)
    runs, center, goal = None, most + 1, m - n
    reach = np.full(2 * most + 3, -(1 << 40), np.int64)
    reach[center] = 0  # the ends differ, so nothing is free
    for e in range(1, most + 1):
        # diagonals from which the goal is still within reach
        low, high = max(-e, goal - (most - e), -n), min(e, goal + (most - e), m)
        d = np.arange(low, high + 1)
        near = reach[low + center - 1 : high + center + 2]
        i = np.maximum(np.maximum(near[1:-1], near[2:]) + 1, near[:-2])
        i = np.minimum(np.minimum(i, n), m - d)
        live = np.flatnonzero((i >= 0) & (i + d >= 0))
        on = live[a[i[live]] == b[i[live] + d[live]]]
        if len(on):
            runs = runs or _Runs(a, b)
            i[on] += runs.length(i[on], i[on] + d[on])
        dead = np.ones(len(i), bool)
        dead[live] = False
        i[dead] = -(1 << 40)
        reach[low + center : high + center + 1] = i
        if reach[goal + center] >= n:
            return e
    return None


def word_bits(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every text, ``WORD_BITS`` bits as 64-bit numbers: which hash values its words have."""
    n = len(starts) - 1
    held = np.zeros(n * WORD_BITS, bool)
    held[np.repeat(np.arange(n), np.diff(starts)) * WORD_BITS + (words % np.uint64(WORD_BITS)).astype(np.int64)] = True
    return np.packbits(held).view(np.int64).reshape(n, -1)


def budget(n: int, m: int) -> int:
    """Edits that texts of n and m words may have."""
    return int((1 - SIMILARITY) * max(n, m) + 1e-9)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the class), n (words), bits (of its words) and keys (buckets) of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = word_hashes(folded(part.column("text")))
        k1, k2 = class_keys(words, starts)
        keys, begins = bucket_keys(words, starts)
        lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(keys.view(np.int64)))
        return pa.record_batch({"doc_id": part.column("doc_id"), "k1": k1, "k2": k2, "n": np.diff(starts), "bits": list(word_bits(words, starts)), "keys": lists})

    return map_slices(docs, run, "doc_id long, k1 long, k2 long, n long, bits array<long>, keys array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, text): one text of each class in ``wanted`` (k1, k2, rep), read from the row of the class's smallest id."""
    rows = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID))).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")

    def own(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words, starts = word_hashes(folded(part.column("text")))
        k1, k2 = class_keys(words, starts)
        # a repeated id brings other texts along
        fits = (k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy())
        return part.select(["k1", "text"]).filter(pa.array(fits))

    return map_slices(rows.select("k1", "k2", "text"), own, "k1 long, text string")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked for pairs (a, b) of classes; the pairs of one leader a are dealt to many tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).alias("parts"))
    leaders = many.join(texts.select(F.col("k1").alias("a"), F.col("text").alias("text_a")), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    joined = dealt.join(texts.select(F.col("k1").alias("b"), F.col("text").alias("text_b")), "b").join(leaders.drop("parts"), ["a", "part"]).select("a", "b", "text_a", "text_b")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        coded = pa.concat_arrays([part.column("text_a").cast(pa.string()), part.column("text_b").cast(pa.string())]).dictionary_encode()  # a leader's text comes many times
        words, starts = word_hashes(folded(coded.dictionary))
        n, at, linked = part.num_rows, coded.indices.to_numpy(zero_copy_only=False), []
        for i, j in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
            x, y = words[starts[i] : starts[i + 1]], words[starts[j] : starts[j + 1]]
            linked.append(edit_distance(x, y, budget(len(x), len(y))) is not None)
        return pa.record_batch({"a": part.column("a"), "b": part.column("b"), "linked": pa.array(linked, pa.bool_())})

    return map_slices(joined, run, "a long, b long, linked boolean", text="text_b")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (a, b) have joined components."""
    if labels is None:
        return components(links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"own_{c}"))
    moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("own_a", "a").alias("a"), F.coalesce("own_b", "b").alias("b"))
    new = components(moved.where("a <> b"))
    known = labels.join(new.select(F.col("node").alias("component"), F.col("component").alias("other")), "component", "left").select("node", F.coalesce("other", "component").alias("component"))
    out = stash(known.unionByName(new.join(labels.select("node"), "node", "left_anti")), "components")
    discard(labels, new)
    return out


def _settle(group: pa.Table) -> pa.Table:
    """Links (a, b) between the two blocks of an open bucket, for pairs that belong to its key."""
    group = group.sort_by("k1")
    value = lambda c: group.column(c).to_numpy()
    m, key, names = group.num_rows, value("key")[0], value("k1")
    near, size, block, lowest, highest = value("component").copy(), value("n"), value("block"), value("first")[0], value("second")[0]
    ok = (near[:, None] != near) & (np.minimum(size[:, None], size) >= SIMILARITY * np.maximum(size[:, None], size))
    ok &= (np.minimum(block[:, None], block) == lowest) & (np.maximum(block[:, None], block) == highest)
    i, j = np.nonzero(np.triu(ok, 1))
    bits = np.stack(group.column("bits").to_pylist()).astype(np.int64).view(np.uint64)
    able = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):  # each hash value of words that one side lacks costs an edit
        x, y = bits[i[k : k + (1 << 16)]], bits[j[k : k + (1 << 16)]]
        able[k : k + (1 << 16)] = np.maximum(np.bitwise_count(x & ~y).sum(axis=1), np.bitwise_count(y & ~x).sum(axis=1)) <= (1 - SIMILARITY) * np.maximum(size[i[k : k + (1 << 16)]], size[j[k : k + (1 << 16)]]) + 1e-9
    i, j = i[able], j[able]
    lists = group.column("keys").combine_chunks()
    owner, keys = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().view(np.uint64)
    salt = (mix(names.view(np.uint64)) % np.uint64(ORDERS)).astype(np.int64)
    salt, out = salt[i] ^ salt[j], []
    words, starts = word_hashes(folded(group.column("text").combine_chunks()))
    for s in np.unique(salt).tolist():
        rank = mix(keys ^ mix(s))
        less = rank < mix(np.uint64(key.view(np.uint64)) ^ mix(s))
        _, code, held = np.unique(keys[less], return_inverse=True, return_counts=True)
        has = np.zeros((m, len(held)), np.float32)
        has[owner[less], code] = 1
        has = has[:, held > 1]
        own = np.flatnonzero((salt == s) & ((has @ has.T)[i, j] == 0))
        for x, y in zip(i[own].tolist(), j[own].tolist(), strict=True):
            if near[x] == near[y]:
                continue
            a, b = words[starts[x] : starts[x + 1]], words[starts[y] : starts[y + 1]]
            if edit_distance(a, b, budget(len(a), len(b))) is not None:
                out.append((names[x], names[y]))
                near[near == near[y]] = near[x]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes (k1, k2, rep, n, bits, keys) that a chain of links joins with another one."""
    listed = classes.select("k1", "n", F.explode("keys").alias("key"))
    members = listed.join(listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    members = stash(members.join(members.groupBy("k1").agg(F.sum(F.log2("size")).alias("weight")), "k1").select("key", "k1", "n", "weight"), "members")
    texts = stash(texts_of(docs, classes.join(members.select("k1").distinct(), "k1").select("k1", "k2", "rep")), "candidate-texts")
    top = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("k1")).alias("order"), "k1", "n")).alias("top"))
    stars = members.join(top.select("key", F.col("top.k1").alias("a"), F.col("top.n").alias("na")), "key").where(F.col("k1") != F.col("a"))
    stars = stars.where(F.least("n", "na") >= SIMILARITY * F.greatest("n", "na")).select("a", F.col("k1").alias("b")).distinct()
    stars = stash(stars, "stars")
    first = stash(verified(stars, texts).where("linked").select("a", "b"), "star-links")
    labels = merged(None, first)

    grouped = members.select("key", "k1").join(labels.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    grouped = stash(grouped, "grouped-members")
    mixed = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high")
    open_ = stash(grouped.join(mixed.select("key", F.ceil(F.col("size") / BLOCK).alias("blocks")), "key"), "open-members")
    known = classes.select("k1", "n", "bits", "keys").join(texts, "k1").join(open_.select("k1").distinct(), "k1", "left_semi")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks"))).join(known, "k1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "k1", "component", "n", "bits", "keys", "text", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    more = stash(dealt.groupBy("key", "first", "second").applyInArrow(_settle, "a long, b long"), "more-links")
    labels = merged(labels, more)
    discard(members, texts, stars, first, grouped, open_, more)
    return labels


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the smallest id of its group), class_id, kept, and k1, k2 (the class) for every row of docs (doc_id, text)."""
    rows = stash(sketched(docs), "sketches")
    ident = F.coalesce("doc_id", F.lit(_NO_ID))
    classes = stash(rows.groupBy("k1", "k2").agg(F.min(ident).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.count("*").alias("rows")), "classes")
    labels = linked_classes(docs, classes)
    alone = classes.select("k1", "k2", "rep", "rows")
    named = alone.join(labels.withColumnRenamed("node", "k1"), "k1", "left")
    named = stash(named.withColumn("component", F.coalesce("component", "k1")), "named-classes")
    groups = named.groupBy("component").agg(F.min(F.struct("rep", "k1")).alias("first"), F.count("*").alias("classes"))
    n = named.count()
    found = join_groups(named, stash(groups, "groups"), ["component"], "classes", n).select("k1", "k2", "rows", "rep", F.col("first.rep").alias("group"), (F.col("first.k1") == F.col("k1")).alias("leads"))
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    out = join_groups(rows.select("doc_id", "k1", "k2"), stash(found, "found-groups"), ["k1", "k2"], "rows", n)
    out = out.select("doc_id", real("group").alias("group_id"), real("rep").alias("class_id"), (F.col("leads") & (ident == F.col("group"))).alias("kept"), "k1", "k2")
    discard(classes, named, labels)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the smallest id of its group), class_id, kept for every row of docs (doc_id, text)."""
    return decisions(docs).drop("k1", "k2")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one for each group stays."""

    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2 = class_keys(*word_hashes(folded(part.column("text"))))
        return pa.record_batch({"doc_id": part.column("doc_id"), "text": part.column("text"), "k1": k1, "k2": k2})

    key = F.struct("k1", "k2").alias("key")
    decided = decisions(docs_of(docs)).select("doc_id", "kept", key)
    return keep_rows(docs, decided, lambda rows: map_slices(rows, keyed, "doc_id long, text string, k1 long, k2 long").select("doc_id", "text", key))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_of(table(spark, sf_dir, "documents")))
