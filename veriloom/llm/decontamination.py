"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-cased letters and digits with single spaces.  An item of m characters that occurs
in a document with at most e edits shares at least m - q + 1 - q*e of its q-grams with the place, all within
e of one diagonal (document position minus item position).  Hits are counted in overlapping bands of
diagonals; bands that reach the bound are verified by banded alignment.  Q-grams that very many items hold are
left out of the index, and the bound of each item falls by as many, so that it stays a bound.

Items go to the executors in blocks of bounded size, each against all documents.  Items of fewer than ``Q`` characters
have no q-gram: they match where they stand unchanged, as whole words, and the first place counts.  Of equally good
places of a longer item the one that ends first counts.  Null texts count as empty and hold nothing, and as items are
none; a null item id stays null; repeated items or rows repeat their matches; empty tables give no rows; other columns
are ignored; texts are read whole, and hits counted in pieces of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, map_slices, narrow_batches, slices, table

Q = 10
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Characters of benchmark text in one block, on average: some 40 MB of index in each Python worker.
BLOCK_CHARS = 1_000_000
#: A q-gram that more items of a block hold is left out where the items' bounds allow it.
COMMON = 12
_FILTER_BITS = 22
#: Shared q-grams that are spread over diagonals at once.
HITS = 1_000_000


@cache
def _folded() -> np.ndarray:
    """Each code point's lower-case form if it is a letter or digit, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each framed by single spaces, their starts, and their places in the text."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    breaks = np.flatnonzero(points == 0)
    chars = _folded()[points]
    keep = (chars != 32) | np.concatenate([[True], chars[:-1] != 32])
    keep[breaks] = True  # a break frames two texts; the space before it is dropped below
    before = np.zeros(len(chars), bool)
    before[:-1] = (chars[:-1] == 32) & (points[1:] == 0) & (points[:-1] != 0)
    after = np.zeros(len(chars), bool)
    after[1:] = (chars[1:] == 32) & (points[:-1] == 0) & (points[1:] != 0)
    keep &= ~(before | after)
    place = np.flatnonzero(keep)
    starts = np.searchsorted(place, breaks)
    return chars[place], starts, place


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    # runs of 1, 2, 4, ... characters, put together to q
    run, length, out, done = chars.astype(np.uint64), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & length:
                out = run[:n] if out is None else out * power(length) + run[done : done + n]
                done += length
            if done == q:
                return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            run = run[:-length] * power(length) + run[length:]
            length *= 2


@dataclass(frozen=True)
class Index:
    """A block of items: their characters, edit budgets and bounds, and their q-grams in order of hash."""

    ids: list
    chars: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bits: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build(rows: list[tuple], q: int = Q, rate: float = EDIT_RATE) -> Index:
    """Index of (item_id, text) rows."""
    flat, starts, _ = normalise([t for _, t in rows])
    chars = [flat[a + 1 : b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    # items below q characters, by length: hashes of the item with the spaces around it, and who has them
    usable, short = [i for i, c in enumerate(chars) if len(c) >= q], {}
    for m in sorted({len(c) for c in chars if 0 < len(c) < q}):
        own = [i for i, c in enumerate(chars) if len(c) == m]
        names = np.concatenate([grams(np.concatenate([[32], chars[i], [32]]).astype(np.uint32), m + 2) for i in own])
        order = np.argsort(names, kind="stable")
        short[m] = names[order], len(usable) + sum(len(v[1]) for v in short.values()) + np.arange(len(own))[order]
    tail = [i for m in sorted(short) for i, c in enumerate(chars) if len(c) == m]
    ids, chars = [rows[i][0] for i in usable + tail], [chars[i] for i in usable]
    size = np.array([len(c) for c in chars], np.int64)
    # the largest budget that leaves a bound of one shared q-gram at least
    edits = np.minimum((size * rate).astype(np.int64), np.maximum(0, (size - q) // q))
    bound = size - q + 1 - q * edits
    hashes = np.concatenate([grams(c, q) for c in chars] or [np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(chars)), size - q + 1)
    at = np.concatenate([np.arange(len(c) - q + 1) for c in chars] or [np.zeros(0, np.int64)])
    _, group = np.unique(hashes, return_inverse=True)
    held = np.bincount(group, minlength=1)[group] if len(hashes) else np.zeros(0, np.int64)
    lost = np.bincount(item, held > COMMON, minlength=len(chars)).astype(np.int64)
    # an item gives up its common q-grams only if its bound stays a third of what it was
    gives = bound - lost >= np.maximum(1, bound // 3)
    keep = ~((held > COMMON) & gives[item]) if len(item) else np.zeros(0, bool)
    bound = np.where(gives, bound - lost, bound)
    hashes, item, at = hashes[keep], item[keep], at[keep]
    order = np.argsort(hashes, kind="stable")
    hashes, item, at = hashes[order], item[order], at[order]
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(ids, chars, edits, bound, hashes, item, at, bits, short)


def align(items: list[np.ndarray], texts: list[np.ndarray], lows: list[int], widths: list[int], anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each item and text: fewest edits between the item and a part of the text, and where that part ends.

    Alignments keep to ``width`` diagonals from ``low`` on; the part starts anywhere on them, or at 0 if
    ``anchored``.  All pairs advance together, an item character at a time, holding one row of each band.
    """
    n, tall, wide = len(items), max(map(len, items)), max(widths)
    size, lows, ramp = np.array([len(x) for x in items]), np.array(lows)[:, None], np.arange(wide)
    ends = np.array([len(t) for t in texts])[:, None]
    pattern, window = np.zeros((n, tall), np.uint32), np.full((n, tall + wide), 0xFFFFFFFF, np.uint32)
    for k, (x, t) in enumerate(zip(items, texts, strict=True)):
        pattern[k, : len(x)] = x
        low = int(lows[k, 0])
        part = t[max(0, low) : max(0, low + tall + wide)]
        window[k, max(0, -low) : max(0, -low) + len(part)] = part
    diagonals, far = lows + ramp, 1 << 30
    shut = ramp >= np.array(widths)[:, None]
    row = np.where(shut | (diagonals < 0) | (diagonals > ends), far, np.abs(diagonals) if anchored else 0)
    for i in range(tall):
        cost = row + (window[:, i : i + wide] != pattern[:, i : i + 1])
        np.minimum(cost[:, :-1], row[:, 1:] + 1, out=cost[:, :-1])
        cost = np.minimum.accumulate(cost - ramp, axis=1) + ramp
        end = diagonals + (i + 1)
        cost[shut | (end < 0) | (end > ends)] = far
        row = np.where((i < size)[:, None], cost, row)
    best = row.argmin(axis=1)
    return row[np.arange(n), best], lows[:, 0] + best + size


def find(texts: list[str | None], index: Index, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): the best place of each item in each text that holds it within its budget."""
    chars, starts, place = normalise(texts)
    hashes = grams(chars, q)
    hit = np.flatnonzero(index.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]) if len(index.hashes) else np.zeros(0, np.int64)
    first = np.searchsorted(index.hashes, hashes[hit])
    ok = first < len(index.hashes)
    ok[ok] = index.hashes[first[ok]] == hashes[hit[ok]]
    hit, first = hit[ok], first[ok]
    short = find_short(chars, starts, place, index)
    if not len(hit):
        return short
    count = np.searchsorted(index.hashes, hashes[hit], side="right") - first
    low = -max(len(chars), *map(len, index.chars)) - 2  # below any bucket
    span, keys, counts = 4 - 2 * low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, a = np.cumsum(count), 0
    while a < len(hit):  # at least one place, and all that stays within HITS
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
        where = np.repeat(hit[a:b], count[a:b])
        entry = np.repeat(first[a:b] - (total[a:b] - count[a:b]) + (total[a - 1] if a else 0), count[a:b]) + np.arange(len(where))
        item, doc = index.item[entry], np.searchsorted(starts, where, side="right") - 1
        bucket = (where - starts[doc] - index.at[entry]) // (index.edits[item] + 1)
        some, n = np.unique((doc * len(index.ids) + item) * span + (bucket - low), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        a = b
    # a band is two neighbouring buckets; it begins at a bucket that has a hit, or one before
    begins = np.union1d(keys, keys - 1)
    held = np.append(counts, 0)
    of = lambda k: held[np.where(keys[at := np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k, at, len(keys))]
    both, keys = of(begins) + of(begins + 1), begins
    pair = keys // span
    enough = both >= index.bound[pair % len(index.ids)]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    chosen = keys[enough]
    for k in range(0, len(chosen), 256):  # pairs that advance together
        some = chosen[k : k + 256]
        d, i = np.divmod(some // span, len(index.ids))
        w = index.edits[i] + 1
        lows = (some % span + low) * w
        edits, end = align([index.chars[x] for x in i], [chars[starts[x] : starts[x + 1] + 1] for x in d], lows, 2 * w)
        for x, y, e, at in zip(d.tolist(), i.tolist(), edits.tolist(), end.tolist(), strict=True):
            if e <= index.edits[y] and ((x, y) not in best or (e, at) < best[x, y]):
                best[x, y] = e, at
    found = sorted(best)
    length = {k: len(index.chars[k[1]]) for k in found}
    if edited := [k for k in found if best[k][0]]:  # an item without edits is as long as its place
        back = [int(index.edits[i]) for _, i in edited]
        _, own = align([index.chars[i][::-1] for _, i in edited], [chars[starts[d] : starts[d] + best[d, i][1]][::-1] for d, i in edited], [-w for w in back], [2 * w + 1 for w in back], anchored=True)
        length |= dict(zip(edited, own.tolist(), strict=True))
    out = []
    for d, i in found:
        edits, end = best[d, i]
        base, begin = int(place[starts[d]]) + 1, end - length[d, i]
        out.append((d, i, int(place[starts[d] + begin]) - base, int(place[starts[d] + end - 1]) + 1 - base, edits))
    return sorted(out + short)


def find_short(chars: np.ndarray, starts: np.ndarray, place: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """As ``find``, for items without a q-gram."""
    out = []
    for m, (names, items) in index.short.items():
        hashes = grams(np.where(chars == 0, 32, chars), m + 2)
        low, high = np.searchsorted(names, hashes), np.searchsorted(names, hashes, side="right")
        seen = set()
        for p in np.flatnonzero(high > low).tolist():
            d = int(np.searchsorted(starts, p, side="right")) - 1
            base = int(place[starts[d]]) + 1
            for i in items[low[p] : high[p]].tolist():
                if (d, i) not in seen:
                    seen.add((d, i))
                    out.append((d, i, int(place[p + 1]) - base, int(place[p + m]) + 1 - base, 0))
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> list[Index]:
    """Indexes of the benchmark (item_id, text), each of about ``most`` characters at most; made one at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // most))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield build(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text), edits: each item that a document of docs (doc_id, text) holds."""
    kind, out = dict(benchmark.dtypes)["item_id"], None
    for index in blocks(benchmark):

        def run(part: pa.RecordBatch, index: Index = index) -> pa.RecordBatch:
            got = find(part.column("text").to_pylist(), index)
            ids = part.column("doc_id").to_pylist()
            return pa.record_batch({"doc_id": pa.array([ids[g[0]] for g in got], pa.int64()), "item_id": pa.array([index.ids[g[1]] for g in got], item_type), **{c: pa.array([g[i] for g in got], pa.int64()) for i, c in ((2, "start"), (3, "end"), (4, "edits"))}})

        item_type = pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        one = map_slices(docs, run, f"doc_id long, item_id {kind}, start long, end long, edits long")
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark; one pass for each block, no shuffle."""
    for index in blocks(benchmark):

        def run(batches, index: Index = index):
            for batch in batches:
                for part in slices(batch, "text"):
                    held = {g[0] for g in find(part.column("text").cast(pa.string()).to_pylist(), index)}
                    yield part.filter(pa.array([i not in held for i in range(part.num_rows)])) if held else part

        docs = narrow_batches(docs).mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(docs_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
