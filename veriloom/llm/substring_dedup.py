"""Substring dedup by recompression.

A text's words are the symbols of level 0.  Each round first names runs of one symbol, then pairs of
neighbours of which the first falls to the left and the second to the right half of the alphabet.  Names and
halves are fingerprints of what is named, so all tasks give equal strings equal names without a shared table.
Each symbol keeps the stretch of words that its making depends on: wherever a window holds that stretch, it
holds the symbol.  A window's anchor is the highest symbol that it holds so, extended by the stretch; equal
windows have equal anchors.  Only windows whose anchor stands in texts that differ are verified, by 128-bit
fingerprints of their words.

A window is ``WINDOW`` consecutive words of one document.  Each word covered by a window that also starts in a
document of smaller id is removed; windows are judged on the input.  Texts with the same words are verified
once: all but the smallest id lose every word if they have a window at all.

Null texts have no words; a null id counts as the largest; windows in one row aren't removed for another row of the
same id (or, without ids, of none); rows that share id and text get the same answer each; texts are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, docs_of, join_groups, map_slices, mix, split_words, stash, table, texts, word_hashes
from .near_dedup import class_keys

WINDOW, ROUNDS = 13, 2
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_NO_ID = 2**63 - 1


def fingerprints(words: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits for every window, and the place of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc_end = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(n) + size <= doc_end[:n])
    halves = []
    for salt in (3, 5):
        with np.errstate(over="ignore"):
            run = mix(words ^ np.uint64(salt * 0x51ED2701))
            out, done, length = None, 0, 1
            while done < size:
                if size & length:
                    part = run[at + done]
                    out = part if out is None else mix(out * _STEP + part)
                    done += length
                run = mix(run[:-length] * _STEP + run[length:]) if len(run) > length else run[:0]
                length *= 2
            halves.append(out)
    return halves[0], halves[1], at


def parse(words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: its symbols' names, and the stretch of words, from and to, that each depends on.

    Texts are kept apart by boundaries that never join a run or a pair.
    """
    n = len(words)
    first = np.zeros(n, bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    name, low, high = words, np.arange(n), np.arange(n) + 1
    levels = [(name, low, high)]
    for level in range(1, ROUNDS + 1):
        if not len(name):
            break
        # runs: a symbol depends on both neighbours, which tell where its run ends; the text's own ends
        # lie beyond every window, so what leans on them is no one's anchor
        left = np.concatenate([[0], np.arange(len(name) - 1)])
        right = np.concatenate([np.arange(1, len(name)), [len(name) - 1]])
        last = np.concatenate([first[1:], [True]])
        low_run, high_run = np.where(first, low - 1, low[left]), np.where(last, high + 1, high[right])
        begins = np.concatenate([[True], (name[1:] != name[:-1]) | first[1:]])
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, len(name)))
        with np.errstate(over="ignore"):
            name = np.where(length > 1, mix(name[at] * _STEP + length.astype(np.uint64) + np.uint64(level << 40)), name[at])
        first, low, high = first[at], low_run[at], high_run[at + length - 1]
        # pairs: left half then right half; a symbol that stays alone depends on the neighbour it might have joined
        half = (mix(name ^ mix(level * 7919)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = ~half[:-1] & half[1:] & ~first[1:]
        joined = np.concatenate([[False], joins[:-1]])
        pair = np.flatnonzero(joins)
        last = np.concatenate([first[1:], [True]])
        left = np.concatenate([[0], np.arange(len(name) - 1)])
        right = np.concatenate([np.arange(1, len(name)), [len(name) - 1]])
        alone_low = np.where(half & ~first, np.minimum(low, low[left]), low)
        alone_high = np.where(~half & ~last, np.maximum(high, high[right]), high)
        new_name, new_low, new_high = name.copy(), alone_low, alone_high
        with np.errstate(over="ignore"):
            new_name[pair] = mix(mix(name[pair] * _STEP + np.uint64(level)) * _STEP + name[pair + 1])
        new_low[pair], new_high[pair] = np.minimum(low[pair], low[pair + 1]), np.maximum(high[pair], high[pair + 1])
        stay = ~joined
        name, low, high, first = new_name[stay], new_low[stay], new_high[stay], first[stay]
        levels.append((name, low, high))
    return levels


def anchors(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The anchor of the window at each word; 0 where no window starts."""
    n = len(words)
    best = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        # sums of words by place, so that a stretch's fingerprint is a difference of two sums
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * _powers(n), dtype=np.uint64)])
        inverse = _inverse_powers(n)
        levels = parse(words, starts)
        for level in range(len(levels) - 1, -1, -1):
            name, low, high = levels[level]
            own = np.flatnonzero((high - low <= WINDOW) & (low >= 0) & (high <= n))
            name, low, high = name[own], low[own], high[own]
            stretch = (sums[high] - sums[low]) * inverse[low]
            if not len(own):  # one word over and over: a run is wider than any window
                continue
            value = (mix(name * _STEP + stretch) >> np.uint64(2)) | np.uint64(level << 62)
            if level == len(levels) - 1:
                reach = np.minimum(WINDOW - (high - low), low)
                for back in range(WINDOW):
                    some = np.flatnonzero(reach >= back)
                    np.maximum.at(best, low[some] - back, value[some])
                continue
            bare = np.flatnonzero(best == 0)  # few windows hold no higher symbol
            next_one = np.searchsorted(low, bare)
            for k in range(WINDOW):
                at = np.minimum(next_one + k, len(low) - 1)
                held = (next_one + k < len(low)) & (low[at] >= bare) & (high[at] <= bare + WINDOW)
                best[bare[held]] = np.maximum(best[bare[held]], value[at[held]])
    size = np.diff(starts)
    whole = np.arange(n) + WINDOW <= np.repeat(starts[1:], size)
    best[~whole] = 0
    return best


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)[:n]


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)[: n + 1]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def surveyed(docs: DataFrame) -> DataFrame:
    """doc_id, t, c1, c2 (the word sequence), n_words, whole (digest of all words) and the distinct anchors of each row (doc_id, t, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = word_hashes(part.column("text"))
        c1, c2 = class_keys(words, starts)
        anchor = anchors(words, starts)
        # neighbouring windows mostly share their anchor
        change = anchor != np.concatenate([[0], anchor[:-1]])
        change[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(change & (anchor != 0))
        bounds = np.searchsorted(at, starts)
        digests = [_digest(t.split()) for t in texts(part.column("text"))]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(anchor[at].view(np.int64)))
        return pa.record_batch({"doc_id": part.column("doc_id"), "t": part.column("t"), "c1": c1, "c2": c2, "n_words": np.diff(starts), "whole": pa.array(digests, pa.binary()), "anchors": lists})

    return map_slices(docs, run, "doc_id long, t long, c1 long, c2 long, n_words long, whole binary, anchors array<long>")


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and places of the windows whose anchor is listed in ``shared``, and where each text's words start."""
    words, starts = word_hashes(part.column("text"))
    shared = part.column("shared")
    listed = np.unique(shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    anchor = anchors(words, starts)
    first, second, at = fingerprints(words, starts)
    if len(at):
        # an anchor that is listed for another text of the slice does no harm: its windows are verified as well
        known = np.searchsorted(listed, anchor[at])
        known[known == len(listed)] = 0
        keep = listed[known] == anchor[at]
        first, second, at = first[keep], second[keep], at[keep]
    return first, second, at, starts


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text)."""
    # a row is known by its id and a hash of its text, since ids may repeat or be null
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = stash(surveyed(docs), "survey")
    small = rows.select("doc_id", "t", "c1", "c2", "n_words", "whole")
    firsts = stash(rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "word-sequences")
    roles = stash(join_groups(small, firsts, ["c1", "c2"], "copies", rows.count()).select("doc_id", "t", "n_words", "whole", "rep"), "roles")
    # anchors that stand in texts with different words
    text = F.shiftrightunsigned("c1", 16)
    spread = rows.select(F.explode("anchors").alias("anchor"), text.alias("text")).groupBy("anchor").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo != hi").select("anchor")
    spread = stash(spread, "spread-anchors")
    listed = stash(rows.select("doc_id", "t", F.explode("anchors").alias("anchor")).join(spread, "anchor").groupBy("doc_id", "t").agg(F.collect_set("anchor").alias("shared")), "listed-anchors")
    discard(rows, firsts, spread)
    # a text that repeats a smaller document whole needs no look at its windows
    wanted = listed.join(roles.where("rep = doc_id").select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi")
    open_docs = stash(docs.join(wanted, ["doc_id", "t"]), "open-texts")
    discard(listed)

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        first, second, at, starts = _windows(part)
        doc = np.searchsorted(starts, at, side="right") - 1
        ids, t = part.column("doc_id").to_numpy(), part.column("t").to_numpy()
        return pa.record_batch({"w1": first.view(np.int64), "w2": (second >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[doc], "t": t[doc], "at": (at - starts[doc]).astype(np.int32)})

    windows = map_slices(open_docs, emit, "w1 long, w2 int, doc_id long, t long, at int")
    earliest = stash(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "repeated-windows")
    repeats = stash(windows.join(earliest, ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id", "t").agg(F.collect_set("at").alias("at")), "repeats")
    discard(earliest)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = split_words(part.column("text"))
        spelled = flat.cast(pa.binary()).to_pylist()
        removed, digests = [], []
        for r, places in enumerate(part.column("at")):
            a, b = int(starts[r]), int(starts[r + 1])
            hits = places.values.to_numpy()
            marks = np.bincount(hits, minlength=b - a + 1)[: b - a + 1] - np.bincount(np.minimum(hits + WINDOW, b - a), minlength=b - a + 1)[: b - a + 1]
            gone = np.cumsum(marks)[: b - a] > 0
            removed.append(int(gone.sum()))
            digests.append(_digest([spelled[a + i] for i in np.flatnonzero(~gone)]))
        return pa.record_batch({"doc_id": part.column("doc_id"), "t": part.column("t"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(digests, pa.binary())})

    changed = stash(map_slices(open_docs.select("doc_id", "t", "text").join(repeats, ["doc_id", "t"]), cut, "doc_id long, t long, n_removed long, kept binary"), "cut-texts")
    discard(open_docs, repeats)
    copied = (F.col("rep") < F.col("doc_id")) & (F.col("n_words") >= WINDOW)
    rest = roles.join(changed.dropDuplicates(["doc_id", "t"]), ["doc_id", "t"], "left")
    empty = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return rest.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(copied, empty).otherwise(F.coalesce("kept", "whole")))).alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(docs_of(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM d WHERE len(words) >= 13),
h AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS win FROM w),
f AS (SELECT win, min(doc_id) AS lo FROM h GROUP BY win),
g AS (SELECT DISTINCT h.doc_id, p + k AS i FROM h JOIN f USING (win), range(0, 13) AS t(k) WHERE lo < h.doc_id),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
c AS (SELECT e.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
