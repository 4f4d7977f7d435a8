"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes homoglyphs of other scripts, full-width forms, invisible characters and digits or signs that
stand for letters.  Lexicon entries are whole words or word stems; a word counts once, with its heaviest
entry, unless an exception phrase covers it.  The weighted sum is normalised by text length and calibrated.

Null and empty texts score like a text without any entry; null ids stay null; texts of any length are read whole, in
time that grows with their length; repeated rows get equal scores; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_labels, docs_of, fit_logistic, fold_of, map_slices, table

# Characters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
# Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# The lexicon's words and their weights before training, which adds to them and re-weighs those it sees.
SEED = {
    f" {word} ": weight
    for weight, words in (
        (4.0, "moron morons scum idiot idiots idiotic loser losers trash clown clowns stupid pathetic worthless disgusting imbecile imbeciles scumbag scumbags dumbass jackass asshole assholes bastard bastards bitch bitches fuck fucking fucker shit shitty bullshit dickhead prick wanker twat whore slut retard retarded"),
        (3.0, "cretin dimwit nitwit halfwit dunce simpleton blockhead numbskull lowlife vermin parasite degenerate freak weirdo creep coward cowards liar liars hypocrite fraudster crook despicable repulsive revolting vile filthy hideous braindead brainless clueless spineless gutless useless"),
        (2.0, "dumb fool fools foolish jerk jerks ugly fat lazy crap crappy damn hell hate kill die shut garbage rubbish laughable joke pig pigs rat rats snake"),
    )
    for word in words.split()
}
# Phrases in which an entry is harmless.
EXCEPTIONS = tuple(
    f" {phrase} "
    for phrase in (
        "trash can", "trash cans", "trash bin", "trash bag", "clown fish", "sore loser rule", "class clown act", "circus clown", "birthday clown", "idiot proof", "idiot board", "fool proof", "april fools", "fools gold",
        "pond scum", "dumb waiter", "dumb terminal", "dumb bell", "pig iron", "pig farm", "guinea pig", "guinea pigs", "rat race", "lab rat", "lab rats", "mole rat", "snake river", "snake bite", "garbage collection", "garbage collector",
        "garbage bag", "garbage truck", "rubbish bin", "inside joke", "hell or high water", "kill switch", "kill process", "die cast", "tool and die", "shut down", "shut off", "low fat", "full fat", "fat free", "saturated fat", "body fat", "flesh and fat",
    )
)

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_SUB = {ord(k): v for k, v in SUBSTITUTES.items()}
# a whole run of letters, digits and signs that holds a digit or sign, and in it the first letter beside a substitute
_MIXED = re.compile(r"(?<![^\W_])(?<![@$!])[^\W_0-9]*+[0-9@$!](?:[^\W_]|[@$!])*+")
_BESIDE = re.compile(r"[0-9@$](?=[^\W\d_])|[^\W\d_](?=[0-9@$!]++[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
STEM_LENGTHS = range(4, 9)


def _undo(mixed: re.Match) -> str:
    """The run with its substitutes undone, but for signs around the word: signs at its end, and what an exclamation mark parts from its start."""
    token = mixed[0]
    beside = _BESIDE.search(token)
    if not beside:
        return token
    a, b = beside.start(), len(token.rstrip("@$!"))
    while a and token[a - 1] in "0123456789@$":
        a -= 1
    while a and token[a - 1].isalnum():
        a -= 1
    return token[:a] + token[a:b].translate(_SUB) + token[b:]


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD).lower()
    text = _MIXED.sub(_undo, text)
    return f" {' '.join(_WORD.findall(text))} "


@dataclass(frozen=True)
class ToxicityModel:
    entries: dict[str, float]
    weights: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(model: ToxicityModel):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for entry, weight in model.entries.items():
        auto.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        auto.add_word(phrase, (len(phrase), -1.0))
    auto.make_automaton()
    return auto


def matches(folded: str, auto) -> list[tuple[int, float]]:
    """(start, weight) of each hit word: the heaviest entry at a place, none inside an exception phrase."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []  # hits come in order of their end, so these do as well
    for end, (n, weight) in auto.iter(folded):
        start = end - n + 1
        if weight < 0:
            while spared and spared[-1][0] >= start:
                spared.pop()
            spared.append((start, end))
        elif weight > best.get(start, 0):
            best[start] = weight
    if not spared:
        return list(best.items())
    ends = [e for _, e in spared]
    # the first phrase that ends after a place is the one that could begin before it
    return [(s, w) for s, w in best.items() if (k := bisect_right(ends, s)) == len(ends) or spared[k][0] > s]


def features(folded: str, auto) -> tuple[float, float, float, float, int, int]:
    found = matches(folded, auto)
    total, words = sum(w for _, w in found), folded.count(" ") - 1
    return math.log1p(total), total / math.sqrt(words + 10), 10 * total / (words + 10), 1.0, len(found), words


def train(docs: DataFrame, labelled: DataFrame, min_docs: int = 5, min_weight: float = 2.0) -> ToxicityModel:
    """Learn entries and calibration from (doc_id, y) rows, a bounded set that is broadcast to the documents."""
    rows = docs.join(F.broadcast(labelled), "doc_id")

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[int]] = {}
        for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
            words = set(fold(text or "").split())
            for c in {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_LENGTHS if len(w) >= n}:
                seen.setdefault(c, [0, 0])[y] += 1
        return pa.record_batch({"entry": list(seen), "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]}, schema=pa.schema([("entry", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    sizes = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return ToxicityModel(dict(SEED), (1.0, 0.0, 1.0, -3.0))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0)))
    kept = map_slices(rows.select("text", "y"), count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known = F.col("entry").isin(*SEED) & (F.col("clean") + F.col("toxic") >= min_docs)
    kept = kept.where(known | (F.col("toxic") >= min_docs)).select("entry", weight.alias("w"), known.alias("known")).where(F.col("known") | (F.col("w") >= min_weight))
    entries = {k: w for k, w in (SEED | {r["entry"]: float(r["w"]) for r in kept.orderBy("entry").collect()}).items() if w > 0}
    model = ToxicityModel(entries, ())

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        auto = automaton(model)
        x = [features(fold(t or ""), auto)[:4] for t in part.column("text").to_pylist()]
        return pa.record_batch({"x": x, "y": part.column("y")}, schema=pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    got = map_slices(rows.select("text", "y"), measure, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    order = np.lexsort([*x.T, y])
    w = fit_logistic(x[order], y[order], ridge=0.05)
    return ToxicityModel(entries, tuple(float(v) for v in w))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_hits, n_words for each row of docs (doc_id, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        auto = automaton(model)
        x = np.array([features(fold(t or ""), auto) for t in part.column("text").to_pylist()], float).reshape(-1, 6)
        z = x[:, :4] @ np.array(model.weights)
        return pa.record_batch({"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "n_hits": x[:, 4].astype(np.int64), "n_words": x[:, 5].astype(np.int64)})

    return map_slices(docs, run, "doc_id long, score double, n_hits long, n_words long")


def op4_toxicity(spark: SparkSession, sf_dir: str, max_train: int = 8_000) -> DataFrame:
    """Every document's toxicity; ``max_train`` bounds the labelled rows that the lexicon is learned from."""
    docs = docs_of(table(spark, sf_dir, "documents"))
    labelled = bounded_labels(table(spark, sf_dir, "labels"), "toxic", "doc_id", fold_of(F.col("doc_id"), 3) != 1, max_train)
    model = train(docs, labelled)
    return score(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")
