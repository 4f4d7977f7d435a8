"""Language ID by hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1: bits of a hash of its code point.  A letter trigram is
the product of its letters' vectors, each rotated by its place; a document is the sum of its trigrams' vectors; a
language's prototype is the mean of the unit vectors of its training documents.  A document takes the prototype of the
largest cosine.  What lies between two words, or at an end of the text,
counts as one more letter.

Null texts and texts without letters get ``und`` and score 0, as does every text if no language was learned; null ids
stay null; texts are read whole, and trigrams bundled in blocks, so that memory grows with a text's length only by its
characters; an empty table gives no rows; repeated rows repeat their result; ties go to the first language in order;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, fold_of, map_slices, mix, table

DIMENSIONS = 2048
#: Distinct trigrams, and documents, that are bundled at once.
BLOCK = 1024
_BITS = 21
_SEED = 20_240_229


@cache
def _alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The vectors of code points, as +1 and -1; code point 0 stands for what parts two words."""
    parts = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    words = mix(mix(letters.astype(np.uint64) ^ mix(_SEED))[:, None] + parts)
    return 1 - 2 * np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, given by the code points of their letters, ``_BITS`` bits each."""
    low = (1 << _BITS) - 1
    letters, place = np.unique(np.concatenate([codes >> 2 * _BITS, codes >> _BITS & low, codes & low]), return_inverse=True)
    v, (a, b, c) = letter_vectors(letters), place.reshape(3, -1)
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of each text, and whether it has letters at all."""
    n = len(texts)
    joined = "".join(f"\0{(t or '').replace(chr(0), ' ')} " for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    doc = np.cumsum(points == 0, dtype=np.int32) - 1
    letters = np.where(_alphabet()[points], points, 0).astype(np.int64)
    keep = (letters > 0) | (points == 0)
    keep[1:] |= letters[:-1] > 0
    letters, doc = letters[keep], doc[keep]
    some = np.bincount(doc[letters > 0], minlength=n)[:n] > 0
    code = letters[:-2] << 2 * _BITS | letters[1:-1] << _BITS | letters[2:]
    whole = (doc[:-2] == doc[2:]) & (code > 0)
    code, doc = code[whole], doc[:-2][whole]
    names, at = np.unique(code, return_inverse=True)
    # trigram by trigram, so that each block of trigrams is one run
    pairs, counts = np.unique(at * np.int64(n) + doc, return_counts=True)
    column, row = np.divmod(pairs, n)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for k in range(0, len(names), BLOCK):
        vectors = trigram_vectors(names[k : k + BLOCK]).astype(np.float32)
        a, b = np.searchsorted(column, [k, k + BLOCK])
        for i in range(0, n, BLOCK):
            own = np.flatnonzero((row[a:b] >= i) & (row[a:b] < i + BLOCK)) + a if n > BLOCK else np.arange(a, b)
            dense = np.zeros((min(BLOCK, n - i), len(vectors)), np.float32)
            dense[row[own] - i, column[own] - k] = counts[own]
            out[i : i + BLOCK] += dense @ vectors
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), some


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    prototypes: np.ndarray


def train(docs: DataFrame, most: int = 20_000) -> LanguageModel:
    """Prototypes from docs (doc_id, text, lang); at most about ``most`` rows, picked by a hash of the id, are read."""
    rows = docs.where(F.col("lang").isNotNull())
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * most / n))

    def bundle(part: pa.RecordBatch) -> pa.RecordBatch:
        unit, some = profiles(part.column("text").to_pylist())
        langs = np.array(part.column("lang").to_pylist(), object)
        names = sorted(set(langs[some]))
        # sums of whole numbers don't depend on the order of the parts
        sums = [np.rint(unit[some & (langs == x)] * 2.0**20).astype(np.int64).sum(axis=0) for x in names]
        return pa.record_batch({"lang": names, "v": [s.tolist() for s in sums]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    parts = map_slices(rows.select("text", "lang"), bundle, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    names = sorted({r["lang"] for r in summed})
    proto = np.zeros((len(names), DIMENSIONS))
    for r in summed:
        proto[names.index(r["lang"]), r["place"]] = r["value"]
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
    return LanguageModel(tuple(names), proto.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and margin for every row of docs (doc_id, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        unit, some = profiles(part.column("text").to_pylist())
        if not model.names:
            some[:] = False
        cos = unit @ model.prototypes.T if model.names else np.zeros((n, 1))
        best = cos.argmax(axis=1)
        second = np.partition(cos, -2, axis=1)[:, -2] if cos.shape[1] > 1 else np.zeros(n)
        top = cos[np.arange(n), best]
        names = np.array([*model.names, "und"], object)
        return pa.record_batch({"doc_id": part.column("doc_id"), "lang_pred": pa.array(names[np.where(some, best, len(names) - 1)], pa.string()), "score": np.where(some, np.clip(top, 0, 1), 0).astype(float), "margin": np.where(some, top - second, 0).astype(float)})

    return map_slices(docs, run, "doc_id long, lang_pred string, score double, margin double", most=1_500_000)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents")
    model = train(source.where(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return predict(docs_of(source), model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin")
