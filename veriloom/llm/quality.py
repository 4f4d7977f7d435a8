"""Quality by Bradley-Terry ranking: scores learned from preference pairs.

Every pair joins a good and a bad labelled document; logistic loss on the difference of their features gives
the weights, so a document's strength is a weighted sum of its features.  All pairs of all labelled documents
of the training folds count: each Newton step is one pass over their features that adds these up by strength, each
document shared between the two nearest multiples of ``STEP``, and the loss is that of pairs of multiples, so
the weights are those of all pairs up to that interpolation.  The cut is a quantile of the labelled strengths, the share of bad documents among them, found to the last bit by passes over
the digits of the strengths.  Strengths are then mapped to scores so that the cut falls on ``THRESHOLD``.

Null and empty texts count as texts without words and get a score; texts are read whole; an empty table
gives no rows; repeated rows get equal scores; without labels of both kinds every text scores THRESHOLD; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, docs_of, fit_logistic, fold_of, labels_of, map_slices, narrow_batches, slices, stash, table, texts

THRESHOLD = 0.3
#: Strengths are counted at ``BINS`` multiples of ``STEP`` around 0, the outermost with all beyond; products of features, which only steer Newton's method, in steps ``COARSE`` times as wide.
STEP, BINS, COARSE = 1 / 32, 2048, 16
_LETTERS = bytes(c for c in range(256) if not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80))
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def features(text: bytes) -> list[float]:
    """Shape of a text: length, case, symbols, repetition and layout."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, len(text.translate(None, _LETTERS)))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    bangs, bars, digits = text.count(b"!"), text.count(b"|"), len(text) - len(text.translate(None, b"0123456789"))
    stops, runs = text.count(b". ") + text.count(b".\n"), sum(a == b for a, b in zip(words, words[1:], strict=False))
    most = max(counts.values(), default=0)
    m = max(1, n)
    return [
        math.log1p(n) / 5, math.log1p(size / m), upper / letters, math.sqrt(upper / letters), min(1, 20 * symbols / size), math.sqrt(symbols / size), min(1, 20 * bangs / size), min(1, 20 * bars / size), min(1, 20 * digits / size),
        len(counts) / m, len(counts) / math.sqrt(m) / 10, most / m, runs / m, math.sqrt(runs / m), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))) / 5, min(1, stops / m), float(n < 5), float(symbols > 0), float(bangs > 0), float(runs > 2), float(bars > 2),
    ]


N_FEATURES = len(features(b""))


def strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The strength of each row of features; it depends on no other row, to the last bit."""
    return ((x - mean) / scale * weights).sum(axis=1)


@dataclass(frozen=True)
class QualityModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    slope: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = strengths(x, np.array(self.mean), np.array(self.scale), np.array(self.weights))
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """x: the features of each row of docs; the columns in ``more`` stay."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([features(t) for t in texts(part.column("text"))], pa.list_(pa.float64()))
        return pa.record_batch([part.column(c) for c in more] + [x], names=[*more, "x"])

    kinds = dict(docs.dtypes)
    return map_slices(docs, run, ", ".join(f"{c} {kinds[c]}" for c in more) + ", x array<double>")


def summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``fn(x, y)`` over the batches of rows (x, y), in one pass; ``fn`` gives flat arrays of one length.

    Each task sends the entries that aren't 0.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
                part = fn(x, batch.column("y").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch({"size": pa.array([len(total)]), "at": pa.array([at.astype("<i4").tobytes()]), "total": pa.array([total[at].astype("<f8").tobytes()])})

    total = np.zeros(0)
    for part in rows.mapInArrow(run, "size long, at binary, total binary").collect():
        total = total if len(total) else np.zeros(part["size"])
        total[np.frombuffer(part["at"], "<i4")] += np.frombuffer(part["total"], "<f8")
    return total


def nodes(used: np.ndarray) -> np.ndarray:
    """The strengths that the places ``used`` of ``pair_sums`` stand for."""
    return (used - BINS // 2) * STEP


def pair_sums(z: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of rows and sums of features by kind and multiple of ``STEP``, then sums of products of features by wider steps."""
    place = np.clip(s / STEP + BINS // 2, 0, BINS - 1 - 1e-9)
    own = place.astype(np.int64)
    above = place - own
    own += BINS * y
    fine = [np.bincount(own, c * (1 - above), 2 * BINS) + np.bincount(own + 1, c * above, 2 * BINS) for c in (np.ones(len(s)), *z.T)]
    wide = own // COARSE
    order = np.argsort(wide, kind="stable")
    products = np.zeros((2 * BINS // COARSE, N_FEATURES, N_FEATURES))
    for rows in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1):
        products[wide[rows[0]]] += z[rows].T @ z[rows]
    return np.concatenate([*fine, products.ravel()])


def pair_loss(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs, its gradient and its second derivatives, from ``pair_sums``."""
    fine, products = sums[: (1 + N_FEATURES) * 2 * BINS].reshape(1 + N_FEATURES, 2, BINS), sums[(1 + N_FEATURES) * 2 * BINS :].reshape(2, -1, N_FEATURES, N_FEATURES)
    bad, good = (np.flatnonzero(fine[0, kind]) for kind in (0, 1))
    n_bad, n_good, x_bad, x_good = fine[0, 0, bad], fine[0, 1, good], fine[1:, 0, bad], fine[1:, 1, good]
    s_bad, s_good = nodes(bad), nodes(good)
    loss, grad, hess = 0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
    curved = np.zeros((2, BINS))
    for i in range(0, len(good), 256):
        few = slice(i, i + 256)
        ahead = s_good[few, None] - s_bad
        # P(bad beats good)
        q = 1 / (1 + np.exp(np.clip(ahead, -30, 30)))
        loss += float(n_good[few] @ np.logaddexp(0, -ahead) @ n_bad)
        grad -= x_good[:, few] @ (q @ n_bad) - x_bad @ (n_good[few] @ q)
        h = q * (1 - q)
        curved[1, good[few]] = h @ n_bad
        curved[0, bad] += n_good[few] @ h
        both = x_good[:, few] @ h @ x_bad.T
        hess -= both + both.T
    held = fine[0].reshape(2, -1, COARSE)
    each = (curved.reshape(2, -1, COARSE) * held).sum(axis=2) / np.maximum(held.sum(axis=2), 1)
    hess += np.einsum("kb,kbij->ij", each, products)
    pairs = n_good.sum() * n_bad.sum()
    return loss / pairs, grad / pairs, hess / pairs


def fit_pairs(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weight: float, steps: int = 60) -> np.ndarray:
    """The weights of least loss, ``weight`` times the mean loss of all pairs with a ridge of 1, by Newton's method."""
    best = w = step = np.zeros(N_FEATURES)
    least = np.inf
    for _ in range(steps):
        at = w
        sums = summed(rows, lambda x, y: pair_sums((x - mean) / scale, strengths(x, mean, scale, at), y))  # noqa: B023
        loss, grad, hess = pair_loss(sums)
        loss = weight * loss + w @ w / 2
        if loss > 1.001 * least:
            step = step / 2
        else:
            best, least = w, min(least, loss)
            step = np.clip(np.linalg.solve(weight * hess + np.eye(N_FEATURES), weight * grad + w), -4, 4)
        w = best - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def quantile(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int, q: float) -> float:
    """``np.quantile(of(x), q)`` of all n rows (x, y): five passes settle 13 bits each of the two values next to it."""

    def bits(x: np.ndarray) -> np.ndarray:
        held = (of(x) + 0.0).view(np.uint64)
        return np.where(held >> np.uint64(63), ~held, held | np.uint64(1 << 63))

    place = q * (n - 1)
    ranks = [int(place), min(int(place) + 1, n - 1)]
    found = [0, 0]
    for shift in (52, 39, 26, 13, 0):

        def digits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            high = bits(x) >> np.uint64(shift)  # noqa: B023
            return np.concatenate([np.bincount((high[high >> np.uint64(13) == np.uint64(f)] & np.uint64(8191)).astype(np.int64), minlength=8192) for f in found])  # noqa: B023

        counts = summed(rows, digits).reshape(2, 8192)
        for i in (0, 1):
            upto = np.cumsum(counts[i])
            digit = int(np.searchsorted(upto, ranks[i], side="right"))
            ranks[i] -= int(upto[digit] - counts[i, digit])
            found[i] = found[i] << 13 | digit
    low, high = (float(np.uint64(f & (1 << 63) - 1 if f >> 63 else ~f & (1 << 64) - 1).view(np.float64)) for f in found)
    return low + (high - low) * (place - int(place))


def train(docs: DataFrame, labelled: DataFrame, pairs_each: int = 12) -> QualityModel:
    """Fit on all (doc_id, y) rows, y 1 or 0, that docs hold; the ridge weighs as if each document of the rarer kind had ``pairs_each`` pairs."""
    rows = stash(measured(docs, "doc_id").join(labelled.where("y IN (0, 1)"), "doc_id").select("x", "y"), "quality-features")
    first = summed(rows, lambda x, y: np.concatenate([[np.sum(y == 0), np.sum(y == 1)], x.sum(axis=0)]))
    if not len(first) or not first[:2].all():
        discard(rows)
        return QualityModel((0.0,) * N_FEATURES, (1.0,) * N_FEATURES, (0.0,) * N_FEATURES, 0.0, 0.0)
    n_bad, n_good = first[:2].astype(int).tolist()
    n = n_bad + n_good
    mean = first[2:] / n
    scale = np.maximum(np.sqrt(summed(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n), 1e-6)
    # both orders of each pair
    w = fit_pairs(rows, mean, scale, 2 * pairs_each * min(n_bad, n_good))
    cut = quantile(rows, lambda x: strengths(x, mean, scale, w), n, n_bad / n)
    fine = summed(rows, lambda x, y: pair_sums((x - mean) / scale, strengths(x, mean, scale, w), y))[: (1 + N_FEATURES) * 2 * BINS].reshape(1 + N_FEATURES, 2 * BINS)
    used = np.flatnonzero(fine[0])
    s = nodes(used % BINS)
    slope = float(fit_logistic(np.stack([s, np.ones(len(s))], 1), (used >= BINS).astype(float), fine[0, used], ridge=0.01)[0])
    discard(rows)
    return QualityModel(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), max(slope, 1e-3), cut)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts(part.column("text"))], float).reshape(-1, N_FEATURES)
        return pa.record_batch({"doc_id": part.column("doc_id"), "score": model.scores(x)})

    return map_slices(docs, run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches ``THRESHOLD``; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t) for t in texts(part.column("text"))], float).reshape(-1, N_FEATURES)
                yield part.filter(pa.array(model.scores(x) >= THRESHOLD))

    return narrow_batches(docs).mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """The model of all labelled rows of the training folds."""
    training = fold_of(F.col("doc_id"), 5) != 0
    return train(docs_of(docs).where(training), labels_of(table(spark, sf_dir, "labels"), "quality", "doc_id", training))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs_of(docs), fitted(spark, docs, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
