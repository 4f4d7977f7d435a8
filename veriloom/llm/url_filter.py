"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The longest rule that fits decides.  URLs that a rule decides are the labelled ones: the trees learn from a
bounded sample of the distinct ones and judge the urls that no rule fits.

A null url, or one without ``://``, has empty host and path, no rule, and the trees' verdict on the empty
features; without labelled urls of both kinds the verdict is the kind there is, or else allow; an empty table
gives no rows; repeated rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

# The rules, a host and the start of a path each.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@dataclass(frozen=True)
class Rules:
    verdicts: dict[str, str] = field(default_factory=lambda: dict(RULES))

    def fit(self, host: Column, path: Column) -> Column:
        """The longest rule that fits, or null; equal lengths go by the alphabet."""
        out = F.lit(None).cast("string")
        for rule in sorted(self.verdicts, key=lambda r: (len(r), r)):
            rule_host, slash, rest = rule.partition("/")
            fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
            out = F.when(fits, F.lit(rule)).otherwise(out)
        return out

    def verdict(self, rule: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, what in self.verdicts.items():
            out = F.when(rule == name, what).otherwise(out)
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def tokens(url: str) -> tuple[str, str, str]:
    """Top domain, first path part and extension: their block rates are the suffix statistics."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    parts = [p for p in path.split("/") if p]
    last = parts[-1] if parts else ""
    return "tld:" + host.rpartition(".")[2], "dir:" + (parts[0] if len(parts) > 1 else ""), "ext:" + (last.rpartition(".")[2] if "." in last else "")


def features(url: str | None, rates: dict[str, float], base: float) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    return [
        float(len(url)), float(len(host)), float(len(path)), float(path.count("/")), float(host.count(".")), float(host.count("-")),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / max(1, len(host)), _entropy(url), _entropy(host),
        float(len([p for p in query.split("&") if p])), float(len(query)), float("#" in url), float(url.startswith("https://")), float(path.endswith("/")),
        *(rates.get(t, base) for t in tokens(url)),
    ]


@dataclass(frozen=True)
class Tree:
    """A binary tree in arrays: rows with feature value <= cut go to ``left``, a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            goes_left = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    """One regression tree on gradients: each split is the histogram cut of the largest gain."""
    nodes: list[list] = []

    def node(rows: np.ndarray, left_depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, -g / (h + ridge)])
        if left_depth == 0 or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, 0)
        for f in range(x.shape[1]):
            m = len(edges[f]) + 1
            if m < 2:
                continue
            gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], w, m))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            _, f, b = best
            goes_left = bins[rows, f] <= b
            nodes[at][:2] = f, edges[f][b]
            nodes[at][2] = node(rows[goes_left], left_depth - 1)
            nodes[at][3] = node(rows[~goes_left], left_depth - 1)
        return at

    node(np.arange(len(x)), depth)
    return Tree(*(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float), strict=True)))


@dataclass(frozen=True)
class Boosted:
    base: float
    rate: float
    trees: tuple[Tree, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, least: int = 10, ridge: float = 1.0, cuts: int = 63) -> Boosted:
    """Gradient boosting with logistic loss over histograms of quantile bins."""
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base, trees = float(np.log(p / (1 - p))), []
    if 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, cuts + 2)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        z = np.full(len(y), base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-z))
            trees.append(grow(x, bins, edges, q - y, np.maximum(q * (1 - q), 1e-9), depth, least, ridge))
            z += rate * trees[-1].predict(x)
    return Boosted(base, rate, tuple(trees))


@dataclass(frozen=True)
class UrlModel:
    """P(block) of a url."""

    rates: dict[str, float]
    base: float
    trees: Boosted | None
    constant: float = 0.0

    def probability(self, urls: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.constant)
        return self.trees.probability(np.array([features(u, self.rates, self.base) for u in urls]).reshape(len(urls), -1))


def train(urls: list[str], y: np.ndarray, smooth: float = 20.0) -> UrlModel:
    """Trees from urls labelled 1 (block) or 0 (allow); suffix rates are smoothed.

    A rate that left the url's own label out would tell that label, and trees would learn it.
    """
    if not len(y) or y.min() == y.max():
        return UrlModel({}, 0.0, None, float(y[0]) if len(y) else 0.0)
    base, seen, blocked = float(y.mean()), Counter(), Counter()
    for u, v in zip(urls, y, strict=True):
        for t in tokens(u):
            seen[t] += 1
            blocked[t] += int(v)
    rates = {t: (blocked[t] + smooth * base) / (seen[t] + smooth) for t in seen}
    x = np.array([features(u, rates, base) for u in urls])
    return UrlModel(rates, base, boost(x, y.astype(float)))


def url_filter(pages: DataFrame, rules: Rules | None = None, max_train: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of pages (page_id, url).

    ``max_train`` bounds the labelled urls that train the trees, picked by a hash of the url.
    """
    rules = rules or Rules()
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rules.fit(F.col("host"), F.col("path"))).withColumn("ruled", rules.verdict(F.col("rule")))
    labelled = rows.where(F.col("ruled").isNotNull())
    # a url counts once, however many pages repeat it
    labelled = labelled.groupBy("url").agg(F.first("ruled").alias("ruled"))
    n = labelled.count()
    if n > max_train:
        labelled = labelled.where(F.pmod(F.xxhash64("url", F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    got = sorted((r["url"], r["ruled"] == "block") for r in labelled.collect())
    model = train([u for u, _ in got], np.array([int(v) for _, v in got]))

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(part.column("url").to_pylist())
        return pa.record_batch([*(part.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(p, pa.float64())], names=["page_id", "host", "path", "rule", "ruled", "block_score"])

    kind = dict(pages.dtypes)["page_id"]
    judged = map_slices(rows, judge, f"page_id {kind}, host string, path string, rule string, ruled string, block_score double", text="url")
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
