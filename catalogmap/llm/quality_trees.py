"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy arrays.

The trees are grown on histograms of a bounded sample of labelled rows. Chosen features are monotone: a
split that would turn the direction is refused, and the values below a split stay on their side of its
middle. A trained forest is five arrays; scoring moves all rows and all trees one level down at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "digit_share", "mark_share", "distinct_share")
#: −1: the score may only fall as the feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1}
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?=_{}[]~^@"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    key = ids[:n]
    for k in range(1, width):  # renumbered after each word, so the product fits 64 bits
        key = np.unique(key * np.uint64(len(numbers)) + ids[k : n + k], return_inverse=True)[1].astype(np.uint64)
    twice = np.bincount(key.astype(np.int64))[key.astype(np.int64)] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; a null text has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\r\v\f")]
    size = len(raw)
    kinds = (size - len(raw.translate(None, kind)) for kind in (_UPPER, _DIGITS, _MARKS))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), *kinds, len(set(words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES of rows of STATS; shares of an empty text are 0."""
    s = stats.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.stack([np.log1p(s[:, 0]), s[:, 1] / words, s[:, 2] / chars, s[:, 3] / lines, s[:, 4] / words, s[:, 0] / lines, s[:, 6] / chars, s[:, 7] / chars, s[:, 8] / chars, s[:, 9] / words], 1)


@dataclass(frozen=True)
class Forest:
    """Flat trees: at node i go left if x[feature[i]] <= threshold[i]; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Logistic boosting. ``signs``: 1 rising, −1 falling, 0 free, per feature."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), int)
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    margin = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    def build(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows], hess[rows]
        own = float(np.clip(g.sum() / (h.sum() + ridge), lo, hi))
        node = leaf(rate * own)
        if level == depth or len(rows) < 2:
            return node
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(m):
            if not len(edges[j]):
                continue
            gs = np.bincount(binned[rows, j], g, len(edges[j]) + 1).cumsum()[:-1]
            hs = np.bincount(binned[rows, j], h, len(edges[j]) + 1).cumsum()[:-1]
            gr, hr = g.sum() - gs, h.sum() - hs
            vl, vr = np.clip(gs / (hs + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
            gain = (gs * vl - 0.5 * (hs + ridge) * vl**2) + (gr * vr - 0.5 * (hr + ridge) * vr**2) - (g.sum() * own - 0.5 * (h.sum() + ridge) * own**2)
            gain[(hs < least) | (hr < least) | (signs[j] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            return node
        middle = (vl + vr) / 2
        llo, lhi, rlo, rhi = lo, hi, lo, hi
        if signs[j]:
            (lhi, rlo) = (middle, middle) if signs[j] > 0 else (hi, lo)
            if signs[j] < 0:
                llo, rhi = middle, middle
        goes = binned[rows, j] <= k
        feature[node], threshold[node] = j, float(edges[j][k])
        left[node] = build(rows[goes], level + 1, llo, lhi)
        right[node] = build(rows[~goes], level + 1, rlo, rhi)
        return node

    def walk(root: int) -> np.ndarray:
        node = np.full(n, root)
        f, t, lft, rgt = np.array(feature), np.array(threshold), np.array(left), np.array(right)
        for _ in range(depth):
            node = np.where(x[np.arange(n), f[node]] <= t[node], lft[node], rgt[node])
        return np.array(value)[node]

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            roots.append(build(np.arange(n), 0, -8.0, 8.0))
            margin = margin + walk(roots[-1])
    else:
        roots.append(leaf(0.0))
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), start, depth)


STATS_TYPE = "struct<" + ",".join(f"{s}:long" for s in STATS) + ">"


def stats_of(text: Column) -> Column:
    """STATS of a text column as a struct."""
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATS), dtype="int64")

    return F.pandas_udf(stats, STATS_TYPE)(text)


def probability_of(stats: Column, forest: Forest) -> Column:
    """The forest's probability that a document is good, from its STATS."""
    def scored(*columns: pd.Series) -> pd.Series:
        rows = np.stack([c.to_numpy() for c in columns], 1) if len(columns[0]) else np.zeros((0, len(STATS)))
        return pd.Series(forest.probability(features(rows)))

    return F.pandas_udf(scored, "double")(*[stats[s] for s in STATS])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> Forest:
    """Fits the forest on about ``sample_rows`` labelled documents, picked by a hash of doc_id.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (1 good, 0 bad). Null labels and ids are
    not used; several labels of one document count as the lowest. Statistics of the sample (a few numbers
    per row) are what the driver receives. Without both kinds of labels the probability is constant.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * share))
    # every document is looked at, only the picked ones keep their text
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * share)).select("doc_id", stats_of(F.col("text")).alias("s"))
    rows = picked.join(known, "doc_id").select("doc_id", "quality", "s.*").orderBy("doc_id", *STATS).collect()
    stats = np.array([[r[s] for s in STATS] for r in rows]).reshape(len(rows), len(STATS))
    y = np.array([r.quality for r in rows], float)
    signs = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return grow(features(stats), y, signs, **options)


def judge(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): STATS, base_failed, quality and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows of three. kept is false
    if base_failed, else quality >= ``least``. A null or empty text has no words and fails.
    """
    counted = docs.select("doc_id", stats_of(F.col("text")).alias("s"))
    judged = counted.select("doc_id", "s", probability_of(F.col("s"), forest).alias("quality"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "s.*", "quality").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))
