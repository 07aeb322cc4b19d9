"""Toxic text by compression distance between two zstandard dictionaries.

Every window of a text (a word, repeated so that a frame can be shorter than its input) is compressed with
a dictionary of ordinary text and with one of toxic text; the margin is the difference of the lengths. Both
dictionaries hold the frequent windows of ordinary text, since toxic documents consist mostly of those, and
the toxic one ends with the windows that stand out in toxic documents. How far a window must stand out, and
how margins turn into a score, is calibrated on labelled rows that neither dictionary has seen.

zstandard's own trainer was tried and left: it concatenates whole sample stretches, so chance matches of
ordinary words drown the signal. The dictionaries are raw content chosen by counts over all training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows
from catalogmap.session import cut

#: Labelled documents that a model is fitted on, as a rule.
TRAINING_ROWS = 20_000
WORD_BYTES = 48
REPEATS = 4
BASE_WORDS = 8192
MARKED_WORDS = 4096
DICT_BYTES = 65536
#: Words are counted whole and by their beginning, for stems with many endings.
STEM = 5
LEVEL = 3
_NO_MARKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
CACHE_WORDS = 200_000
MARGINS = (2, 3, 4, 5)
WIDTH = 3 + len(MARGINS)


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case, without ASCII punctuation; a longer word is cut into pieces."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_NO_MARKS).split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def _compressors(base: list[bytes], marked: list[bytes]):
    """Compressors with the ordinary and the toxic dictionary.

    Both are raw content of one length with the shared words in the same places, so that zstandard sets up
    its tables alike; the ordinary one ends with zeros where the toxic one has its marked words.
    """
    import zstandard

    content = b" ".join([b"", *base, b""])[-DICT_BYTES:] or b" "
    tail = b" ".join([b"", *marked, b""])
    for end in (bytes(len(tail)), tail):
        made = zstandard.ZstdCompressionDict(content + end + b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        yield zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False, write_checksum=False)


class Margins(dict):
    """Window → ordinary length minus toxic length; remembers a bounded number of windows."""

    def __init__(self, base: list[bytes], marked: list[bytes]) -> None:
        super().__init__()
        self.packers = list(_compressors(base, marked))

    def __missing__(self, word: bytes) -> int:
        window = (b" " + word) * REPEATS + b" "
        ordinary, toxic = (len(p.compress(window)) for p in self.packers)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ordinary - toxic
        return ordinary - toxic

    def summary(self, text: str | None) -> list[float]:
        words = windows(text)
        if not words:
            return [0.0] * WIDTH
        m = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        top = np.sort(np.partition(m, max(0, len(m) - 3))[-3:])[::-1]
        return [min(float(top[0]), 8.0), min(float(top.sum()), 24.0), *(float(np.log1p((m >= k).sum())) for k in MARGINS), float(np.log1p(len(m)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights (the constant first) and the mean log loss on the same rows."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pull = np.r_[1e-6, np.full(len(w) - 1, ridge)]  # the constant is free
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(pull), grad)
        w = w + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass(frozen=True)
class ToxicityModel:
    base: list[bytes]
    marked: list[bytes]
    weights: list[float]

    def scorer(self) -> Callable[[str | None], float]:
        weights = np.array(self.weights)
        margins = Margins(self.base, self.marked)
        return lambda text: float(1 / (1 + np.exp(-np.clip(weights[0] + weights[1:] @ np.array(margins.summary(text)), -30, 30))))

    def score(self, text: Column) -> Column:
        """The score of a text column, 0 to 1; a null text scores like an empty one."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = model.scorer()  # one cache of windows for all batches of a task
            for texts in batches:
                yield pd.Series([score(t) for t in texts], dtype="float64")

        return scored(text)


def labelled_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about ``rows`` labelled documents, picked by a hash of doc_id.

    ``labels`` has doc_id and toxic; several labels of a document count as the highest. The picked labels
    are as many as ``rows`` says whatever the table, so they are broadcast and no text is shuffled.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = int(1_000_000 * min(1.0, rows / max(1, known.count())))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < share
    return docs.select("doc_id", "text").where(picked).join(F.broadcast(known.where(picked)), "doc_id")


def train(labelled: DataFrame, calibration_rows: int = 4000, candidates: int = 7) -> ToxicityModel:
    """Learns from ``labelled`` (columns doc_id, text, toxic); only text and toxic decide a score.

    The rows are a bounded sample, see :func:`labelled_documents`. Two thirds of them (by a hash of doc_id)
    give the dictionaries: all their texts are counted, the driver receives at most BASE_WORDS +
    MARKED_WORDS words. Of the rest about ``calibration_rows`` rows, picked by the hash, choose the
    threshold and the weights. Rows with a null label or id are not used; a null text is empty. Without any
    labelled toxic row the score is the same small number for all.
    """
    known = cut(labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(3_000_000))
    sizes = known.groupBy((part < 1_000_000).alias("held")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    of = {r.held: r for r in sizes}
    nt, no = (of[False].t, of[False].n - of[False].t) if False in of else (0, 0)

    words = F.array_distinct(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    counted = (
        known.where(part >= 1_000_000)
        .select("toxic", words.alias("words"))
        .select("toxic", F.explode(F.array_distinct(F.concat("words", F.transform("words", lambda w: F.left(w, F.lit(STEM)))))).alias("word"))
        .where((F.col("word") != "") & (F.octet_length("word") <= WORD_BYTES))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    )
    expected = F.lit(float(nt)) * (F.col("o") + 1) / F.lit(float(max(1, no)))
    stands_out = ((F.col("t") - expected) / F.sqrt(expected + 1)).alias("z")
    counted = cut(counted.where("t + o >= 2").select("word", "t", "o", stands_out))
    base = [r.word.encode() for r in counted.where("o > 0").orderBy(F.desc("o"), "word").limit(BASE_WORDS).collect()][::-1]
    marked = [(r.z, r.word.encode()) for r in counted.where("z >= 3").orderBy(F.desc("z"), "word").limit(MARKED_WORDS).collect()][::-1]

    if not marked or not no or True not in of or not 0 < of[True].t < of[True].n:
        rate = (nt + 0.5) / (nt + no + 50)
        return ToxicityModel(base, [], [float(np.log(rate / (1 - rate))), *[0.0] * WIDTH])

    cuts = sorted({float(c) for c in np.geomspace(3, max(3.0, marked[-1][0] * 0.9), candidates)})
    choices = [[w for z, w in marked if z >= c] for c in cuts]

    def run(rows):
        tables = [Margins(base, words) for words in choices]
        for toxic, text in rows:
            yield toxic, [x for t in tables for x in t.summary(text)]

    share = int(1_000_000 * min(1.0, calibration_rows / of[True].n))
    rows = map_rows(known.where(part < share).select("toxic", "text"), run, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    if not 0 < y.sum() < len(y):
        rate = (nt + 0.5) / (nt + no + 50)
        return ToxicityModel(base, [], [float(np.log(rate / (1 - rate))), *[0.0] * WIDTH])
    x = np.array([r.x for r in rows]).reshape(len(rows), len(choices), WIDTH)
    fits = [fit_logistic(x[:, i], y) for i in range(len(choices))]
    best = min(range(len(fits)), key=lambda i: fits[i][1])
    return ToxicityModel(base, choices[best], fits[best][0].tolist())


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (columns doc_id, text), repeated rows and null ids included."""
    return docs.select("doc_id", model.score(F.col("text")).alias("score"))
