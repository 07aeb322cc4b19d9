"""Ranked lexical search with hashed max-sketches.

The index holds one row per document: its distinct terms with their counts, and a sketch in which every term's
count is folded into one of ``width`` coordinates by maximum. For one document the impact of a term grows with its
count alone, so the maxima of counts are the maxima of impacts once the corpus figures are known; the index
does not depend on them. The width is a power of two in proportion to the document's distinct terms.

A search looks up all query terms of a block of items in the sketches of a batch of documents at once. A
coordinate is never below the impact of a term that hashes to it, so the weighted sums are upper bounds. Per item
the documents of a batch are then scored exactly from their term counts in descending order of the bounds, until the
bound falls below the item's k-th best score, which is carried on from batch to batch. A task returns k rows per
item, whatever the bounds are worth.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import OUT_ROWS
from catalogmap.operators.ranking import top_k_per_group
from catalogmap.session import cut, cut_counted

#: Coordinates per distinct term; more of them make the bounds tighter and the sketches larger.
SPREAD = 8
#: A coordinate is one byte; its last value stands for any count from there on.
FULL = 255
#: (item, term) pairs looked up in one pass over the index; more of them are split by item into several passes.
BLOCK_PAIRS = 1 << 17
#: Documents times pairs held at once.
CELLS = 1 << 22
#: Asked terms up to so many are sent to all tasks for counting.
SENT_TERMS = 1 << 19
#: The scale of an impact, and of a term's weight.
UNIT, WEIGHT = 10**6, 1000

#: ASCII letters in lower case, digits and all bytes from 128 on stay; everything else separates terms.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole UTF-8 text in order, repeats included."""
    return (text or b"").translate(_FOLD).split()


def _places(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, terms), np.uint32, len(terms))


def sketch_of(terms: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Coordinatewise maxima of the counts (one byte each, capped at FULL)."""
    width = 1 << max(6, (SPREAD * len(terms) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    order = np.argsort(counts, kind="stable")  # a later assignment to the same place wins: the largest count
    out[(_places(terms) & np.uint32(width - 1))[order]] = np.minimum(counts[order], FULL)
    return out


_INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("sketch", pa.binary())])
INDEX = "doc_id long, n long, terms binary, counts binary, sketch binary"


def index_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text) that has a term: the index, to be kept with :func:`cut`.

    n counts the terms with repeats; terms are the distinct ones joined by spaces, counts their numbers as 32-bit
    values, sketch the maxima. Texts without terms (null and empty ones too) are left out: they match nothing
    and count for nothing. Rows with a null or repeated doc_id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(words)
                terms = list(found)
                counts = np.fromiter(found.values(), np.int64, len(terms))
                held.append((doc_id.as_py(), len(words), b" ".join(terms), counts.astype("<u4").tobytes(), sketch_of(terms, counts).tobytes()))
                if len(held) == 256:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def _batch(held: list[tuple], schema: pa.Schema = _INDEX) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _asked(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for item_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                held += [(item_id.as_py(), term) for term in dict.fromkeys(terms_of(text.as_py()))]
                while len(held) >= OUT_ROWS:
                    yield _batch(held[:OUT_ROWS], schema)
                    held = held[OUT_ROWS:]
            if held:
                yield _batch(held, schema)

    picked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "item_id long, term binary").distinct()


def document_counts(index: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, df): how many documents hold each of ``terms`` (column term, distinct)."""
    held = index.select(F.explode(F.split(F.col("terms").cast("string"), " ")).alias("word"))
    wanted = terms.select(F.col("term").cast("string").alias("word"))
    if n_terms <= SENT_TERMS:
        counted = held.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    else:  # counted before they meet, so that a frequent term is one row
        counted = held.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(wanted, "word", "left_semi")
    return counted.select(F.col("word").cast("binary").alias("term"), "df")


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """The terms of some items, laid out for batched lookups."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]]) -> None:
        """rows: (item_id, term, weight)."""
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.terms = list(dict.fromkeys(r[1] for r in rows))
        number = {t: i for i, t in enumerate(self.terms)}
        self.places = _places(self.terms)
        self.term = np.array([number[r[1]] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.int64)
        ids = [r[0] for r in rows]
        self.start = np.array([i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]], np.int64)
        self.items = [ids[i] for i in self.start]
        ends = [*self.start[1:].tolist(), len(rows)]
        self.weights = [[(rows[i][1], rows[i][2]) for i in range(a, b)] for a, b in zip(self.start.tolist(), ends, strict=True)]


def upper_bounds(block: Block, sketches: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """(documents × items): no document's score is above its bound. ``damping`` is m of each document."""
    n = np.arange(FULL, dtype=np.int64)
    impact = np.full((len(damping), FULL + 1), UNIT, np.int64)  # FULL stands for any larger count
    impact[:, :FULL] = (UNIT * 1000 * n) // (1000 * n + 8 * damping[:, None])
    seen = sketches[:, block.places & np.uint32(sketches.shape[1] - 1)]
    of_term = np.take_along_axis(impact, seen.astype(np.int64), 1)
    return np.add.reduceat(of_term[:, block.term] * block.weight, block.start, axis=1)


class Leaders:
    """The k best documents of every item so far."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in block.items]
        self.least = np.ones(len(block.items), np.int64)  # a score below this cannot enter

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        best = self.best[item]
        insort(best, (-score, doc_id is None, doc_id or 0))
        if len(best) > self.k:
            best.pop()
        if len(best) == self.k:
            self.least[item] = -best[-1][0]

    def beaten(self, item: int, bound: int, doc_id: int | None) -> bool:
        """Whether a document with this bound is outranked by the k-th best, ties by doc_id included."""
        best = self.best[item]
        return len(best) == self.k and (-bound, doc_id is None, doc_id or 0) >= best[-1]

    def rescore(self, bounds: np.ndarray, doc_ids: list[int | None], damping: list[int], counts_of) -> None:
        for item in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            column = bounds[:, item]
            order = np.flatnonzero(column >= self.least[item])
            for at in order[np.argsort(-column[order], kind="stable")].tolist():
                bound = int(column[at])
                if bound < self.least[item]:
                    break
                if self.beaten(item, bound, doc_ids[at]):
                    continue
                counts, m = counts_of(at), 8 * damping[at]
                score = sum(w * (UNIT * 1000 * tf // (1000 * tf + m)) for t, w in self.block.weights[item] if (tf := counts.get(t)))
                if score > 0 and not self.beaten(item, score, doc_ids[at]):
                    self.offer(item, score, doc_ids[at])

    def rows(self) -> Iterator[tuple]:
        for item_id, best in zip(self.block.items, self.best, strict=True):
            for score, nameless, doc_id in best:
                yield item_id, None if nameless else doc_id, -score


def _search(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(block)  # about BLOCK_PAIRS pairs
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        leaders = Leaders(asked, k)
        step = max(1, CELLS // len(asked.term))
        for batch in batches:
            doc_ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            damping = 10 + (90 * lengths * n_docs) // n_terms
            sketches = [memoryview(s.as_buffer()) for s in batch.column(4)]
            widths = np.array([len(s) for s in sketches])
            for width in np.unique(widths).tolist():
                same = np.flatnonzero(widths == width)
                for lo in range(0, len(same), step):
                    part = same[lo : lo + step]
                    table = np.frombuffer(b"".join([sketches[i] for i in part]), np.uint8).reshape(-1, width)
                    known: dict[int, dict[bytes, int]] = {}

                    def counts_of(at: int, part=part, known=known, batch=batch) -> dict[bytes, int]:
                        if at not in known:
                            row = int(part[at])
                            counts = np.frombuffer(batch.column(3)[row].as_buffer(), "<u4").tolist()
                            known[at] = dict(zip(batch.column(2)[row].as_py().split(b" "), counts, strict=True))
                        return known[at]

                    leaders.rescore(upper_bounds(asked, table, damping[part]), [doc_ids[i] for i in part], damping[part].tolist(), counts_of)
        held = list(leaders.rows())  # k rows per item at most
        for lo in range(0, len(held), OUT_ROWS):
            yield _batch(held[lo : lo + OUT_ROWS], schema)

    return index.select("doc_id", "n", "terms", "counts", "sketch").mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index for every item.

    ``items`` has item_id and text. N is the number of documents of the index, L all their terms, df the documents
    with a term: its weight w is floor(1000 ln((2N + 2) / (2 df + 1))). A document of n terms has
    m = 10 + 90 n N div L; its score sums w · ((10⁹ tf) div (1000 tf + 8 m)) over the item's distinct terms. Only
    scores above 0 count; equal scores go by doc_id, a null one last. Items with one item_id are one item with
    all their terms; an item without terms (null or empty text) has no rows, nor has an empty index.
    """
    asked, pairs = cut_counted(_asked(items))
    figures = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    nothing = "item_id long, rank int, doc_id long, score long"
    if not pairs or not figures.docs:
        return index.sparkSession.createDataFrame([], nothing)
    distinct, n_distinct = cut_counted(asked.select("term").distinct())
    blocks = -(-pairs // BLOCK_PAIRS)
    counted = asked.join(document_counts(index, distinct, n_distinct), "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    counted = cut(counted.select("item_id", "term", "df", "block"))
    found = None
    for number in range(blocks):
        rows = [(r.item_id, bytes(r.term), weight(figures.docs, r.df)) for r in counted.where(F.col("block") == number).collect()]  # one block
        if rows:
            part = _search(index, Block(rows), figures.docs, figures.terms, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return index.sparkSession.createDataFrame([], nothing)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_k_per_group(found, ["item_id"], order, k, "rank").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` over a fresh index of ``docs`` (columns doc_id, text); other columns are not looked at."""
    return search(cut(index_documents(docs)), items, k)
