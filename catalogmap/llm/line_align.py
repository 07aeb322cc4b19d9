"""Line-level deduplication by pairwise alignment.

A text is the sequence of its lines with words. A *run* is a shortest stretch of lines that has ``least_words``
words, from a given line on or up to a given line. Runs of that many words are rare. Each line of a block of that
size lies in a run inside the block: in the one that begins there, or, where the block ends too soon, in the one up
to the block's end. So a line is a copy exactly if a run that holds it is in an earlier document, and it is enough that
every run links its later holders to its first one: a passage in a third of all documents gives one pair per
document and no copy is missed. The two line sequences of a pair are aligned by patience diff (lines that occur
once in both, in rising order, then the gaps between them); gaps without such lines are matched by their runs. An
alignment may split a block, so every common stretch of the pair is looked up as well. Common blocks of
``least_words`` words or more are deleted from the later document. A line is only deleted where an earlier document
has it, so no text is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.names import free_names
from catalogmap.llm.rows import map_rows
from catalogmap.session import cut

LAST = 2**63 - 1
#: Later holders of a run per copy of its first holder's lines.
PARTNERS = 256


def line_runs(text: str | None, least_words: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """(place of each line with words, its hash, its words, hashes of the runs from and up to there or 0)."""
    places, hashes, words = [], [], []
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        parts = line.split()
        if parts:
            places.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(parts)))
            words.append(len(parts))
    octets = np.array(hashes, "<u8").tobytes()
    ends = np.searchsorted(sums := np.concatenate(([0], np.cumsum(words, dtype=np.int64))), sums[:-1] + least_words, "left")
    runs = [xxhash.xxh64_intdigest(octets[8 * i : 8 * e], 1) or 1 if e <= len(places) else 0 for i, e in enumerate(ends.tolist())]
    # the last line from which the words up to and with line i are enough
    froms = np.searchsorted(sums, sums[1:] - least_words, "right") - 1
    upto = [xxhash.xxh64_intdigest(octets[8 * f : 8 * (i + 1)], 1) or 1 if f >= 0 else 0 for i, f in enumerate(froms.tolist())]
    signed = lambda xs: np.array(xs, np.uint64).view(np.int64).tolist()
    return places, signed(hashes), words, signed(runs), signed(upto)


def patience_anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest rising chain of lines that occur once in both stretches."""
    once_a, once_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {h: i for i, h in enumerate(a[alo:ahi], alo) if once_a[h] == 1}
    tops: list[int] = []
    piles: list[tuple[int, int, int]] = []  # (i, j, the pile below)
    last: list[int] = []
    for j in range(blo, bhi):
        if once_b[b[j]] == 1 and (i := at.get(b[j])) is not None:
            pile = bisect_left(tops, i)
            piles.append((i, j, last[pile - 1] if pile else -1))
            if pile == len(tops):
                tops.append(i)
                last.append(len(piles) - 1)
            else:
                tops[pile], last[pile] = i, len(piles) - 1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        i, j, k = piles[k]
        out.append((i, j))
    return out[::-1]


def aligned_blocks(a: list[int], a_runs: list[int], b: list[int], b_runs: list[int]) -> list[tuple[int, int, int]]:
    """(first line in a, first line in b, lines): common blocks, each line of b in one block at most."""
    pairs: list[tuple[int, int]] = []
    extra: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    first_run: dict[int, int] = {}
    for i, r in enumerate(a_runs):
        first_run.setdefault(r, i)
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            pairs.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            pairs.append((ahi, bhi))
        if blo == bhi:
            continue
        anchors = patience_anchors(a, b, alo, ahi, blo, bhi) if alo < ahi else []
        if not anchors:  # repeated or moved lines: the first place of their run in the whole of a
            j = blo
            while j < bhi:
                i = first_run.get(b_runs[j]) if b_runs[j] else None
                n = 0
                while i is not None and j + n < bhi and i + n < len(a) and a[i + n] == b[j + n]:
                    n += 1
                if n:
                    extra.append((i, j, n))
                j += max(1, n)
            continue
        i0, j0 = alo, blo
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            pairs.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, ahi, j0, bhi))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs, key=lambda p: p[1]):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks + extra


def common_stretches(a: list[int], b: list[int]) -> list[int]:
    """Per line of b the lines of the longest stretch that ends there and stands anywhere in a.

    A suffix automaton of a, so the time is linear in both.
    """
    steps: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in a:
        new = len(steps)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, at, n = [], 0, 0
    for c in b:
        while at and c not in steps[at]:
            at = link[at]
            n = size[at]
        if c in steps[at]:
            at, n = steps[at][c], n + 1
        out.append(n)
    return out


def copied_places(a: list[int], a_runs: list[int], b: list[int], b_runs: list[int], words: list[int], least_words: int) -> list[int]:
    """The lines of b in a block of ``least_words`` words or more that stands in a."""
    gone = {j for _, at, n in aligned_blocks(a, a_runs, b, b_runs) if sum(words[at : at + n]) >= least_words for j in range(at, at + n)}
    if len(gone) < len(b):
        sums = [0, *accumulate(words)]
        upto = len(b)  # from the end, so that each line is added once
        for end, n in zip(range(len(b), 0, -1), reversed(common_stretches(a, b)), strict=True):
            if sums[end] - sums[end - n] >= least_words:
                gone.update(range(end - n, min(end, upto)))
                upto = min(upto, end - n)
    return sorted(gone)


def copied_lines(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """(doc_id, key, lines): per document the places of the lines to delete; documents without any are absent.

    ``docs`` has doc_id and text. Earlier means a smaller doc_id (null last), then a smaller hash of the
    text; rows equal in both are one document, so repeated rows are treated alike. key is that hash.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            places, hashes, words, runs, upto = line_runs(text, least_words)
            if any(runs):
                key = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)  # as Spark's xxhash64
                key = key - (1 << 64) if key >> 63 else key
                yield doc_id, LAST if doc_id is None else doc_id, key, places, hashes, words, runs, sorted({*runs, *upto} - {0})

    fields = "doc_id long, ord long, key long, places array<int>, hashes array<long>, words array<int>, runs array<long>, held array<long>"
    lines = cut(map_rows(docs.select("doc_id", "text"), run, fields))
    held = lines.select("ord", "key", F.explode("held").alias("run"))
    me = F.struct("ord", "key")
    holders = held.groupBy("run").agg(F.min(me).alias("first"), F.max(me).alias("last"), F.count(F.lit(1)).alias("n"))
    # a first holder with many partners is sent to them in several copies, so that no task meets them all
    copies = F.ceil(F.col("n") / PARTNERS).cast("int").alias("copies")
    shared = holders.where("first <> last").select("run", F.col("first.ord").alias("first_ord"), F.col("first.key").alias("first_key"), copies)
    pairs = held.join(shared, "run").where("ord <> first_ord or key <> first_key").groupBy("ord", "key", "first_ord", "first_key").agg(F.max("copies").alias("copies"))
    pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("ord", "key"), F.col("copies")).cast("int"))
    sent = shared.groupBy("first_ord", "first_key").agg(F.max("copies").alias("copies"))

    # Only lines that are shared at all take part in an alignment, but blocks need their neighbours' places:
    # whole sequences of 64-bit line hashes travel, not texts.
    whole = lines.dropDuplicates(["ord", "key"])
    later = whole.select("ord", "key", "doc_id", "places", F.col("hashes").alias("b"), "words", F.col("runs").alias("b_runs"))
    first = whole.select(F.col("ord").alias("first_ord"), F.col("key").alias("first_key"), F.col("hashes").alias("a"), F.col("runs").alias("a_runs"))
    first = first.join(sent, ["first_ord", "first_key"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = pairs.join(later, ["ord", "key"]).join(first, ["first_ord", "first_key", "copy"]).select("ord", "key", "doc_id", "places", "words", "a", "a_runs", "b", "b_runs")

    def align(rows: Iterator[tuple]) -> Iterator[tuple]:
        for order, key, doc_id, places, words, a, a_runs, b, b_runs in rows:
            gone = copied_places(a, a_runs, b, b_runs, words, least_words)
            if gone:
                yield order, key, doc_id, [places[j] for j in gone]

    copied = map_rows(met, align, "ord long, key long, doc_id long, lines array<int>")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines"))))
    return copied.groupBy("ord", "key").agg(F.first("doc_id").alias("doc_id"), merged.alias("lines")).select("doc_id", "key", "lines")


def delete_copied_lines(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """``docs`` with the copied lines gone from ``text``, and n_deleted (lines).

    All columns and rows stay; the text of other documents is not changed, a null text stays null. A
    document whose lines are all copies keeps an empty text. A column n_deleted is replaced. Lines are split at line feeds only.
    """
    columns = [c for c in docs.columns if c.lower() != "n_deleted"]
    own_id, own_key, own_lines = free_names(docs, "gone_id", "gone_key", "gone_lines")
    gone = copied_lines(docs, least_words).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("lines").alias(own_lines))
    text, same = F.col("text"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(own_lines, i)), "\n")
    cleaned = F.when(F.col(own_lines).isNotNull(), kept).otherwise(text).alias("text")
    return docs.select(*columns).join(gone, same, "left").select(
        *[cleaned if c == "text" else F.col(c) for c in columns], F.coalesce(F.size(own_lines), F.lit(0)).alias("n_deleted")
    )
