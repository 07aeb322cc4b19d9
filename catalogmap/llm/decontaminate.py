"""Benchmark decontamination by spaced seeds.

A mask such as ``111011011`` hashes the marked tokens of a window and ignores the others, so a changed word
does not hide a passage. Hashes of the benchmark and of the training texts meet in an equi-join. Before
it, training hashes pass a Bloom filter of the benchmark's hashes; its size is bounded whatever the
benchmark, and what slips through is removed by the join. Each hit gives a diagonal (offset between
document and item), along which the tokens are compared: any stretch that is long and equal enough counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows
from catalogmap.session import cut, cut_counted, shuffled

MASKS = ("111011011", "1101101011", "1110010111")
#: Items shorter than the longest mask are also looked up whole.
LONGEST = max(map(len, MASKS))
BLOOM_BITS = (1 << 20, 1 << 28)
PROBES = 6
#: Ranges of diagonals marked at once.
RANGES = 1 << 20
_MARKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word of the whole text; words are split at ASCII marks and white space, in lower case."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _factors(mask: str) -> list[tuple[int, np.uint64]]:
    return [(i, np.uint64(xxhash.xxh64_intdigest(f"{mask}:{i}") | 1)) for i, c in enumerate(mask) if c == "1"]


_FACTORS = {m: _factors(m) for m in (*MASKS, *("1" * n for n in range(1, LONGEST)))}


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of the mask's length."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)), np.uint64)
    with np.errstate(over="ignore"):
        for i, factor in _FACTORS[mask]:
            out += tokens[i : i + n] * factor
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def _masks_of(tokens: np.ndarray) -> list[str]:
    """The masks an item is looked up by."""
    return [m for m in MASKS if len(m) <= len(tokens)] + (["1" * len(tokens)] if 0 < len(tokens) < LONGEST else [])


class Bloom:
    """A bit table of bounded size; ``words`` holds its non-zero words."""

    def __init__(self, bits: int, words: dict[int, int]) -> None:
        self.bits = bits
        self.table = np.zeros(bits // 64, np.uint64)
        if words:
            self.table[np.fromiter(words, np.int64)] = np.fromiter(words.values(), np.int64).view(np.uint64)

    @staticmethod
    def places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = hashes * np.uint64(2 * probe + 1) + (hashes >> np.uint64(17 + probe))
        return (mixed >> np.uint64(8)) & np.uint64(bits - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the table."""
        at = np.arange(len(hashes))
        for probe in range(PROBES):
            place = self.places(hashes[at], probe, self.bits)
            at = at[(self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


HIT = "hashes array<long>, places array<array<int>>"


def _placed(hashes: list[int], places: list[int]) -> tuple[list[int], list[list[int]]]:
    """The distinct hashes and the places of each."""
    held: dict[int, list[int]] = {}
    for h, at in zip(hashes, places, strict=True):
        held.setdefault(h, []).append(at)
    return list(held), list(held.values())


def _benchmark(items: DataFrame) -> DataFrame:
    """(item_id, tokens, hashes, places): one row per item with words; each seed hash once, with its places."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, text in rows:
            tokens = token_hashes(text)
            seeds = [(h, i) for m in _masks_of(tokens) for i, h in enumerate(_signed(seed_hashes(tokens, m)))]
            if seeds:
                yield item_id, _signed(tokens), *_placed([h for h, _ in seeds], [i for _, i in seeds])

    return map_rows(items.select("item_id", "text").distinct(), run, f"item_id long, tokens array<long>, {HIT}")


def _bloom(seeds: DataFrame, count: int) -> Bloom:
    """The filter over column hash; the driver receives its bounded words, not the hashes."""
    bits = BLOOM_BITS[0]
    while bits < BLOOM_BITS[1] and bits < 64 * count:
        bits *= 2

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (h,) in rows:
            value = np.array([h], np.int64).view(np.uint64)
            for probe in range(PROBES):
                place = int(Bloom.places(value, probe, bits)[0])
                bit = 1 << (place & 63)
                yield place >> 6, bit - (1 << 64) if bit >> 63 else bit

    words = map_rows(seeds.select("hash").distinct(), run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return Bloom(bits, {r.word: r.bits for r in words.collect()})


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int, least_tokens: int = 13, least_share: float = 0.8) -> tuple[int, int, int] | None:
    """(first token in the document, length, equal tokens) of the best valid stretch on a diagonal, or None.

    A stretch is valid with ``least_tokens`` tokens (a shorter item: all of its tokens) or more, of which
    ``least_share`` or more are equal; the best has the most equal tokens, then the fewest others, then comes first.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    least = min(least_tokens, len(item))
    if not least or hi - lo < least:
        return None
    equal = np.concatenate(([0], np.cumsum(doc[lo:hi] == item[lo - diagonal : hi - diagonal])))
    share = Fraction(str(least_share))
    sums = equal * share.denominator - np.arange(hi - lo + 1) * share.numerator  # matched >= share * length where it does not fall
    # from each end the earliest start with a sum not above the end's; starts that are new lows are enough
    lows = np.minimum.accumulate(sums)
    ends = np.arange(least, hi - lo + 1)
    starts = np.searchsorted(-lows, -sums[ends], "left")
    fits = starts <= ends - least
    if not fits.any():
        return None
    starts, ends = starts[fits], ends[fits]
    matched = equal[ends] - equal[starts]
    top = matched == matched.max()
    # an unequal token at a rim is dropped where the stretch stays long enough
    start, end = min(zip(starts[top].tolist(), ends[top].tolist(), strict=True), key=lambda s: (s[1] - s[0], s[0]))
    same = np.diff(equal)
    while end - start > least and not same[end - 1]:
        end -= 1
    while end - start > least and not same[start]:
        start += 1
    return lo + start, end - start, int(equal[end] - equal[start])


def hit_diagonals(met: list[tuple[np.ndarray, np.ndarray]], doc_tokens: int, item_tokens: int) -> np.ndarray:
    """The diagonals (place in the document less place in the item) on which a hash of both meets, in order.

    ``met`` has, per hash, its places in the document and in the item. Consecutive places are taken together: a run of
    places meets another on a whole range of diagonals, so a word repeated thousands of times is one step.
    """
    edges = np.zeros(doc_tokens + item_tokens + 2, np.int64)
    for at, place in met:
        sides = []
        for where in (np.sort(at), np.sort(place)):
            breaks = np.flatnonzero(np.diff(where) != 1)
            sides.append((where[np.concatenate(([0], breaks + 1))], where[np.concatenate((breaks, [len(where) - 1]))]))
        (first, last), (low, high) = sides
        step = max(1, RANGES // len(low))
        for i in range(0, len(first), step):
            starts = (first[i : i + step, None] - high[None, :]).ravel() + item_tokens
            ends = (last[i : i + step, None] - low[None, :]).ravel() + item_tokens + 1
            edges += np.bincount(starts, minlength=len(edges)) - np.bincount(ends, minlength=len(edges))
    return np.flatnonzero(np.cumsum(edges) > 0) - item_tokens


def contaminated(docs: DataFrame, benchmark: DataFrame, least_tokens: int = 13, least_share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, length, matched, item_tokens): documents that hold a benchmark passage.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. One row per document and item: the stretch
    with the most equal tokens over all diagonals with a seed hit. It must cover ``least_tokens`` tokens (a shorter item:
    all of them) with at least ``least_share`` equal ones. Items without words match nothing; a null or
    empty text holds nothing. Rows without doc_id are compared too and reported with a null doc_id; rows
    that repeat an id are reported once. Items with a repeated id are compared each.
    """
    found = contaminated_texts(docs, benchmark, least_tokens, least_share)
    best = F.max(F.struct("matched", (-F.col("start")).alias("before"), "length", "item_tokens")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.before")).alias("start"), "b.length", "b.matched", "b.item_tokens")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, least_tokens: int = 13, least_share: float = 0.8) -> DataFrame:
    """:func:`contaminated` for each different text of a doc_id, with its text_key (Spark's xxhash64 of the text)."""
    items, _ = cut_counted(_benchmark(benchmark))
    items = items.withColumn("item", F.xxhash64("item_id", "tokens"))
    seeds = items.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("item", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    # a hash stands once per item, so a text that repeats it meets the item once
    seeds, count = cut_counted(seeds)
    if not count:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "0L text_key", "0L item_id", "0L start", "0L length", "0L matched", "0L item_tokens")
    short = [r.n for r in items.where(F.size("tokens") < LONGEST).select(F.size("tokens").alias("n")).distinct().collect()]
    bloom = _bloom(seeds, count)
    masks = [*MASKS, *("1" * n for n in short)]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, key, text in rows:
            tokens = token_hashes(text)
            found, places = [], []
            for mask in masks:
                hashes = seed_hashes(tokens, mask)
                at = bloom.holds(hashes)
                found += _signed(hashes[at])
                places += at.tolist()
            if found:
                yield doc_id, key, _signed(tokens), *_placed(found, places)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    hit = cut(map_rows(keyed, run, f"doc_id long, text_key long, tokens array<long>, {HIT}"))
    hit = hit.withColumn("doc", F.xxhash64("doc_id", "text_key", "tokens"))
    spread = hit.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("doc", F.col("s.hashes").alias("hash"), F.col("s.places").alias("at"))
    met = spread.join(seeds, "hash").groupBy("doc", "item").agg(F.collect_list(F.struct("at", "place")).alias("met"))
    pairs = cut(met)  # a pair's hits: at most the places of both

    def verify(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, key, item_id, doc, item, met in rows:
            doc, item = np.array(doc, np.int64), np.array(item, np.int64)
            hits = [(np.array(m["at"], np.int64), np.array(m["place"], np.int64)) for m in met]
            valid = [s for d in hit_diagonals(hits, len(doc), len(item)).tolist() if (s := best_stretch(doc, item, d, least_tokens, least_share))]
            if valid:
                start, length, matched = max(valid, key=lambda s: (s[2], -s[1], -s[0]))
                yield doc_id, key, item_id, start, length, matched, len(item)

    # the hits of a pair are runs of small numbers: a few MB on disk, a hundred times that in a hash table on the driver
    held = hit.select("doc", "doc_id", "text_key", F.col("tokens").alias("doc_tokens")).dropDuplicates(["doc"])
    sides = (
        pairs.join(shuffled(held), "doc")
        .join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")).dropDuplicates(["item"]), "item")
        .select("doc_id", "text_key", "item_id", "doc_tokens", "item_tokens", "met")
    )
    return map_rows(sides, verify, "doc_id long, text_key long, item_id long, start long, length long, matched long, item_tokens long")
