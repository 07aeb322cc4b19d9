"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

A document's shingles give ``SLOTS`` minima. Of each minimum only its low ``BITS`` bits are retained, packed into
eight 64-bit lanes; ``ROWS`` whole minima at a time also give a band key before they are dropped. Documents that
share a band key are candidates. Two minima that differ agree in their low bits by chance, so the share of equal
slots, found by counting bits, is corrected for that before it estimates the similarity; a pair is left out only
if the estimate lies six standard deviations below the threshold.

With bands of four rows a pair at similarity 0.8 shares none of 32 bands with a probability of 5e-8.

Work is spent where components are still apart:

* equal texts collapse first;
* each document of a band's bucket meets the bucket's leader, one row per document; a document takes the name of a leader
  that it links to, and that of its leader's leader, which stands for its component so far;
* buckets whose documents then lie in several components are completed: what is not in the bucket's largest
  component meets everything in the bucket, block by block, by signatures alone. Components with a candidate pair between
  them form a family; its documents that have such a candidate meet once more in the same way with their whole sets,
  and a task returns a spanning forest of the links, never the pairs.

So a group of copies of any size costs one pass, unless its members are alike without being similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows
from catalogmap.operators.graph import connected_components
from catalogmap.session import cut, cut_counted, fresh

SLOTS, BITS, ROWS = 128, 4, 4
LANES = SLOTS * BITS // 64
#: Standard deviations of the estimate between the threshold and the first estimate that is not looked at.
DEVIATIONS = 6.0
#: Shingles turned into minima at once, and rows of a block in a bucket.
STEP, BLOCK_ROWS = 2048, 1024
#: Texts whose sets are needed are picked by a broadcast of their keys up to so many (some 24 bytes each).
SENT_KEYS = 1 << 20

_rng = np.random.default_rng(13)
_FACTORS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0x1111111111111111)


def shingle_set(text: bytes | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text in ASCII lower case.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of SLOTS hash functions over a non-empty set."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), STEP):
            part = shingles[at : at + STEP]
            np.minimum(out, (part[None, :] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1), out=out)
    return out >> np.uint64(32)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima in LANES 64-bit values."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(LANES, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS minima."""
    rows = least.reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        key = (rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(32))


def least_equal(share: float) -> int:
    """Equal slots from which a pair is looked at: those expected at similarity ``share`` less DEVIATIONS deviations."""
    by_chance = 0.5**BITS
    expected = by_chance + (1 - by_chance) * share
    return int(SLOTS * expected - DEVIATIONS * (SLOTS * expected * (1 - expected)) ** 0.5)


def estimate(equal: int | np.ndarray) -> float | np.ndarray:
    """Similarity from the number of equal slots, corrected for slots that agree by chance."""
    by_chance = 0.5**BITS
    return (equal / SLOTS - by_chance) / (1 - by_chance)


def equal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a × rows of b): slots whose retained bits agree."""
    differing = np.zeros((len(a), len(b)), np.int64)
    for lane in range(LANES):
        x = a[:, lane][:, None] ^ b[:, lane][None, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differing += np.bitwise_count(x & _LOW)
    return SLOTS - differing


def _equal_slots_of(a: str, b: str) -> Column:
    """The same for two structs of lanes, as an expression."""
    total = F.lit(SLOTS)
    for lane in range(LANES):
        x = F.col(f"{a}.l{lane}").bitwiseXOR(F.col(f"{b}.l{lane}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(int(_LOW)))
        total = total - F.bit_count(x)
    return total


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, g, text): h and g are 128 bits of the whole text."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return named.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.col("text").cast("binary").alias("text"))


_LANE_NAMES = [f"l{i}" for i in range(LANES)]


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, h, g, n_shingles, sig, bands) of every row of ``docs``; sig and bands are null for an empty set."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, h, g, text in rows:
            shingles = shingle_set(text, width)
            if not len(shingles):
                yield doc_id, h, g, 0, None, None
                continue
            least = minima(shingles)
            lanes = packed(least).view(np.int64).tolist()
            yield doc_id, h, g, len(shingles), dict(zip(_LANE_NAMES, lanes, strict=True)), band_keys(least).view(np.int64).tolist()

    lanes = ",".join(f"{name}:bigint" for name in _LANE_NAMES)
    return map_rows(_keyed(docs), run, f"doc_id long, h long, g long, n_shingles long, sig struct<{lanes}>, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """(id, shingles): the whole sets of the texts ``wanted`` (id, h, g), one row each."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for number, text in rows:
            yield number, shingle_set(text, width).tobytes()

    side = F.broadcast(wanted) if n_wanted <= SENT_KEYS else wanted
    texts = _keyed(docs).join(side, ["h", "g"]).groupBy("id").agg(F.first("text").alias("text"))
    return map_rows(texts, run, "id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 · intersection ≥ percent · union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs (leader, id) whose whole sets are similar enough."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for leader, number, a, b in rows:
            if similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent):
                yield leader, number

    of_id = sets.select("id", F.col("shingles").alias("b"))
    of_leader = fresh(sets).join(pairs.select(F.col("leader").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("leader"), F.col("shingles").alias("a"))
    return map_rows(pairs.join(of_id, "id").join(of_leader, "leader").select("leader", "id", "a", "b"), run, "u long, v long")


def _met(rows: DataFrame, block_rows: int, sets: DataFrame | None = None) -> DataFrame:
    """``rows`` (value, id, component, …) of unsettled buckets, dealt to the meetings (value, left, right) of their blocks.

    The bucket's largest component need not meet itself. The others are the rest; a meeting has at least one block of
    them. Blocks of the rest have numbers from 0 on, those of the largest component negative ones.
    """
    sizes = cut(rows.groupBy("value", "component").agg(F.count(F.lit(1)).alias("n")))
    top = F.max(F.struct("n", "component")).alias("top")
    totals = sizes.groupBy("value").agg(top, F.sum("n").alias("all")).where(F.col("top.n") < F.col("all"))
    blocks = totals.select(
        "value", F.col("top.component").alias("largest"),
        F.ceil(F.col("top.n") / block_rows).cast("int").alias("mass"),
        F.ceil((F.col("all") - F.col("top.n")) / block_rows).cast("int").alias("rest"),
    )
    placed = rows.join(cut(blocks), "value")
    if sets is not None:
        placed = placed.join(sets, "id")
    names = [*rows.columns, *([c for c in sets.columns if c != "id"] if sets is not None else [])]
    placed = placed.withColumn("inside", F.col("component") == F.col("largest"))
    number = F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("mass")).otherwise(F.col("rest"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("inside"), -1 - number).otherwise(number))
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(-F.col("mass"), F.col("rest") - 1))
    met = placed.withColumn("other", F.explode(others))
    keys = ["value", "left", "right"]
    met = met.select("value", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", *[c for c in names if c != "value"])
    return met.repartition(*keys).sortWithinPartitions(*keys, "block")


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of one meeting at a time (about two blocks)."""
    held: list[tuple] = []
    for row in rows:
        if held and row[:3] != held[0][:3]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _sides(group: list[tuple], lanes: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the right block, equal slots with all rows of the left block; −1 within a component)."""
    block = np.array([r[3] for r in group])
    left, right = np.flatnonzero(block == group[0][1]), np.flatnonzero(block == group[0][2])
    sig = np.array(lanes, np.int64).view(np.uint64)
    for at in range(0, len(right), 256):
        few = right[at : at + 256]
        equal = equal_slots(sig[few], sig[left])
        equal[part[few][:, None] == part[left][None, :]] = -1
        for row, counts in zip(few.tolist(), equal, strict=True):
            yield row, left, counts


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


#: What a meeting reads: its key, then the document.
_MEETING = ["value", "left", "right", "block", "id", "component", "sig"]


def _families(rows: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(value, id, component, sig): the documents of ``rows`` with a candidate in another component of a bucket; value is now their family."""
    enough = least_equal(percent / 100)

    def hopeful(found: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(found):
            names, part = np.unique([r[5] for r in group], return_inverse=True)
            root, seen = list(range(len(names))), set()
            for row, left, counts in _sides(group, [list(r[6].values()) for r in group], part):
                close = left[counts >= enough]
                if len(close):
                    seen.add(row)
                    seen.update(close.tolist())
                    for other in np.unique(part[close]).tolist():
                        root[_find(root, other)] = _find(root, int(part[row]))
            for row in seen:
                yield group[row][4], int(names[part[row]]), int(names[_find(root, int(part[row]))])

    met = map_rows(_met(rows, block_rows).select(*_MEETING), hopeful, "id long, component long, root long").distinct()
    met = cut(met)
    # every component here has a partner, so it is an end of an edge
    family = connected_components(met.select(F.col("component").alias("u"), F.col("root").alias("v")))
    family = family.select(F.col("id").alias("component"), F.col("component").alias("value"))
    return met.select("id", "component").distinct().join(family, "component").join(rows.select("id", "sig").dropDuplicates(["id"]), "id").select("value", "id", "component", "sig")


def _completed(rows: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(u, v): components of a family (value, id, component, sig) with a link between them, one row per component and meeting."""
    enough = least_equal(percent / 100)

    def linked(found: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(found):
            names, part = np.unique([r[5] for r in group], return_inverse=True)
            root = list(range(len(names)))
            held = [np.frombuffer(r[7], np.uint64) for r in group]
            for row, left, counts in _sides(group, [list(r[6].values()) for r in group], part):
                near = np.flatnonzero(counts >= enough)
                for at in near[np.argsort(-counts[near], kind="stable")].tolist():
                    other = int(left[at])
                    x, y = _find(root, int(part[row])), _find(root, int(part[other]))
                    if x != y and similar(held[row], held[other], percent):
                        root[x] = y
            for i in range(len(names)):
                if (top := _find(root, i)) != i:
                    yield int(names[i]), int(names[top])

    with_sets = _met(rows, block_rows, sets).select(*_MEETING, "shingles")
    return map_rows(with_sets, linked, "u long, v long")


def _components(docs: DataFrame, texts: DataFrame, rows: DataFrame, width: int, percent: int, block_rows: int) -> DataFrame:
    """(id, component) of the texts with a link; ``rows`` (value, id, sig) are the buckets with several texts."""
    lead = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "sig")).alias("lead")
    # the same text leads most buckets of a group, so a group's documents have few distinct leaders
    star = rows.join(rows.groupBy("value").agg(lead), "value").where(F.col("id") != F.col("lead.id"))
    star = star.withColumn("equal", _equal_slots_of("sig", "lead.sig")).where(F.col("equal") >= least_equal(percent / 100))
    pairs = cut(star.select("id", F.col("lead.id").alias("leader")).distinct())
    wanted, n_wanted = cut_counted(texts.select("id", "h", "g").join(rows.select("id").distinct(), "id"))
    sets = cut(_sets(docs, wanted, n_wanted, width))
    led = cut(_led(cut(_confirmed(pairs, sets, percent))))
    named = rows.join(led, "id", "left").withColumn("component", F.coalesce("component", "id"))
    families = cut(_families(cut(named), percent, block_rows))
    # a link between components is a candidate within a family, so these edges are all that is missing
    joined = connected_components(_completed(families, sets, percent, block_rows))
    joined = cut(joined.select(F.col("id").alias("component"), F.col("component").alias("top")))
    # a leader that follows nobody stands for itself
    named = led.unionByName(fresh(joined).select(F.col("component").alias("id"), F.col("component")).join(led, "id", "left_anti"))
    return named.join(joined, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs`` (columns doc_id, text).

    Documents link if 100 · intersection ≥ percent · union of their sets of ``width``-word shingles (lower-cased,
    A–Z). component_id is the smallest doc_id reachable over links; kept tells whether it is the row's own. A null text
    is empty; a text without words has no shingles and is linked with nothing, copies of it neither. A row
    without doc_id takes part, gets the class's smallest id (null if there is none) and is kept only if there
    is none. Rows that share a doc_id are documents of their own, and repeated rows stay repeated. Other columns are
    not looked at.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie in 1..100")
    marked = cut(signatures(docs, width))
    texts = marked.where("n_shingles > 0").groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    banded = texts.select("id", F.explode("bands").alias("value"))
    shared = banded.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    rows, n_rows = cut_counted(banded.join(shared, "value").join(texts.select("id", "sig"), "id"))
    parts = texts.select("id", "h", "g", "least")
    if n_rows:
        parts = parts.join(_components(docs, texts, rows, width, percent, block_rows), "id", "left")
        parts = cut(parts.withColumn("component", F.coalesce("component", "id")))
    else:
        parts = parts.withColumn("component", F.col("id"))
    smallest = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = parts.join(smallest, "component").select("h", "g", "component_id")
    found = marked.where("n_shingles > 0").select("doc_id", "h", "g", "n_shingles").join(classes, ["h", "g"])
    lone = marked.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = [c.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")) for c in (found, lone)]
    return out[0].unionByName(out[1])


def _led(links: DataFrame) -> DataFrame:
    """(id, component): the leader's leader or the leader of every id that has one, over confirmed links (u leads v)."""
    up = cut(links.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("up")))
    above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
    return up.join(fresh(above), "up", "left").select("id", F.coalesce("top", "up").alias("component"))
