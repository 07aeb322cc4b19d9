"""Near-duplicate documents by 64-bit SimHash, linked through BK-trees.

Equal fingerprints collapse first. Two fingerprints that differ in at most ``max_bits`` bits agree in at
least ``pieces - max_bits`` of ``pieces`` bit ranges, so every link lies inside a shard of fingerprints
that agree in such a choice of ranges. A shard is a BK-tree (children keyed by their whole-number
Hamming distance to the parent) and a query follows only the edges within the radius. Shards above
``block_rows`` are cut into blocks whose trees meet the blocks pair by pair in separate tasks, so a
shard that holds a third of all rows is neither dropped nor handled by one task. A tree has at most
about two blocks of rows; that is what one task holds. Trees are sent to their queries by an equi-join on the shard and not by
one broadcast, since all trees together grow with the data.

A block hands back a spanning forest of its links: components keep every link between different texts
without listing all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows
from catalogmap.operators.graph import connected_components
from catalogmap.session import cut, cut_counted

BITS = 64
SEED = 42
#: Shingles hashed at once; a longer text is summed block by block.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one whole text, unsigned; 0 for a text without words (or null)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        part = [digest(joined[a:b], SEED) for a, b in zip(lo[at : at + STEP], hi[at : at + STEP], strict=True)]
        octets = np.array(part, ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


class BkForest:
    """One BK-tree per shard over rows sorted by shard, built and searched a level at a time."""

    def __init__(self, values: np.ndarray, shard: np.ndarray) -> None:
        self.values = values
        n = len(values)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]  # of the row's own shard
        waiting = np.flatnonzero(~first)
        parent = self.root[waiting]
        edges, children = [], []
        while len(waiting):
            edge = parent * (BITS + 1) + np.bitwise_count(values[waiting] ^ values[parent])
            taken, at, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(waiting[at])
            down = np.ones(len(waiting), bool)
            down[at] = False
            parent = waiting[at][which][down]
            waiting = waiting[down]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, row) of every row within ``radius``, level by level."""
        q, node = np.arange(len(queries)), roots
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            base = node * (BITS + 1)
            lo = np.searchsorted(self.edge, base + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, base + np.minimum(d + radius, BITS), "right")
            reach = hi - lo
            starts = np.repeat(lo - np.concatenate(([0], np.cumsum(reach)[:-1])), reach)
            node = self.child[starts + np.arange(len(starts))]
            q = np.repeat(q, reach)


def _forest_links(group: np.ndarray, side: np.ndarray, own: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group.

    A group with ``own`` set searches its tree with its own rows; another searches the tree of its side 0
    with the rows of its side 1. Queries come in growing shares, so that the first ones merge most of a
    dense group and the later ones bring few new links.
    """
    order = np.lexsort((values, side, group))
    group, side, own, values = group[order], side[order], own[order], values[order]
    tree = own | (side == 0)
    rows = np.flatnonzero(tree)
    forest = BkForest(values[rows], group[rows])
    asks = np.flatnonzero(own | (side == 1))
    at = np.searchsorted(group[rows], group[asks])
    there = at < len(rows)
    there[there] = group[rows][at[there]] == group[asks][there]
    asks, at = asks[there], at[there]
    # one query of each group comes first, then twice as many, and so on
    starts = np.ones(len(asks), bool)
    starts[1:] = group[asks][1:] != group[asks][:-1]
    rank = np.arange(len(asks)) - np.flatnonzero(starts)[np.cumsum(starts) - 1] if len(asks) else asks
    turn = np.argsort(rank, kind="stable")
    asks, at, rank = asks[turn], at[turn], rank[turn]
    label = np.arange(len(values))
    us, vs = [], []
    done, width = 0, 1
    while done < len(asks):
        end = min(len(asks), max(done + 1, int(np.searchsorted(rank, width)), 0), done + 256 * max(1, int(starts.sum()) // 64))
        part = slice(done, end)
        for q, node in forest.near(values[asks[part]], at[part], radius):
            a, b = asks[part][q], rows[node]
            la, lb = label[a], label[b]
            new = la != lb
            if not new.any():
                continue
            pair = np.unique(np.stack([np.minimum(la, lb)[new], np.maximum(la, lb)[new]], 1), axis=0, return_index=True)[1]
            a, b = a[new][pair], b[new][pair]
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            for i, j, x, y in zip(a.tolist(), b.tolist(), label[a].tolist(), label[b].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    us.append(i)
                    vs.append(j)
            if root:
                keys = np.array(sorted(root), np.int64)
                to = np.array([find(int(x)) for x in keys], np.int64)
                place = np.minimum(np.searchsorted(keys, label), len(keys) - 1)
                label = np.where(keys[place] == label, to[place], label)
        done = end
        width *= 2
    return values[us], values[vs]


def _links(max_bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        cols = ("choice", "value", "low", "high", "block", "fp")

        def settle(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            group = np.concatenate(([0], np.cumsum(change)))
            u, v = _forest_links(group, (rows[:, 4] != rows[:, 2]).astype(int), rows[:, 2] == rows[:, 3], rows[:, 5].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols], 1)
            held = new if held is None else np.concatenate([held, new])
            if not len(held):
                continue
            last = np.flatnonzero(np.any(held[1:, :4] != held[:-1, :4], axis=1))
            if len(last):  # all groups but the last are complete
                yield settle(held[: last[-1] + 1])
                held = held[last[-1] + 1 :]
        if held is not None and len(held):
            yield settle(held)

    return run


def choose_pieces(count: int, max_bits: int, block_rows: int) -> int:
    """The least number of bit ranges with shards that fit a block when fingerprints are spread evenly."""
    for pieces in range(max_bits + 1, max_bits + 5):
        agreeing = BITS * (pieces - max_bits) // pieces
        if count >> agreeing <= block_rows // 2:
            break
    return pieces


def linked_fingerprints(distinct: DataFrame, count: int, max_bits: int = 4, block_rows: int = 4096) -> DataFrame:
    """(u, v): links between the fingerprints of ``distinct`` (column fp) that connect all that are near.

    ``max_bits`` lies in 0..31, so that at least one range of two bits or more agrees.
    """
    if not 0 <= max_bits < 32:
        raise ValueError("max_bits must lie in 0..31")
    pieces = choose_pieces(count, max_bits, block_rows)
    bounds = [BITS * i // pieces for i in range(pieces + 1)]
    shards = []
    for number, choice in enumerate(combinations(range(pieces), pieces - max_bits)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in choice)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        shards.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    spread = distinct.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.choice", "s.value")
    sizes = spread.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if pieces == max_bits + 1 and (max_bits + 1) << (BITS // pieces + 1) <= 1 << 17:
        sizes = F.broadcast(sizes)  # at most one row for each value of each range
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    placed = spread.join(sizes, ["choice", "value"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = placed.select("choice", "value", "block", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("choice", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    key = ["choice", "value", "low", "high"]
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links(max_bits), "u long, v long")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            h = fingerprint(text, shingle)
            yield doc_id, h - (1 << BITS) if h >> (BITS - 1) else h

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, block_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs`` (columns doc_id, text).

    component_id is the smallest doc_id that can be reached over links, the own one included. A null or
    empty text has fingerprint zero and links like any other. A row without doc_id takes part and gets
    the class's smallest id, null if the class has none. Repeated rows stay repeated. Other columns of
    ``docs`` are not looked at.
    """
    marked = cut(fingerprints(docs, shingle))
    distinct, count = cut_counted(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked_fingerprints(distinct, count, max_bits, block_rows))
    rooted = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(classes, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(members, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
