"""Blocks of near rows with a ball around each, and the pairs of blocks that a search has to look at.

Rows go to the cell of their nearest pivot. A cell that is too large is split by pivots of its own, and so on, so that
every block is a compact set of rows. A block's ball (centre, radius) bounds all distances to its rows from one distance
to the centre. A search compares balls first, cell by cell and then block by block, and only pairs of blocks that may
hold an answer are joined with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from catalogmap.operators.ranking import top_k_per_group
from catalogmap.session import cut, cut_counted, fresh

#: Pivots of a cell that is split, levels of splitting (beyond, a hash splits), rows of a cell per task.
FAN, MAX_LEVELS, SPLIT_ROWS = 256, 6, 1 << 16
#: Partner blocks that one task looks at for one block.
PART_BLOCKS = 64
#: Partners that a block meets before the others are chosen, where there are so many blocks.
FIRST, MANY_BLOCKS = 4, 32
#: A block is parted if its parts' radii are at most this share of its own; so few rows are not.
COMPACT, FEW_ROWS = 0.7, 8
SLACK = 1e-6
#: Rows of query blocks that a task holds, groups of a smaller table, rows of one product, pairs compared at a time.
GROUP_ROWS, GROUPS, TILE_ROWS, PAIRS_AT_ONCE = 1 << 15, 16, 256, 1 << 16


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as one matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def runs_of(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Stretches of rows with equal keys."""
    n = len(keys[0])
    if not n:
        return
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Consecutive rows with equal keys, over the borders of batches: (key, pieces of each column)."""
    now, held = None, {}
    for batch in batches:
        arrays = [batch.column(k).to_pandas().to_numpy() for k in keys]
        for lo, hi in runs_of(arrays):
            key = tuple(a[lo] for a in arrays)
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, {c: [] for c in columns}
            for c in columns:
                held[c].append(batch.column(c).slice(lo, hi - lo))
    if now is not None:
        yield now, held


def joined_matrix(pieces: list[pa.Array]) -> np.ndarray:
    return np.concatenate([matrix_of(p) for p in pieces])


def joined_values(pieces: list[pa.Array]) -> np.ndarray:
    return np.concatenate([p.to_pandas().to_numpy() for p in pieces])


@dataclass
class Cells:
    """The first level: at most as many rows as there are pivots."""

    number: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def upper(self, center: np.ndarray, k: int) -> float:
        """A bound of the distance from ``center`` to its k-th nearest row."""
        far = np.sqrt(((self.center - center) ** 2).sum(1)) + self.radius
        order = np.argsort(far)
        enough = np.flatnonzero(np.cumsum(self.rows[order]) >= k)
        return float(far[order[enough[0]]]) if len(enough) else float("inf")


def first_cells(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    """The cells of ``assigned`` (cell, r), one row per pivot."""
    found = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).toPandas()
    number = found["cell"].to_numpy("int64")
    return Cells(number, pivots[number], found["r"].to_numpy("float64"), found["n"].to_numpy("int64"))


def _children(rows: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """The rows of the large nodes under the names of their children."""
    from catalogmap.operators.neighbors import distances

    large = rows.join(sizes, "node")
    order = [F.xxhash64("id", F.lit(level)), F.col("id")]
    some = top_k_per_group(large, ["node"], order, FAN, "rank").where(F.col("rank") <= F.col("wanted"))
    salts = F.ceil(F.col("n") / SPLIT_ROWS).cast("int")
    lead = some.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("side", F.lit(0))
    body = large.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).withColumn("side", F.lit(1))
    columns = ["node", "salt", "side", "cell", "id", "vec"]
    ordered = lead.select(*columns).unionByName(body.select(*columns)).repartition("node", "salt").sortWithinPartitions("node", "salt", "side", "id")
    out = rows.select("node", "cell", "id", "vec")
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, pivots, named = None, [], np.zeros((0, 0))
        for batch in batches:
            keys = [batch.column(c).to_pandas().to_numpy() for c in ("node", "salt", "side")]
            for lo, hi in runs_of(keys):
                part, node = batch.slice(lo, hi - lo), keys[0][lo]
                if (node, keys[1][lo]) != where:
                    where, pivots = (node, keys[1][lo]), []
                if keys[2][lo] == 0:
                    pivots.append(matrix_of(part.column("vec")))
                    named = np.concatenate(pivots)
                    continue
                child = distances(matrix_of(part.column("vec")), named).argmin(1)
                names = pa.array([f"{node}.{c}" for c in child.tolist()])
                yield pa.RecordBatch.from_arrays([names, *[part.column(c) for c in ("cell", "id", "vec")]], schema=schema)

    return ordered.mapInArrow(run, out.schema)


def nested_blocks(assigned: DataFrame, block_rows: int) -> DataFrame:
    """(block, cell, id, vec): the rows of ``assigned`` (cell, id, vec) in blocks of at most about ``block_rows``."""
    rows = assigned.select(F.col("cell").cast("string").alias("node"), "cell", "id", "vec")
    done = None
    for level in range(MAX_LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
        sizes, n_large = cut_counted(sizes.withColumn("wanted", F.ceil(F.col("n") * 2 / block_rows) + 1))
        if not n_large:
            break
        small = rows.join(sizes.select("node"), "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        if level < MAX_LEVELS:
            rows = cut(_children(rows, sizes, level))
        else:  # rows so dense that pivots do not part them
            parts = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows))
            rows = rows.join(sizes, "node").select(F.concat_ws("#", "node", parts.cast("string")).alias("node"), "cell", "id", "vec")
    return cut(_parted(rows if done is None else done.unionByName(rows)))


def _halves(y: np.ndarray) -> np.ndarray | None:
    """Which rows are nearer to the first of two far apart seeds, moved once towards the halves' means."""
    seed = y[((y - y.mean(0)) ** 2).sum(1).argmax()]
    seeds = seed, y[((y - seed) ** 2).sum(1).argmax()]
    for _ in range(2):
        left = ((y - seeds[0]) ** 2).sum(1) <= ((y - seeds[1]) ** 2).sum(1)
        if left.all() or not left.any():
            return None
        seeds = y[left].mean(0), y[~left].mean(0)
    return left


def bisected(x: np.ndarray) -> np.ndarray:
    """The number of the compact part of each row.

    Rows are halved down to a few; halves stay apart where the balls of their parts are, on average over the rows, much
    smaller than the common ball.
    """

    def parts(rows: np.ndarray, depth: int) -> tuple[list[np.ndarray], float]:
        y = x[rows]
        radius = float(np.sqrt(((y - y.mean(0)) ** 2).sum(1).max()))
        left = _halves(y) if len(rows) > FEW_ROWS and radius > 0 and depth < 16 else None
        if left is None:
            return [rows], radius * len(rows)
        a, b = parts(rows[left], depth + 1), parts(rows[~left], depth + 1)
        if a[1] + b[1] <= COMPACT * radius * len(rows):
            return a[0] + b[0], a[1] + b[1]
        return [rows], radius * len(rows)

    label = np.zeros(len(x), np.int64)
    for number, rows in enumerate(parts(np.arange(len(x)), 0)[0]):
        label[rows] = number
    return label


def _parted(rows: DataFrame) -> DataFrame:
    """(block, cell, id, vec): the nodes of ``rows`` as blocks, loose ones in their compact parts."""
    out = rows.select(F.col("node").alias("block"), "cell", "id", "vec")
    schema = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node,), held in grouped(batches, ["node"], ["cell", "id", "vec"]):
            part = bisected(joined_matrix(held["vec"])).tolist()
            at = 0
            for cell, ids, vec in zip(held["cell"], held["id"], held["vec"], strict=True):
                names = pa.array([f"{node}/{p}" for p in part[at : at + len(ids)]])
                at += len(ids)
                yield pa.RecordBatch.from_arrays([names, cell, ids, vec], schema=schema)

    return rows.repartition("node").sortWithinPartitions("node").select("node", "cell", "id", "vec").mapInArrow(run, out.schema)


BALL = "block string, cell int, n long, center array<double>, radius double, extent double"


def balls(rows: DataFrame, cells: Cells, k: int, own: bool) -> DataFrame:
    """One row per block of ``rows`` (block, cell, id, vec): BALL.

    extent bounds, from the block's centre, how far away the k nearest rows of its members may be: no row beyond it
    is among the answers. With ``own`` the block is part of the searched rows and tells more than the cells do.
    """
    from catalogmap.operators.neighbors import distances

    sent = rows.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("block", pa.string()), ("cell", pa.int32()), ("n", pa.int64()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("extent", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, cell), held in grouped(batches, ["block", "cell"], ["vec"]):
            x = joined_matrix(held["vec"])
            center = x.mean(0)
            r = np.sqrt(((x - center) ** 2).sum(1))
            reach = r + sent.value.upper(center, k + own)
            if own and len(x) > k:
                d = distances(x, x)
                np.fill_diagonal(d, np.inf)
                reach = np.minimum(reach, np.partition(d, k - 1, axis=1)[:, k - 1])
            line = [block], [cell], [len(x)], [center.tolist()], [float(r.max())], [float((r + reach).max())]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(line, schema, strict=True)], schema=schema)

    ordered = rows.select("block", "cell", "vec").repartition("block").sortWithinPartitions("block")
    return cut(ordered.mapInArrow(run, BALL))


def block_pairs(asking: DataFrame, asked: DataFrame, cells: Cells) -> DataFrame:
    """(i, j, gap, extent): pairs of balls in which j may hold an answer for i; gap bounds the distance from i's centre to j's rows."""
    sent = asking.sparkSession.sparkContext.broadcast(cells)

    def near_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for pdf in batches:
            for block, center, extent in zip(pdf["block"], pdf["center"], pdf["extent"], strict=True):
                gap = np.sqrt(((known.center - np.asarray(center)) ** 2).sum(1)) - known.radius
                hit = known.number[gap <= extent + SLACK]
                yield pd.DataFrame({"i": block, "ci": [center] * len(hit), "extent": extent, "cell": hit.astype("int32")})

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gap = np.sqrt(((np.vstack(pdf["ci"]) - np.vstack(pdf["cj"])) ** 2).sum(1)) - pdf["radius"].to_numpy()
                kept = pdf.assign(gap=gap)[gap <= pdf["extent"].to_numpy() + SLACK]
                yield kept[["i", "j", "gap", "extent"]]

    sides = asking.select("block", "center", "extent").mapInPandas(near_cells, "i string, ci array<double>, extent double, cell int")
    others = asked.select("cell", F.col("block").alias("j"), F.col("center").alias("cj"), "radius")
    return cut(sides.join(fresh(others), "cell").mapInPandas(close, "i string, j string, gap double, extent double"))


class _Side:
    """A block of queries and what it has found so far."""

    def __init__(self, held: dict[str, list], k: int, skip_self: bool) -> None:
        self.k, self.skip_self = k, skip_self
        self.ids, self.x = joined_values(held["id"]), joined_matrix(held["vec"])
        self.center = self.x.mean(0)
        self.near_center = self.x - self.center
        self.xx = (self.near_center**2).sum(1)
        self.r = np.sqrt(self.xx)
        self.reach = np.fmin(joined_values(held["extent"])[0] - self.r, joined_values(held["reach"]).astype("float64"))
        self.best = np.full((len(self.x), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, gap: float, ids: np.ndarray, y: np.ndarray) -> None:
        """Products of single precision only narrow the choice, by the error they may have; the differences decide."""
        rows = np.flatnonzero(gap <= self.r + self.reach + SLACK)
        if not len(rows):
            return
        far = y - self.center
        yy = (far**2).sum(1)
        number = np.float32 if max(self.xx.max(), yy.max()) < 1e30 else np.float64
        far, short = far.astype(number).T, yy.astype(number)
        error = (y.shape[1] + 8) * 2 * float(np.finfo(number).eps)
        for lo in range(0, len(rows), TILE_ROWS):
            at = rows[lo : lo + TILE_ROWS]
            d2 = (-2.0 * self.near_center[at]).astype(number) @ far
            d2 += self.xx[at].astype(number)[:, None]
            d2 += short[None, :]
            a, b = self._choice(d2, at, error * (self.xx[at] + yy.max()))
            if self.skip_self:
                other = self.ids[at[a]] != ids[b]
                a, b = a[other], b[other]
            if len(a):
                self._take(at, a, b, ids, y)

    def _choice(self, d2: np.ndarray, at: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``d2`` that may lie within the reach of their rows or, where these are many, among the k nearest."""
        limit = ((self.reach[at] + SLACK) ** 2 + error) * (1 + 1e-6)
        close = d2 <= limit[:, None].astype(d2.dtype)
        some = self.k + self.skip_self
        if some < d2.shape[1] and np.count_nonzero(close) > 4 * some * len(at):
            low = np.partition(d2, some - 1, axis=1)[:, some - 1].astype("float64")
            # the k-th distance itself stays in, so that ties are settled by id
            low = ((np.sqrt(np.maximum(low, 0) + error) + SLACK) ** 2 + error) * (1 + 1e-6)
            close = d2 <= np.minimum(limit, low)[:, None].astype(d2.dtype)
        return np.divmod(np.flatnonzero(close), d2.shape[1])

    def _take(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        pieces = [slice(lo, lo + PAIRS_AT_ONCE) for lo in range(0, len(a), PAIRS_AT_ONCE)]
        exact = np.concatenate([np.sqrt(((self.x[at[a[p]]] - y[b[p]]) ** 2).sum(1)) for p in pieces]).round(9)
        kept = exact <= self.reach[at[a]] + SLACK
        a, b, exact = a[kept], b[kept], exact[kept]
        if not len(a):
            return
        self.found.append((at[a], ids[b], exact))
        self.waiting += len(a)
        many = np.bincount(a, minlength=len(at))
        placed = np.full((len(at), many.max()), np.inf)
        placed[a, np.arange(len(a)) - (np.cumsum(many) - many)[a]] = exact
        top = np.partition(np.concatenate([self.best[at], placed], axis=1), self.k - 1, axis=1)[:, : self.k]
        self.best[at] = top
        self.reach[at] = np.minimum(self.reach[at], top.max(1))
        if self.waiting > 16 * self.k * len(self.x) + PAIRS_AT_ONCE:
            self.found = [self._least()]
            self.waiting = len(self.found[0][0])

    def _least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, near, dist): the k best of every row, ties by id."""
        row, near, dist = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((near, dist, row))
        row, near, dist = row[order], near[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.x)))[row] < self.k
        return row[keep], near[keep], dist[keep]

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, near, dist): the k best of every row, ties by id."""
        if not self.found:
            return self.ids[:0], self.ids[:0], np.zeros(0)
        row, near, dist = self._least()
        return self.ids[row], near, dist


def _meetings(queries: DataFrame, points: DataFrame, dealt: DataFrame, k: int, skip_self: bool, answers: bool) -> DataFrame:
    """Every block of queries meets the partners that ``dealt`` (g, part, i, j, gap, extent) gives it, nearest first.

    The blocks of a group g are held together, so that a partner's rows come once per group. With ``answers`` the rows
    are (id, near, dist), else (i, id, reach, far): how far a row still has to look, from itself and from its block's centre.
    """
    # a query may have an id of another type than the points
    id_type, near_type = (df.schema["id"].dataType.simpleString() for df in (queries, points))
    ids, nears = (to_arrow_schema(df.select("id").schema).field(0).type for df in (queries, points))
    heads = fresh(dealt).groupBy("g", "part", "i").agg(F.first("extent").alias("extent"))
    reach = F.col("reach") if "reach" in queries.columns else F.lit(None).cast("double").alias("reach")
    lead = heads.join(queries.select(F.col("block").alias("i"), "id", "vec", reach), "i")
    meeting = fresh(dealt).groupBy("g", "part", "j").agg(F.min("gap").alias("gap"), F.collect_list(F.struct("i", "gap")).alias("who"))
    meeting = cut(meeting)
    body = meeting.drop("who").join(points.select(F.col("block").alias("j"), F.col("id").alias("near"), "vec"), "j")
    kinds = {
        "i": "string", "j": "string", "gap": "double", "id": id_type, "near": near_type, "vec": "array<double>", "extent": "double", "reach": "double",
        "who": "array<struct<i:string,gap:double>>",
    }
    columns = ["g", "part", "side", "gap", "j", "i", "id", "near", "vec", "extent", "reach", "who"]

    def filled(df: DataFrame, side: int) -> DataFrame:
        lacking = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns}
        return df.withColumns({**lacking, "side": F.lit(side)}).select(*columns)

    # side 0: the group's rows; side 1: who meets a partner, in a row without near ahead of the partner's rows
    lead = filled(lead.withColumn("gap", F.lit(0.0)).withColumn("j", F.lit("")), 0)
    ordered = lead.unionByName(filled(meeting.withColumn("i", F.lit("")), 1)).unionByName(filled(body.withColumn("i", F.lit("-")), 1))
    ordered = ordered.repartition("g", "part").sortWithinPartitions("g", "part", "side", "gap", "j", "i", "id", "near")

    def finished(sides: dict[str, _Side]) -> Iterator[pa.RecordBatch]:
        for i, side in sides.items():
            if answers:
                found = side.answers()
                yield pa.RecordBatch.from_arrays([pa.array(found[0].tolist(), ids), pa.array(found[1].tolist(), nears), pa.array(found[2], pa.float64())], names=["id", "near", "dist"])
            else:
                left = [pa.array([i] * len(side.x)), pa.array(side.ids.tolist(), ids), pa.array(side.reach), pa.array(side.r + side.reach)]
                yield pa.RecordBatch.from_arrays(left, names=["i", "id", "reach", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, where, who = {}, None, []
        for (g, part, number, _, _, i), held in grouped(batches, ["g", "part", "side", "gap", "j", "i"], ["id", "near", "vec", "extent", "reach", "who"]):
            if (g, part) != where:
                yield from finished(sides)
                sides, where = {}, (g, part)
            if number == 0:
                sides[i] = _Side(held, k, skip_self)
            elif not i:
                who = held["who"][0][0].as_py()
            else:
                near, y = joined_values(held["near"]), joined_matrix(held["vec"])
                for one in who:
                    sides[one["i"]].meet(one["gap"], near, y)
        yield from finished(sides)

    return ordered.mapInArrow(run, f"id {id_type}, near {near_type}, dist double" if answers else f"i string, id {id_type}, reach double, far double")


def tightened(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """``pairs`` that are left when every block has met its FIRST nearest partners: outliers then reach less far."""
    left = fresh(reach).groupBy("i").agg(F.max("far").alias("left"))
    return cut(pairs.join(left, "i").where(F.col("gap") <= F.col("left") + SLACK).select("i", "j", "gap", F.col("left").alias("extent")))


def block_groups(queries: DataFrame, cells: Cells, least: int) -> DataFrame:
    """(i, g): blocks of near cells in groups of at most about GROUP_ROWS rows, ``least`` or more of them."""
    sizes = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per pivot
    total = int(sizes["n"].sum())
    room = max(1, min(GROUP_ROWS, total // least))
    place = {c: i for i, c in enumerate(cells.number.tolist())}
    center = cells.center[[place.get(c, 0) for c in sizes["cell"].tolist()]]
    leads = cells.center[:: max(1, len(cells.center) * room // max(total, 1))]
    to_lead = np.stack([((center - one) ** 2).sum(1) for one in leads])
    nearest = to_lead.argmin(0)
    sizes = sizes.iloc[np.lexsort((to_lead.min(0), nearest))]
    before = np.cumsum(sizes["n"].to_numpy()) - sizes["n"].to_numpy()
    known = sizes.assign(at=before // room, split=-(-sizes["n"] // room))[["cell", "at", "split"]]
    known = queries.sparkSession.createDataFrame(known, "cell int, at bigint, split bigint")
    split = F.pmod(F.xxhash64("block"), F.col("split"))  # a cell with more rows than a group
    blocks = queries.select("block", "cell").distinct().join(F.broadcast(known), "cell")
    return cut(blocks.select(F.col("block").alias("i"), F.concat_ws("-", "at", split).alias("g")))


def search_pairs(queries: DataFrame, points: DataFrame, pairs: DataFrame, k: int, skip_self: bool, cells: Cells) -> DataFrame:
    """(id, near, dist): what may be among the k nearest; ``queries`` and ``points`` are (block, cell, id, vec).

    A group of query blocks meets its partners nearest first; partners beyond its present k-th distances are passed over.
    Many partners are dealt to several tasks.
    """
    groups = block_groups(queries, cells, GROUPS)
    blocks, met = pairs.agg(F.countDistinct("i"), F.count(F.lit(1))).first()
    if blocks >= MANY_BLOCKS and met > 3 * FIRST * blocks:
        first = top_k_per_group(pairs, ["i"], [F.col("gap"), F.col("j")], FIRST).join(groups, "i").withColumn("part", F.lit(0))
        reach = cut(_meetings(queries, points, cut(first), k, skip_self, False))
        pairs = tightened(pairs, reach)
        queries = cut(queries.join(reach.select("id", "reach"), "id", "left"))
    grouped_pairs = cut(pairs.join(groups, "i"))
    counts = fresh(grouped_pairs).groupBy("g").agg(F.countDistinct("j").alias("m"))
    dealt = grouped_pairs.join(counts, "g").withColumn("part", F.pmod(F.xxhash64("j"), F.ceil(F.col("m") / (2 * PART_BLOCKS))).cast("int"))
    return _meetings(queries, points, cut(dealt.select("g", "part", "i", "j", "gap", "extent")), k, skip_self, True)
