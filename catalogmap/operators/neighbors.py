"""Exact k-nearest-neighbour joins by blocks and distance bounds.

Every vector is put into the cell of its nearest pivot and large cells are split by pivots of their
own into compact blocks (see :mod:`balls`). The k-th distances inside a block bound the rest of its
search: by the triangle inequality it meets only the blocks whose balls can still hold a nearer vector.
Pairs of blocks are chosen by their balls alone; rows move by an equi-join on the block, and a task
returns k rows per query, never the pairs it looked at. Equal vectors are searched once, so a table
in which a third of the rows are copies does not fill one block with ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogmap.operators import balls
from catalogmap.operators.ranking import sample_exact, top_k_per_group
from catalogmap.session import cut, fresh, salt_of

BLOCK_ROWS = 1024
MAX_PIVOTS = 4096
MAX_BROADCAST_BYTES = 64 << 20
_DUP_SALTS = 32
#: Close pairs of rows whose difference is taken at a time.
CLOSE_PAIRS = 1 << 14
#: Queries whose results leave a task of scan_top_k at a time.
QUERIES_AT_ONCE = 512


def stack(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, into ``out`` if given; close pairs without cancellation."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    d2 = np.matmul(-2.0 * a, b.T, out=out)
    d2 += aa[:, None]
    d2 += bb[None, :]
    if d2.size:
        some = np.flatnonzero(d2.min(1) < 1e-6 * (aa + bb.max()))
        i, j = np.nonzero(d2[some] < 1e-6 * (aa[some, None] + bb[None, :]))
        for at in range(0, len(i), CLOSE_PAIRS):
            rows, cols = some[i[at : at + CLOSE_PAIRS]], j[at : at + CLOSE_PAIRS]
            d2[rows, cols] = ((a[rows] - b[cols]) ** 2).sum(1)
    return np.sqrt(d2, out=d2)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit rows with one more component, set only for a zero vector: it is then orthogonal to all."""
    n = np.linalg.norm(x, axis=1)
    zero = n == 0
    return np.hstack([x / np.where(zero, 1.0, n)[:, None], zero.astype("float64")[:, None]])


def _prepare(df: DataFrame, id_col: str, vec_col: str, metric: str) -> DataFrame:
    """(id, vec double): unit vectors for cosine."""
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    if metric == "euclidean":
        return base

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "vec": list(unit_rows(stack(pdf["vec"])))})

    return base.mapInPandas(unit, base.schema)


def _collapse(pts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(one row per distinct vector, all (id, rep) of repeated vectors or None when there are none)."""
    keyed = pts.withColumn("_h", F.xxhash64("vec"))
    groups = cut(
        keyed.groupBy("_h", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    )
    twins = groups.where("n > 1").select("_h", F.col("vec").alias("_v"), F.col("id").alias("rep"))
    if twins.isEmpty():
        return groups.select("id", "vec"), None
    # few groups, many copies: the group side is repeated per salt so a hot group's copies spread out
    salted = twins.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_DUP_SALTS - 1))))
    left = keyed.withColumn("_s", salt_of(_DUP_SALTS, "id"))
    on = (left["_h"] == salted["_h"]) & (left["_s"] == salted["_s"]) & (left["vec"] == salted["_v"])
    members = cut(left.join(salted, on).select("id", "rep"))
    return groups.select("id", "vec"), members


def pick_pivots(points: DataFrame, n: int, block_rows: int) -> np.ndarray:
    """A bounded index sample; it steers the search and never decides its result."""
    dim = points.select(F.size("vec").alias("n")).first()["n"]
    affordable = MAX_BROADCAST_BYTES // (8 * max(dim, 1))
    wanted = max(1, min(MAX_PIVOTS, affordable, math.ceil(n / block_rows)))
    return stack(pd.Series([r["vec"] for r in sample_exact(points, "id", wanted, 7).select("vec").collect()]))


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell (nearest pivot) and r (distance to it)."""
    pivot_table = points.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS rows
    schema = T.StructType(
        points.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())]
    )

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(stack(pdf["vec"]), pivot_table.value)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(cell)), cell])

    return points.mapInPandas(nearest, schema)


def split_cells(assigned: DataFrame, block_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """Cuts cells into blocks of about ``block_rows``: (rows with ``sub``, cell bounds).

    The bounds hold one row per pivot, so at most MAX_PIVOTS.
    """
    bounds = (
        assigned.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))
        .toPandas()
        .sort_values("cell")
        .reset_index(drop=True)
    )
    bounds["subs"] = np.ceil(bounds["n"] / block_rows).astype("int64").clip(lower=1)
    subs = assigned.sparkSession.createDataFrame(bounds[["cell", "subs"]], "cell int, subs bigint")
    rows = assigned.join(F.broadcast(subs), "cell").withColumn(
        "sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")
    )
    return rows.select("id", "vec", "cell", "r", "sub"), bounds


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    id_col: str = "book_id",
    vec_col: str = "vector",
) -> DataFrame:
    """Exact ``k`` nearest points of every query, an equal id excluded: (id, near, rank, dist).

    ``dist`` is Euclidean; for ``metric='cosine'`` it is taken between unit vectors, so the cosine
    is ``1 - dist² / 2``. Ties go to the smaller id.
    """
    q = _prepare(queries, id_col, vec_col, metric)
    p, members = _collapse(_prepare(points, id_col, vec_col, metric))
    same = queries is points
    if same:
        q = p
    else:
        q = cut(q)
    # k + 1: a query in another table may carry the id of a point it must skip
    found = _distinct_knn(q, p, k + (0 if same else 1), block_rows)
    if members is None:
        near = found
    else:
        near = _spread_copies(found, members, k, same)
    if queries.schema[id_col].dataType == points.schema[id_col].dataType:
        near = near.where(F.col("id") != F.col("near"))
    return top_k_per_group(near, ["id"], [F.col("dist"), F.col("near")], k, "rank").select(
        "id", "near", "rank", "dist"
    )


def _distinct_knn(q: DataFrame, p: DataFrame, k: int, block_rows: int) -> DataFrame:
    n = p.count()
    if n == 0:
        id_type, near_type = (df.schema["id"].dataType.simpleString() for df in (q, p))
        return p.sparkSession.createDataFrame([], f"id {id_type}, near {near_type}, dist double")
    pivots = pick_pivots(p, n, max(1, block_rows // 2))
    assigned = cut(assign_cells(p, pivots))
    cells = balls.first_cells(assigned, pivots)
    points = balls.nested_blocks(assigned, block_rows)
    of_points = balls.balls(points, cells, k, q is p)
    if q is p:
        return balls.search_pairs(points, points, balls.block_pairs(of_points, of_points, cells), k, True, cells)
    asked = balls.nested_blocks(cut(assign_cells(q, pivots)), block_rows)
    of_asked = balls.balls(asked, cells, k, False)
    return balls.search_pairs(asked, points, balls.block_pairs(of_asked, of_points, cells), k, False, cells)


def _route(asked: DataFrame, pivots: np.ndarray, bounds: pd.DataFrame, id_type: str) -> DataFrame:
    """Sends every query to the blocks whose cell may hold something within its reach."""
    cells = bounds["cell"].to_numpy()
    table = asked.sparkSession.sparkContext.broadcast(
        (pivots, cells, bounds["r_min"].to_numpy(), bounds["r_max"].to_numpy(), bounds["subs"].to_numpy())
    )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piv, cell, r_min, r_max, subs = table.value
        gap = distances(piv, piv)
        for pdf in batches:
            if not len(pdf):
                continue
            d = distances(stack(pdf["vec"]), piv)
            own = pdf["cell"].to_numpy()
            to_own = d[np.arange(len(own)), own][:, None]
            to_cell = d[:, cell]
            low = np.maximum(to_cell - r_max[None, :], r_min[None, :] - to_cell)
            between = gap[own][:, cell]
            with np.errstate(divide="ignore", invalid="ignore"):
                half = np.where(between > 0, (to_cell**2 - to_own**2) / (2.0 * between), 0.0)
            low = np.maximum(low, half)
            rows, cols = np.nonzero(low <= pdf["reach"].to_numpy()[:, None] + 1e-6)
            times = subs[cols]
            out_row = np.repeat(rows, times)
            out_sub = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out_cell = np.repeat(cell[cols], times)
            home_cell, home_sub = pdf["tcell"].to_numpy("float64"), pdf["tsub"].to_numpy("float64")
            fresh = ~((home_cell[out_row] == out_cell) & (home_sub[out_row] == out_sub))
            out_row = out_row[fresh]
            yield pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy()[out_row],
                    "vec": pdf["vec"].to_numpy()[out_row],
                    "chunk": pdf["chunk"].to_numpy()[out_row],
                    "tcell": out_cell[fresh].astype("int32"),
                    "tsub": out_sub[fresh].astype("int32"),
                }
            )

    return asked.mapInPandas(route, f"id {id_type}, vec array<double>, chunk string, tcell int, tsub int")


def _spread_copies(found: DataFrame, members: DataFrame, k: int, same: bool) -> DataFrame:
    """Turns neighbours of distinct vectors into neighbours of all rows.

    Only the k + 1 smallest ids of a group of copies can appear in a result, because the others lose
    every tie; so each group adds at most k + 1 candidates however many copies it has.
    """
    firsts = cut(
        top_k_per_group(members, ["rep"], [F.col("id")], k + 1, salt_on=["id"]).select(
            F.col("rep").alias("near"), F.col("id").alias("copy")
        )
    )
    near = found.join(firsts, "near", "left").select("id", F.coalesce("copy", "near").alias("near"), "dist")
    if not same:
        return near
    own = firsts.select(F.col("near").alias("id"), F.col("copy").alias("near"), F.lit(0.0).alias("dist"))
    lists = top_k_per_group(
        near.unionByName(own), ["id"], [F.col("dist"), F.col("near")], k + 1
    )
    per_rep = lists.groupBy("id").agg(F.collect_list(F.struct("near", "dist")).alias("_l"))  # k + 1 entries
    salted = per_rep.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_DUP_SALTS - 1))))
    copies = members.withColumn("_s", salt_of(_DUP_SALTS, "id"))
    for_copies = (
        copies.join(
            salted.withColumnRenamed("id", "rep").join(members.select("rep").distinct(), "rep", "left_semi"),
            ["rep", "_s"],
        )
        .select("id", F.explode("_l").alias("_e"))
        .select("id", "_e.near", "_e.dist")
    )
    singles = lists.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
    return singles.unionByName(for_copies)


def knn(df: DataFrame, k: int = 15, metric: str = "cosine", block_rows: int = BLOCK_ROWS, **cols: str) -> DataFrame:
    """Exact self-join: every row's ``k`` nearest other rows."""
    return knn_join(df, df, k, metric, block_rows, **cols)


def with_similarity(near: DataFrame) -> DataFrame:
    return near.withColumn("similarity", F.lit(1.0) - F.col("dist") * F.col("dist") / 2)


def scan_top_k(
    queries: DataFrame, points: DataFrame, k: int = 12, id_col: str = "book_id", vec_col: str = "vector"
) -> DataFrame:
    """Top-k by the distance of unit vectors, in one pass over the points: (id, near, rank, similarity).

    The queries are sent to all tasks when their measured size is below MAX_BROADCAST_BYTES; more of
    them take the block join instead.
    """
    q = cut(queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    size = q.agg(F.coalesce(F.sum(F.size("vec") * F.lit(8)), F.lit(0))).first()[0]
    if size > MAX_BROADCAST_BYTES:
        return with_similarity(
            knn_join(queries, points, k, "cosine", id_col=id_col, vec_col=vec_col)
        ).select("id", "near", "rank", "similarity")
    id_type = points.schema[id_col].dataType.simpleString()
    q_type = q.schema["id"].dataType.simpleString()
    if size == 0:
        return q.sparkSession.createDataFrame([], f"id {q_type}, near {id_type}, rank int, similarity double")
    rows = q.collect()
    sent = q.sparkSession.sparkContext.broadcast(
        (pd.Series([r["id"] for r in rows]).to_numpy(), unit_rows(stack(pd.Series([r["vec"] for r in rows])))[:, :-1])
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked = sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            near = pdf["near"].to_numpy()
            points_ = unit_rows(stack(pdf["vec"]))[:, :-1]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for n, (one, vec) in enumerate(zip(ids, asked), 1):  # one query at a time bounds the memory
                # the product only narrows the choice: it cannot tell near copies apart, the difference can
                sims = points_ @ vec
                sims[near == one] = -np.inf
                if len(sims) > k:
                    few = np.flatnonzero(sims >= np.partition(sims, -k)[-k] - 1e-9)
                else:
                    few = np.arange(len(sims))
                few = few[np.isfinite(sims[few])]
                dist = np.sqrt(((points_[few] - vec) ** 2).sum(1)).round(9)
                best = np.lexsort((near[few], dist))[:k]
                found.append((near[few][best], dist[best]))
                if len(found) == QUERIES_AT_ONCE or n == len(ids):
                    sizes = [len(d) for _, d in found]
                    of = np.repeat(ids[n - len(found) : n], sizes)
                    yield pd.DataFrame({"id": of, "near": np.concatenate([x for x, _ in found]), "dist": np.concatenate([d for _, d in found])})
                    found = []

    table = points.select(F.col(id_col).alias("near"), F.col(vec_col).alias("vec"))
    found = table.mapInPandas(scan, f"id {q_type}, near {id_type}, dist double")
    order = [F.col("dist"), F.col("near")]
    top = top_k_per_group(found, ["id"], order, k, "rank", salt_on=["near"])
    return with_similarity(top).select("id", "near", "rank", "similarity")
