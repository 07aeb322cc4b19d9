"""Neighbour-graph operators: core distance, mutual reachability, components, spanning forest.

The loops work on shrinking tables that are cut to the scratch folder in every round. A round joins
on node ids; a hub that touches a third of all edges is reduced by map-side minima and its join
partition is split by adaptive execution, since the other side has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.session import cut, cut_counted, shuffled

MAX_ROUNDS = 80


def core_distances(near: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th nearest other row.

    In a table with fewer rows the last rank in ``near`` stands in; ``near`` must otherwise hold
    ``min_samples`` ranks.
    """
    return near.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("dist").alias("core"))


def undirected(near: DataFrame) -> DataFrame:
    """(u, v, dist) with u < v, one row per linked pair."""
    return (
        near.select(F.least("id", "near").alias("u"), F.greatest("id", "near").alias("v"), "dist")
        .groupBy("u", "v")
        .agg(F.min("dist").alias("dist"))
    )


def mutual_reachability(near: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, w): w is the greatest of both core distances and the distance."""
    cu = core.select(F.col("id").alias("u"), F.col("core").alias("_cu"))
    cv = core.select(F.col("id").alias("v"), F.col("core").alias("_cv"))
    return undirected(near).join(shuffled(cu), "u").join(shuffled(cv), "v").select(
        "u", "v", F.greatest("dist", "_cu", "_cv").alias("w")
    )


def _both_ways(edges: DataFrame, *rest: str) -> DataFrame:
    return edges.select(F.col("a"), F.col("b"), *rest).unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    )


def follow_pointers(pointers: DataFrame) -> DataFrame:
    """(a, root) from (a, p): pointer jumping to the fixed points, which have p = a."""
    current = pointers
    for _ in range(MAX_ROUNDS):
        for _ in range(2):  # two jumps per written round; the last one shows whether anything moved
            hop = current.select(F.col("a").alias("p"), F.col("p").alias("_pp"))
            current = current.select("a", "p").join(shuffled(hop), "p").select("a", "_pp", (F.col("_pp") != F.col("p")).alias("moved"))
            current = current.withColumnRenamed("_pp", "p")
        current, moved = cut_counted(current, F.col("moved"))
        if not moved:
            return current.select("a", F.col("p").alias("root"))
    raise RuntimeError("pointer jumping did not settle")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the smallest id of the connected part.

    ``edges`` has u and v. In every round a node joins the neighbour (or itself) with the least
    hashed priority and equal edges merge, so the graph shrinks by a constant share on average
    whatever its shape; the rounds' mappings are composed at the end.
    """
    live, n_live = cut_counted(
        edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()
    )
    every = live.select(F.col("a").alias("id")).union(live.select("b"))
    if nodes is not None:
        every = every.union(nodes.select("id"))
    labels = every.distinct().withColumn("c", F.col("id"))
    for step in range(MAX_ROUNDS):
        if not n_live:
            break
        priority = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("n"))
        best = cut(
            _both_ways(live)
            .groupBy("a")
            .agg(F.min(priority("b")).alias("m"))
            .select("a", F.least(F.col("m"), priority("a"))["n"].alias("m"))
        )
        for _ in range(2):  # follow the choices: still inside the component, and paths shorten faster
            hop = best.select(F.col("a").alias("m"), F.col("m").alias("_mm"))
            best = best.join(shuffled(hop), "m").select("a", F.col("_mm").alias("m"))
        best = cut(best)
        ma = best.withColumnRenamed("m", "ma")
        mb = best.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        moved = live.join(shuffled(ma), "a").join(shuffled(mb), "b").where("ma <> mb")
        live, n_live = cut_counted(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
        labels = labels.join(shuffled(best.withColumnRenamed("a", "c")), "c", "left").select("id", F.coalesce("m", "c").alias("c"))
        if step % 4 == 3:
            labels = cut(labels)
    else:
        raise RuntimeError("components did not settle")
    labels = cut(labels)
    smallest = labels.groupBy("c").agg(F.min("id").alias("component"))
    return labels.join(shuffled(smallest), "c").select("id", "component")


def edge_key(w: str = "w", u: str = "u", v: str = "v"):
    """Total order of edges: weight, then the two ends."""
    return F.struct(F.col(w).alias("w"), F.col(u).alias("u"), F.col(v).alias("v"))


def min_spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w): the minimum spanning forest, by Borůvka rounds on a contracted edge table."""
    live, n_live = cut_counted(
        edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), edge_key().alias("e"))
    )
    chosen: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if not n_live:
            break
        pick = cut(least_edges(_both_ways(live, "e")))
        new = pick.select("e").distinct()
        chosen = new if chosen is None else chosen.unionByName(new)
        roots = follow_pointers(rooted(pick))
        ra = roots.withColumnRenamed("root", "ra")
        rb = roots.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        moved = live.join(shuffled(ra), "a").join(shuffled(rb), "b").where("ra <> rb")
        live, n_live = cut_counted(
            moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e"))
        )
    else:
        raise RuntimeError("spanning forest did not settle")
    if chosen is None:
        return edges.select("u", "v", "w").limit(0)
    return cut(chosen.select("e.u", "e.v", "e.w"))


def least_edges(arcs: DataFrame, *rest: str) -> DataFrame:
    """(a, e, b, rest…): the least edge that leaves each node."""
    best = F.min(F.struct("e", "b", *rest)).alias("m")
    return arcs.groupBy("a").agg(best).select("a", "m.e", "m.b", *[f"m.{r}" for r in rest])


def rooted(pick: DataFrame) -> DataFrame:
    """(a, p): every node points along its least edge; the smaller end of a mutual pair is the root."""
    back = pick.select(F.col("a").alias("b"), F.col("b").alias("_back"))
    mutual = (F.col("_back") == F.col("a")) & (F.col("a") < F.col("b"))
    return pick.join(shuffled(back), "b", "left").select("a", F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("p"))
