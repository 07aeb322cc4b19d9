"""Assignment of arriving items to existing clusters, and views of clusters over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from catalogmap.functions.vectors import dot
from catalogmap.operators.neighbors import MAX_BROADCAST_BYTES, knn_join, stack, unit_rows, with_similarity


def assign_clusters(items: DataFrame, centroids: DataFrame, min_similarity: float = 0.0, vec_col: str = "vector", id_col: str = "book_id") -> DataFrame:
    """Adds cluster_id and similarity of the nearest centroid; −1 below ``min_similarity``.

    Works on a static and on a streaming frame (append mode, no state). The centroids go to the
    tasks when their measured size is within bounds; beyond it a static frame takes the block join.
    """
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid") * F.lit(8)), F.lit(0))).first()[0]
    if size > MAX_BROADCAST_BYTES:
        if items.isStreaming:
            raise ValueError("this many centroids meet a stream in assign_stream()")
        return _assign_by_join(items, centroids, min_similarity, vec_col, id_col)
    rows = centroids.orderBy("cluster_id").collect()
    ids = np.array([r["cluster_id"] for r in rows], "int32")
    table = items.sparkSession.sparkContext.broadcast(
        (ids, unit_rows(stack(pd.Series([r["centroid"] for r in rows])))[:, :-1])
    )
    schema = T.StructType(
        items.schema.fields + [T.StructField("cluster_id", T.IntegerType()), T.StructField("similarity", T.DoubleType())]
    )

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, cents = table.value
        for pdf in batches:
            if not len(pdf):
                continue
            if not len(labels):
                yield pdf.assign(cluster_id=np.int32(-1), similarity=0.0)
                continue
            sims = (unit_rows(stack(pdf[vec_col]))[:, :-1] @ cents.T).round(9)
            best = sims.argmax(1)
            top = sims[np.arange(len(best)), best]
            yield pdf.assign(cluster_id=np.where(top >= min_similarity, labels[best], -1).astype("int32"), similarity=top)

    return items.mapInPandas(nearest, schema)


def assign_stream(items: DataFrame, centroids: DataFrame, path: str, state: str, min_similarity: float = 0.0, vec_col: str = "vector", id_col: str = "book_id") -> DataStreamWriter:
    """A writer that assigns each micro-batch of ``items`` and stores it below ``path``; start it with a trigger.

    Any number of centroids: a micro-batch is a static frame and may take the block join. A batch has a
    folder of its own (``batch=n``) that a repeated run overwrites, so every row is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        assign_clusters(batch, centroids, min_similarity, vec_col, id_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(store).option("checkpointLocation", state)


def _assign_by_join(items: DataFrame, centroids: DataFrame, min_similarity: float, vec_col: str, id_col: str) -> DataFrame:
    cents = centroids.select((-F.col("cluster_id") - 1).cast("string").alias("_c"), F.col("centroid").alias(vec_col))
    asked = items.select(F.col(id_col).cast("string").alias("_c"), vec_col)
    # text ids: cluster numbers carry a sign, so that they never equal an item id
    near = with_similarity(
        knn_join(
            asked.select(F.concat(F.lit("i"), "_c").alias("_c"), vec_col),
            cents.select(F.concat(F.lit("c"), "_c").alias("_c"), vec_col),
            1, "cosine", id_col="_c", vec_col=vec_col,
        )
    )
    best = near.select(
        F.substring("id", 2, 1 << 20).cast(items.schema[id_col].dataType).alias(id_col),
        (-F.substring("near", 2, 20).cast("int") - 1).alias("_to"), F.round("similarity", 9).alias("similarity"),
    )
    cluster = F.when(F.col("similarity") >= min_similarity, F.col("_to")).otherwise(F.lit(-1))
    return items.join(best, id_col).withColumn("cluster_id", cluster).select(*items.columns, "cluster_id", "similarity")


def cluster_trend(assigned: DataFrame, ts_col: str = "ts", every: str = "1 day") -> DataFrame:
    """(window_start, cluster_id, n, share): how clusters grow or shrink over time slices."""
    return _shares(_slices(assigned, ts_col, every))


def trend_stream(assigned: DataFrame, path: str, state: str, ts_col: str = "ts", every: str = "1 day", late: str = "1 day") -> DataStreamWriter:
    """A writer of the slice counts of a stream; start it with a trigger, read them with :func:`read_trend`.

    The counts of open slices are kept in Spark's state. A micro-batch stores the slices that it changed
    in a folder of its own (``batch=n``), which a repeated run overwrites. A slice closes when the greatest
    time seen is ``late`` beyond its end: its state goes, and rows that come later still are dropped.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts = _slices(assigned.withWatermark(ts_col, late), ts_col, every)
    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state)


def read_trend(stored: DataFrame) -> DataFrame:
    """The rows of :func:`cluster_trend` from what :func:`trend_stream` stored: the last count of each slice."""
    last = stored.groupBy("window_start", "cluster_id").agg(F.max(F.struct("batch", "n")).alias("m"))
    return _shares(last.select("window_start", "cluster_id", "m.n"))


def _slices(assigned: DataFrame, ts_col: str, every: str) -> DataFrame:
    counts = assigned.groupBy(F.window(ts_col, every).alias("w"), "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "cluster_id", "n")


def _shares(slices: DataFrame) -> DataFrame:
    totals = slices.groupBy("window_start").agg(F.sum("n").alias("total"))
    return slices.join(totals, "window_start").select("window_start", "cluster_id", "n", (F.col("n") / F.col("total")).alias("share"))


def population_drift(before: DataFrame, after: DataFrame, label_col: str = "cluster_id") -> DataFrame:
    """(cluster, share_before, share_after, change) between two runs."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
        total = n.agg(F.sum("n").alias("t")).withColumn("_k", F.lit(1))  # one row
        return n.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(label_col, (F.col("n") / F.col("t")).alias(name))

    both = shares(before, "share_before").join(shares(after, "share_after"), label_col, "full_outer")
    filled = both.na.fill(0.0, ["share_before", "share_after"])
    return filled.withColumn("change", F.col("share_after") - F.col("share_before"))


def centroid_drift(before: DataFrame, after: DataFrame, label_col: str = "cluster_id") -> DataFrame:
    """(cluster, similarity) of a cluster's centroids in two runs."""
    old = before.select(label_col, F.col("centroid").alias("_old"))
    return old.join(after, label_col).select(label_col, dot("_old", "centroid").alias("similarity"))
