"""Top-k per group, exact-size samples and contiguous numbering, all without a single big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogmap.session import cut, salt_of

#: Up to so many rows per group Spark drops the rest ahead of the shuffle; more are ranked by ranges.
MAP_SIDE_ROWS = 1000


def ranked_by_range(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the rank of each row in its group, in a total order, for groups of any size.

    A range partitioning sorts groups and rows, so a large group lies over many partitions. A row's rank is
    its rank in its partition plus the group's rows in the partitions before; those sums exist only for
    groups that cross a border, one row per border at most.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", before).where("_before > 0")
    offsets = offsets.select(F.col("_p").alias("_op"), *[F.col(c).alias(f"_o_{c}") for c in by], "_before")
    same = F.col("_p") == F.col("_op")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)))
    placed = local.join(F.broadcast(offsets), same, "left")
    return placed.withColumn(name, F.col("_r") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order; a large ``n`` is not gathered in one task."""
    if n <= MAP_SIDE_ROWS:
        return df.orderBy(*order).limit(n)
    return ranked_by_range(df, [], order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def top_k_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str | None = None,
    salt_on: Sequence[str] = (),
    salts: int = 32,
) -> DataFrame:
    """First ``k`` rows of every group in a total order.

    With ``salt_on`` the group is first ranked in ``salts`` parts, so a group that holds a third of
    the table is spread over that many tasks and only ``salts * k`` of its rows meet in the last
    step. Without it the window's own map-side limit drops rows before the shuffle. Where ``k`` is above
    that limit the rows are ranked by ranges, with the same result.
    """
    name = rank_col or "_rank"
    if k > MAP_SIDE_ROWS:
        out = ranked_by_range(df, by, order, name).where(F.col(name) <= k)
        return out if rank_col else out.drop(name)
    if salt_on:
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt_of(salts, *salt_on))
            .withColumn("_part_rank", F.row_number().over(part))
            .where(F.col("_part_rank") <= k)
            .drop("_part_rank", "_salt")
        )
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col(name) <= k
    )
    return out if rank_col else out.drop(name)


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, drawn by the order of ``md5(id-seed)``: repeatable everywhere."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}"))))
    if n <= MAP_SIDE_ROWS:
        return keyed.orderBy("_h", id_col).limit(n).drop("_h")
    # Large samples: count the 65,536 hash prefixes, keep whole prefixes, rank only the border one.
    keyed = keyed.withColumn("_p", F.substring("_h", 1, 4))
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sizes = sizes.withColumn("_before", before).where(F.col("_before") < n)
    joined = keyed.join(F.broadcast(sizes), "_p")
    whole = joined.where(F.col("_before") + F.col("_n") <= n)
    border = (
        joined.where(F.col("_before") + F.col("_n") > n)
        .withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", id_col)))
        .where(F.col("_r") + F.col("_before") <= n)
    )
    return whole.select(df.columns).unionByName(border.select(df.columns))


def contiguous_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the distinct values of ``key`` 0, 1, 2, … in ascending order: (key, name).

    A range partitioning sorts them; only one row count per partition is gathered to find offsets.
    """
    ranged = cut(
        df.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    )
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return (
        ranged.withColumn("_r", local)
        .join(F.broadcast(offsets), "_p")
        .select(key, (F.col("_r") + F.col("_o") - 1).alias(name))
    )
