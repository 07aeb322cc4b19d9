"""Session settings and the lineage cut used by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "catalogmap", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where they are already given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for cut tables: ``spark.checkpoint.dir``; a local session without one gets a new folder.

    On a cluster the folder must be shared, so an unset setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    made = tempfile.mkdtemp(prefix="catalogmap-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    This ends the lineage with a durable table, so a lost executor never restarts a loop, and gives
    the planner real file sizes instead of estimates that multiply in every self-join.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows (that meet ``condition``), counted while writing."""
    seen = Observation()
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    out = cut(df.observe(seen, counted.alias("n")))
    return out, seen.get.get("n") or 0


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in which both sides are shuffled by the key.

    Spark would gather a table of up to 10 MB on the driver and send it to every executor. In a loop over tables with a row per
    node that is most of what the driver receives, and it grows with the table.
    """
    return df.hint("merge")


def salt_of(salts: int, *cols: str | Column) -> Column:
    """A repeatable salt from the row's own columns (never from a random draw)."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new internal ids, so that a table can meet a part of itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def widen(scan: DataFrame) -> DataFrame:
    """Spreads a scan that has fewer splits than the session has cores, ahead of heavy work per row.

    For a plain scan only: looking at the splits of a joined table would run its shuffles. A table
    with splits enough, as any large one, is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
