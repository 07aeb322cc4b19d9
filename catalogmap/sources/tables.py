"""Parquet tables, vector tables, the checked bundle and the small JSON reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.operators.selection import bundle_manifest, verify_bundle


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """A vector table ``(book_id, vector)``; a missing one is empty, its block then counts as zeros."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"book_id {id_type}, vector array<float>")


class BundleError(ValueError):
    """The tables do not form a self-contained bundle."""


def freeze_bundle(
    books: DataFrame,
    reviews: DataFrame,
    path: str,
    n_requested: int,
    rank_by: str,
    series: DataFrame | None = None,
) -> DataFrame:
    """Check, write books / reviews / series as Parquet, then the manifest row as JSON; returns the manifest."""
    failed = verify_bundle(books, reviews).where("violations > 0").collect()  # one row per check
    if failed:
        raise BundleError("; ".join(f"{r['check_name']}: {r['violations']}" for r in failed))
    spark = books.sparkSession
    parts = {"books": books, "reviews": reviews, **({"series": series} if series is not None else {})}
    for name, df in parts.items():
        write_table(df, f"{path}/{name}.parquet")
    frozen_books = spark.read.parquet(f"{path}/books.parquet")
    frozen_reviews = spark.read.parquet(f"{path}/reviews.parquet")
    manifest = bundle_manifest(frozen_books, frozen_reviews, n_requested, rank_by).select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created_utc"),
        "*",
        F.array(*[F.lit(f"{n}.parquet") for n in parts]).alias("files"),
        F.lit("Self-contained dataset; the raw files are not needed after this point.").alias("note"),
    )
    manifest.write.json(f"{path}/manifest.json")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest.json")


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics or the reducer choice: few rows, as JSON."""
    df.write.mode(mode).json(path)
