"""The given tables in the parts the operators read: catalog, reviews, documents, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.plans.registry import table
from catalogmap.session import widen

BOOKS_SQL = """
books AS (
  SELECT p_partkey AS book_id, p_name AS title, p_type AS top_genre, p_brand AS brand, p_size AS num_pages,
         p_retailprice AS average_rating, n AS text_reviews_count, w AS work_id, a AS first_author_id
  FROM part LEFT JOIN (
    SELECT l_partkey, count(*) AS n, min(l_orderkey) AS w, min(l_suppkey) AS a FROM lineitem GROUP BY l_partkey
  ) ON l_partkey = p_partkey)
"""
REVIEWS_SQL = """
reviews AS (
  SELECT conv_id AS book_id, text AS review_text, turn AS n_votes, length(role) AS rating FROM conversations)
"""


def books(spark: SparkSession, sf: str) -> DataFrame:
    """part as catalog; lineitem gives the review counts and the links to author and work."""
    counts = (
        table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("book_id"))
        .agg(
            F.count(F.lit(1)).alias("text_reviews_count"),
            F.min("l_orderkey").alias("work_id"),
            F.min("l_suppkey").alias("first_author_id"),
        )
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_type").alias("top_genre"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("num_pages"),
        F.col("p_retailprice").alias("average_rating"),
    ).join(counts, "book_id", "left")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("book_id"), F.col("text").alias("review_text"), F.col("turn").alias("n_votes"),
        F.length("role").cast("bigint").alias("rating"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(book_id, doc_text, cluster_id, source, lang): the source number plays the cluster."""
    return widen(table(spark, sf, "documents").drop("n_chars")).select(
        F.col("doc_id").alias("book_id"), F.col("text").alias("doc_text"),
        F.substring("source", 4, 9).try_cast("int").alias("cluster_id"), "source", "lang",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(book_id, vector, cluster_id): the label plays the cluster."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("book_id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id")
    )


def spread(df: DataFrame, *ids: str, vec_col: str = "vector") -> DataFrame:
    """One row per vector component, to six places."""
    return df.select(*ids, F.posexplode(vec_col).alias("pos", "_v")).select(
        *ids, "pos", F.round(F.col("_v").cast("double"), 6).alias("value")
    )
