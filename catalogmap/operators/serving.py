"""Lookups on the finished map: neighbours, search, the points to draw and one category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.operators.models import TextToVectors, embed_texts
from catalogmap.operators.neighbors import scan_top_k


def similar_items(vectors: DataFrame, ids: DataFrame, k: int = 12, id_col: str = "book_id", vec_col: str = "vector") -> DataFrame:
    """The ``k`` items most like each given one: (id, near, rank, similarity)."""
    asked = vectors.select(id_col, vec_col).join(ids.select(id_col), id_col, "left_semi")
    return scan_top_k(asked, vectors, k, id_col, vec_col)


def semantic_search(
    queries: DataFrame, content: DataFrame, fn: TextToVectors | None = None, k: int = 12,
    query_id: str = "query_id", text_col: str = "text", id_col: str = "book_id",
) -> DataFrame:
    """Best content matches of free texts: (query_id, book_id, rank, similarity)."""
    asked = embed_texts(queries, text_col, fn, (query_id,)).select(
        F.concat(F.lit("q"), F.col(query_id).cast("string")).alias(id_col), "vector"
    )
    found = scan_top_k(asked, content.select(F.concat(F.lit("i"), F.col(id_col).cast("string")).alias(id_col), "vector"), k, id_col)
    strip = lambda c, t: F.substring(F.col(c), 2, 1 << 20).cast(t)
    return found.select(
        strip("id", queries.schema[query_id].dataType).alias(query_id),
        strip("near", content.schema[id_col].dataType).alias(id_col),
        "rank",
        "similarity",
    )


def category_name(cluster_col: str = "cluster_id", name_col: str = "name"):
    """Display name of a cluster: its label, 'Cluster n' without one, 'Unclustered' for noise."""
    c = F.coalesce(F.col(cluster_col), F.lit(-1))
    return F.when(c < 0, F.lit("Unclustered")).otherwise(
        F.coalesce(F.col(name_col), F.concat(F.lit("Cluster "), c.cast("string")))
    )


def map_points(
    coordinates: DataFrame, books: DataFrame, clusters: DataFrame, labels: DataFrame, unlabelled: str | None = None
) -> DataFrame:
    """(book_id, x, y, title, author, category) for drawing; missing texts are empty.

    ``unlabelled`` is the static map's form: every row without a label gets that one name.
    """
    named = labels.select("cluster_id", "name")
    joined = (
        coordinates.select("book_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))
        .join(books.select("book_id", "title", "author_name"), "book_id", "left")
        .join(clusters.select("book_id", "cluster_id"), "book_id", "left")
        .join(named, "cluster_id", "left")
    )
    category = F.coalesce("name", F.lit(unlabelled)) if unlabelled is not None else category_name()
    return joined.select(
        "book_id", "x", "y",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("author_name", F.lit("")).alias("author"),
        category.alias("category"),
    )


def browse_category(labels: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """Name, description, keywords and representatives of one category, or of all in order."""
    rows = labels if cluster_id is None else labels.where(F.col("cluster_id") == cluster_id)
    return rows.select(
        "cluster_id",
        category_name().alias("name"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("description", "keywords", "representatives")],
    ).orderBy("cluster_id")
