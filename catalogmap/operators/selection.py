"""Balanced selection by category, enrichment joins and bundle checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.operators.ranking import first_rows, sample_exact, top_k_per_group
from catalogmap.session import cut


def eligible(books: DataFrame, stratum: str = "top_genre", rank: str = "text_reviews_count") -> DataFrame:
    return books.where(F.col(stratum).isNotNull() & (F.coalesce(F.col(rank), F.lit(0)) > 0))


def stratified_ids(
    books: DataFrame,
    n: int = 5000,
    stratum: str = "top_genre",
    rank: str = "text_reviews_count",
    id_col: str = "book_id",
    seed: int = 42,
) -> DataFrame:
    """Ids of ``n`` books with an equal quota per category, the highest ranked first.

    Too many picks are trimmed by an exact sample, missing ones are filled from the highest ranked
    rest. Only (id, category, rank) is shuffled; the category sizes decide which branch is planned.
    """
    pool = eligible(books, stratum, rank).select(id_col, stratum, rank)
    sizes = cut(pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")))
    quota = math.ceil(n / max(sizes.count(), 1))
    picked_rows = sizes.agg(F.sum(F.least("size", F.lit(quota)))).first()[0] or 0

    order = [F.col(rank).desc_nulls_last(), F.col(id_col)]
    picked = top_k_per_group(pool, [stratum], order, quota, salt_on=[id_col]).select(id_col)
    if picked_rows > n:
        return sample_exact(picked, id_col, n, seed)
    if picked_rows < n:
        rest = pool.join(picked, id_col, "left_anti")
        extra = first_rows(rest, order, n - picked_rows).select(id_col)
        return picked.unionByName(extra)
    return picked


def stratified_select(books: DataFrame, n: int = 5000, id_col: str = "book_id", **options) -> DataFrame:
    """The selected rows of ``books``; see :func:`stratified_ids`."""
    return books.join(stratified_ids(books, n, id_col=id_col, **options), id_col, "left_semi")


def with_genres(books: DataFrame, genres: DataFrame) -> DataFrame:
    return books.join(genres.select("book_id", "top_genre", "genres_json"), "book_id", "left")


def with_credits(books: DataFrame, authors: DataFrame, works: DataFrame) -> DataFrame:
    """Left joins to author name and to year and title of the work."""
    names = authors.select(F.col("author_id").alias("first_author_id"), F.col("name").alias("author_name"))
    return books.join(names, "first_author_id", "left").join(works, "work_id", "left")


def reviews_of(reviews: DataFrame, books: DataFrame, id_col: str = "book_id") -> DataFrame:
    """Reviews of the selected books: a semi join, never a list of ids on the driver."""
    return reviews.join(books.select(id_col), id_col, "left_semi")


def category_distribution(books: DataFrame, stratum: str = "top_genre", id_col: str = "book_id") -> DataFrame:
    return (
        books.groupBy(stratum)
        .agg(F.count(F.lit(1)).alias("n_books"), F.countDistinct(id_col).alias("n_distinct"))
        .orderBy(F.desc("n_books"), stratum)
    )


def verify_bundle(books: DataFrame, reviews: DataFrame, id_col: str = "book_id") -> DataFrame:
    """(check_name, violations): any row above zero makes the bundle unfit to freeze."""
    one = F.count(F.lit(1))
    stray = reviews.join(books.select(id_col), id_col, "left_anti")
    twice = books.groupBy(id_col).agg(one.alias("n")).where((F.col("n") > 1) & F.col(id_col).isNotNull())

    def check(df: DataFrame, name: str, value) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )

    return (
        check(books, "books empty", (one == 0).cast("bigint"))
        .unionByName(check(reviews, "reviews empty", (one == 0).cast("bigint")))
        .unionByName(check(books, "book id null", F.count_if(F.col(id_col).isNull())))
        .unionByName(check(stray, "reviews outside the selection", one))
        .unionByName(check(twice, "book id repeated", one))
    )


def bundle_manifest(
    books: DataFrame, reviews: DataFrame, n_requested: int, rank_by: str, id_col: str = "book_id"
) -> DataFrame:
    """One row of counts."""
    b = books.agg(F.count(F.lit(1)).alias("n_books"))
    # count first per book: a book with a third of all reviews is one partial row per task
    per_book = reviews.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    r = per_book.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_reviews"),
        F.count(id_col).alias("n_books_with_reviews"),
    )
    both = b.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k")  # one row each
    return both.select(
        F.lit(n_requested).cast("bigint").alias("n_books_requested"),
        F.lit(rank_by).alias("rank_by"),
        "n_books",
        "n_reviews",
        "n_books_with_reviews",
        F.round(F.col("n_reviews") / F.greatest(F.col("n_books_with_reviews"), F.lit(1)), 2).alias(
            "avg_reviews_per_book"
        ),
    )
