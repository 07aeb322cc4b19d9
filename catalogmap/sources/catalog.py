"""Readers and projections of the raw newline-JSON catalog.

Scalars arrive as text and are cast one by one, so a bad value becomes null instead of ending the
job. A field of another shape than the schema's is null and the row stays; only lines that are no
JSON objects are dropped, and can be counted. The genre file may be read strictly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogmap.functions.text import top_key

_CORRUPT = "_corrupt_record"

_TEXT = T.StringType()


def _schema(*texts: str, **others: T.DataType) -> T.StructType:
    fields = [T.StructField(n, _TEXT) for n in texts] + [T.StructField(n, t) for n, t in others.items()]
    return T.StructType(fields)


BOOKS_RAW = _schema(
    *"book_id title description publisher language_code average_rating ratings_count".split(),
    *"text_reviews_count num_pages work_id".split(),
    series=T.ArrayType(_TEXT),
    authors=T.ArrayType(_schema("author_id")),
    popular_shelves=T.ArrayType(_schema("name")),
)
AUTHORS_RAW = _schema("author_id", "name", "average_rating")
WORKS_RAW = _schema("work_id", "original_publication_year", "original_title")
SERIES_RAW = _schema("series_id", "title")
GENRES_RAW = _schema("book_id", genres=T.MapType(_TEXT, _TEXT))
REVIEWS_RAW = _schema("book_id", "review_text", "rating", "n_votes")

MAX_SHELVES = 10


def read_ndjson(
    spark: SparkSession, path: str, schema: T.StructType, sample: int | None = None, strict: bool = False
) -> DataFrame:
    """Newline JSON with a fixed schema; ``sample`` keeps the first rows; ``strict`` fails on a bad line.

    Lines are read as text and parsed with the full schema, so that a bad line is found whatever
    columns the query goes on to use.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = parse_ndjson(lines, "value", schema, strict)
    return df.limit(sample) if sample else df


def parse_ndjson(df: DataFrame, line_col: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a table that holds one JSON text each."""
    if strict:
        parsed = F.from_json(line_col, schema, {"mode": "FAILFAST"})
        return df.select(parsed.alias("_j")).select("_j.*")
    marked = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    whole = F.from_json(line_col, marked, {"columnNameOfCorruptRecord": _CORRUPT})
    lines = df.where(is_object(line_col)).select(F.col(line_col).alias("_line"), whole.alias("_j"))
    # where some field has another shape, each is read on its own and takes no other field with it
    single = F.struct(*[F.from_json("_line", T.StructType([f]))[f.name].alias(f.name) for f in schema.fields])
    clean = F.struct(*[F.col(f"_j.{n}").alias(n) for n in schema.names])
    return lines.select(F.when(F.col(f"_j.{_CORRUPT}").isNull(), clean).otherwise(single).alias("_r")).select("_r.*")


def is_object(line_col: str) -> Column:
    """True for a text that is one JSON object."""
    return F.coalesce(F.ltrim(line_col).startswith("{") & F.get_json_object(line_col, "$").isNotNull(), F.lit(False))


def count_dropped(df: DataFrame, line_col: str) -> DataFrame:
    """One row: how many texts are JSON objects (n_rows) and how many are not (n_dropped)."""
    good = is_object(line_col)
    return df.agg(F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_dropped"))


def project_books(raw: DataFrame) -> DataFrame:
    return raw.select(
        "book_id",
        "title",
        "description",
        "publisher",
        "language_code",
        F.col("average_rating").try_cast("double").alias("average_rating"),
        F.col("ratings_count").try_cast("bigint").alias("ratings_count"),
        F.col("text_reviews_count").try_cast("bigint").alias("text_reviews_count"),
        F.col("num_pages").try_cast("bigint").alias("num_pages"),
        "work_id",
        F.col("series").alias("series_ids"),
        F.try_element_at("authors", F.lit(1))["author_id"].alias("first_author_id"),
        F.slice(F.transform("popular_shelves", lambda s: s["name"]), 1, MAX_SHELVES).alias("shelves"),
    )


def project_authors(raw: DataFrame) -> DataFrame:
    return raw.select("author_id", "name", F.col("average_rating").try_cast("double").alias("average_rating"))


def project_works(raw: DataFrame) -> DataFrame:
    return raw.select(
        "work_id", F.col("original_publication_year").try_cast("bigint").alias("pub_year"), "original_title"
    )


def project_series(raw: DataFrame) -> DataFrame:
    return raw.select("series_id", F.col("title").alias("series_title"))


def project_genres(raw: DataFrame) -> DataFrame:
    """Genre counts per book, the leading genre, and the counts as JSON text."""
    numbers = F.transform_values("genres", lambda _, n: n.try_cast("bigint"))
    counts = F.coalesce(numbers, F.create_map().cast("map<string,bigint>"))
    return raw.select("book_id", top_key(counts).alias("top_genre"), F.to_json(counts).alias("genres_json"))


def project_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "book_id",
        "review_text",
        F.col("rating").try_cast("bigint").alias("rating"),
        F.col("n_votes").try_cast("bigint").alias("n_votes"),
    )


def with_text(reviews: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Reviews whose text is present and not empty."""
    return reviews.where(F.length(text_col) > 0)


def in_language(books: DataFrame, *codes: str) -> DataFrame:
    return books.where(F.col("language_code").isin(*codes))


def read_optional(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """An optional source: an unreadable one gives the empty table with its schema."""
    try:
        df = read()
        df.limit(1).count()
        return df
    except Exception:  # any failure of an optional source means "absent"
        return spark.createDataFrame([], schema)
