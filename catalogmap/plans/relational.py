"""Queries on sources, selection, joins and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.functions.text import clean_html as clean_html_col
from catalogmap.functions.text import parse_label_reply, rating_digit, space_tokens, top_key
from catalogmap.operators import documents as docs
from catalogmap.operators import selection as sel
from catalogmap.operators.metrics import judge_rollup
from catalogmap.operators.ranking import sample_exact
from catalogmap.plans import roles
from catalogmap.plans.registry import query, table
from catalogmap.session import cut, scratch_dir, widen
from catalogmap.sources import catalog, tables

BOOKS, REVIEWS = roles.BOOKS_SQL, roles.REVIEWS_SQL


# ---- sources -------------------------------------------------------------------------------


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_retailprice AS average_rating,
       CAST(p_size AS BIGINT) AS num_pages, p_brand AS first_author_id,
       array_to_string(string_split(p_name, ' ')[1:10], '|') AS shelves, p_type || '|' || p_brand AS series_ids,
       CAST(NULL AS BIGINT) AS ratings_count
FROM part
""")
def ingest_books(spark: SparkSession, sf: str) -> DataFrame:
    """part written as JSON text, read with the tolerant schema, projected and cast."""
    part = table(spark, sf, "part")
    line = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"),
            F.col("p_retailprice").cast("string").alias("average_rating"),
            F.col("p_size").cast("string").alias("num_pages"), F.col("p_type").alias("ratings_count"),
            F.array("p_type", "p_brand").alias("series"),
            F.array(F.struct(F.col("p_brand").alias("author_id"))).alias("authors"),
            F.transform(F.split("p_name", " "), lambda s: F.struct(s.alias("name"))).alias("popular_shelves"),
        )
    )
    raw = catalog.parse_ndjson(part.select(line.alias("line")), "line", catalog.BOOKS_RAW)
    return catalog.project_books(raw).select(
        "book_id", "title", "average_rating", "num_pages", "first_author_id",
        F.array_join("shelves", "|").alias("shelves"), F.array_join("series_ids", "|").alias("series_ids"),
        "ratings_count",
    )


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, CASE WHEN p_partkey % 5 <> 3 THEN CAST(p_size AS BIGINT) END AS num_pages,
       CASE WHEN p_partkey % 5 <> 1 THEN p_type END AS series_ids, CASE WHEN p_partkey % 5 <> 2 THEN p_brand END AS first_author_id
FROM part WHERE p_partkey % 5 <> 0
""")
def ingest_damaged_file(spark: SparkSession, sf: str) -> DataFrame:
    """part as a newline-JSON file in which lines are cut off and fields have other shapes, read from disk.

    All parts are written; the reader itself drops the lines that are cut off and nulls the unfit fields.
    """

    def line(num_pages, series, authors):
        return F.to_json(
            F.struct(
                F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"),
                num_pages.alias("num_pages"), series.alias("series"), authors.alias("authors"),
            )
        )

    pages, series, authors = F.col("p_size").cast("string"), F.array("p_type"), F.array(F.struct(F.col("p_brand").alias("author_id")))
    whole, kind = line(pages, series, authors), F.col("p_partkey") % 5
    damaged = (
        F.when(kind == 0, F.left(whole, F.length(whole) - 3))
        .when(kind == 1, line(pages, F.col("p_type"), authors))
        .when(kind == 2, line(pages, series, F.lit(7)))
        .when(kind == 3, line(F.struct("p_size"), series, authors))
        .otherwise(whole)
    )
    path = f"{scratch_dir(spark)}/damaged-{uuid.uuid4().hex}"
    table(spark, sf, "part").select(damaged.alias("value")).write.text(path)
    got = catalog.project_books(catalog.read_ndjson(spark, path, catalog.BOOKS_RAW))
    return got.select("book_id", "title", "num_pages", F.array_join("series_ids", "|").alias("series_ids"), "first_author_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS author_id, s_name AS name, s_acctbal AS average_rating FROM supplier")
def ingest_authors(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(
        F.struct(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("average_rating"))
    )
    lines = table(spark, sf, "supplier").select(line.alias("line"))
    return catalog.project_authors(catalog.parse_ndjson(lines, "line", catalog.AUTHORS_RAW))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS work_id, CAST(year(o_orderdate) AS BIGINT) AS pub_year,
       o_orderpriority AS original_title FROM orders
""")
def ingest_works(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("original_publication_year"),
            F.col("o_orderpriority").alias("original_title"),
        )
    )
    lines = table(spark, sf, "orders").select(line.alias("line"))
    return catalog.project_works(catalog.parse_ndjson(lines, "line", catalog.WORKS_RAW))


@query("SELECT CAST(page_id AS VARCHAR) AS series_id, url AS series_title FROM pages")
def ingest_series(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("page_id").alias("series_id"), F.col("url").alias("title")))
    lines = table(spark, sf, "pages").select(line.alias("line"))
    return catalog.project_series(catalog.parse_ndjson(lines, "line", catalog.SERIES_RAW))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_name AS title FROM supplier")
def optional_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A newline-JSON file that is there, and one that is not: the second counts as empty."""
    path = f"{scratch_dir(spark)}/series-{uuid.uuid4().hex}"
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("series_id"), F.col("s_name").alias("title")).write.json(path)
    read = lambda where: catalog.read_optional(spark, lambda: catalog.read_ndjson(spark, where, catalog.SERIES_RAW), catalog.SERIES_RAW)
    return read(path).unionByName(read(f"{path}-missing"))


@query("SELECT lang AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang")
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Counts written as a JSON report and read back."""
    path = f"{scratch_dir(spark)}/report-{uuid.uuid4().hex}"
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    tables.write_report(counts, path)
    return spark.read.schema("metric string, value double").json(path)


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE lang IN ('de', 'fr') GROUP BY ALL")
def partitioned_storage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored by language; a filter on it reads those folders only."""
    path = f"{scratch_dir(spark)}/by-lang-{uuid.uuid4().hex}"
    tables.write_table(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), path, ["lang"])
    kept = tables.read_table(spark, path).where(F.col("lang").isin("de", "fr"))
    return kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""
WITH c AS (
  SELECT p_partkey AS k, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a,
         count(*) FILTER (l_returnflag = 'N') AS n, count(l_partkey) AS t
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT CAST(k AS VARCHAR) AS book_id,
       CASE WHEN t = 0 THEN NULL WHEN r >= a AND r >= n THEN 'R' WHEN a >= n THEN 'A' ELSE 'N' END AS top_genre,
       CASE WHEN t = 0 THEN '{}' ELSE '{"R":' || r || ',"A":' || a || ',"N":' || n || '}' END AS genres_json
FROM c
""")
def ingest_genres(spark: SparkSession, sf: str) -> DataFrame:
    """Leading key of a JSON count map per part, the first key winning ties."""
    flags = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        *[F.count_if(F.col("l_returnflag") == f).alias(f) for f in "RAN"]
    )
    joined = table(spark, sf, "part").select("p_partkey").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left")
    line = F.concat(
        F.lit('{"book_id":"'), F.col("p_partkey").cast("string"), F.lit('","genres":'),
        F.when(F.col("R").isNull(), F.lit("{}")).otherwise(F.to_json(F.struct("R", "A", "N"))), F.lit("}"),
    )
    return catalog.project_genres(catalog.parse_ndjson(joined.select(line.alias("line")), "line", catalog.GENRES_RAW, strict=True))


@query("""
SELECT event_id, 'k' AS top_key, CAST(props->>'k' AS BIGINT) AS top_count FROM events
""")
def json_map_top_key(spark: SparkSession, sf: str) -> DataFrame:
    counts = F.from_json("props", "map<string,bigint>")
    df = table(spark, sf, "events").select("event_id", counts.alias("m"))
    return df.select("event_id", top_key("m").alias("top_key"), F.try_element_at("m", top_key("m")).alias("top_count"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS book_id, text AS review_text, CAST(NULL AS BIGINT) AS rating, turn AS n_votes
FROM conversations WHERE length(text) > 0
""")
def scan_reviews(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(
        F.struct(
            F.col("conv_id").alias("book_id"), F.col("text").alias("review_text"), F.col("role").alias("rating"),
            F.col("turn").alias("n_votes"),
        )
    )
    lines = table(spark, sf, "conversations").select(line.alias("line"))
    return catalog.with_text(catalog.project_reviews(catalog.parse_ndjson(lines, "line", catalog.REVIEWS_RAW)))


# ---- selection -----------------------------------------------------------------------------


def _selection_sql(n: int, stratum: str) -> str:
    return f"""{BOOKS},
pool AS (SELECT * FROM books WHERE {stratum} IS NOT NULL AND coalesce(text_reviews_count, 0) > 0),
quota AS (SELECT ceil({n} / greatest(count(DISTINCT {stratum}), 1)) AS q FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY text_reviews_count DESC NULLS LAST, book_id) AS r FROM pool),
picked AS (SELECT book_id FROM ranked, quota WHERE r <= q),
size AS (SELECT count(*) AS c FROM picked),
trimmed AS (SELECT book_id FROM picked ORDER BY md5(book_id || '-42'), book_id LIMIT {n}),
extra AS (SELECT book_id FROM (
    SELECT book_id, row_number() OVER (ORDER BY text_reviews_count DESC NULLS LAST, book_id) AS r
    FROM pool WHERE book_id NOT IN (SELECT book_id FROM picked)), size WHERE r <= {n} - c),
chosen AS (SELECT book_id FROM trimmed UNION ALL SELECT book_id FROM extra)"""


@query(f"WITH {_selection_sql(1000, 'top_genre')} SELECT book_id, title, top_genre, text_reviews_count FROM books SEMI JOIN chosen USING (book_id)")
def stratified_selection(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 books with equal quotas; the quotas overshoot and are trimmed by an exact sample."""
    chosen = sel.stratified_select(roles.books(spark, sf), 1000)
    return chosen.select("book_id", "title", "top_genre", "text_reviews_count")


@query(f"WITH {_selection_sql(1990, 'brand')} SELECT book_id, title, brand, text_reviews_count FROM books SEMI JOIN chosen USING (book_id)")
def stratified_selection_topped_up(spark: SparkSession, sf: str) -> DataFrame:
    """Some brands are smaller than their quota, so the highest ranked rest fills the gap."""
    chosen = sel.stratified_select(roles.books(spark, sf), 1990, stratum="brand")
    return chosen.select("book_id", "title", "brand", "text_reviews_count")


@query("SELECT doc_id, source, lang FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 300")
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample_exact(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id", 300)


@query(f"""WITH {BOOKS}
SELECT book_id, title, top_genre, s_name AS author_name, CAST(year(o_orderdate) AS BIGINT) AS pub_year, o_orderpriority AS original_title
FROM books LEFT JOIN supplier ON s_suppkey = first_author_id LEFT JOIN orders ON o_orderkey = work_id
""")
def enriched_books(spark: SparkSession, sf: str) -> DataFrame:
    authors = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))
    works = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").cast("bigint").alias("pub_year"),
        F.col("o_orderpriority").alias("original_title"),
    )
    joined = sel.with_credits(roles.books(spark, sf), authors, works)
    return joined.select("book_id", "title", "top_genre", "author_name", "pub_year", "original_title")


@query(f"""WITH {_selection_sql(1000, 'top_genre')}
SELECT l_partkey AS book_id, l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS n_votes
FROM lineitem SEMI JOIN chosen ON l_partkey = book_id
""")
def reviews_of_selected(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("book_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("n_votes"),
    )
    return sel.reviews_of(said, sel.stratified_ids(roles.books(spark, sf), 1000))


@query(f"""WITH {BOOKS} SELECT top_genre, count(*) AS n_books, count(DISTINCT book_id) AS n_distinct
FROM books GROUP BY top_genre""")
def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return sel.category_distribution(roles.books(spark, sf))


@query(f"""WITH {BOOKS}, rv AS (SELECT doc_id AS book_id FROM documents)
SELECT 'books empty' AS check_name, CAST(count(*) = 0 AS BIGINT) AS violations FROM books
UNION ALL SELECT 'reviews empty', CAST(count(*) = 0 AS BIGINT) FROM rv
UNION ALL SELECT 'book id null', count(*) FROM books WHERE book_id IS NULL
UNION ALL SELECT 'reviews outside the selection', count(*) FROM rv ANTI JOIN books USING (book_id)
UNION ALL SELECT 'book id repeated', count(*) FROM (SELECT book_id FROM books GROUP BY book_id HAVING count(*) > 1)
""")
def bundle_checks(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"))
    return sel.verify_bundle(roles.books(spark, sf), said)


@query(f"""WITH {BOOKS}
SELECT CAST(5000 AS BIGINT) AS n_books_requested, 'text_reviews_count' AS rank_by, n_books, n_reviews, n_books_with_reviews,
       round(n_reviews / greatest(n_books_with_reviews, 1), 2) AS avg_reviews_per_book
FROM (SELECT count(*) AS n_books FROM books),
     (SELECT count(*) AS n_reviews, count(DISTINCT l_partkey) AS n_books_with_reviews FROM lineitem)
""")
def bundle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"))
    return sel.bundle_manifest(roles.books(spark, sf), said, 5000, "text_reviews_count")


@query(f"""WITH {_selection_sql(1000, 'top_genre')}, rv AS (SELECT l_partkey AS book_id FROM lineitem SEMI JOIN chosen ON l_partkey = book_id)
SELECT CAST(1000 AS BIGINT) AS n_books_requested, 'text_reviews_count' AS rank_by, n_books, n_reviews, n_books_with_reviews,
       round(n_reviews / greatest(n_books_with_reviews, 1), 2) AS avg_reviews_per_book, 'books.parquet|reviews.parquet' AS files
FROM (SELECT count(*) AS n_books FROM chosen), (SELECT count(*) AS n_reviews, count(DISTINCT book_id) AS n_books_with_reviews FROM rv)
""")
def frozen_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The selection and its reviews, checked, written, and described by the manifest read back."""
    books = cut(sel.stratified_select(roles.books(spark, sf), 1000))
    said = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_quantity").alias("n_votes"))
    path = f"{scratch_dir(spark)}/bundle-{uuid.uuid4().hex}"
    manifest = tables.freeze_bundle(books, sel.reviews_of(said, books), path, 1000, "text_reviews_count")
    return manifest.select(
        "n_books_requested", "rank_by", "n_books", "n_reviews", "n_books_with_reviews", "avg_reviews_per_book",
        F.array_join("files", "|").alias("files"),
    )


@query("SELECT doc_id AS book_id, text FROM documents WHERE lang = 'en'")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), "text", F.col("lang").alias("language_code"))
    return catalog.in_language(named, "en").drop("language_code")


# ---- documents, reviews, prompts -----------------------------------------------------------

WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'))"


STRIPPED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
UNESCAPED = (
    f"replace(replace(replace(replace({STRIPPED}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
)


@query(f"""
SELECT page_id AS book_id, 'Title: ' || url || '. Author: . Genre: web. Reader shelves: ' ||
  array_to_string(string_split(url, '/')[1:8], ', ') || '. Description: ' || {_clean_sql(STRIPPED)} AS doc_text
FROM pages
""")
def build_documents(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("book_id"), F.col("url").alias("title"), F.lit(None).cast("string").alias("author_name"),
        F.lit("web").alias("top_genre"), F.split("url", "/").alias("shelves"), F.col("html").alias("description"),
    )
    return docs.build_documents(pages)


@query(f"SELECT page_id, {_clean_sql(UNESCAPED)} AS text FROM pages")
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return widen(table(spark, sf, "pages").select("page_id", "html")).select("page_id", clean_html_col("html").alias("text"))


@query(rf"""
SELECT doc_id, CAST(len(list_filter(string_split({_clean_sql('text')}, ' '), lambda x: x <> '')) AS BIGINT) AS n_words, length(text) AS n_chars
FROM documents
""")
def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return widen(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.size(space_tokens("text")).cast("bigint").alias("n_words"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(f"""WITH {REVIEWS} SELECT book_id, review_text, n_votes, rating FROM reviews
QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY length(review_text) DESC, review_text, rating, n_votes) <= 3""")
def cap_reviews_longest(spark: SparkSession, sf: str) -> DataFrame:
    return docs.cap_reviews(roles.reviews(spark, sf), 3, "longest")


@query(f"""WITH {REVIEWS} SELECT book_id, review_text, n_votes, rating FROM reviews
QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n_votes DESC NULLS LAST, review_text, rating, n_votes) <= 3""")
def cap_reviews_votes(spark: SparkSession, sf: str) -> DataFrame:
    return docs.cap_reviews(roles.reviews(spark, sf), 3, "votes")


@query(f"WITH {REVIEWS} SELECT book_id, count(*) AS n_reviews FROM reviews GROUP BY book_id ORDER BY n_reviews DESC, book_id LIMIT 50")
def distill_targets(spark: SparkSession, sf: str) -> DataFrame:
    return docs.distill_targets(roles.reviews(spark, sf), 50)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""WITH {REVIEWS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY length(review_text) DESC, review_text) AS k FROM reviews)
SELECT book_id, {_quoted(docs.DISTILL_INSTRUCTION)} ||
  string_agg('- ' || substring(review_text, 1, 600), chr(10) || chr(10) ORDER BY k) AS prompt
FROM r WHERE k <= 10 GROUP BY book_id""")
def distill_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return docs.distill_prompts(roles.reviews(spark, sf), 10)


@query(r"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '**NAME:** ' || substring(text, 1, 20) || chr(10) || '**DESC:** ' || text ELSE text END AS reply
           FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(reply, '\*\*|__', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM r)
SELECT conv_id, turn,
  trim(CASE WHEN regexp_matches(t, 'NAME:\s*[^\n]') THEN regexp_extract(t, 'NAME:\s*([^\n]+)', 1) ELSE substring(string_split(t, chr(10))[1], 1, 60) END) AS name,
  trim(regexp_extract(t, '(?s)DESC:\s*(.+)', 1)) AS description
FROM c
""")
def parse_label_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the texts are given the asked-for form, the others fall back to their first line."""
    reply = F.when(
        F.col("role") == "user",
        F.concat(F.lit("**NAME:** "), F.substring("text", 1, 20), F.lit("\n**DESC:** "), F.col("text")),
    ).otherwise(F.col("text"))
    name, desc = parse_label_reply(reply)
    return table(spark, sf, "conversations").select("conv_id", "turn", name.alias("name"), desc.alias("description"))


@query("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[123]'), '') AS INTEGER) AS rating FROM pages")
def judge_digit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", rating_digit("url").alias("rating"))


@query("""WITH d AS (SELECT TRY_CAST(nullif(regexp_extract(url, '[123]'), '') AS INTEGER) AS r FROM pages)
SELECT round(avg(r), 2) AS mean_rating, count(r) AS n_rated FROM d""")
def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return judge_rollup(table(spark, sf, "pages").select(rating_digit("url").alias("rating")))
