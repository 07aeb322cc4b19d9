"""Queries on vectors: pooling, fusion, neighbours, search, assignment and serving tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.functions.vectors import l2_normalize as l2
from catalogmap.operators import approximate, fusion, models, serving
from catalogmap.operators.neighbors import knn, scan_top_k, with_similarity
from catalogmap.plans import roles
from catalogmap.plans.registry import query, table, table_stream
from catalogmap.session import cut, scratch_dir
from catalogmap.sources import tables
from catalogmap.streaming import assign

LONG = "e AS (SELECT vec_id AS book_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _unit_sql(source: str, key: str) -> str:
    """(key, pos, x) of ``source`` divided by the norm of each key."""
    return f"""SELECT {key}, pos, x / CASE WHEN n = 0 THEN 1 ELSE n END AS x
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS n FROM {source})"""


def _pool_sql(name: str, key: str, weight: str) -> str:
    return f"""{name}_raw AS (SELECT {key} AS book_id, pos, sum(({weight}) * x) / sum({weight}) AS x FROM e GROUP BY ALL),
{name} AS ({_unit_sql(name + '_raw', 'book_id')})"""


@query(f"WITH {LONG} SELECT book_id, pos, round(x, 6) AS value FROM ({_unit_sql('e', 'book_id')})")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = roles.vectors(spark, sf)
    return roles.spread(v.select("book_id", l2("vector").alias("vector")), "book_id")


@query("""WITH e AS (SELECT vec_id AS book_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT book_id, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY book_id)) + 1e-9), 6) AS value FROM e""")
def l2_normalize_eps(spark: SparkSession, sf: str) -> DataFrame:
    """The serving form: the norm plus a small number divides."""
    v = roles.vectors(spark, sf)
    return roles.spread(v.select("book_id", l2("vector", 1e-9).alias("vector")), "book_id")


@query("SELECT vec_id AS book_id, unnest(range(0, len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def vector_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as a table and read back; a table that does not exist adds no rows."""
    path = f"{scratch_dir(spark)}/vectors-{uuid.uuid4().hex}"
    tables.write_table(roles.vectors(spark, sf).select("book_id", "vector"), path)
    missing = tables.read_vectors(spark, f"{path}-missing", "bigint")
    return roles.spread(tables.read_vectors(spark, path).unionByName(missing), "book_id")


def _review_vectors(spark: SparkSession, sf: str, books: int) -> DataFrame:
    """Vectors as reviews of ``books`` books, the label as votes."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % books).alias("book_id"), F.col("embedding").alias("vector"), F.col("label").alias("n_votes")
    )


@query(f"WITH {LONG}, {_pool_sql('p', 'book_id % 50', '1 + ln(1 + greatest(coalesce(label, 0), 0))')} SELECT book_id, pos, round(x, 6) AS value FROM p")
def pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return roles.spread(fusion.pool_vectors(_review_vectors(spark, sf, 50)), "book_id")


def _fuse_sql(c: float, p: float, d: float) -> str:
    w = "1 + ln(1 + greatest(coalesce(label, 0), 0))"
    return f"""WITH {LONG}, {_pool_sql('p', 'book_id % 50', w)}, {_pool_sql('d', 'book_id % 30', '1')},
c AS ({_unit_sql('e', 'book_id')}),
f AS (SELECT book_id, pos, {c} * x AS x FROM c
  UNION ALL SELECT c.book_id, pos + 64, {p} * coalesce(p.x, 0) FROM c LEFT JOIN p USING (book_id, pos)
  UNION ALL SELECT c.book_id, pos + 128, {d} * coalesce(d.x, 0) FROM c LEFT JOIN d USING (book_id, pos))
SELECT book_id, pos, round(x::FLOAT::DOUBLE, 6) AS value FROM ({_unit_sql('f', 'book_id')})"""


def _fused(spark: SparkSession, sf: str, **options) -> DataFrame:
    return fusion.fuse_vectors(
        roles.vectors(spark, sf),
        fusion.pool_vectors(_review_vectors(spark, sf, 50)),
        fusion.pool_vectors(_review_vectors(spark, sf, 30), weight_by_votes=False),
        **options,
    )


@query(_fuse_sql(0.5, 0.3, 0.2))
def fuse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Content, vote-weighted pool and plain pool blocks; most books miss the last two."""
    return roles.spread(_fused(spark, sf), "book_id")


@query(_fuse_sql(0.5**0.5, 0.3**0.5, 0.2**0.5))
def fuse_vectors_sqrt_weights(spark: SparkSession, sf: str) -> DataFrame:
    return roles.spread(_fused(spark, sf, sqrt_weights=True), "book_id")


CENTROIDS = f"""cr AS (SELECT label AS cluster_id, pos, avg(x) AS x FROM e GROUP BY ALL),
c AS ({_unit_sql('cr', 'cluster_id')})"""


@query(f"WITH {LONG}, {CENTROIDS} SELECT cluster_id, pos, round(x, 6) AS value FROM c")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    cents = fusion.centroids(roles.vectors(spark, sf))
    return roles.spread(cents, "cluster_id", vec_col="centroid")


@query(f"""WITH {LONG}, {CENTROIDS},
s AS (SELECT label AS cluster_id, book_id, round(sum(e.x * c.x), 9) AS score FROM e JOIN c ON label = cluster_id AND e.pos = c.pos GROUP BY ALL)
SELECT cluster_id, book_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= 6""")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    v = roles.vectors(spark, sf)
    reps = fusion.representatives(v.drop("cluster_id"), v.select("book_id", "cluster_id"))
    return reps.select("cluster_id", "book_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


UNIT = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v
FROM embeddings)"""
KNN_COSINE = f"""{UNIT}, d AS (SELECT a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS dist FROM u a JOIN u b ON a.id <> b.id)"""


@query(f"""WITH {KNN_COSINE} SELECT id, near, rank, round(1 - dist * dist / 2, 6) AS similarity FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM d) WHERE rank <= 10""")
def nearest_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine neighbours of every vector."""
    near = with_similarity(knn(roles.vectors(spark, sf), 10))
    return near.select("id", "near", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("""SELECT count(*) AS vectors, CAST(10 AS INTEGER) AS k, true AS recall_reached FROM embeddings""")
def approximate_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate index finds nine tenths of the neighbours that the exact join finds, over all vectors."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    found = approximate.recall(approximate.approximate_knn(v, 10), knn(v, 10))
    return found.select(F.col("rows").alias("vectors"), F.lit(10).alias("k"), (F.col("recall") >= 0.9).alias("recall_reached"))


def _top_sql(asked: str, k: int) -> str:
    return f"""s AS (SELECT a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS dist FROM {asked} a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM s)
SELECT id, near, rank, round(1 - dist * dist / 2, 6) AS similarity FROM r WHERE rank <= {k}"""


def _shown(top: DataFrame) -> DataFrame:
    return top.select("id", "near", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {UNIT}, q AS (SELECT u.* FROM u SEMI JOIN benchmark ON id = item_id), {_top_sql('q', 12)}")
def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    """'More like this' for the ids that the benchmark table names."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("book_id"))
    return _shown(serving.similar_items(roles.vectors(spark, sf), asked))


@query(f"""WITH {UNIT}, {LONG},
m AS (SELECT user_id, pos, avg(x) AS x FROM events JOIN e ON event_id = book_id GROUP BY ALL),
mu AS ({_unit_sql('m', 'user_id')}),
q AS (SELECT user_id AS id, list(x ORDER BY pos) AS v FROM mu GROUP BY user_id),
s AS (SELECT a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS dist FROM q a, u b)
SELECT id, near, rank, round(1 - dist * dist / 2, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM s) WHERE rank <= 5""")
def taste_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of the items a user touched, matched against all items."""
    liked = table(spark, sf, "events").select("user_id", F.col("event_id").alias("book_id"))
    tastes = fusion.taste_vector(liked, roles.vectors(spark, sf))
    # users and items are different things: text ids keep equal numbers apart
    asked = tastes.select(F.col("user_id").cast("string").alias("book_id"), "vector")
    top = scan_top_k(asked, roles.vectors(spark, sf), 5)
    return _shown(top.withColumn("id", F.col("id").cast("bigint")))


def _hashed_sql(name: str, source: str, key: str, text: str) -> str:
    """(key, pos, x) of unit vectors of signed word counts."""
    return rf"""{name}_w AS (SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'))) AS h FROM {source}),
{name}_s AS (SELECT {key}, CAST('0x' || substring(h, 1, 4) AS INTEGER) % 64 AS pos, sum(CASE WHEN substring(h, 5, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
  FROM {name}_w GROUP BY ALL),
{name}_d AS (SELECT g.{key}, g.pos, coalesce(x, 0) AS x FROM (SELECT {key}, unnest(range(64)) AS pos FROM {source}) g LEFT JOIN {name}_s USING ({key}, pos)),
{name} AS (SELECT {key}, pos, x::FLOAT::DOUBLE AS x FROM ({_unit_sql(name + '_d', key)}))"""


@query(f"""WITH {_hashed_sql('v', 'documents', 'doc_id', 'text')}
SELECT doc_id AS book_id, pos, round(x, 6) AS value FROM v""")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed unit vectors of the whole texts."""
    docs = roles.documents(spark, sf)
    return roles.spread(models.embed_texts(docs, "doc_text"), "book_id")


@query("""WITH s AS (SELECT doc_id AS book_id, CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 16 AS share,
  greatest(1, length(text) // 3) AS n FROM documents),
m AS (SELECT *, (row_number() OVER w - 1) // 128 AS i,
  coalesce(sum(n) OVER (PARTITION BY share ORDER BY book_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 250000 AS t
  FROM s WINDOW w AS (PARTITION BY share ORDER BY book_id)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY share ORDER BY i, t) - 1 AS request FROM m)
SELECT share, request, count(*) AS n_items, sum(n)::BIGINT AS n_tokens FROM r GROUP BY ALL""")
def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable plan of the requests of an embedding run over the documents."""
    packed = models.pack_batches(roles.documents(spark, sf), "book_id", "doc_text")
    return packed.groupBy("share", "request").agg(F.count(F.lit(1)).alias("n_items"), F.sum("est_tokens").alias("n_tokens"))


@query(f"""WITH {_hashed_sql('v', 'documents', 'doc_id', 'text')}, {_hashed_sql('q', 'benchmark', 'item_id', 'text')},
vv AS (SELECT doc_id, list(x ORDER BY pos) AS v FROM v GROUP BY doc_id), qv AS (SELECT item_id, list(x ORDER BY pos) AS v FROM q GROUP BY item_id),
unit AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM vv), qunit AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM qv),
a AS (SELECT doc_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM unit),
b AS (SELECT item_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM qunit),
s AS (SELECT item_id AS query_id, doc_id AS book_id, round(list_distance(a.v, b.v), 9) AS dist FROM b, a)
SELECT query_id, book_id, rank, round(1 - dist * dist / 2, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, CAST(book_id AS VARCHAR)) AS rank FROM s) WHERE rank <= 12""")
def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as free-text queries against the document vectors; ties by the id as text."""
    content = cut(models.embed_texts(roles.documents(spark, sf), "doc_text"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = serving.semantic_search(asked, content)
    return top.select("query_id", "book_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _first_sentence(prompt: str) -> str:
    """Stands for a chat model: the first sentence of the first review."""
    return prompt.split("Reviews:\n- ", 1)[-1].split("\n\n- ", 1)[0].split(".", 1)[0]


@query(r"""WITH wanted AS (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY count(*) DESC, conv_id LIMIT 1000),
longest AS (SELECT conv_id, text FROM conversations SEMI JOIN wanted USING (conv_id)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, text) = 1)
SELECT conv_id AS book_id, trim(string_split(substring(text, 1, 600), '.')[1], ' ' || chr(10)) AS summary, 64 AS dim FROM longest""")
def distill_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts, checkpointed model calls and embedded summaries of the most reviewed books."""
    store = f"{scratch_dir(spark)}/summaries-{uuid.uuid4().hex}"
    said = roles.reviews(spark, sf)
    done = models.distill_reviews(said, _first_sentence, store, top_n=1000)
    return done.select("book_id", "summary", F.size("vector").alias("dim"))


ASSIGNED = f"""WITH {LONG}, {CENTROIDS}, eu AS ({_unit_sql('e', 'book_id')}),
s AS (SELECT book_id, cluster_id, round(sum(eu.x * c.x), 9) AS sim FROM eu JOIN c ON eu.pos = c.pos GROUP BY ALL)
SELECT book_id, cluster_id, round(sim, 6) AS similarity FROM s
QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY sim DESC, cluster_id) = 1"""


def _assigned(items: DataFrame, cents: DataFrame) -> DataFrame:
    return assign.assign_clusters(items.select("book_id", "vector"), cents, -1.0).select(
        "book_id", "cluster_id", F.round("similarity", 6).alias("similarity")
    )


@query(ASSIGNED)
def assign_items(spark: SparkSession, sf: str) -> DataFrame:
    v = roles.vectors(spark, sf)
    return _assigned(v, fusion.centroids(v))


@query(ASSIGNED)
def assign_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same assignment as a stream: files arrive, rows are appended with their cluster."""
    known = roles.vectors(spark, sf)
    items = table_stream(spark, sf, "embeddings").select(F.col("vec_id").alias("book_id"), F.col("embedding").alias("vector"))
    out = f"{scratch_dir(spark)}/assigned-{uuid.uuid4().hex}"
    cents = cut(fusion.centroids(known))
    assign.assign_stream(items, cents, out, f"{out}-state", -1.0).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(out)
    return stored.select("book_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


TREND = """WITH s AS (SELECT date_trunc('day', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d') AS day, event_type AS cluster_id, n, round(n / sum(n) OVER (PARTITION BY w), 6) AS share FROM s"""


def _daily(trend: DataFrame) -> DataFrame:
    return trend.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "cluster_id", "n", F.round("share", 6).alias("share"))


@query(TREND)
def cluster_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as clusters, day by day."""
    arriving = table(spark, sf, "events").select("ts", F.col("event_type").alias("cluster_id"))
    return _daily(assign.cluster_trend(arriving))


@query(TREND)
def cluster_trend_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same trend from a stream of events, with the open days in Spark's state."""
    events = table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("cluster_id"))
    out = f"{scratch_dir(spark)}/trend-{uuid.uuid4().hex}"
    assign.trend_stream(events, out, f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return _daily(assign.read_trend(spark.read.parquet(out)))


@query("""WITH d AS (SELECT CAST(substring(source, 4) AS INTEGER) AS cluster_id, lang FROM documents),
a AS (SELECT cluster_id, count(*) / (SELECT count(*) FROM d WHERE lang = 'en') AS s FROM d WHERE lang = 'en' GROUP BY 1),
b AS (SELECT cluster_id, count(*) / (SELECT count(*) FROM d) AS s FROM d GROUP BY 1)
SELECT cluster_id, round(coalesce(a.s, 0), 6) AS share_before, round(coalesce(b.s, 0), 6) AS share_after,
       round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS change FROM a FULL JOIN b USING (cluster_id)""")
def population_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Source shares of the English documents against those of all documents."""
    docs = roles.documents(spark, sf)
    drift = assign.population_drift(docs.where("lang = 'en'"), docs)
    return drift.select("cluster_id", *[F.round(c, 6).alias(c) for c in ("share_before", "share_after", "change")])


@query("""SELECT vec_id AS book_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y,
  coalesce(p_name, '') AS title, coalesce(p_brand, '') AS author, coalesce(r_name, 'Cluster ' || label) AS category
FROM embeddings LEFT JOIN part ON p_partkey = vec_id LEFT JOIN region ON r_regionkey = label""")
def map_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with title, author and category; only some clusters have a name."""
    v = roles.vectors(spark, sf)
    books = table(spark, sf, "part").select(
        F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author_name")
    )
    labels = table(spark, sf, "region").select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("name"))
    shown = serving.map_points(v.select("book_id", "vector"), books, v.select("book_id", "cluster_id"), labels)
    return shown.select(
        "book_id", F.round(F.col("x").cast("double"), 6).alias("x"), F.round(F.col("y").cast("double"), 6).alias("y"),
        "title", "author", "category",
    )


@query("""SELECT doc_id AS book_id, CAST(length(text) AS VARCHAR) AS reply FROM documents""")
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt to text on the partitions; the stand-in model answers with the length of the prompt."""
    prompts = roles.documents(spark, sf).select("book_id", "doc_text")
    return models.apply_model(prompts, "book_id", "doc_text", lambda p: str(len(p))).select("book_id", "reply")


@query("""SELECT conv_id * 100 + turn AS item, CAST(length(text) AS VARCHAR) AS reply FROM conversations""")
def resumed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Two checkpointed calls over one store: the second asks only what the first has not answered."""
    store = f"{scratch_dir(spark)}/replies-{uuid.uuid4().hex}"
    asked = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), "role", "text")

    def once(prompt: str) -> str:
        return str(len(prompt))

    models.run_checkpointed(asked.where("role = 'user'"), "item", "text", once, store)
    return models.run_checkpointed(asked, "item", "text", once, store)


@query(f"""WITH {LONG}, g AS (SELECT e.* FROM e SEMI JOIN labels ON doc_id = book_id AND quality = 1),
cr AS (SELECT label AS cluster_id, pos, avg(x) AS x FROM e GROUP BY ALL), c AS ({_unit_sql('cr', 'cluster_id')}),
gr AS (SELECT label AS cluster_id, pos, avg(x) AS x FROM g GROUP BY ALL), d AS ({_unit_sql('gr', 'cluster_id')})
SELECT cluster_id, round(sum(c.x * d.x), 6) AS similarity FROM c JOIN d USING (cluster_id, pos) GROUP BY cluster_id""")
def centroid_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of all items against those of the items of good quality."""
    v = roles.vectors(spark, sf)
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("book_id"))
    drift = assign.centroid_drift(fusion.centroids(v), fusion.centroids(v.join(good, "book_id", "left_semi")))
    return drift.select("cluster_id", F.round("similarity", 6).alias("similarity"))
