import json
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogmap.functions import vectors as vx
from catalogmap.operators import fusion, models, ranking, selection, serving
from catalogmap.operators.neighbors import scan_top_k
from catalogmap.sources import catalog, tables
from catalogmap.streaming import assign


def test_ndjson_tolerates_bad_lines_and_numbers(spark, tmp_path):
    lines = [
        {"book_id": "1", "title": "A", "average_rating": "3.5", "ratings_count": "x", "text_reviews_count": "7",
         "series": ["9"], "authors": [{"author_id": "5"}, {"author_id": "6"}],
         "popular_shelves": [{"name": f"s{i}"} for i in range(12)]},
        {"book_id": 2, "title": None, "average_rating": "", "authors": [], "popular_shelves": []},
    ]
    path = tmp_path / "books.json"
    path.write_text("\n".join(json.dumps(x) for x in lines) + '\n{"book_id": "3", "title"\n')
    got = catalog.project_books(catalog.read_ndjson(spark, str(path), catalog.BOOKS_RAW)).orderBy("book_id").collect()
    assert [r["book_id"] for r in got] == ["1", "2"]
    assert got[0]["average_rating"] == 3.5 and got[0]["ratings_count"] is None and got[0]["text_reviews_count"] == 7
    assert got[0]["first_author_id"] == "5" and len(got[0]["shelves"]) == 10
    assert got[1]["first_author_id"] is None and got[1]["average_rating"] is None
    assert catalog.read_ndjson(spark, str(path), catalog.BOOKS_RAW, sample=1).count() == 1
    counted = catalog.count_dropped(spark.read.text(str(path)), "value").first()
    assert (counted["n_rows"], counted["n_dropped"]) == (2, 1)
    with pytest.raises(Exception):
        catalog.read_ndjson(spark, str(path), catalog.GENRES_RAW, strict=True).collect()


def test_one_unfit_field_costs_no_row(spark):
    lines = [
        '{"book_id":"1","series":"text","authors":[{"author_id":"5"}]}', '{"book_id":"2","title":"T","authors":"x"}',
        '{"book_id":"3","num_pages":{"a":1},"series":["s"]}', "[1]", "7", "null", '{"book_id":"4"', "{}",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["book_id"]: r for r in catalog.project_books(catalog.parse_ndjson(df, "value", catalog.BOOKS_RAW)).collect()}
    assert set(got) == {"1", "2", "3", None}
    assert got["1"]["series_ids"] is None and got["1"]["first_author_id"] == "5"
    assert got["2"]["title"] == "T" and got["2"]["first_author_id"] is None
    assert got["3"]["num_pages"] is None and got["3"]["series_ids"] == ["s"]
    genres = spark.createDataFrame([('{"book_id":"1","genres":{"a":"2","b":null,"c":"x","d":3}}',), ('{"book_id":"2","genres":{"a":null}}',)], "value string")
    top = {r["book_id"]: r["top_genre"] for r in catalog.project_genres(catalog.parse_ndjson(genres, "value", catalog.GENRES_RAW)).collect()}
    assert top == {"1": "d", "2": None}


def test_optional_source(spark, tmp_path):
    schema = catalog.SERIES_RAW
    empty = catalog.read_optional(spark, lambda: spark.read.schema(schema).json(str(tmp_path / "none.json")), schema)
    assert empty.count() == 0 and empty.columns == ["series_id", "title"]
    assert tables.read_vectors(spark, str(tmp_path / "none.parquet")).count() == 0


def catalog_frame(spark, sizes):
    rows, i = [], 0
    for genre, n in sizes.items():
        for k in range(n):
            rows.append((i, genre, k + 1))
            i += 1
    rows += [(i, "x", None), (i + 1, "x", 0), (i + 2, None, 5)]
    return spark.createDataFrame(rows, "book_id bigint, top_genre string, text_reviews_count bigint")


@pytest.mark.parametrize("n", [4, 10, 21, 60, 500])
def test_selection_is_balanced_and_exact(spark, n):
    df = catalog_frame(spark, {"big": 40, "mid": 15, "small": 3})
    got = selection.stratified_select(df, n).collect()
    assert len({r["book_id"] for r in got}) == len(got) == min(n, 58)
    quota = math.ceil(n / 3)
    if n < 10:
        assert max(sum(r["top_genre"] == g for r in got) for g in ("big", "mid", "small")) <= quota
    if n == 21:  # small is taken whole, the gap goes to the highest ranks
        assert sum(r["top_genre"] == "small" for r in got) == 3
    again = {r["book_id"] for r in selection.stratified_ids(df, n).collect()}
    assert again == {r["book_id"] for r in got}


def test_top_k_with_one_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100 + 1).alias("g"))
    salted = ranking.top_k_per_group(df, ["g"], [F.desc("id")], 7, "r", salt_on=["id"])
    plain = ranking.top_k_per_group(df, ["g"], [F.desc("id")], 7, "r")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_large_sample_takes_the_same_rows(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "book_id")
    small = {r[0] for r in ranking.sample_exact(df, "book_id", 1234).collect()}
    monkeypatch.setattr(ranking, "MAP_SIDE_ROWS", 10)
    assert {r[0] for r in ranking.sample_exact(df, "book_id", 1234).collect()} == small
    assert ranking.sample_exact(df, "book_id", 9999).count() == 5000


def test_contiguous_ids(spark):
    df = spark.createDataFrame([(x,) for x in (9, 4, 4, 30, 7, 9)], "k int")
    assert {r["k"]: r["n"] for r in ranking.contiguous_ids(df, "k", "n").collect()} == {4: 0, 7: 1, 9: 2, 30: 3}


def test_bundle(spark, tmp_path):
    books = catalog_frame(spark, {"a": 4})
    rv = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "book_id bigint, review_text string")
    manifest = tables.freeze_bundle(books, rv, str(tmp_path / "ok"), 5, "text_reviews_count").first()
    assert (manifest["n_reviews"], manifest["n_books_with_reviews"], manifest["avg_reviews_per_book"]) == (3, 2, 1.5)
    assert tables.read_table(spark, str(tmp_path / "ok" / "reviews.parquet")).count() == 3
    stray = rv.unionByName(spark.createDataFrame([(99, "q")], rv.schema))
    with pytest.raises(tables.BundleError, match="outside the selection: 1"):
        tables.freeze_bundle(books, stray, str(tmp_path / "bad"), 5, "r")
    assert not (tmp_path / "bad").exists()
    twice = selection.verify_bundle(books.unionByName(books.limit(1)), rv).where("violations > 0").collect()
    assert [r["check_name"] for r in twice] == ["book id repeated"]


def test_credits_keep_books_without_a_match(spark):
    books = spark.createDataFrame([(1, 10, 5), (2, None, 6)], "book_id int, first_author_id int, work_id int")
    authors = spark.createDataFrame([(10, "N", 1.0)], "author_id int, name string, average_rating double")
    works = spark.createDataFrame([(6, 1999, "T")], "work_id int, pub_year bigint, original_title string")
    got = {r["book_id"]: (r["author_name"], r["pub_year"]) for r in selection.with_credits(books, authors, works).collect()}
    assert got == {1: ("N", None), 2: (None, 1999)}


def vec(spark, rows):
    return spark.createDataFrame(rows, "book_id string, vector array<float>")


def test_l2_normalize(spark):
    df = vec(spark, [("a", [3.0, 4.0]), ("z", [0.0, 0.0])]).select("book_id", vx.l2_normalize("vector").alias("v"))
    got = {r["book_id"]: r["v"] for r in df.collect()}
    assert np.linalg.norm(got["a"]) == pytest.approx(1, abs=1e-6) and got["z"] == [0.0, 0.0]


def test_pool_follows_votes(spark):
    rows = [("b", [1.0, 0.0], 0), ("b", [0.0, 1.0], 100), ("n", [2.0, 0.0], None), ("n", [0.0, 2.0], -5), ("z", [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "book_id string, vector array<float>, n_votes bigint")
    got = {r["book_id"]: r["vector"] for r in fusion.pool_vectors(df).collect()}
    assert len(got["b"]) == 2 and got["b"][1] > got["b"][0]
    assert got["n"][0] == pytest.approx(got["n"][1]) and got["z"] == [0.0, 0.0]


def test_fusion_blocks(spark):
    content = vec(spark, [("a", [3.0, 4.0]), ("b", [1.0, 0.0])])
    pool = vec(spark, [("a", [0.0, 2.0])])
    got = {r["book_id"]: np.array(r["vector"]) for r in fusion.fuse_vectors(content, pool, None).collect()}
    raw = np.array([0.3, 0.4, 0, 0.3, 0, 0])
    assert np.allclose(got["a"], raw / np.linalg.norm(raw), atol=1e-6)
    assert np.allclose(got["b"], [1, 0, 0, 0, 0, 0], atol=1e-6)


@pytest.mark.parametrize("k", [900, 1500])
def test_large_k_in_a_hot_group(spark, k):
    rows = [(i, "hot" if i % 10 else None, (i * 7919) % 5003) for i in range(6000)] + [(9000 + i, "few", i) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, g string, x int").repartition(5)
    order = [F.desc("x"), F.col("id")]
    want = {}
    for g in ("hot", None, "few"):
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:k]
        want |= {r[0]: n + 1 for n, r in enumerate(best)}
    got = ranking.top_k_per_group(df, ["g"], order, k, "rank", salt_on=["id"])
    assert {r["id"]: r["rank"] for r in got.collect()} == want
    first = [r["id"] for r in ranking.first_rows(df, order, k).collect()]
    assert sorted(first) == sorted(r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:k])


def test_packing_limits():
    assert models.request_bounds(np.ones(130)) == [0, 128, 130]
    assert models.request_bounds(np.array([200, 100, 400, 1]), max_tokens=300) == [0, 2, 3, 4]
    assert models.request_bounds(np.array([])) == [0]


def test_long_texts_are_read_whole(spark):
    def first_letters(texts):
        assert all(len(t) <= 10 for t in texts)
        return np.array([[t.count("a"), t.count("b")] for t in texts], float)

    df = spark.createDataFrame([("1", "a" * 10 + "b" * 10), ("2", "a" * 10 + "b" * 5), ("3", None), ("4", "b")], "book_id string, t string")
    got = {r["book_id"]: list(r["vector"]) for r in models.embed_texts(df, "t", first_letters, max_chars=10).collect()}
    assert got["1"] == pytest.approx([2**-0.5, 2**-0.5])
    assert got["2"] == pytest.approx(np.array([100, 25]) / np.hypot(100, 25))
    assert got["3"] == [0, 0] and got["4"] == [0, 1]


def test_hashed_vectors_keep_rows(spark):
    rows = [(1, "red red roses"), (1, "red red roses"), (1, "other words"), (None, ""), (2, None), (3, "x " * 9000 + "tail tail")]
    got = models.hashed_vectors(spark.createDataFrame(rows, "book_id long, t string"), "t").collect()
    assert sorted(str(r["book_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(len(r["vector"]) == 64 for r in got)
    norms = {str(r["book_id"]): np.linalg.norm(r["vector"]) for r in got}
    assert norms["None"] == norms["2"] == 0 and norms["3"] == pytest.approx(1)


def test_near_copies_come_by_distance(spark):
    base = np.array([1.0, 0, 0])
    points = [(1, [1.0, 2e-5, 0.0]), (2, [1.0, 1e-5, 0.0]), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in points], "book_id int, vector array<double>")
    asked = spark.createDataFrame([(9, base.tolist())], "book_id int, vector array<double>")
    assert [r["near"] for r in scan_top_k(asked, df, 2).orderBy("rank").collect()] == [2, 1]


def test_scan_hands_out_few_queries_at_a_time(spark, monkeypatch):
    from catalogmap.operators import neighbors

    monkeypatch.setattr(neighbors, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "book_id long, vector array<double>")
    asked = df.where("book_id % 3 = 0")
    found, want = scan_top_k(asked, df, 4), neighbors.knn_join(asked, df, 4, "cosine")
    place = lambda rows: sorted((r["id"], r["rank"], r["near"]) for r in rows.collect())
    assert place(found) == place(want)


def test_embedding_requests(spark):
    seen = []

    def fn(texts):
        assert len(texts) <= 3
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(str(i), "y" * i) for i in range(10)], "book_id string, doc_text string")
    out = models.embed_texts(df, "doc_text", fn, max_items=3).collect()
    assert len(out) == 10 and not seen
    assert all(np.linalg.norm(r["vector"]) == pytest.approx(1, abs=1e-6) for r in out)


def test_model_calls_resume(spark, tmp_path):
    table = str(tmp_path / "replies")
    df = spark.createDataFrame([("a", "one"), ("b", "bad"), ("c", "three")], "book_id string, prompt string")

    def fails(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper() + " "

    first = {r["book_id"]: r["reply"] for r in models.run_checkpointed(df, "book_id", "prompt", fails, table).collect()}
    assert first == {"a": "ONE", "c": "THREE"}
    errors = models.apply_model(df, "book_id", "prompt", fails).where("error is not null").collect()
    assert [(r["book_id"], r["error"]) for r in errors] == [("b", "no")]

    changed = df.withColumn("prompt", F.when(F.col("book_id") == "a", "new").otherwise(F.col("prompt")))

    def only_open(prompt):  # stored prompts must not be asked again
        assert prompt in ("new", "bad")
        return "later"

    second = {r["book_id"]: r["reply"] for r in models.run_checkpointed(changed, "book_id", "prompt", only_open, table, parts=2).collect()}
    assert second == {"a": "later", "b": "later", "c": "THREE"}


def test_prompts_of_one_id_keep_their_own_replies(spark, tmp_path):
    rows = [(i % 40, f"prompt {i}") for i in range(120)] + [(7, "prompt 7")]
    df = spark.createDataFrame(rows, "item long, prompt string")
    got = models.run_checkpointed(df, "item", "prompt", str.upper, str(tmp_path / "replies"), parts=3).collect()
    assert sorted(map(tuple, got)) == sorted((i, p.upper()) for i, p in rows)


def test_a_share_reads_its_own_files(spark, tmp_path, monkeypatch):
    read, plain = [], models.apply_model
    monkeypatch.setattr(models, "apply_model", lambda share, *args: read.append([r[0] for r in share.select(F.input_file_name()).distinct().collect()]) or plain(share, *args))
    monkeypatch.setattr(models, "SHARE_PROMPTS", 50)
    df = spark.range(200).select(F.col("id").alias("item"), F.col("id").cast("string").alias("prompt"))
    seen = []
    assert models.run_checkpointed(df, "item", "prompt", str, str(tmp_path / "replies")).count() == 200
    for files in read:
        seen += files
    assert len(read) == 4 and len(seen) == len(set(seen))


def test_distill(spark, tmp_path):
    rv = spark.createDataFrame([("a", "long text"), ("a", "x"), ("b", "y")], "book_id string, review_text string")
    out = models.distill_reviews(rv, lambda p: p[-5:], str(tmp_path / "d"), top_n=1).collect()
    assert [(r["book_id"], len(r["vector"])) for r in out] == [("a", 64)]
    assert models.distill_reviews(rv, None, "").count() == 0


def test_search_and_display(spark):
    content = models.embed_texts(
        spark.createDataFrame([("1", "space ships war"), ("2", "garden roses soil")], "book_id string, doc_text string"), "doc_text"
    )
    asked = spark.createDataFrame([(1, "roses in the garden")], "query_id int, text string")
    assert serving.semantic_search(asked, content, k=1).first()["book_id"] == "2"

    xy = spark.createDataFrame([("1", [0.0, 1.0]), ("2", [1.0, 1.0]), ("3", [2.0, 2.0])], "book_id string, vector array<double>")
    books = spark.createDataFrame([("1", "T", None)], "book_id string, title string, author_name string")
    clusters = spark.createDataFrame([("1", 0), ("2", 7)], "book_id string, cluster_id int")
    labels = spark.createDataFrame([(0, "Zero", "k")], "cluster_id int, name string, keywords string")
    got = {r["book_id"]: (r["title"], r["author"], r["category"]) for r in serving.map_points(xy, books, clusters, labels).collect()}
    assert got == {"1": ("T", "", "Zero"), "2": ("", "", "Cluster 7"), "3": ("", "", "Unclustered")}
    static = serving.map_points(xy, books, clusters, labels, unlabelled="Unlabelled")
    assert {r["category"] for r in static.collect()} == {"Zero", "Unlabelled"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "book_id bigint, vector array<double>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster_id int, centroid array<double>")
    items = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = (
        assign.assign_clusters(items, cents, 0.2).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    key = lambda d: sorted((r["book_id"], r["cluster_id"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(assign.assign_clusters(df, cents, 0.2))
    assert any(c == -1 for _, c in key(assign.assign_clusters(df, cents, 0.2)))


@pytest.mark.parametrize("files", [0, 3])
def test_stream_queries_read_a_table_of_one_file_or_many(spark, tmp_path, files):
    from catalogmap.plans import spaces

    for name in ("embeddings", "events"):
        given = f"/root/testdata/sf0.001/{name}.parquet"
        if files:
            spark.read.parquet(given).repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            shutil.copy(given, tmp_path)
    for stream, plain in ((spaces.assign_stream, spaces.assign_items), (spaces.cluster_trend_stream, spaces.cluster_trend)):
        want = sorted(map(tuple, plain(spark, str(tmp_path)).collect()))
        assert want and sorted(map(tuple, stream(spark, str(tmp_path)).collect())) == want


def test_trend_of_a_stream_with_late_rows(spark, tmp_path):
    batches = [
        [("2024-01-01 12:00", 0), ("2024-01-01 12:00", 0), ("2024-01-01 08:00", 1)],
        [("2024-01-03 12:00", 1), ("2024-01-01 09:00", 0)],  # a late row of an open day
        [("2024-01-01 10:00", 1), ("2024-01-02 10:00", 0)],  # the first day is closed by now, the second is not
        [("2024-01-03 13:00", 1)],
    ]
    frames = [spark.createDataFrame(b, "ts string, cluster_id int").select(F.to_timestamp("ts").alias("ts"), "cluster_id") for b in batches]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for df in frames:  # every start goes on from the state of the one before
        df.coalesce(1).write.mode("append").parquet(source)
        items = spark.readStream.schema(df.schema).parquet(source)
        assign.trend_stream(items, out, state).trigger(availableNow=True).start().awaitTermination()
    counted = frames[0].unionByName(frames[1]).unionByName(frames[2].where("cluster_id = 0")).unionByName(frames[3])
    rows = lambda df: sorted(map(tuple, df.select("window_start", "cluster_id", "n", "share").collect()))
    assert rows(assign.read_trend(spark.read.parquet(out))) == rows(assign.cluster_trend(counted))


def test_drift(spark):
    a = spark.createDataFrame([(0,), (0,), (1,), (1,)], "cluster_id int")
    b = spark.createDataFrame([(0,), (2,)], "cluster_id int")
    got = {r["cluster_id"]: r["change"] for r in assign.population_drift(a, b).collect()}
    assert got == {0: 0.0, 1: -0.5, 2: 0.5}
    old = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    new = spark.createDataFrame([(0, [0.0, 1.0])], "cluster_id int, centroid array<double>")
    assert assign.centroid_drift(old, new).first()["similarity"] == 0.0


def test_assignment_by_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 3)))], "book_id bigint, vector array<double>")
    cents = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(5, 3)))], "cluster_id int, centroid array<double>")
    key = lambda d: sorted((r["book_id"], r["cluster_id"], round(r["similarity"], 6)) for r in d.collect())
    sent = key(assign.assign_clusters(df, cents, 0.3))
    monkeypatch.setattr(assign, "MAX_BROADCAST_BYTES", 1)
    assert key(assign.assign_clusters(df, cents, 0.3)) == sent
