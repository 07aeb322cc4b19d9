import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from catalogmap.operators import approximate, balls, condensed, density, foreign, graph, membership, merging, metrics, neighbors, reduce, tuning
from catalogmap.session import cut, cut_counted


def frame(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "book_id bigint, vector array<double>, cluster_id int")


def blobs(seed=0, sizes=(30, 25, 20), spread=0.4, noise=8, dim=2):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [6, 0], [3, 7]])
    parts = [np.pad(centers[i], (0, dim - 2)) + rng.normal(0, spread, (n, dim)) for i, n in enumerate(sizes)]
    parts.append(rng.uniform(-4, 10, (noise, dim)))
    return np.vstack(parts)


def as_lists(near):
    out = {}
    for r in near.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["near"])
    return out


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_knn_equals_brute_force(spark, block_rows):
    x = np.random.default_rng(1).normal(size=(120, 5))
    got = as_lists(neighbors.knn(frame(spark, x), 7, "euclidean", block_rows))
    assert got == brute.nearest(brute.distance_matrix(x), 7)


def test_knn_with_a_third_of_all_rows_equal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    x[::3] = x[0]
    x[1::9] = x[1]
    got = as_lists(neighbors.knn(frame(spark, x), 5, "euclidean", 16))
    assert got == brute.nearest(brute.distance_matrix(x), 5)


def test_knn_cosine_keeps_a_zero_vector_apart(spark):
    x = np.array([[1.0, 0], [2.0, 0.1], [0, 0], [0, 1.0]])
    got = as_lists(neighbors.knn(frame(spark, x), 1, "cosine"))
    assert got[0] == [1] and got[1] == [0] and got[3] == [1]


def test_knn_join_of_two_tables_skips_the_equal_id(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[10:20] = x[9]
    some = frame(spark, x).where("book_id < 15")
    got = as_lists(neighbors.knn_join(some, frame(spark, x), 4, "euclidean", 16))
    want = brute.nearest(brute.distance_matrix(x), 4)
    assert got == {i: want[i] for i in range(15)}


def test_scan_equals_join(spark):
    x = np.random.default_rng(4).normal(size=(50, 4))
    df = frame(spark, x)
    scanned = neighbors.scan_top_k(df.where("book_id < 5"), df, 6)
    assert as_lists(scanned) == {k: v for k, v in as_lists(neighbors.knn(df, 6)).items() if k < 5}


@pytest.mark.parametrize("asked_type,known_type", [("string", "bigint"), ("bigint", "string"), ("string", "string")])
def test_many_queries_may_have_ids_of_another_type(spark, monkeypatch, asked_type, known_type):
    """Queries too many to be sent to all tasks take the block join, whatever the types of both ids; copies included."""
    x = np.random.default_rng(14).normal(size=(150, 4))
    x[40:44] = x[39]
    typed = lambda kind: frame(spark, x).withColumn("book_id", F.col("book_id").cast(kind))
    asked, known = typed(asked_type).where("cast(book_id as int) >= 100"), typed(known_type)
    few = neighbors.scan_top_k(asked, known, 6)
    monkeypatch.setattr(neighbors, "MAX_BROADCAST_BYTES", 800)  # and 25 pivots at most
    many = neighbors.scan_top_k(asked, known, 6)
    assert [f.dataType.simpleString() for f in many.schema][:2] == [asked_type, known_type]
    rows = lambda df: sorted((str(r["id"]), r["rank"], str(r["near"]), round(r["similarity"], 9)) for r in df.collect())
    assert len(rows(many)) == 300 and rows(many) == rows(few)


def test_components_and_forest(spark):
    rng = np.random.default_rng(5)
    edges = [(float(round(rng.uniform(), 6)), int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2)) if a != b]
    edges += [(0.5 + i / 100, i, i + 1) for i in range(100, 140)]  # a long path
    df = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    forest = brute.kruskal([(w, u, v) for w, u, v in edges])
    got = graph.min_spanning_forest(df).collect()
    assert len(got) == len(forest)
    assert sum(r["w"] for r in got) == pytest.approx(sum(w for w, _, _ in forest))
    parts = {}
    for r in graph.connected_components(df).collect():
        parts.setdefault(r["component"], set()).add(r["id"])
    assert all(min(ids) == c for c, ids in parts.items())
    assert sum(len(p) - 1 for p in parts.values()) == len(forest)
    assert {*range(100, 141)} in parts.values()


@pytest.mark.parametrize("block_rows,few", [(20, 0), (20, 8), (1000, 8)])
def test_reachability_forest_is_the_true_tree(spark, block_rows, few, monkeypatch):
    monkeypatch.setattr(density, "FEW_BLOCKS", few)
    x = blobs(6, noise=15)
    m = brute.reachability(brute.distance_matrix(x), 4)
    want = brute.kruskal([(m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))])
    tree = density.reachability_forest(frame(spark, x), 4, block_rows=block_rows).collect()
    assert sorted((r["u"], r["v"]) for r in tree) == sorted((u, v) for _, u, v in want)
    assert sum(r["w"] for r in tree) == pytest.approx(sum(w for w, _, _ in want), abs=1e-6)


@pytest.mark.parametrize("case", ["far blobs", "grid", "copies"])
def test_parts_seek_their_least_way_out(spark, case):
    rng = np.random.default_rng(8)
    if case == "far blobs":  # no neighbour list leads out of a blob
        x = np.vstack([rng.normal(100 * c, 1, (40, 3)) for c in range(5)])
    elif case == "grid":  # ties everywhere
        x = np.array([[i, j] for i in range(12) for j in range(12)], float)
    else:
        x = rng.normal(size=(150, 2))
        x[::3], x[1::9] = x[0], x[1]
    df = frame(spark, x)
    near = cut(neighbors.knn(df, 6, "euclidean", 16))
    pts = df.select(F.col("book_id").alias("id"), F.col("vector").alias("vec")).join(graph.core_distances(near, 4), "id")
    tree = foreign.exact_forest(cut(pts), near, 16).collect()
    m = brute.reachability(brute.distance_matrix(x), 4)
    want = brute.kruskal([(m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))])
    assert len(tree) == len(x) - 1
    assert sorted(r["w"] for r in tree) == pytest.approx(sorted(w for w, _, _ in want), abs=1e-6)
    if case != "copies":  # a copy hangs on the first of its kind
        assert sorted((r["u"], r["v"]) for r in tree) == sorted((u, v) for _, u, v in want)


def test_forest_of_few_rows(spark):
    for x in (np.zeros((3, 2)), np.array([[0.0, 0], [1, 0]])):
        df = frame(spark, x)
        near = neighbors.knn(df, 4, "euclidean")
        pts = df.select(F.col("book_id").alias("id"), F.col("vector").alias("vec"), F.lit(0.5).alias("core"))
        assert foreign.exact_forest(pts, near, 16).count() == len(x) - 1


def test_a_partner_comes_once_to_a_group_of_asking_blocks(spark, monkeypatch):
    """Without structure most blocks ask for most others; their rows must not move once per pair of blocks."""
    seen, plain = [], foreign._dealt

    def counted(pairs, groups):
        dealt = plain(pairs, groups)
        asking, asked = pairs.agg(F.countDistinct("i"), F.countDistinct("j")).first()
        seen.append((pairs.count(), dealt.count(), asking, asked, dealt.agg(F.countDistinct("g")).first()[0]))
        return dealt

    monkeypatch.setattr(foreign, "_dealt", counted)
    x = np.random.default_rng(31).normal(size=(400, 8))
    df = frame(spark, x)
    near = cut(neighbors.knn(df, 5, "euclidean", 20))
    pts = df.select(F.col("book_id").alias("id"), F.col("vector").alias("vec")).join(graph.core_distances(near, 4), "id")
    tree = foreign.exact_forest(cut(pts), near, 20).collect()
    m = brute.reachability(brute.distance_matrix(x), 4)
    want = brute.kruskal([(m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))])
    assert sorted((r["u"], r["v"]) for r in tree) == sorted((u, v) for _, u, v in want)
    pairs, sent, asking, asked, groups = seen[0]
    assert asking > 4
    assert sent <= groups * asked and pairs > 2 * sent


def test_the_inside_of_a_part_is_passed_over(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(20 * c, 1, (200, 4)) for c in range(6)])
    met, plain = [], foreign.foreign_pairs

    def counted(asking, blocks, cells):
        pairs = plain(asking, blocks, cells)
        met.append((pairs.count(), blocks.count()))
        return pairs

    monkeypatch.setattr(foreign, "foreign_pairs", counted)
    df = frame(spark, x)
    near = cut(neighbors.knn(df, 15, "euclidean", 40))
    pts = df.select(F.col("book_id").alias("id"), F.col("vector").alias("vec")).join(graph.core_distances(near, 5), "id")
    assert foreign.exact_forest(cut(pts), near, 40).count() == len(x) - 1
    blocks = met[0][1]
    assert sum(n for n, _ in met) < 0.3 * len(met) * blocks * blocks


@pytest.mark.parametrize("seed,mcs,selection", [(7, 5, "leaf"), (8, 3, "eom"), (9, 8, "eom")])
def test_density_clusters_equal_the_merge_tree(spark, seed, mcs, selection):
    x = blobs(seed, spread=0.9, noise=20)
    forest = cut(density.reachability_forest(frame(spark, x), 3))
    edges = [(r["w"], r["u"], r["v"]) for r in forest.collect()]
    want = brute.merge_tree_clusters(edges, len(x), mcs, selection)
    got = density.density_clusters(forest, frame(spark, x), mcs, selection).orderBy("book_id").collect()
    assert [r["cluster_id"] for r in got] == list(want)
    assert all((r["probability"] == 0) == (r["cluster_id"] < 0) for r in got)
    assert {c for c in want if c >= 0} == {r["cluster_id"] for r in got if r["probability"] == 1.0}


def shaped_tree(shape, n=70):
    rng = np.random.default_rng(5)
    if shape == "rising path":
        return [(1.0 + i, i, i + 1) for i in range(n)]
    if shape == "equal path":
        return [(1.0, i, i + 1) for i in range(n)]
    if shape == "star":
        return [(float(rng.integers(1, 9)), 0, i) for i in range(1, n)]
    if shape == "comb":  # pairs hang on a rising path: every merge of the path is a split for size 2
        return [(1.0 + i, 2 * i, 2 * i + 2) for i in range(n // 2)] + [(0.5, 2 * i, 2 * i + 1) for i in range(n // 2 + 1)]
    trees = 3 if shape == "forest" else 1  # node i hangs on an earlier node of the tree i % trees
    return [(round(float(rng.exponential()), 1), int(rng.integers(i // trees)) * trees + i % trees, i) for i in range(trees, n)]


@pytest.mark.parametrize("shape", ["rising path", "star", "comb", "forest"])
def test_merge_tree_equals_the_merge_list(spark, shape):
    edges = shaped_tree(shape)
    want, want_least = brute.merge_list(edges)
    forest = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    tree, least = condensed.merge_tree(forest)
    got = {tuple(r["e"]): (r["parent"] and tuple(r["parent"]), r["size"]) for r in tree.collect()}
    assert got == want
    assert {r["id"]: tuple(r["e"]) for r in least.collect()} == want_least


@pytest.mark.parametrize("shape,mcs", [("comb", 2), ("random", 5)])
def test_stable_clusters_of_deep_trees(spark, shape, mcs):
    edges = shaped_tree(shape)
    forest = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    n = 1 + max(v for _, _, v in edges)
    nodes = spark.range(n).withColumnRenamed("id", "book_id")
    tree = condensed.merge_tree(forest)
    for selection in ("leaf", "eom"):
        got = density.density_clusters(forest, nodes, mcs, selection, tree=tree).orderBy("book_id").collect()
        assert [r["cluster_id"] for r in got] == list(brute.merge_tree_clusters(edges, n, mcs, selection))


def test_levels_are_nested(spark):
    edges = shaped_tree("random", 90)
    forest = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    rows = density.cluster_levels(forest, spark.range(90).withColumnRenamed("id", "book_id"), [3, 6, 12]).collect()
    of = {(r["level"], r["book_id"]): r["cluster_id"] for r in rows}
    parents = {}
    for r in rows:
        assert r["parent_id"] == of.get((r["level"] - 1, r["book_id"]), -1)
        if r["cluster_id"] >= 0:
            parents.setdefault((r["level"], r["cluster_id"]), set()).add(r["parent_id"])
    assert {len(p) for p in parents.values()} == {1}
    for level, size in enumerate((12, 6, 3)):
        assert [of[level, i] for i in range(90)] == list(brute.merge_tree_clusters(edges, 90, size, "leaf"))


def test_levels_send_no_table_with_a_row_per_node_to_the_driver(spark, monkeypatch):
    edges = shaped_tree("random", 90)
    forest = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    plans = []

    def noted(write):
        return lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest))[1]

    for module in (density, condensed, graph):
        monkeypatch.setattr(module, "cut", noted(cut))
        monkeypatch.setattr(module, "cut_counted", noted(cut_counted))
    nodes = spark.range(90).withColumnRenamed("id", "book_id")
    plans.append(density.cluster_levels(forest, nodes, [3, 6, 12])._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "BroadcastHashJoin" in p and "_p#" not in p]  # but for a row per partition


def test_stable_clusters_send_no_table_with_a_row_per_node_to_the_driver(spark, monkeypatch):
    edges = shaped_tree("random", 90)
    forest = spark.createDataFrame([(u, v, w) for w, u, v in edges], "u bigint, v bigint, w double")
    plans = []

    def noted(write):
        return lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest))[1]

    for name, write in (("cut", cut), ("cut_counted", cut_counted)):
        monkeypatch.setattr(condensed, name, noted(write))
    found = density.density_clusters(forest, spark.range(90).withColumnRenamed("id", "book_id"), 4, "eom")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "BroadcastHashJoin" in p and "_p#" not in p]  # but for a row per partition


def test_long_chain_of_growing_gaps(spark):
    n = 200
    rows = [(i, i + 1, 1.0 + i) for i in range(n)]
    forest = spark.createDataFrame(rows, "u bigint, v bigint, w double")
    settled = {r["id"]: r["t"]["w"] for r in density.settling_edges(forest, 6).collect()}
    assert all(settled[i] == max(5.0, float(i)) for i in range(n + 1))


def test_two_trees_are_apart(spark):
    rows = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 2.0), (10, 11, 1.0), (11, 12, 1.5), (20, 21, 1.0)]
    forest = spark.createDataFrame(rows, "u bigint, v bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 10, 11, 12, 20, 21, 30)], "book_id bigint")
    got = {r["book_id"]: r["cluster_id"] for r in density.density_clusters(forest, nodes, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 10: 1, 11: 1, 12: 1, 20: -1, 21: -1, 30: -1}
    levels = density.cluster_levels(forest, nodes, [3, 4]).where("book_id in (0, 10)").collect()
    assert {(r["book_id"], r["level"], r["cluster_id"]) for r in levels} == {(0, 0, -1), (10, 0, -1), (0, 1, 0), (10, 1, 1)}


def test_one_blob_is_noise(spark):
    x = np.random.default_rng(12).normal(size=(12, 2))
    forest = density.reachability_forest(frame(spark, x), 3)
    got = density.density_clusters(forest, frame(spark, x), 12).collect()
    assert {r["cluster_id"] for r in got} == {-1}


@pytest.mark.parametrize("block_rows", [12, 1000])
def test_dbcv_equals_brute_force(spark, block_rows):
    x = blobs(13, spread=0.7, noise=0)
    labels = np.repeat([0, 1, 2], (30, 25, 20))
    labels[::11] = -1
    x[5] = x[4]
    got = metrics.dbcv(frame(spark, x, labels), block_rows=block_rows).first()[0]
    assert got == pytest.approx(brute.dbcv(x, labels), abs=1e-6)


def plain_tree(x, core):
    """Prim's tree with all distances of every row, edges compared as (w, u, v)."""
    n, now, out = len(x), 0, []
    best, done = [(np.inf, -1, -1)] * n, [False] * n
    for _ in range(n - 1):
        done[now] = True
        for i in range(n):
            if not done[i]:
                d = np.sqrt(((x[i] - x[now]) ** 2).sum()).round(9)
                best[i] = min(best[i], (max(d, core[i], core[now]), min(i, now), max(i, now)))
        now = min((b, i) for i, b in enumerate(best) if not done[i])[1]
        out.append(best[now])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_local_tree_equals_the_plain_tree(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, size=(50, 3)).astype(float) if seed % 2 else rng.normal(size=(50, 3)) * 1e-3 + 1e3
    core = rng.random(50) * (seed % 3)
    u, v, w = foreign.local_tree(x, core)
    assert list(zip(w.tolist(), np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True)) == plain_tree(x, core)


def test_inverse_powers():
    """Powers by squaring equal those of the definition, and equal points add nothing."""
    d = np.array([[0.0, 0.5], [2.0, 1e-3]])
    for dim in (1, 2, 7, 64):
        assert metrics.inverse_powers(d, dim) == pytest.approx(np.array([[0.0, 2.0**dim], [0.5**dim, 1e3**dim]]))


def test_dbcv_below_its_limits(spark):
    assert metrics.dbcv(frame(spark, np.zeros((5, 2)), [0, 0, 1, 1, 1])).first()[0] == -1.0
    assert metrics.dbcv(frame(spark, np.eye(12), [0] * 12)).first()[0] == -1.0


def test_silhouette_blocks_agree(spark):
    x, labels = blobs(14, noise=0), np.repeat([0, 1, 2], (30, 25, 20))
    df = frame(spark, x, labels)
    a, b = metrics.silhouette(df, block_rows=10).first()[0], metrics.silhouette(df).first()[0]
    d = brute.distance_matrix(x)
    want = []
    for i in range(len(x)):
        means = {c: d[i][labels == c].sum() / ((labels == c).sum() - (c == labels[i])) for c in (0, 1, 2)}
        own = means.pop(labels[i])
        want.append((min(means.values()) - own) / max(own, min(means.values())))
    assert a == b == pytest.approx(np.mean(want), abs=1e-4)


def test_silhouette_hands_out_few_sums_per_row():
    """Of the clusters that pass by whole, a row keeps the least mean alone; its own and unfinished ones keep their sums."""
    rng = np.random.default_rng(15)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(40, 3))
    held = metrics._DistanceSums(4)
    held.add(pa.array(range(6)), np.array([0, 0, 1, 1, 9, 9]), x)
    held.start()
    out = []
    for c in range(10):
        out += held.finished()
        held.cluster, held.size = c, 4 if c < 9 else 5  # of the last one a row is elsewhere
        held.meet(y[4 * c : 4 * c + 4])
    got = pa.Table.from_batches([*out, *held.finished(), held.leasts(3)]).to_pandas()
    assert got["other"].value_counts().to_dict() == {0: 2, 1: 2, 9: 6, -4: 6}
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).reshape(6, 10, 4).sum(2)
    least = [min(d[i, c] / 4 for c in range(9) if c != own) for i, own in enumerate([0, 0, 1, 1, 9, 9])]
    assert got[got["other"] == -4]["s"].tolist() == pytest.approx(least)
    assert got[got["other"] == 9]["s"].tolist() == pytest.approx(d[:, 9])


def test_merge_follows_the_greedy_order(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(40, 2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = frame(spark, x, range(40))
    for rows in (8, 1000):
        got = merging.merge_map(df.select("cluster_id", "vector"), 0.9, rows)
        assert brute.is_greedy_merge({r["cluster_id"]: r["leader"] for r in got.collect()}, dict(enumerate(x)), 0.9)


def test_merge_chain_does_not_pass_through(spark):
    angles = np.deg2rad([0, 20, 40])
    x = np.c_[np.cos(angles), np.sin(angles)]
    df = frame(spark, x, [0, 1, 2])
    out = merging.merge_clusters(df.select("book_id", "cluster_id"), df.select("book_id", "vector"), 0.92)
    assert [r["cluster_id"] for r in out.orderBy("book_id").collect()] == [0, 0, 1]


def test_rescue_takes_the_nearest_cluster(spark):
    x = np.array([[0, 0], [0.1, 0], [10, 0], [10.1, 0], [1, 0], [5.05, 0]], float)
    rows = [(i, c, p) for i, (c, p) in enumerate([(0, 1.0), (0, 0.5), (1, 1.0), (1, 0.5), (-1, 0.0), (-1, 0.0)])]
    clusters = spark.createDataFrame(rows, "book_id bigint, cluster_id int, probability double")
    for chunk in (1, 4096):
        out = merging.rescue_noise(clusters, frame(spark, x).drop("cluster_id"), 0.6, chunk_rows=chunk)
        got = {r["book_id"]: (r["cluster_id"], r["probability"]) for r in out.collect()}
        assert got[4] == (0, 0.0) and got[5][0] == -1 and got[0] == (0, 1.0)


@pytest.mark.parametrize("chunk_rows", [7, 1000])
def test_rescue_returns_a_row_per_noise_row_and_chunk(spark, monkeypatch, chunk_rows):
    """Not one per noise row and cluster; ties, copies and a cluster of more exemplars than a chunk holds included."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = np.random.default_rng(31)
    x = rng.normal(size=(160, 3)).round(1)
    label = [-1] * 60 + [0] * 20 + [1 + i // 2 for i in range(80)]
    x[81], x[83] = x[80], x[80]  # exemplars of clusters 1 and 2 in one place
    x[0] = x[80]
    clusters = spark.createDataFrame([(i, c, 0.0 if c < 0 else 1.0) for i, c in enumerate(label)], "book_id bigint, cluster_id int, probability double")
    met, apply = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, fn, schema: (met.append(apply(self, fn, schema)), met[-1])[1])
    got = {r["book_id"]: r for r in merging.rescue_noise(clusters, frame(spark, x).drop("cluster_id"), 0.05, True, chunk_rows).collect()}
    for i in range(60):
        d = {c: min(np.linalg.norm(x[i] - x[j]) for j in range(60, 160) if label[j] == c) for c in range(41)}
        pull = {c: 1 / max(v, 1e-9) for c, v in d.items()}
        best = max(pull, key=lambda c: (round(pull[c], 9), -c))
        share = pull[best] / sum(pull.values())
        assert got[i]["cluster_id"] == (best if share > 0.05 else -1)
        assert got[i]["probability"] == pytest.approx(share if share > 0.05 else 0.0)
    # 15 chunks, and the large cluster is in as many: one row more for each
    assert met[0].count() <= 60 * (2 * 15 + 2 if chunk_rows == 7 else 2)


def test_spectral_map_keeps_blobs_apart(spark):
    x = blobs(16, noise=0, dim=4)
    near = cut(neighbors.knn(frame(spark, x), 10, "euclidean"))
    edges = cut(reduce.fuzzy_graph(near))
    assert edges.agg(F.min("w"), F.max("w")).first()[1] <= 1.0 + 1e-9
    dense = reduce.density_weights(edges, near)
    assert dense.count() == edges.count()
    xy = np.array([r["vector"] for r in reduce.spectral_reduce(edges, 2).orderBy("id").collect()])
    labels = np.repeat([0, 1, 2], (30, 25, 20))
    hit = [labels[brute.nearest(brute.distance_matrix(xy), 1)[i][0]] == labels[i] for i in range(len(x))]
    assert np.mean(hit) > 0.9


@pytest.mark.parametrize("density_aware", [False, True])
def test_spectrum_against_dense_eigenvectors(spark, density_aware):
    x = blobs(18, noise=3, dim=4)
    near = cut(neighbors.knn(frame(spark, x), 12, "euclidean"))
    edges = cut(reduce.fuzzy_graph(near))
    if density_aware:
        edges = cut(reduce.density_weights(edges, near))
    w = np.zeros((len(x), len(x)))
    for r in edges.collect():
        w[r.u, r.v] = w[r.v, r.u] = r.w
    half = 1 / np.sqrt(w.sum(1))
    a = w * half[:, None] * half[None, :]
    values, axes = np.linalg.eigh(a)
    found = reduce.spectrum(edges, 4, 1e-4)
    got = np.array([r.vector for r in found.vectors.orderBy("id").collect()])
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-6)
    left = np.linalg.norm(a @ got - got * np.array(found.values), axis=0)
    assert left.max() <= 1.1e-4 and np.allclose(left, found.residuals, atol=1e-6)
    assert np.allclose(found.values, values[-2:-6:-1], atol=1e-6)
    angles = np.linalg.svd(axes[:, -5:-1].T @ got, compute_uv=False)
    assert angles.min() > 1 - 1e-4  # the same subspace


def test_spectrum_over_blocks_writes_one_table_per_filter(spark, monkeypatch):
    x = blobs(18, noise=3, dim=4)
    near = cut(neighbors.knn(frame(spark, x), 12, "euclidean"))
    edges = cut(reduce.fuzzy_graph(near))
    w = np.zeros((len(x), len(x)))
    for r in edges.collect():
        w[r.u, r.v] = w[r.v, r.u] = r.w
    half = 1 / np.sqrt(w.sum(1))
    a = w * half[:, None] * half[None, :]
    axes = np.linalg.eigh(a)[1]
    written, filters = [], []
    gram = reduce._gram
    monkeypatch.setattr(reduce, "cut", lambda df: (written.append(1), cut(df))[1])
    monkeypatch.setattr(reduce, "_gram", lambda *of: (filters.append(1), gram(*of))[1])
    monkeypatch.setattr(reduce, "MATRIX_ROWS", 20, raising=False)
    named = edges.select(F.format_string("n%03d", "u").alias("u"), F.format_string("n%03d", "v").alias("v"), "w")
    for tolerance in (1e-4, 1e-7):  # coordinates move in single and in double precision
        found = reduce.spectrum(named, 4, tolerance)
        got = np.array([r.vector for r in found.vectors.orderBy("id").collect()])
        assert [r.id for r in found.vectors.orderBy("id").collect()] == [f"n{i:03d}" for i in range(len(x))]
        assert np.linalg.norm(a @ got - got * np.array(found.values), axis=0).max() <= 1.1 * tolerance
        assert np.linalg.svd(axes[:, -5:-1].T @ got, compute_uv=False).min() > 1 - 1e-4
    assert len(written) == len(filters) + 4  # per run the matrix and the result


def test_reducer_choice_and_guard(spark):
    a, b = frame(spark, np.eye(2)), frame(spark, np.eye(2))
    scores = {id(a): (0.9, 2), id(b): (0.4, 12)}
    best, report = reduce.choose_reducer({"a": a, "b": b}, lambda d: scores[id(d)])
    assert best == "a" and report.where("chosen").first()["reducer"] == "a"
    assert reduce.choose_reducer({"a": a, "b": b}, lambda d: scores[id(d)], min_clusters=5)[0] == "b"


def test_candidates_are_made_and_scored_side_by_side(spark):
    both = threading.Barrier(2, timeout=30)  # breaks where one candidate waits for the other
    made = lambda: (both.wait(), spark.range(1))[1]
    best, report = reduce.choose_reducer({"a": made, "b": made}, lambda df: (float(both.wait() >= 0), 5), 3)
    assert best == "a" and [(r["reducer"], r["chosen"]) for r in report.collect()] == [("a", True), ("b", False)]


def test_search_space_and_tuning(spark):
    assert tuning.search_space(5000) == {"min_cluster_size": (12, 300), "min_samples": (3, 50)}
    assert tuning.search_space(100) == {"min_cluster_size": (12, 22), "min_samples": (3, 50)}
    assert tuning.draw_trials(tuning.search_space(5000), 40) == tuning.draw_trials(tuning.search_space(5000), 40)
    x = blobs(17, noise=6)
    out = tuning.tune_clusters(frame(spark, x), trials=[(10, 3), (60, 3)]).collect()
    assert out[0]["min_cluster_size"] == 10 and out[0]["n_clusters"] == 3 and out[1]["objective"] == -1.0


@pytest.mark.parametrize("seed,mcs,selection", [(7, 5, "leaf"), (9, 4, "eom")])
def test_merge_heights_are_least_greatest_edges(spark, seed, mcs, selection):
    x = blobs(seed, spread=0.9, noise=20)
    forest = cut(density.reachability_forest(frame(spark, x), 3))
    tree = condensed.merge_tree(forest)
    clusters = cut(density.density_clusters(forest, frame(spark, x), mcs, selection, tree=tree))
    label = {r["book_id"]: r["cluster_id"] for r in clusters.collect()}
    got = {(r["book_id"], r["cluster_id"]): r["w"] for r in membership.merge_heights(tree, clusters, mcs).collect()}
    far = np.full((len(x), len(x)), np.inf)
    np.fill_diagonal(far, 0)
    part = {i: {i} for i in range(len(x))}
    for r in forest.orderBy("w", "u", "v").collect():  # parts grow edge by edge
        a, b = part[r["u"]], part[r["v"]]
        for i in a:
            for j in b:
                far[i, j] = far[j, i] = r["w"]
        for i in a | b:
            part[i] = a | b
    named = {c: [i for i in label if label[i] == c] for c in set(label.values()) if c >= 0}
    want = {(i, c): min(far[i, j] for j in ids) for i in label if label[i] < 0 for c, ids in named.items()}
    assert len(named) > 1 and got == want


def test_common_ancestors_of_a_deep_tree(spark):
    parent = {0: None, 100: None, 101: 100} | {i: i - 1 for i in range(1, 40)} | {50: 10, 51: 50}
    nodes = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")
    line = lambda n: [n, *(line(parent[n]) if parent[n] is not None else [])]
    pairs = [(39, 51), (51, 39), (39, 0), (7, 7), (5, 39), (101, 3), (50, 51), (12, 50), (100, 101)]
    got = {(r["left"], r["right"]): r["top"] for r in membership.common_ancestors(spark.createDataFrame(pairs, "left bigint, right bigint"), nodes).collect()}
    assert got == {(a, b): next((n for n in line(a) if n in line(b)), None) for a, b in pairs}


def test_rescue_with_text_ids_and_nothing_to_do(spark):
    clusters = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.5)], "book_id string, cluster_id int, probability double")
    vectors = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "book_id string, vector array<double>")
    assert merging.rescue_noise(clusters, vectors).count() == 2
    noise = spark.createDataFrame([("c", -1, 0.0)], clusters.schema)
    more = vectors.unionByName(spark.createDataFrame([("c", [0.2])], vectors.schema))
    got = merging.rescue_noise(clusters.unionByName(noise), more, chunk_rows=1).where("book_id = 'c'").first()
    assert got["cluster_id"] == 0


def test_most_block_pairs_of_clustered_vectors_are_skipped(spark, monkeypatch):
    """Rows that move grow with N · partners: a block meets about as many partners whatever the number of clusters."""
    kept = []
    chosen = balls.tightened

    def seen(*args):
        out = chosen(*args)
        kept.append((out.select("i").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(balls, "tightened", seen)
    rng = np.random.default_rng(8)
    for clusters in (40, 80):
        x = np.repeat(rng.normal(size=(clusters, 6)) * 30, 25, axis=0) + rng.normal(size=(clusters * 25, 6))
        got = as_lists(neighbors.knn(frame(spark, x), 5, "euclidean", 25))
        assert got == brute.nearest(brute.distance_matrix(x), 5)
    for blocks, pairs in kept:
        assert pairs < 8 * blocks < 0.2 * blocks * blocks


def test_a_partner_comes_once_to_a_group_of_blocks(spark, monkeypatch):
    """Without structure every block meets every other; their rows must not move once per pair of blocks."""
    sent = []
    dealt = balls._meetings

    def seen(queries, points, pairs, k, skip_self, answers):
        sizes = points.groupBy(F.col("block").alias("j")).count()
        moved = pairs.select("g", "part", "j").distinct().join(sizes, "j").agg(F.sum("count")).first()[0]
        sent.append((moved, pairs.select("g", "part").distinct().count(), pairs.select("g", "i").distinct().count()))
        return dealt(queries, points, pairs, k, skip_self, answers)

    monkeypatch.setattr(balls, "_meetings", seen)
    monkeypatch.setattr(balls, "GROUPS", 4)
    x = np.random.default_rng(21).normal(size=(600, 12))
    assert as_lists(neighbors.knn(frame(spark, x), 5, "euclidean", 12)) == brute.nearest(brute.distance_matrix(x), 5)
    moved, tasks, blocks = sent[-1]
    assert moved <= 8 * len(x) and tasks > 1 and blocks >= 50


def test_far_rows_close_together_are_told_apart(spark):
    """Distances below what single precision sees at this offset, and rows beyond its range."""
    rng = np.random.default_rng(22)
    x = np.concatenate([1e4 + rng.normal(size=(60, 4)) * 1e-4, rng.normal(size=(40, 4)) * 1e20])
    near = neighbors.knn(frame(spark, x), 3, "euclidean", 16)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    assert as_lists(near) == brute.nearest(d, 3)


def test_blocks_of_dense_rows_are_nested(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MAX_PIVOTS", 3)
    monkeypatch.setattr(balls, "SPLIT_ROWS", 40)
    monkeypatch.setattr(balls, "PART_BLOCKS", 2)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 3)) * 1e-3, rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) + 50])
    assert as_lists(neighbors.knn(frame(spark, x), 4, "euclidean", 16)) == brute.nearest(brute.distance_matrix(x), 4)
    assigned = neighbors.assign_cells(frame(spark, x).selectExpr("book_id AS id", "cast(vector AS array<double>) AS vec"), x[:2])
    blocks = balls.nested_blocks(assigned, 16)
    assert blocks.groupBy("block").count().agg({"count": "max"}).first()[0] <= 48
    assert blocks.select("id").distinct().count() == blocks.count() == len(x)


@pytest.mark.parametrize("more", [16, 1])
def test_approximate_neighbours_of_clustered_vectors(spark, monkeypatch, more):
    monkeypatch.setattr(approximate, "SAMPLE_ROWS", 64)  # two levels from the sample, deeper ones per leaf
    monkeypatch.setattr(approximate, "MORE_LEVELS", more)
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(30, 8)) * 9, 20, axis=0) + rng.normal(size=(600, 8))
    x[:40] = x[0]
    df = frame(spark, x)
    found = cut(approximate.approximate_knn(df, 6, "euclidean", trees=8, leaf_rows=40))
    got, exact = as_lists(found), neighbors.knn(df, 6, "euclidean")
    assert got[3] == [0, 1, 2, 4, 5, 6]  # copies are found like any others
    assert {len(v) for v in got.values()} == {6}
    rows, share = approximate.recall(found, exact).first()
    assert rows == 600 and share >= (0.9 if more > 1 else 0.5)
    d = brute.distance_matrix(x)
    assert all(abs(d[r.id, r.near] - r.dist) < 1e-8 for r in found.collect())


def test_approximate_neighbours_of_nothing(spark):
    assert approximate.approximate_knn(frame(spark, np.zeros((0, 2)))).count() == 0
    assert approximate.approximate_knn(frame(spark, np.ones((1, 2)))).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_refined_pairs_carry_no_vectors(spark, monkeypatch, kind):
    """The vectors move once per block of rows, whatever the number of pairs."""
    for name, value in (("BLOCK_ROWS", 16), ("FEW_ROWS", 8), ("PAIRS_AT_ONCE", 5)):
        monkeypatch.setattr(approximate, name, value)
    x = np.random.default_rng(8).normal(size=(90, 3))
    points = cut(frame(spark, x).select(F.col("book_id").cast(kind).alias("id"), F.col("vector").cast("array<double>").alias("vec")))
    pairs = cut(points.select("id").crossJoin(points.select(F.col("id").alias("near"))).where("id <> near"))
    found = approximate._measured(pairs, points, 90)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # pairs and blocks, dealt by the block
    got = {(int(r["id"]), int(r["near"])): r["dist"] for r in found.collect()}
    d = brute.distance_matrix(x)
    assert len(got) == 90 * 89 and all(v == pytest.approx(d[i, j], abs=1e-9) for (i, j), v in got.items())
