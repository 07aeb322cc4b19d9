"""Queries on the neighbour graph, density clusters, validity and reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.operators import density, graph, merging, metrics, reduce, tuning
from catalogmap.operators.condensed import merge_tree
from catalogmap.operators.membership import merge_heights
from catalogmap.operators.neighbors import knn
from catalogmap.plans import roles
from catalogmap.plans.registry import query
from catalogmap.session import cut

MIN_SAMPLES = 5
MIN_SIZE = 10
K = 15


def _near(spark: SparkSession, sf: str, metric: str = "euclidean", k: int = K) -> DataFrame:
    return cut(knn(roles.vectors(spark, sf), k, metric))


DIST = """u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS dist FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM d QUALIFY rank <= 15),
core AS (SELECT id, dist AS core FROM k WHERE rank = 5),
links AS (SELECT least(id, near) AS u, greatest(id, near) AS v, min(dist) AS dist FROM k GROUP BY ALL)"""


@query(f"WITH {DIST} SELECT id, round(core, 6) AS core FROM core")
def core_distances(spark: SparkSession, sf: str) -> DataFrame:
    core = graph.core_distances(_near(spark, sf), MIN_SAMPLES)
    return core.select("id", F.round("core", 6).alias("core"))


@query(f"""WITH {DIST} SELECT u, v, round(greatest(dist, a.core, b.core), 6) AS w
FROM links JOIN core a ON a.id = u JOIN core b ON b.id = v""")
def mutual_reachability(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf)
    edges = graph.mutual_reachability(near, graph.core_distances(near, MIN_SAMPLES))
    return edges.select("u", "v", F.round("w", 6).alias("w"))


@query(f"""WITH RECURSIVE {DIST},
cuts AS (SELECT id AS a, near AS b FROM k WHERE rank <= 1 UNION SELECT near, id FROM k WHERE rank <= 1),
r(id, c) AS (SELECT id, id FROM u UNION SELECT cuts.b, r.c FROM r JOIN cuts ON cuts.a = r.id)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def linked_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of the first-neighbour graph."""
    near = _near(spark, sf).where("rank <= 1")
    nodes = roles.vectors(spark, sf).select(F.col("book_id").alias("id"))
    return graph.connected_components(graph.undirected(near), nodes)


# Prim's tree in the total order (weight, ends): one row enters per round
TREE = f"""{DIST},
m AS MATERIALIZED (SELECT d.id AS a, near AS b, {{'w': greatest(dist, x.core, y.core), 'u': least(d.id, near), 'v': greatest(d.id, near)}} AS e
  FROM d JOIN core x ON x.id = d.id JOIN core y ON y.id = near),
grow(step, id, e, done) AS (
  SELECT 0, b, e, false FROM m WHERE a = (SELECT min(id) FROM u)
  UNION ALL
  SELECT step + 1, p.id, CASE WHEN p.done OR p.id = pick THEN p.e ELSE least(p.e, m.e) END, p.done OR p.id = pick
  FROM (SELECT *, arg_min(id, e) FILTER (NOT done) OVER () AS pick FROM grow) p LEFT JOIN m ON m.a = p.pick AND m.b = p.id
  WHERE pick IS NOT NULL),
tree AS (SELECT e.u AS u, e.v AS v, e.w AS w FROM grow WHERE step = (SELECT max(step) FROM grow))"""


@query(f"WITH RECURSIVE {TREE} SELECT u, v, round(w, 6) AS w FROM tree")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Exact spanning tree of the mutual-reachability graph."""
    tree = density.reachability_forest(roles.vectors(spark, sf), MIN_SAMPLES, near=_near(spark, sf))
    return tree.select("u", "v", F.round("w", 6).alias("w"))


# The merge list, one edge per round. Lists hold a value per row: its part, the weight at which the part grew
# large enough, whether the part holds a split, the worth of its chosen clusters and the edge that formed it.
ORDERED = f"""{TREE},
ix AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM u),
es AS (SELECT row_number() OVER (ORDER BY w, u, v) AS step, a.i AS iu, b.i AS iv, w FROM tree JOIN ix a ON a.id = u JOIN ix b ON b.id = v)"""


def _merge_list(size: int, tag: str = "") -> str:
    """found (id, density, leaf, eom) of the least cluster size, from ``ORDERED``; ``tag`` ends its names."""
    return f"""merge{tag}(step, part, settled, parted, kids, formed, leaf, eom) AS (
  SELECT 0::BIGINT, list(i ORDER BY i), list(NULL::DOUBLE), list(false), list(0::DOUBLE), list('inf'::DOUBLE), list(0::BIGINT), list(0::BIGINT) FROM ix
  UNION ALL
  SELECT step + 1,
    list_transform(part, lambda x: CASE WHEN x = b THEN a ELSE x END),
    list_transform(settled, lambda t, i: CASE WHEN t IS NULL AND na + nb >= {size} AND part[i] IN (a, b) THEN w ELSE t END),
    list_transform(parted, lambda x, i: x OR (part[i] IN (a, b) AND (split OR pa OR pb))),
    list_transform(kids, lambda x, i: CASE WHEN part[i] NOT IN (a, b) THEN x WHEN split THEN greatest(oa, ka) + greatest(ob, kb) WHEN na >= {size} THEN ka WHEN nb >= {size} THEN kb ELSE 0 END),
    list_transform(formed, lambda x, i: CASE WHEN part[i] NOT IN (a, b) THEN x WHEN split THEN lam WHEN na >= {size} THEN fa WHEN nb >= {size} THEN fb ELSE 'inf'::DOUBLE END),
    list_transform(leaf, lambda x, i: CASE WHEN split AND NOT parted[i] AND part[i] = a THEN 2 * step + 1 WHEN split AND NOT parted[i] AND part[i] = b THEN 2 * step + 2 ELSE x END),
    list_transform(eom, lambda x, i: CASE WHEN split AND part[i] = a AND oa >= ka THEN 2 * step + 1 WHEN split AND part[i] = b AND ob >= kb THEN 2 * step + 2 ELSE x END)
  FROM (SELECT *, na >= {size} AND nb >= {size} AS split,
      list_sum(list_transform(range(1, len(part) + 1), lambda i: CASE WHEN part[i] = a THEN least(1 / greatest(settled[i], 1e-12), fa) - lam ELSE 0 END)) AS oa,
      list_sum(list_transform(range(1, len(part) + 1), lambda i: CASE WHEN part[i] = b THEN least(1 / greatest(settled[i], 1e-12), fb) - lam ELSE 0 END)) AS ob
    FROM (SELECT merge{tag}.*, w, 1 / greatest(w, 1e-12) AS lam, part[iu] AS a, part[iv] AS b, parted[iu] AS pa, parted[iv] AS pb, kids[iu] AS ka, kids[iv] AS kb,
        formed[iu] AS fa, formed[iv] AS fb, len(list_filter(part, lambda x: x = part[iu])) AS na, len(list_filter(part, lambda x: x = part[iv])) AS nb
      FROM merge{tag} JOIN es ON es.step = merge{tag}.step + 1))),
last{tag} AS (SELECT * FROM merge{tag} ORDER BY step DESC LIMIT 1),
found{tag} AS (SELECT id, 1 / greatest(settled[i], 1e-12) AS density, nullif(leaf[i], 0) AS leaf, nullif(eom[i], 0) AS eom FROM ix, last{tag})"""


MERGE_LIST = f"{ORDERED},\n{_merge_list(MIN_SIZE)}"


def _numbered_sql(kind: str) -> str:
    return f"""WITH RECURSIVE {MERGE_LIST},
named AS (SELECT {kind} AS g, row_number() OVER (ORDER BY min(id)) - 1 AS c, max(density) AS top FROM found WHERE {kind} IS NOT NULL GROUP BY 1)
SELECT id AS book_id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_id, round(CASE WHEN c IS NULL THEN 0 ELSE density / top END, 6) AS probability
FROM found LEFT JOIN named ON g = {kind}"""


def _clusters(spark: SparkSession, sf: str, selection: str = "leaf") -> DataFrame:
    v = roles.vectors(spark, sf).select("book_id", "vector")
    forest = density.reachability_forest(v, MIN_SAMPLES, near=_near(spark, sf))
    return cut(density.density_clusters(forest, v, MIN_SIZE, selection))


def _six(df: DataFrame) -> DataFrame:
    return df.select("book_id", "cluster_id", F.round("probability", 6).alias("probability"))


@query(_numbered_sql("leaf"))
def density_clusters_leaf(spark: SparkSession, sf: str) -> DataFrame:
    return _six(_clusters(spark, sf))


@query(_numbered_sql("eom"))
def density_clusters_eom(spark: SparkSession, sf: str) -> DataFrame:
    return _six(_clusters(spark, sf, "eom"))


LEVELS = (40, 20, 10)


def _levels_sql() -> str:
    """Leaf clusters of every size of ``LEVELS``, with the row's cluster one level up."""
    parts = [ORDERED]
    for i, size in enumerate(LEVELS):
        parts += [
            _merge_list(size, str(i)),
            f"named{i} AS (SELECT leaf AS g, row_number() OVER (ORDER BY min(id)) - 1 AS c FROM found{i} WHERE leaf IS NOT NULL GROUP BY 1)",
            f"level{i} AS (SELECT id, CAST(coalesce(c, -1) AS INTEGER) AS c FROM found{i} LEFT JOIN named{i} ON g = leaf)",
        ]
    rows = ["SELECT id AS book_id, 0 AS level, c AS cluster_id, -1 AS parent_id FROM level0"]
    rows += [f"SELECT id, {i}, level{i}.c, level{i - 1}.c FROM level{i} JOIN level{i - 1} USING (id)" for i in range(1, len(LEVELS))]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


@query(_levels_sql())
def nested_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse to fine leaf clusters from one merge tree; each lies in one cluster of the level above or in its noise."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    forest = cut(density.reachability_forest(v, MIN_SAMPLES, near=_near(spark, sf)))
    return density.cluster_levels(forest, v, LEVELS)


def _merged_sql(source: str, threshold: float) -> str:
    """goes (label, l) and num (l, c): the greedy merge of the labels of ``source`` (label, embedding)."""
    return f"""cent AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM {source}) GROUP BY ALL),
cn AS (SELECT label, pos, x / n AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM cent)),
ln AS (SELECT a.label AS a, b.label AS b FROM cn a JOIN cn b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL HAVING sum(a.x * b.x) >= {threshold}),
ids AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT label FROM {source})),
walk(i, leaders) AS (SELECT 0::BIGINT, []::INTEGER[] UNION ALL
  SELECT ids.i, CASE WHEN EXISTS (SELECT 1 FROM ln WHERE ln.b = ids.label AND list_contains(walk.leaders, ln.a)) THEN leaders ELSE list_append(leaders, ids.label) END
  FROM walk JOIN ids ON ids.i = walk.i + 1),
lead AS (SELECT unnest(leaders) AS l FROM (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)),
goes AS (SELECT ids.label, coalesce((SELECT min(a) FROM ln JOIN lead ON a = l WHERE b = ids.label AND ids.label NOT IN (SELECT l FROM lead)), ids.label) AS l FROM ids),
num AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS c FROM (SELECT DISTINCT l FROM goes))"""


# The rescue: noise rows take the cluster with the strongest membership m, where that is above 0.05.
RESCUED = f"""{MERGE_LIST},
named AS (SELECT leaf AS g, row_number() OVER (ORDER BY min(id)) - 1 AS c, max(density) AS top FROM found WHERE leaf IS NOT NULL GROUP BY 1),
cl AS (SELECT id, coalesce(c, -1) AS c, CASE WHEN c IS NULL THEN 0 ELSE density / top END AS prob FROM found LEFT JOIN named ON g = leaf),
marks AS (SELECT c, v FROM cl JOIN u USING (id) WHERE c >= 0 AND prob >= 1 - 1e-12),
pulls AS (SELECT cl.id, marks.c AS o, 1 / greatest(min(list_distance(u.v, marks.v)), 1e-9) AS pull FROM cl JOIN u USING (id), marks WHERE cl.c < 0 GROUP BY ALL),
saved AS (SELECT id, o, round(pull, 9) / sum(pull) OVER (PARTITION BY id) AS m FROM pulls
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(pull, 9) DESC, o) = 1),
rescued AS (SELECT cl.id, m, CAST(CASE WHEN m > 0.05 THEN o ELSE c END AS INTEGER) AS label, prob FROM cl LEFT JOIN saved USING (id))"""


@query(f"""WITH RECURSIVE {RESCUED}
SELECT id AS book_id, label AS cluster_id, round(CASE WHEN m > 0.05 THEN m ELSE prob END, 6) AS probability FROM rescued""")
def rescued_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Rescued rows with the membership that saved them as their probability."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    return _six(merging.rescue_noise(_clusters(spark, sf), v, refresh_probability=True))


# Both halves of the membership: the tree is walked from every noise row for its merge heights.
SOFT = f"""{RESCUED},
ways AS (SELECT u AS a, v AS b, w FROM tree UNION ALL SELECT v, u, w FROM tree),
walked(x, here, prev, w) AS (SELECT id, id, -1::BIGINT, 0::DOUBLE FROM cl WHERE c < 0
  UNION ALL SELECT x, b, here, greatest(walked.w, ways.w) FROM walked JOIN ways ON a = here AND b <> prev),
high AS (SELECT x, c AS o, 1 / greatest(min(w), 1e-12) AS h FROM walked JOIN cl ON cl.id = here WHERE c >= 0 GROUP BY ALL),
half AS (SELECT pulls.id, pulls.o, pull, top / greatest(top - coalesce(h, 0), 1e-8 * top) AS s, coalesce(h, 0) / top AS inside
  FROM pulls JOIN named ON named.c = pulls.o LEFT JOIN high ON x = pulls.id AND high.o = pulls.o),
heavy AS (SELECT id, o, pull * exp(s - max(s) OVER (PARTITION BY id)) AS g, max(inside) OVER (PARTITION BY id) AS share FROM half),
soft AS (SELECT id, o, g / sum(g) OVER (PARTITION BY id) AS g, share FROM heavy),
both_halves AS (SELECT id, o, round(g, 9) * share AS m FROM soft QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(g, 9) DESC, o) = 1)"""


@query(f"""WITH RECURSIVE {SOFT}
SELECT cl.id AS book_id, CAST(CASE WHEN m > 0.05 THEN o ELSE c END AS INTEGER) AS cluster_id, round(CASE WHEN m > 0.05 THEN m ELSE prob END, 6) AS probability
FROM cl LEFT JOIN both_halves ON both_halves.id = cl.id""")
def soft_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Noise rows rescued by both halves of the membership: exemplar distances and merge heights."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    tree = merge_tree(cut(density.reachability_forest(v, MIN_SAMPLES, near=_near(spark, sf))))
    clusters = cut(density.density_clusters(tree[0], v, MIN_SIZE, tree=tree))
    heights = merge_heights(tree, clusters, MIN_SIZE)
    return _six(merging.rescue_noise(clusters, v, refresh_probability=True, heights=heights))


@query(f"""WITH RECURSIVE {RESCUED},
placed AS (SELECT rescued.label, embedding FROM rescued JOIN embeddings ON vec_id = id WHERE rescued.label >= 0),
{_merged_sql('placed', 0.92)}
SELECT id AS book_id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_id, round(prob, 6) AS probability
FROM rescued LEFT JOIN goes USING (label) LEFT JOIN num USING (l)""")
def rescued_and_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Noise rows take their strongest cluster, then near-equal clusters merge."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    rescued = cut(merging.rescue_noise(_clusters(spark, sf), v))
    return _six(merging.merge_clusters(rescued, v))


@query(f"WITH RECURSIVE {_merged_sql('embeddings', 0.2)} SELECT vec_id AS book_id, CAST(c AS INTEGER) AS cluster_id FROM embeddings JOIN goes USING (label) JOIN num USING (l)")
def merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy centroid merge of the given labels, at a threshold that some of them pass."""
    v = roles.vectors(spark, sf)
    return merging.merge_clusters(v.select("book_id", "cluster_id"), v.select("book_id", "vector"), 0.2)


@query("""WITH c AS (SELECT doc_id AS book_id, CASE WHEN lang = 'en' THEN -1 ELSE CAST(substring(source, 4) AS INTEGER) * 3 + 1 END AS c FROM documents)
SELECT book_id, CAST(CASE WHEN c < 0 THEN -1 ELSE n END AS INTEGER) AS cluster_id FROM c
LEFT JOIN (SELECT c, row_number() OVER (ORDER BY c) - 1 AS n FROM (SELECT DISTINCT c FROM c WHERE c >= 0)) USING (c)""")
def relabel_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with gaps become 0, 1, 2, …; noise stays −1."""
    label = F.when(F.col("lang") == "en", F.lit(-1)).otherwise(F.col("cluster_id") * 3 + 1)
    return merging.relabel(roles.documents(spark, sf).select("book_id", label.alias("cluster_id")))


@query("""WITH u AS (SELECT vec_id AS id, label AS c, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM u a JOIN u b ON a.id <> b.id GROUP BY ALL),
m AS (SELECT id, max(CASE WHEN c = o THEN s / n END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM s GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM m""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.silhouette(roles.vectors(spark, sf))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS id, label AS c, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 0),
n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.c AS ca, b.c AS cb, list_distance(a.v, b.v) AS dist, len(a.v) AS dim FROM p a JOIN p b ON a.id <> b.id),
core AS (SELECT a AS id, ca AS c, CASE WHEN sum(CASE WHEN dist > 0 THEN pow(1 / dist, dim) ELSE 0 END) > 0
   THEN pow(sum(CASE WHEN dist > 0 THEN pow(1 / dist, dim) ELSE 0 END) / (any_value(n) - 1), -1.0 / any_value(dim)) ELSE 0 END AS core
  FROM d JOIN n ON n.c = ca WHERE ca = cb GROUP BY ALL),
m AS MATERIALIZED (SELECT a, b, ca, cb, {'w': greatest(dist, x.core, y.core), 'u': least(a, b), 'v': greatest(a, b)} AS e FROM d JOIN core x ON x.id = a JOIN core y ON y.id = b),
first AS (SELECT c, min(id) AS id FROM p GROUP BY c),
grow(step, c, id, e, done) AS (
  SELECT 0, ca, b, e, false FROM m JOIN first ON first.id = a WHERE ca = cb
  UNION ALL
  SELECT step + 1, q.c, q.id, CASE WHEN q.done OR q.id = pick THEN q.e ELSE least(q.e, m.e) END, q.done OR q.id = pick
  FROM (SELECT *, arg_min(id, e) FILTER (NOT done) OVER (PARTITION BY c) AS pick FROM grow) q LEFT JOIN m ON m.a = q.pick AND m.b = q.id
  WHERE pick IS NOT NULL),
tree AS (SELECT c, e FROM grow QUALIFY step = max(step) OVER (PARTITION BY c)),
deg AS (SELECT c, id, count(*) AS deg FROM (SELECT c, e.u AS id FROM tree UNION ALL SELECT c, e.v FROM tree) GROUP BY ALL),
inn AS (SELECT c, id FROM deg QUALIFY deg > 1 OR (max(deg) OVER (PARTITION BY c) = 1 AND id = min(id) OVER (PARTITION BY c))),
sparse AS (SELECT tree.c, coalesce(max(e.w) FILTER (e.u IN (SELECT id FROM inn) AND e.v IN (SELECT id FROM inn)), max(e.w)) AS s FROM tree GROUP BY tree.c),
apart AS (SELECT ca AS c, min(e.w) AS s FROM m WHERE ca <> cb AND a IN (SELECT id FROM inn) AND b IN (SELECT id FROM inn) GROUP BY ca)
SELECT round(sum(n.n * (apart.s - sparse.s) / greatest(apart.s, sparse.s)) / (SELECT count(*) FROM p), 4) AS dbcv
FROM n JOIN sparse ON sparse.c = n.c JOIN apart ON apart.c = n.c""")
def dbcv(spark: SparkSession, sf: str) -> DataFrame:
    """Density-based validity of the given labels."""
    return metrics.dbcv(roles.vectors(spark, sf)).select(F.round("dbcv", 4).alias("dbcv"))


@query("""WITH RECURSIVE un AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
d AS (SELECT a.id, b.id AS near, round(list_distance(a.v, b.v), 9) AS dist FROM un a JOIN un b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM d QUALIFY rank <= 15),
l AS (SELECT id, list(dist ORDER BY rank) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS floor, avg(dist) AS mean, count(*) AS n FROM k GROUP BY id),
b(step, id, far, goal, low, high, scale) AS (
  SELECT 0, id, list_transform(ds, lambda x: greatest(x - floor, 0)), log2(greatest(n, 2)), 0::DOUBLE, 'inf'::DOUBLE, 1::DOUBLE FROM l
  UNION ALL
  SELECT step + 1, id, far, goal, lo, hi, greatest(CASE WHEN isfinite(hi) THEN (lo + hi) / 2 ELSE scale * 2 END, 1e-12) FROM (
    SELECT *, CASE WHEN total > goal THEN low ELSE scale END AS lo, CASE WHEN total > goal THEN scale ELSE high END AS hi
    FROM (SELECT *, list_sum(list_transform(far, lambda x: exp(-x / scale))) AS total FROM b WHERE step < 64))),
w AS (SELECT k.id, near, exp(-greatest(dist - floor, 0) / greatest(scale, 1e-3 * mean)) AS w FROM k JOIN l USING (id) JOIN b ON b.id = k.id AND step = 64),
s AS (SELECT least(id, near) AS u, greatest(id, near) AS v, sum(w) AS s, sum(w * w) AS q, count(*) AS n FROM w GROUP BY ALL)
SELECT u, v, round(CASE WHEN n > 1 THEN s - (s * s - q) / 2 ELSE s END, 6) AS w FROM s""")
def fuzzy_graph(spark: SparkSession, sf: str) -> DataFrame:
    edges = reduce.fuzzy_graph(_near(spark, sf, "cosine"))
    return edges.select("u", "v", F.round("w", 6).alias("w"))


@query()
def spectral_map(spark: SparkSession, sf: str) -> DataFrame:
    """Two coordinates per item for display."""
    edges = cut(reduce.fuzzy_graph(_near(spark, sf, "cosine")))
    xy = reduce.spectral_reduce(edges, 2)
    return xy.select("id", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


@query()
def reducer_choice(spark: SparkSession, sf: str) -> DataFrame:
    """All reduced spaces scored by the validity of their density clusters; a space needs three clusters to win."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    near = _near(spark, sf, "cosine")
    edges = cut(reduce.fuzzy_graph(near))
    candidates = {
        "spectral": lambda: reduce.spectral_reduce(edges, 10),
        "spectral-density": lambda: reduce.spectral_reduce(cut(reduce.density_weights(edges, near)), 10),
        "projection": lambda: cut(reduce.random_projection(v, 10, 64)),
    }

    def score(df: DataFrame) -> tuple[float, int]:
        forest = density.reachability_forest(df, 3, id_col="id")
        found = cut(density.density_clusters(forest, df, 8, "eom", id_col="id"))
        k = found.where("cluster_id >= 0").select("cluster_id").distinct().count()
        return metrics.dbcv(df.join(found, "id"), id_col="id").first()[0], k

    _, report = reduce.choose_reducer(candidates, score, min_clusters=3)
    return report.withColumn("dbcv", F.round("dbcv", 4))


@query()
def tuned_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A short seeded search over cluster size and neighbourhood size."""
    v = roles.vectors(spark, sf).select("book_id", "vector")
    found = tuning.tune_clusters(v, trials=[(8, 5), (12, 5)])
    return found.select(
        "min_cluster_size", "min_samples", "n_clusters", *[F.round(c, 4).alias(c) for c in ("noise", "dbcv", "objective")]
    )
