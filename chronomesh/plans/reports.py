"""Queries on what other queries find: routes by text, rankings, senses, errors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.functions import numbers as N
from chronomesh.functions import vectors as V
from chronomesh.operators import corpus as C
from chronomesh.operators import decompose as D
from chronomesh.operators import learning as L
from chronomesh.operators import octree as O
from chronomesh.operators import structure as S
from chronomesh.operators import tensor as K
from chronomesh.operators import walker as Wk
from chronomesh.plans import catalog as A
from chronomesh.plans import query as Q
from chronomesh.plans.catalog import r6, register
from chronomesh.plans.graphs import embedding_graph, embedding_nodes
from chronomesh.plans.model import Graph
from chronomesh.plans.storage import table


@register("route_temporal", f"{A.ARRIVAL} SELECT arrival AS arrival_time, arrival - 5 AS duration FROM d40 WHERE node = 40")
def route_temporal(spark: SparkSession, d: str) -> DataFrame:
    return Q.run(embedding_graph(spark, d), "CALL db.route.temporal(0, 40, departure: 5) YIELD arrival_time, duration")["rows"]


BOTTLENECKS = "CALL db.resilience.bottlenecks(spatial_sphere([0, 0, 0], 0.5), time_window(0, 60)) YIELD articulation_points, bridges"
ALLOWED = f"{A.SPARSE}, {A.allowed((0, 60), 0.5)}"


@register("bottleneck_points", f"""{ALLOWED}, s AS (SELECT src AS cut, min(dst) AS first FROM g GROUP BY src),
 r AS (SELECT cut, first AS node FROM s UNION SELECT r.cut, g.dst FROM r JOIN g ON g.src = r.node AND g.dst <> r.cut)
 SELECT DISTINCT src AS node FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cut = g.src AND r.node = g.dst)""")
def bottleneck_points(spark: SparkSession, d: str) -> DataFrame:
    return Q.run(embedding_graph(spark, d, 0.05), BOTTLENECKS)["articulation_points"]


@register("bottleneck_bridges", f"""{ALLOWED}, l AS (SELECT DISTINCT src AS u, dst AS v FROM g WHERE src < dst),
 r AS (SELECT u, v, u AS node FROM l UNION SELECT r.u, r.v, g.dst FROM r JOIN g ON g.src = r.node AND NOT (g.src = r.u AND g.dst = r.v) AND NOT (g.src = r.v AND g.dst = r.u))
 SELECT u, v FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = l.u AND r.v = l.v AND r.node = l.v)""")
def bottleneck_bridges(spark: SparkSession, d: str) -> DataFrame:
    return Q.run(embedding_graph(spark, d, 0.05), BOTTLENECKS)["bridges"]


SIGNAL = A.arrival_sql("SELECT CAST(5 AS BIGINT) AS departure").replace("edges", "g")


@register("signal_call", f"{A.GRAPH}, {A.allowed(None, 0.6)}, {SIGNAL} SELECT node, arrival FROM d40")
def signal_call(spark: SparkSession, d: str) -> DataFrame:
    found = Q.run(embedding_graph(spark, d), "CALL db.signal.propagate(0, departure: 5, spatial_sphere([0, 0, 0], 0.6)) YIELD reachable")
    return found["reachable"].select("node", "arrival")


@register("causal_first_ten", f"{A.CAUSAL} SELECT src, dst, volume, proper_time FROM iv ORDER BY proper_time, dst, src LIMIT 10")
def causal_first_ten(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the pairs with the shortest chains."""
    return S.shortest_intervals(A.causal_graph(spark, d), 10)


@register("lowest_curvature", f"SELECT * FROM ({A._SQL['dice_curvature']}) ORDER BY curvature, u, v LIMIT 5")
def lowest_curvature(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the five edges of the least curvature."""
    return A.dice_curvature(spark, d).orderBy("curvature", "u", "v").limit(5)


@register("geometry_with_curvature", f"""SELECT i.src, i.dst, i.js_div, c.curvature IS NULL AS missing, coalesce(c.curvature, -9) AS curvature
 FROM ({A._SQL['info_geometry']}) i LEFT JOIN ({A._SQL['dice_curvature']}) c ON c.u = i.src AND c.v = i.dst""")
def geometry_with_curvature(spark: SparkSession, d: str) -> DataFrame:
    curved = A.dice_curvature(spark, d, 0.05).withColumnsRenamed({"u": "src", "v": "dst"})  # no longer edge is asked for
    own = S.geometry_with_curvature(A.info_geometry(spark, d), curved)
    return own.select("src", "dst", "js_div", F.isnan("curvature").alias("missing"), F.nanvl("curvature", F.lit(-9.0)).alias("curvature"))


@register("fractal_label", f"SELECT CASE WHEN dimension > 1.5 AND dimension < 2 THEN 'fractal' WHEN dimension >= 2 THEN 'fills the plane' WHEN dimension >= 1 THEN 'line-like' ELSE 'degenerate' END AS label FROM ({A._SQL['correlation_dimension']})")
def fractal_label(spark: SparkSession, d: str) -> DataFrame:
    return S.fractal_class(A.correlation_dimension(spark, d)).select("label")


@register("first_mentions", f"{A.WALK} SELECT walker, step, node * 1000 AS node FROM wk QUALIFY row_number() OVER (PARTITION BY walker, node ORDER BY step) = 1 OR step < 3")
def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    paths = A.walks(spark, d)[1]
    return Wk.first_mentions(paths.select("walker", "step", (F.col("node") * C.SENSE_ID).alias("node")))


@register("visited_nodes", f"{A.WALK} SELECT walker, array_to_string(list_sort(list_distinct(list(node))), ' ') AS nodes FROM wk GROUP BY walker")
def visited_nodes(spark: SparkSession, d: str) -> DataFrame:
    every = A.walks(spark, d)[1].groupBy("walker").agg(F.collect_list("node").alias("x"))  # a walk's steps are bounded
    return every.select("walker", F.array_join(F.array_distinct(F.sort_array("x")).cast("array<string>"), " ").alias("nodes"))


def sense_ids(graph: Graph) -> Graph:
    """Three nodes in a row as the senses of one token."""
    number = lambda c: F.floor(F.col(c) / 3) * C.SENSE_ID + F.col(c) % 3
    return Graph(graph.nodes.withColumn("id", number("id")), graph.edges.withColumns({c: number(c) for c in ("src", "dst")}))


@register("graph_counters", f"""{A.GRAPH}, p AS (SELECT id // 3 AS t, count(*) AS s FROM nodes GROUP BY 1) SELECT CAST(sum(s) AS BIGINT) AS nodes, (SELECT count(*) FROM edges) AS edges,
 round((SELECT count(*) FROM edges) / CAST(sum(s) AS DOUBLE), 6) AS mean_degree, count(*) FILTER (WHERE s > 1) AS multi_sense_tokens, CAST(sum(s) AS BIGINT) AS senses FROM p""")
def graph_counters(spark: SparkSession, d: str) -> DataFrame:
    return C.graph_counters(sense_ids(embedding_graph(spark, d))).select("nodes", "edges", r6("mean_degree"), "multi_sense_tokens", "senses")


@register("tool_centroid", f"WITH {A.NODES} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM nodes JOIN embeddings ON vec_id = id WHERE label = 1")
def tool_centroid(spark: SparkSession, d: str) -> DataFrame:
    nodes = embedding_nodes(spark, d).withColumn("id", F.col("id") * C.SENSE_ID)
    domains = table(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.when(F.col("label") == 1, "tool").otherwise("other").alias("domain"))
    return C.tool_centroid(Graph(nodes, nodes), domains).select(r6("x"), r6("y"), r6("z"))


@register("ranked_senses", f"""WITH {A.NODES}, s AS (SELECT label AS word, id, x, y, z FROM nodes JOIN embeddings ON vec_id = id), c AS (SELECT word, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM s GROUP BY word),
 r AS (SELECT s.word, id AS sense_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d FROM s JOIN c ON c.word = s.word)
 SELECT word, sense_id, round(d, 6) AS d, row_number() OVER (PARTITION BY word ORDER BY d, sense_id) AS nth FROM r QUALIFY nth <= 5""")
def ranked_senses(spark: SparkSession, d: str) -> DataFrame:
    own = embedding_nodes(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("word")), "id")
    centers = own.groupBy("word").agg(*[F.avg(c).alias(c) for c in "xyz"])
    found = Wk.ranked_senses(own.select("word", F.col("id").alias("sense_id"), "x", "y", "z"), centers)
    return found.select("word", "sense_id", r6("d"), F.col("nth").cast("bigint").alias("nth"))


INT8 = """x AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(k)), s AS (SELECT *, min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 254 AS sc FROM x WINDOW w AS (PARTITION BY vec_id)),
 q AS (SELECT vec_id, k, v, GREATEST(0, LEAST(254, floor((v - lo) / sc + 0.5))) * sc + lo AS w FROM s)"""


@register("relative_error", f"WITH {INT8} SELECT vec_id, round(sqrt(sum((v - w) * (v - w))) / sqrt(sum(v * v)), 6) AS error FROM q GROUP BY vec_id")
def relative_error(spark: SparkSession, d: str) -> DataFrame:
    return A.doubles(spark, d).select("vec_id", F.round(V.relative_error(F.col("v"), V.quantized(F.col("v"), 255)), 6).alias("error"))


@register("channel_error", f"WITH {INT8} SELECT CAST(k AS INTEGER) AS channel, round(avg(abs(v - w)), 7) AS error FROM q GROUP BY k")
def channel_error(spark: SparkSession, d: str) -> DataFrame:
    own = A.doubles(spark, d).select(F.col("v").alias("a"), V.quantized(F.col("v"), 255).alias("b"))
    return K.channel_error(own).select("channel", F.round("error", 7).alias("error"))


@register("prediction_errors", f"WITH {INT8}, e AS (SELECT sqrt(sum((v - w) * (v - w))) AS e FROM q GROUP BY vec_id) SELECT round(avg(e), 6) AS mean_l2, round(max(e), 6) AS max_l2 FROM e")
def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    own = A.doubles(spark, d).select(V.euclid(F.col("v"), V.quantized(F.col("v"), 255)).alias("l2_error"))
    return L.error_summary(own).select(r6("mean_l2"), r6("max_l2"))


@register("improvement", "WITH a AS (SELECT avg(value) AS m FROM events) SELECT event_type AS kind, round(CASE WHEN any_value(m) = 0 THEN 0 ELSE (avg(value) - any_value(m)) / any_value(m) * 100 END, 6) AS percent FROM events, a GROUP BY event_type")
def improvement(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    old = events.agg(F.avg("value").alias("old"))
    each = events.groupBy(F.col("event_type").alias("kind")).agg(F.avg("value").alias("new")).join(F.broadcast(old))  # one row
    return each.select("kind", F.round(L.improvement(F.col("new"), F.col("old")), 6).alias("percent"))


@register("compressed_attention", """WITH q AS (SELECT label, vec_id AS query, embedding FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT q.label, query, list_sum(list_transform(range(1, 65), lambda k: CAST(q.embedding[k] AS DOUBLE) * CAST(e.embedding[k] AS DOUBLE))) * 2.0 AS s, e.embedding AS v FROM q JOIN embeddings e ON e.label = q.label),
 x AS (SELECT label, query, exp(s - max(s) OVER (PARTITION BY query)) AS w, v FROM s)
 SELECT label AS head, query, CAST(d AS INTEGER) AS dim, round(sum(w * CAST(v[d + 1] AS DOUBLE)) / sum(w), 6) AS value FROM x, range(0, 64) t(d) GROUP BY ALL""")
def compressed_attention(spark: SparkSession, d: str) -> DataFrame:
    """At full rank, so the rebuilt cache gives what the whole one gives; a head is a label."""
    own = table(spark, d, "embeddings").select(F.lit(0).alias("layer"), F.col("label").cast("int").alias("head"), F.col("vec_id").cast("int").alias("token"), F.col("embedding").cast("array<double>").alias("key"))
    ask = own.where("token % 20 = 0").select("layer", "head", F.col("token").cast("bigint").alias("query"), F.col("key").alias("q"))
    found = K.attend_compressed(own.withColumn("value", F.col("key")), ask, 64, 2.0)
    return found.select("head", "query", F.posexplode("out").alias("dim", "value")).select("head", "query", "dim", r6("value"))


@register("binomial", "SELECT CAST(k AS BIGINT) AS k, round(CAST(factorial(13) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(13 - k AS INTEGER))) AS DOUBLE) * power(0.3, k) * power(0.7, 13 - k), 9) AS p FROM range(0, 14) t(k)")
def binomial(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, N.binomial_exactly(13, k, 0.3)) for k in range(14)], "k bigint, p double").select("k", F.round("p", 9).alias("p"))


@register("transfer_score", "SELECT p_partkey AS name, round(log10(p_size + 1) * (p_retailprice / 1000) * CASE WHEN p_size % 2 = 0 THEN 2.0 ELSE 1.0 END, 6) AS score FROM part")
def transfer_score(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") + 1).alias("info"), (F.col("p_retailprice") / 1000).alias("universality"), (F.col("p_size") % 2 == 0).alias("actionable"))
    return N.transfer_score(own).select("name", r6("score"))


@register("target_score", "SELECT round(avg(CASE WHEN abs(p_retailprice / 1300 - 1) < 0.1 THEN 1.0 ELSE 1 - abs(p_retailprice / 1300 - 1) END), 6) AS score FROM part")
def target_score(spark: SparkSession, d: str) -> DataFrame:
    return N.target_score(table(spark, d, "part").select(F.col("p_retailprice").alias("value"), F.lit(1300.0).alias("target"))).select(r6("score"))


@register("octree_knn", f"{A.knn_sql(5, False)} SELECT query, point, round(d, 6) AS d, nth FROM k")
def octree_knn(spark: SparkSession, d: str) -> DataFrame:
    nodes = embedding_nodes(spark, d)
    found = O.nearest(nodes, O.build(nodes), 5)
    return found.select("query", "point", r6("d"), F.col("nth").cast("bigint").alias("nth"))


@register("octree_range", f"""WITH {A.NODES}, p AS (SELECT a.id AS a, c.id AS b, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS d
 FROM nodes a JOIN nodes c ON a.id < c.id) SELECT a, b, round(d, 6) AS d FROM p WHERE d <= 0.1""")
def octree_range(spark: SparkSession, d: str) -> DataFrame:
    nodes = embedding_nodes(spark, d)
    return O.within(nodes, O.build(nodes), 0.1).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), r6("d"))


@register("svd_rebuild", "SELECT vec_id, CAST(k AS INTEGER) AS k, round(CAST(embedding[k + 1] AS DOUBLE), 6) AS value FROM embeddings, range(0, 64) t(k)")
def svd_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """U S Vt of all vectors, whose entries are those of the vectors."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row"))
    u, s, vt = D.svd(rows, 64)
    right = spark.createDataFrame([(k, (s * vt[:, k]).tolist()) for k in range(64)], "k int, b array<double>")
    return u.join(F.broadcast(right)).select(F.col("i").alias("vec_id"), "k", F.round(V.dot(F.col("u"), F.col("b")), 6).alias("value"))  # a row a dimension


@register("lowest_ricci")
def lowest_ricci(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the five edges of the most negative Ollivier-Ricci curvature."""
    return S.ricci(embedding_graph(spark, d, 0.05)).orderBy("curvature", "src", "dst").limit(5).select("src", "dst", r6("curvature"))


@register("geometry_with_ricci")
def geometry_with_ricci(spark: SparkSession, d: str) -> DataFrame:
    """Information geometry of every edge beside its Ollivier-Ricci curvature."""
    g = embedding_graph(spark, d, 0.05)
    found = S.geometry_with_curvature(S.information_geometry(g)[1], S.ricci(g))
    return found.select("src", "dst", r6("js_div"), r6("fisher_rao"), r6("curvature"))
