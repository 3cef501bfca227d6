"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.functions import numbers as N
from chronomesh.functions import vectors as V
from chronomesh.operators import corpus as C
from chronomesh.operators import learning as L
from chronomesh.operators import spatial as P
from chronomesh.operators import structure as S
from chronomesh.operators import tensor as K
from chronomesh.operators import traversal as T
from chronomesh.operators import walker as Wk
from chronomesh.plans import query as Q
from chronomesh.plans.graphs import corpus, embedding_graph, embedding_nodes
from chronomesh.plans.model import Context, Graph, Sphere, Window
from chronomesh.plans.storage import stored, table
from chronomesh.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from chronomesh.plans import reports  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def also(name: str, other: str) -> None:
    """A second name of a query."""
    register(other, _SQL.get(name))(_QUERIES[name])


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# SQL shared by many queries: the embedding graph by brute force

NODES = """nodes AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
 CAST(embedding[3] AS DOUBLE) AS z, vec_id * 37 % 60 AS b, LEAST(100, vec_id * 37 % 60 + 20 + vec_id * 11 % 40) AS e FROM embeddings)"""


def edges_sql(radius: float = 0.1, name: str = "edges") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT p.id AS src, q.id AS dst,
 sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS w,
 GREATEST(p.b, q.b) AS b, LEAST(p.e, q.e) AS e FROM nodes p JOIN nodes q ON p.id <> q.id) WHERE w <= {radius} AND b < e)"""


GRAPH = f"WITH RECURSIVE {NODES}, {edges_sql()}"
SPARSE = f"WITH RECURSIVE {NODES}, {edges_sql(0.05)}"


def allowed(window: tuple[int, int] | None, radius: float | None) -> str:
    """Nodes (n) and edges (g) inside a closed window and a sphere around the origin."""
    node = ["true"] + ([f"b <= {window[1]} AND e >= {window[0]}"] if window else []) + ([f"x * x + y * y + z * z <= {radius} * {radius}"] if radius else [])
    edge = f"b <= {window[1]} AND e >= {window[0]}" if window else "true"
    return f"""n AS (SELECT * FROM nodes WHERE {' AND '.join(node)}),
 g AS (SELECT * FROM edges WHERE {edge} AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"""


def matched(text: str) -> Query:
    return lambda spark, d: Q.run(embedding_graph(spark, d), text)["rows"]


register("match_edges", f"{GRAPH} SELECT src AS a, dst AS b FROM edges")(matched("MATCH (a)-[:NEAR]->(b) RETURN a, b"))
register("match_props", f"{GRAPH} SELECT 'v' || src AS a_name, 'v' || dst AS b_name FROM edges")(matched("MATCH (a)-[:NEAR]->(b) RETURN a.name, b.name"))
register("match_time_window", f"{GRAPH}, {allowed((10, 30), None)} SELECT src AS a, dst AS b FROM g")(
    matched("MATCH (a)-[:NEAR]->(b) WHERE time_window(10, 30) RETURN a, b"))
register("match_spatial_sphere", f"{GRAPH}, {allowed(None, 0.25)} SELECT src AS a, dst AS b FROM g")(
    matched("MATCH (a)-[:NEAR]->(b) WHERE spatial_sphere([0, 0, 0], 0.25) RETURN a, b"))
register("match_both", f"{GRAPH}, {allowed((10, 30), 0.25)} SELECT src AS a, dst AS b FROM g")(
    matched("MATCH (a)-[:NEAR]->(b) WHERE time_window(10, 30) AND spatial_sphere([0.0, 0.0, 0.0], 0.25) RETURN a, b"))


@register("spatial_range_join", f"{GRAPH} SELECT src, dst, round(w, 6) AS weight, b AS begin_ts, e AS end_ts FROM edges")
def spatial_range_join(spark: SparkSession, d: str) -> DataFrame:
    return P.proximity_edges(embedding_nodes(spark, d), 0.1).select("src", "dst", r6("weight"), "begin_ts", "end_ts")


@register("link_join", f"""WITH {NODES}, p AS (SELECT a.id AS src, c.id AS dst, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS d
 FROM nodes a JOIN nodes c ON a.id <> c.id) SELECT src, dst, round(d, 6) AS weight, CAST(15 AS BIGINT) AS begin_ts, CAST(35 AS BIGINT) AS end_ts FROM p WHERE d <= 0.08""")
def link_join(spark: SparkSession, d: str) -> DataFrame:
    return P.link_edges(embedding_nodes(spark, d), 0.08, 25, 10, 100).select("src", "dst", r6("weight"), "begin_ts", "end_ts")


@register("distance_join_inverse_weight", f"""WITH {NODES}, p AS (SELECT a.id AS src, c.id AS dst, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS d
 FROM nodes a JOIN nodes c ON a.id <> c.id) SELECT src, dst, round(1 / (d + 0.001), 6) AS weight FROM p WHERE d <= 0.05""")
def distance_join(spark: SparkSession, d: str) -> DataFrame:
    return P.inverse_edges(embedding_nodes(spark, d), 0.05).select("src", "dst", r6("weight"))


def knn_sql(k: int, causal: bool) -> str:
    return f"""WITH {NODES}, p AS (SELECT a.id AS query, c.id AS point, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS d
 FROM nodes a JOIN nodes c ON {'c.id % 16 <= a.id % 16' if causal else 'true'}),
 k AS (SELECT query, point, d, row_number() OVER (PARTITION BY query ORDER BY d, point) AS nth FROM p QUALIFY nth <= {k})"""


@register("knn_join", f"{knn_sql(5, False)} SELECT query, point, round(d, 6) AS d, nth FROM k")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    nodes = embedding_nodes(spark, d)
    return P.nearest(nodes, nodes, 5, 0.1).select("query", "point", r6("d"), F.col("nth").cast("bigint").alias("nth"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    return embedding_nodes(spark, d).select("id", "x", "y", "z", (F.col("id") % 16).alias("time_step"))


@register("causal_knn", f"{knn_sql(4, True)} SELECT query, point, round(d, 6) AS d, nth FROM k")
def causal_knn(spark: SparkSession, d: str) -> DataFrame:
    own = timed(spark, d)
    return P.nearest(own, own, 4, 0.1, causal=True).select("query", "point", r6("d"), F.col("nth").cast("bigint").alias("nth"))


@register("sparse_attention", f"""{knn_sql(4, True)}, s AS (SELECT query, point, exp(-d * d / 0.5) AS w FROM k)
 SELECT query, point AS key, round(w / sum(w) OVER (PARTITION BY query), 6) AS weight FROM s""")
def sparse_attention(spark: SparkSession, d: str) -> DataFrame:
    return K.sparse_attention(timed(spark, d), 4, 0.5, 0.1).select("query", "key", r6("weight"))


@register("dense_attention", """WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query, e.vec_id AS token, list_sum(list_transform(range(1, 65), lambda k: CAST(q.embedding[k] AS DOUBLE) * CAST(e.embedding[k] AS DOUBLE))) * 2.0 AS s, e.embedding AS v FROM q CROSS JOIN embeddings e),
 x AS (SELECT query, exp(s - max(s) OVER (PARTITION BY query)) AS w, v FROM s)
 SELECT query, CAST(d AS INTEGER) AS dim, round(sum(w * CAST(v[d + 1] AS DOUBLE)) / sum(w), 6) AS value FROM x, range(0, 64) t(d) GROUP BY ALL""")
def dense_attention(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ask = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    out = K.attention(ask, own.select(F.col("vec_id").alias("token"), F.col("v").alias("key"), F.col("v").alias("value")), 2.0)
    return out.select("query", F.posexplode("out").alias("dim", "value")).select("query", "dim", r6("value"))


also("dense_attention", "dense_attention_all")


def reach_sql(ctx: str, start: str) -> str:
    return f"""{GRAPH}, {ctx}, r AS (SELECT id AS node FROM n WHERE id = {start} UNION SELECT g.dst FROM r JOIN g ON g.src = r.node)"""


@register("reachable", f"{reach_sql(allowed((10, 60), None), '0')} SELECT node FROM r")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return T.reachable(embedding_graph(spark, d), 0, Context(window=Window(10, 60))).select("node")


@register("impact_radius", f"{reach_sql(allowed((0, 40), 0.5), '0')} SELECT node FROM r")
def impact_radius(spark: SparkSession, d: str) -> DataFrame:
    own = Q.run(embedding_graph(spark, d), "CALL db.impact.radius(0, spatial_sphere([0, 0, 0], 0.5), time_window(0, 40)) YIELD reachable")
    return own["reachable"]


@register("node_failure", f"""{GRAPH}, h AS (SELECT * FROM edges WHERE src <> 7 AND dst <> 7), r AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT h.dst FROM r JOIN h ON h.src = r.node) SELECT node FROM r""")
def node_failure(spark: SparkSession, d: str) -> DataFrame:
    return T.reachable(embedding_graph(spark, d).without(7), 0).select("node")


def unrolled(seed: str, step: str, key: str, value: str, rounds: int) -> str:
    """CTEs d0 .. d{rounds}: the least value a key after so many steps."""
    out = [f"d0 AS ({seed})"]
    for k in range(rounds):
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT {key}, min({value}) AS {value} FROM (SELECT {key}, {value} FROM d{k} UNION ALL {step.format(d=f'd{k}')}) GROUP BY ALL)")
    return ", ".join(out)


COST = unrolled("SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost", "SELECT edges.dst AS node, d.cost + 1.0 * w + 0.2 * w AS cost FROM {d} d JOIN edges ON edges.src = d.node", "node", "cost", 40)


@register("shortest_cost_path", f"{GRAPH}, {COST} SELECT node, round(cost, 6) AS cost FROM d40")
def shortest_cost(spark: SparkSession, d: str) -> DataFrame:
    return T.least_cost(embedding_graph(spark, d), 0, Context(spatial_weight=0.2), paths=False).select("node", r6("cost"))


def arrival_sql(departures: str, rounds: int = 40) -> str:
    step = "SELECT departure, edges.dst AS node, GREATEST(d.arrival, b) + CAST(ceil(w) AS BIGINT) AS arrival FROM {d} d JOIN edges ON edges.src = d.node AND GREATEST(d.arrival, b) < e"
    return unrolled(f"SELECT departure, CAST(0 AS BIGINT) AS node, departure AS arrival FROM ({departures})", step, "departure, node", "arrival", rounds)


ARRIVAL = f"{GRAPH}, {arrival_sql('SELECT CAST(5 AS BIGINT) AS departure')}"


@register("earliest_arrival", f"{ARRIVAL} SELECT node, arrival, arrival - 5 AS duration FROM d40")
def earliest_arrival(spark: SparkSession, d: str) -> DataFrame:
    got = T.arrivals(embedding_graph(spark, d), spark.createDataFrame([(0, 5)], "start bigint, departure bigint"), paths=False)
    return got.select("node", "arrival", (F.col("arrival") - F.col("departure")).alias("duration"))


@register("fastest_path", f"""{GRAPH}, {arrival_sql('SELECT unnest(range(0, 15)) AS departure')},
 f AS (SELECT node, departure, arrival - departure AS duration, row_number() OVER (PARTITION BY node ORDER BY arrival - departure, departure) AS k FROM d40) SELECT node, departure, duration FROM f WHERE k = 1""")
def fastest_path(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.range(0, 15).select(F.lit(0).cast("bigint").alias("start"), F.col("id").alias("departure"))
    got = T.arrivals(embedding_graph(spark, d), starts, paths=False).withColumn("duration", F.col("arrival") - F.col("departure"))
    best = got.groupBy("node").agg(F.min(F.struct("duration", "departure")).alias("s"))
    return best.select("node", "s.departure", "s.duration")


@register("signal_propagate", f"{ARRIVAL} SELECT id AS node, arrival FROM nodes LEFT JOIN d40 ON d40.node = nodes.id")
def signal_propagate(spark: SparkSession, d: str) -> DataFrame:
    got, rest = T.signal(embedding_graph(spark, d), 0, 5, paths=False)
    return got.select("node", "arrival").unionByName(rest.withColumn("arrival", F.lit(None).cast("bigint")))


@register("frontier", f"{ARRIVAL} SELECT node, arrival FROM d40 WHERE arrival <= 12")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    return T.frontier(T.signal(embedding_graph(spark, d), 0, 5, paths=False)[0], 12).select("node", "arrival")


def up_or_third(src, dst):
    return (src < dst) | ((src + dst) % 3 == 0)


def one_way(graph: P.Near) -> P.OneWay:
    return P.OneWay(graph.nodes, graph.radius, up_or_third)


@register("scc", f"""{SPARSE}, o AS (SELECT src, dst FROM edges WHERE src < dst OR (src + dst) % 3 = 0), c AS (SELECT id AS u, id AS v FROM nodes UNION SELECT c.u, o.dst FROM c JOIN o ON o.src = c.v)
 SELECT a.u AS node, min(a.v) AS component FROM c a JOIN c b ON a.u = b.v AND a.v = b.u GROUP BY a.u""")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return T.strong_components(one_way(embedding_graph(spark, d, 0.05))).select("node", "component")


@register("connected_components", f"{SPARSE}, c AS (SELECT id AS u, id AS v FROM nodes UNION SELECT c.u, edges.dst FROM c JOIN edges ON edges.src = c.v) SELECT u AS node, min(v) AS component FROM c GROUP BY u")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    g = embedding_graph(spark, d, 0.05)
    return T.component_labels(g.nodes.select(F.col("id").alias("node")), T.links_for(g, 1))


@register("articulation_points", f"""{SPARSE}, s AS (SELECT src AS cut, min(dst) AS first FROM edges GROUP BY src),
 r AS (SELECT cut, first AS node FROM s UNION SELECT r.cut, edges.dst FROM r JOIN edges ON edges.src = r.node AND edges.dst <> r.cut)
 SELECT DISTINCT src AS node FROM edges WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cut = edges.src AND r.node = edges.dst)""")
def articulation_points(spark: SparkSession, d: str) -> DataFrame:
    return T.cut_points(embedding_graph(spark, d, 0.05))[0]


@register("bridges", f"""{SPARSE}, l AS (SELECT DISTINCT src AS u, dst AS v FROM edges WHERE src < dst),
 r AS (SELECT u, v, u AS node FROM l UNION SELECT r.u, r.v, edges.dst FROM r JOIN edges ON edges.src = r.node AND NOT (edges.src = r.u AND edges.dst = r.v) AND NOT (edges.src = r.v AND edges.dst = r.u))
 SELECT u, v FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = l.u AND r.v = l.v AND r.node = l.v)""")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    return T.cut_points(embedding_graph(spark, d, 0.05))[1]


RADII, TIMES, HALF = [0.1, 0.2, 0.3, 0.4], [20, 40, 60], 10
SWEEP = f"""{GRAPH}, st AS (SELECT id FROM nodes ORDER BY sqrt(x * x + y * y + z * z), id LIMIT 1), sw AS (SELECT CAST(r AS DOUBLE) AS radius, CAST(t AS BIGINT) AS time FROM (SELECT unnest({RADII}) AS r) CROSS JOIN (SELECT unnest({TIMES}) AS t)),
 sn AS (SELECT radius, time, id FROM sw JOIN nodes ON sqrt(x * x + y * y + z * z) <= radius AND b <= time + {HALF} AND e >= time - {HALF}),
 se AS (SELECT sw.radius, sw.time, src, dst FROM sw JOIN edges ON b <= sw.time + {HALF} AND e >= sw.time - {HALF} JOIN sn p ON p.radius = sw.radius AND p.time = sw.time AND p.id = src JOIN sn q ON q.radius = sw.radius AND q.time = sw.time AND q.id = dst),
 r AS (SELECT radius, time, id AS node FROM sn WHERE id = (SELECT id FROM st) UNION SELECT r.radius, r.time, se.dst FROM r JOIN se ON se.radius = r.radius AND se.time = r.time AND se.src = r.node),
 sweep AS (SELECT sw.radius, sw.time, (SELECT count(*) FROM sn WHERE sn.radius = sw.radius AND sn.time = sw.time) AS active, (SELECT count(*) FROM r WHERE r.radius = sw.radius AND r.time = sw.time) AS reachable FROM sw),
 f AS (SELECT *, CASE WHEN active > 0 THEN CAST(reachable AS DOUBLE) / active ELSE 0.0 END AS fraction FROM sweep)"""


def sweep(spark: SparkSession, d: str) -> DataFrame:
    g = embedding_graph(spark, d)
    start = S.nearest_to(g.nodes, 0, 0, 0).first()
    return stored(S.percolation(g, start.id if start else -1, (0.0, 0.0, 0.0), RADII, TIMES, HALF), "sweep")[0]


@register("percolation_sweep", f"{SWEEP} SELECT radius, time, active, reachable, round(fraction, 6) AS fraction FROM f")
def percolation_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweep(spark, d).select("radius", "time", "active", "reachable", r6("fraction"))


@register("critical_radius", f"{SWEEP} SELECT time, min(CASE WHEN fraction >= 0.5 AND active >= 5 THEN radius END) AS critical_radius FROM f GROUP BY time")
def critical_radius(spark: SparkSession, d: str) -> DataFrame:
    return S.critical_radius(sweep(spark, d))


@register("connectivity_jump", f"""{SWEEP}, j AS (SELECT time, abs(fraction - lag(fraction) OVER (PARTITION BY time ORDER BY radius)) AS s FROM f)
 SELECT time, round(coalesce(max(s), 0), 6) AS jump, coalesce(max(s), 0) > 0.3 AS sharp FROM j GROUP BY time""")
def connectivity_jump(spark: SparkSession, d: str) -> DataFrame:
    return S.largest_jump(sweep(spark, d)).select("time", r6("jump"), "sharp")


@register("sweep_summary", f"""{SWEEP} SELECT min(CASE WHEN reachable > 0 THEN time END) AS first_time, max(CASE WHEN reachable > 0 THEN time END) AS last_time,
 round(max(fraction), 6) AS peak_fraction, count(*) FILTER (WHERE active > 0 AND fraction < 1) AS isolated FROM f""")
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.sweep_summary(sweep(spark, d)).select("first_time", "last_time", r6("peak_fraction"), "isolated")


PERSIST_TIMES = list(range(5, 100, 10))
PERSIST = f"""{SPARSE}, tt AS (SELECT CAST(unnest({PERSIST_TIMES}) AS BIGINT) AS time), sn AS (SELECT time, id FROM tt JOIN nodes ON b <= time + 3 AND e >= time - 3 AND sqrt(x * x + y * y + z * z) <= 0.6),
 se AS (SELECT tt.time, src, dst FROM tt JOIN edges ON b <= tt.time + 3 AND e >= tt.time - 3 JOIN sn p ON p.time = tt.time AND p.id = src JOIN sn q ON q.time = tt.time AND q.id = dst),
 c AS (SELECT time, id AS u, id AS v FROM sn UNION SELECT c.time, c.u, se.dst FROM c JOIN se ON se.time = c.time AND se.src = c.v),
 lab AS (SELECT time, u, min(v) AS comp FROM c GROUP BY ALL), sz AS (SELECT time, comp, count(*) AS s FROM lab GROUP BY ALL),
 pers AS (SELECT tt.time, coalesce(CAST(sum(s) AS BIGINT), 0) AS active, count(s) AS n_components, coalesce(max(s), 0) AS largest_size FROM tt LEFT JOIN sz ON sz.time = tt.time GROUP BY tt.time)"""


def persistence(spark: SparkSession, d: str) -> DataFrame:
    own = S.persistence(embedding_graph(spark, d, 0.05), (0.0, 0.0, 0.0), 0.6, PERSIST_TIMES, 3)
    return stored(own, "persistence")[0]


@register("persistence_sweep", f"{PERSIST} SELECT time, active, n_components, largest_size, round(CASE WHEN active > 0 THEN CAST(largest_size AS DOUBLE) / active ELSE 0 END, 6) AS fraction_largest FROM pers")
def persistence_sweep(spark: SparkSession, d: str) -> DataFrame:
    return persistence(spark, d).select("time", "active", "n_components", "largest_size", r6("fraction_largest"))


BARS = f"""{PERSIST}, st AS (SELECT *, coalesce(lag(n_components) OVER (ORDER BY time), 0) AS before FROM pers),
 up AS (SELECT time AS birth, unnest(range(before + 1, n_components + 1)) AS bar FROM st WHERE n_components > before),
 down AS (SELECT time AS death, unnest(range(n_components + 1, before + 1)) AS bar FROM st WHERE n_components < before),
 bars AS (SELECT birth, up.bar, min(death) AS death FROM up LEFT JOIN down ON down.bar = up.bar AND death > birth GROUP BY ALL)"""


@register("barcode", f"{BARS} SELECT birth, bar, death, max(largest_size) AS peak_size FROM bars JOIN pers ON time >= birth AND time < coalesce(death, 1000000) GROUP BY ALL")
def barcode(spark: SparkSession, d: str) -> DataFrame:
    return S.barcode(persistence(spark, d))


@register("longest_bars", f"""{BARS} SELECT (SELECT birth FROM bars WHERE death IS NOT NULL ORDER BY death - birth DESC, birth LIMIT 1) AS longest_birth,
 (SELECT max(death - birth) FROM bars) AS longest_life, (SELECT min(birth) FROM bars WHERE death IS NULL) AS immortal_birth""")
def longest_bars(spark: SparkSession, d: str) -> DataFrame:
    return S.longest_bars(S.barcode(persistence(spark, d)).where("true"))


@register("degree_hub", f"""{GRAPH}, dg AS (SELECT src, count(*) AS c FROM edges GROUP BY src)
 SELECT (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (SELECT CAST(count(*) AS DOUBLE) FROM nodes), 6) AS mean_degree, src AS hub, c AS hub_degree FROM dg ORDER BY c DESC, src DESC LIMIT 1""")
def degree_hub(spark: SparkSession, d: str) -> DataFrame:
    return S.degrees(embedding_graph(spark, d)).select("edges", r6("mean_degree"), "hub", "hub_degree")


@register("edge_kind_counts", f"{GRAPH} SELECT CAST(floor(count(*) FILTER (WHERE b = e) / 2) AS BIGINT) AS spatial, count(*) FILTER (WHERE e > b) AS temporal FROM edges")
def edge_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.edge_kinds(embedding_graph(spark, d).edges)


@register("nearest_node", f"WITH {NODES} SELECT id, round(sqrt(power(x - 0.1, 2) + power(y, 2) + power(z, 2)), 6) AS d FROM nodes ORDER BY sqrt(power(x - 0.1, 2) + power(y, 2) + power(z, 2)), id LIMIT 1")
def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_to(embedding_nodes(spark, d), 0.1, 0.0, 0.0).select("id", r6("d"))


@register("systematic_sample", f"WITH {NODES}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nth, (SELECT GREATEST(1, count(*) // 40) FROM nodes) AS step FROM nodes) SELECT id FROM k WHERE nth % step = 0 AND nth < 40 * step")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    nodes = embedding_nodes(spark, d)
    return S.systematic_sample(Graph(nodes, spark.createDataFrame([], "src bigint, ord int, dst bigint, weight double, begin_ts bigint, end_ts bigint")), 40).nodes.select("id")


CAUSAL = f"""{SPARSE}, o AS (SELECT DISTINCT src, dst FROM edges WHERE src < dst AND e > b), h AS (SELECT src, dst, 1 AS k FROM o UNION SELECT h.src, o.dst, h.k + 1 FROM h JOIN o ON o.src = h.dst),
 rel AS (SELECT src, dst, max(k) AS proper_time FROM h GROUP BY ALL), ev AS (SELECT src, dst FROM rel UNION ALL SELECT id, id FROM nodes),
 vol AS (SELECT p.src, q.dst, count(*) AS volume FROM ev p JOIN ev q ON p.dst = q.src GROUP BY ALL), iv AS (SELECT rel.src, rel.dst, volume, proper_time FROM rel JOIN vol ON vol.src = rel.src AND vol.dst = rel.dst)"""


def causal_graph(spark: SparkSession, d: str) -> Graph:
    g = embedding_graph(spark, d, 0.05)
    return Graph(g.nodes, g.edges.where("src < dst"))


@register("causal_intervals", f"{CAUSAL} SELECT src, dst, volume, proper_time FROM iv")
def causal_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.causal_intervals(causal_graph(spark, d))


@register("causal_stats", f"""{CAUSAL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_related_pairs, round(avg(proper_time), 6) AS mean_proper_time, round(avg(volume), 6) AS mean_volume,
 round(regr_slope(CASE WHEN proper_time >= 2 THEN ln(volume) END, CASE WHEN proper_time >= 2 THEN ln(proper_time) END), 6) AS mm_dimension FROM iv""")
def causal_stats(spark: SparkSession, d: str) -> DataFrame:
    g = causal_graph(spark, d)
    return S.causal_stats(g, S.causal_intervals(g)).select("n_nodes", "n_related_pairs", r6("mean_proper_time"), r6("mean_volume"), r6("mm_dimension"))


@register("ricci")
def ricci(spark: SparkSession, d: str) -> DataFrame:
    return S.ricci(embedding_graph(spark, d, 0.05)).select("src", "dst", r6("w1"), r6("curvature"))


@register("ricci_report")
def ricci_report(spark: SparkSession, d: str) -> DataFrame:
    return S.ricci_report(S.ricci(embedding_graph(spark, d, 0.05)))


@register("dice_curvature", f"""{GRAPH}, l AS (SELECT DISTINCT LEAST(src, dst) AS u, GREATEST(src, dst) AS v FROM edges WHERE w >= 0.03), s AS (SELECT u AS node, v AS pt FROM l UNION ALL SELECT v, u FROM l),
 dg AS (SELECT node, count(*) AS c FROM s GROUP BY node)
 SELECT u, v, round(2.0 * (SELECT count(*) FROM s p JOIN s q ON p.pt = q.pt WHERE p.node = u AND q.node = v) / (p.c + q.c), 6) AS curvature FROM l JOIN dg p ON p.node = u JOIN dg q ON q.node = v""")
def dice_curvature(spark: SparkSession, d: str, most_weight: float | None = None) -> DataFrame:
    return S.dice_curvature(embedding_graph(spark, d), 0.03, most_weight).select("u", "v", r6("curvature"))


@register("info_geometry", f"""{SPARSE}, l AS (SELECT DISTINCT LEAST(src, dst) AS u, GREATEST(src, dst) AS v FROM edges), s AS (SELECT u AS node, v AS pt FROM l UNION ALL SELECT v, u FROM l),
 mu AS (SELECT node, pt, 0.5 / count(*) OVER (PARTITION BY node) AS p FROM s UNION ALL SELECT DISTINCT node, node, 0.5 FROM s), en AS (SELECT node, sum(-p * ln(p)) AS h FROM mu GROUP BY node),
 pq AS (SELECT coalesce(a.u, c.u) AS u, coalesce(a.v, c.v) AS v, coalesce(a.p, 0) AS p, coalesce(c.p, 0) AS q FROM (SELECT u, v, pt, p FROM l JOIN mu ON node = u) a FULL JOIN (SELECT u, v, pt, p FROM l JOIN mu ON node = v) c ON a.u = c.u AND a.v = c.v AND a.pt = c.pt)
 SELECT u AS src, v AS dst, round(any_value(hu.h), 6) AS entropy_src, round(any_value(hv.h), 6) AS entropy_dst, round(sum(CASE WHEN p > 0 THEN p * ln(p / CASE WHEN q > 0 THEN q ELSE 1e-10 END) ELSE 0 END), 5) AS kl_uv,
 round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_div, round(2 * acos(LEAST(1.0, sum(sqrt(p * q)))), 5) AS fisher_rao
 FROM pq JOIN en hu ON hu.node = u JOIN en hv ON hv.node = v GROUP BY u, v""")
def info_geometry(spark: SparkSession, d: str) -> DataFrame:
    own = S.information_geometry(embedding_graph(spark, d, 0.05))[1]
    return own.select("src", "dst", r6("entropy_src"), r6("entropy_dst"), F.round("kl_uv", 5).alias("kl_uv"), r6("js_div"), F.round("fisher_rao", 5).alias("fisher_rao"))


@register("correlation_dimension", """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
 d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id < b.id), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
 r AS (SELECT exp(ln(0.01) + k * (ln(0.5) - ln(0.01)) / 19) AS r FROM range(0, 20) t(k)), c AS (SELECT r, count(*) AS c FROM r JOIN d ON d.d < r GROUP BY r)
 SELECT round(regr_slope(ln(c / (n * (n - 1) / 2)), ln(r)), 5) AS dimension FROM c, n""")
def correlation_dimension(spark: SparkSession, d: str) -> DataFrame:
    points = embedding_nodes(spark, d).select(F.col("id").alias("idx"), "x", "y")
    return S.correlation_dimension(points, 0.01, 0.5, 20).select(F.round("dimension", 5).alias("dimension"))


TOKENS = r"""t AS (SELECT lang AS domain, doc_id, list_filter(list_transform(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS ws FROM documents),
 tk AS (SELECT domain, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM t)"""


@register("token_freq", f"WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM tk GROUP BY word HAVING count(*) >= 5) SELECT row_number() OVER (ORDER BY n DESC, word) - 1 AS token_id, word, n FROM c ORDER BY n DESC, word LIMIT 20000")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return C.vocabulary(C.token_counts(corpus(spark, d)))


@register("token_domain", f"WITH {TOKENS}, c AS (SELECT word, domain, count(*) AS n FROM tk GROUP BY ALL) SELECT word, domain, n FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, domain) = 1")
def token_domain(spark: SparkSession, d: str) -> DataFrame:
    return C.token_domains(corpus(spark, d))


LEADS = " UNION ALL ".join(f"SELECT word AS a, lead(word, {k}) OVER (PARTITION BY domain ORDER BY doc_id, pos) AS b FROM tk" for k in range(1, 6))
PAIRS = f"""WITH {TOKENS}, o AS (SELECT a, b, count(*) AS n FROM ({LEADS}) WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
 co AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM o UNION ALL SELECT b, a, n FROM o) GROUP BY ALL)"""
VOCAB = "vc AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS token_id FROM (SELECT word, count(*) AS n FROM tk GROUP BY word HAVING count(*) >= 5) ORDER BY n DESC, word LIMIT 20000)"
PMI = f"""{PAIRS}, {VOCAB}, ij AS (SELECT p.token_id AS i, q.token_id AS j, n FROM co JOIN vc p ON p.word = a JOIN vc q ON q.word = b), ri AS (SELECT i, CAST(sum(n) AS DOUBLE) AS r FROM ij GROUP BY i), tt AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM ij),
 pm AS (SELECT ij.i, ij.j, GREATEST(0.0, ln(GREATEST(1e-10, CAST(n AS DOUBLE) * total / (p.r * q.r)))) AS pmi FROM ij JOIN ri p ON p.i = ij.i JOIN ri q ON q.i = ij.j, tt)"""


@register("cooccurrence", f"{PAIRS} SELECT a, b, n FROM co")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return C.cooccurrence(corpus(spark, d))


def pmi_rows(spark: SparkSession, d: str, most: int = 20_000) -> DataFrame:
    docs = corpus(spark, d)
    vocab = stored(C.vocabulary(C.token_counts(docs), 5, most), "vocab")[0]
    pairs = stored(C.vocabulary_pairs(docs, vocab), "pairs")[0]
    return C.positive_pmi(pairs)


@register("pmi", f"{PMI} SELECT i, j, round(pmi, 6) AS pmi FROM pm WHERE pmi > 0")
def pmi(spark: SparkSession, d: str) -> DataFrame:
    return pmi_rows(spark, d).select("i", "j", r6("pmi"))


def top_pmi(spark: SparkSession, d: str) -> DataFrame:
    """Ranked by what both engines' logarithms agree in."""
    return C.top_neighbours(pmi_rows(spark, d).withColumn("pmi", F.round("pmi", 9)), 20)


TOP_PMI = f"{PMI}, rd AS (SELECT i, j, round(pmi, 9) AS pmi FROM pm WHERE pmi > 0), tp AS (SELECT i, j, pmi FROM rd QUALIFY row_number() OVER (PARTITION BY i ORDER BY pmi DESC, j) <= 20)"


@register("topk_pmi", f"{TOP_PMI} SELECT i, j, round(pmi, 6) AS pmi FROM tp")
def topk_pmi(spark: SparkSession, d: str) -> DataFrame:
    return top_pmi(spark, d).select("i", "j", r6("pmi"))


also("pmi", "pmi_all")


@register("topk_pmi_all", f"{TOP_PMI} SELECT i, round(sum(pmi), 4) AS total, count(*) AS n FROM tp GROUP BY i")
def topk_pmi_all(spark: SparkSession, d: str) -> DataFrame:
    return top_pmi(spark, d).groupBy("i").agg(F.round(F.sum("pmi"), 4).alias("total"), F.count("*").alias("n"))


SENSES = f"""{TOP_PMI.replace('WITH t AS', 'WITH RECURSIVE t AS', 1)}, nb AS (SELECT i AS center, j AS node FROM tp), lk AS (SELECT DISTINCT LEAST(i, j) AS u, GREATEST(i, j) AS v FROM tp WHERE i <> j),
 l2 AS (SELECT u, v FROM lk UNION ALL SELECT v, u FROM lk), ins AS MATERIALIZED (SELECT p.center, p.node AS u, q.node AS v FROM nb p JOIN l2 ON l2.u = p.node JOIN nb q ON q.center = p.center AND q.node = l2.v),
 r AS (SELECT center, node AS u, node AS v FROM nb UNION SELECT r.center, r.u, ins.v FROM r JOIN ins ON ins.center = r.center AND ins.u = r.v),
 lab AS (SELECT center, u AS node, min(v) AS comp FROM r GROUP BY ALL), sz AS (SELECT center, comp, count(*) AS s FROM lab GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY s DESC, comp) - 1 AS nth, count(*) OVER (PARTITION BY center) AS many FROM sz),
 kp AS (SELECT *, s >= 4 AND nth < 4 AS keep FROM rk), nm AS (SELECT *, CASE WHEN many = 1 THEN 0 WHEN keep THEN nth ELSE count(*) FILTER (WHERE keep) OVER (PARTITION BY center) END AS sense FROM kp),
 few AS (SELECT center FROM nb GROUP BY center HAVING count(*) < 2)"""


@register("senses", f"""{SENSES} SELECT lab.center, CAST(sense AS INTEGER) AS sense, node AS member FROM lab JOIN nm ON nm.center = lab.center AND nm.comp = lab.comp WHERE lab.center NOT IN (SELECT center FROM few)
 UNION ALL SELECT center, 0, NULL FROM few""")
def senses(spark: SparkSession, d: str) -> DataFrame:
    return C.senses(stored(top_pmi(spark, d), "top")[0])


@register("walker_paths")
def walker_paths(spark: SparkSession, d: str) -> DataFrame:
    g = embedding_graph(spark, d)
    return Wk.walk(g, Wk.episode_starts(g, 20), 30, Wk.WalkerConfig(cell=0.1)).select("walker", "node", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), r6("score"))


WALK = f"""{GRAPH}, od AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS ord, count(*) OVER (PARTITION BY src) AS degree, w FROM edges),
 nn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nth FROM nodes), ss AS (SELECT CAST(k AS BIGINT) AS walker, id AS node FROM range(0, 20) t(k) JOIN nn ON nth = (k * 137) % (SELECT count(*) FROM nodes)),
 wk AS (SELECT walker, 0 AS step, node FROM ss UNION ALL SELECT wk.walker, wk.step + 1, od.dst FROM wk JOIN od ON od.src = wk.node AND od.ord = (wk.node + wk.step + 1) % od.degree WHERE wk.step < 30)"""


def walks(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = embedding_graph(spark, d)
    return g, stored(Wk.random_walk(g, Wk.episode_starts(g, 20), 30), "walks")[0]


@register("random_walk", f"{WALK} SELECT walker, step, node FROM wk")
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    return walks(spark, d)[1]


also("random_walk", "random_walk_all")


@register("path_edge_weight", f"{WALK}, pe AS (SELECT walker, lag(node) OVER (PARTITION BY walker ORDER BY step) AS src, node AS dst FROM wk) SELECT walker, round(coalesce(avg(w), 0), 6) AS mean_weight FROM pe LEFT JOIN od ON od.src = pe.src AND od.dst = pe.dst GROUP BY walker")
def path_edge_weight(spark: SparkSession, d: str) -> DataFrame:
    g, paths = walks(spark, d)
    return Wk.mean_path_weight(paths, g).select("walker", r6("mean_weight"))


@register("unique_ratio", f"{WALK} SELECT walker, round(count(DISTINCT node) / CAST(count(*) AS DOUBLE), 6) AS unique_ratio FROM wk GROUP BY walker")
def unique_ratio(spark: SparkSession, d: str) -> DataFrame:
    return Wk.unique_ratio(walks(spark, d)[1]).select("walker", r6("unique_ratio"))


@register("community_crossings", f"{WALK}, cc AS (SELECT walker, label, lag(label) OVER (PARTITION BY walker ORDER BY step) AS l FROM wk JOIN embeddings ON vec_id = node) SELECT walker, count(*) FILTER (WHERE l <> label) AS crossings FROM cc GROUP BY walker")
def community_crossings(spark: SparkSession, d: str) -> DataFrame:
    return Wk.crossings(walks(spark, d)[1], table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community")))


@register("hebbian_update", f"""{WALK}, pe AS (SELECT lag(node) OVER (PARTITION BY walker ORDER BY step) AS src, node AS dst FROM wk), ct AS (SELECT src, dst, count(*) AS c FROM pe WHERE src IS NOT NULL GROUP BY ALL)
 SELECT od.src, od.dst, round(w * 0.995 + 0.05 * coalesce(c, 0), 6) AS weight FROM od LEFT JOIN ct ON ct.src = od.src AND ct.dst = od.dst""")
def hebbian_update(spark: SparkSession, d: str) -> DataFrame:
    g, paths = walks(spark, d)
    return Wk.reinforce(g.edges, paths).select("src", "dst", r6("weight"))


@register("zscore", f"""WITH {NODES}, s AS (SELECT avg(x) AS mx, GREATEST(stddev_pop(x), 1e-6) AS sx, avg(y) AS my, GREATEST(stddev_pop(y), 1e-6) AS sy FROM nodes) SELECT id, round((x - mx) / sx, 6) AS x, round((y - my) / sy, 6) AS y FROM nodes, s""")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return L.normalised(embedding_nodes(spark, d), ["x", "y"])[0].select("id", r6("x"), r6("y"))


@register("upper_median", "SELECT value AS median FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) WHERE k = n // 2")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return L.upper_median(table(spark, d, "events"), "value")


@register("episode_summary", "SELECT event_type AS kind, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def episode_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.episode_summary(table(spark, d, "events").select(F.col("event_type").alias("kind"), "value")).select("kind", r6("mean"), r6("deviation"))


@register("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@register("ring_histogram", f"WITH {NODES}, r AS (SELECT LEAST(floor(sqrt(x * x + y * y) / 0.6 * 10), 9) AS ring, LEAST(floor((atan2(y, x) + pi()) / (2 * pi()) * 8), 7) AS bin FROM nodes) SELECT CAST(ring AS BIGINT) AS ring, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ring), 6) AS share FROM r GROUP BY ring, bin")
def ring_histogram(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    ring, sector = V.ring_histogram(F.col("id"), F.col("x"), F.col("y"), 0.6)
    n = embedding_nodes(spark, d).select(ring.cast("bigint").alias("ring"), sector.cast("bigint").alias("bin")).groupBy("ring", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("ring")), 6))


def doubles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@register("quant4", """WITH x AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(k)), s AS (SELECT *, min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 15 AS sc FROM x WINDOW w AS (PARTITION BY vec_id, k // 16))
 SELECT vec_id, round(sum(abs(v - (GREATEST(0, LEAST(15, floor((v - lo) / sc + 0.5))) * sc + lo))), 5) AS error FROM s GROUP BY vec_id""")
def quant4(spark: SparkSession, d: str) -> DataFrame:
    own = doubles(spark, d).withColumn("q", V.block_quantized(F.col("v")))
    return own.select("vec_id", F.round(V.total(F.zip_with("v", "q", lambda a, b: F.abs(a - b))), 5).alias("error"))


@register("int8_error", """WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT *, min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 254 AS sc FROM x WINDOW w AS (PARTITION BY vec_id))
 SELECT vec_id, round(sqrt(sum(power(v - (GREATEST(0, LEAST(254, floor((v - lo) / sc + 0.5))) * sc + lo), 2))), 6) AS error FROM s GROUP BY vec_id""")
def int8_error(spark: SparkSession, d: str) -> DataFrame:
    return doubles(spark, d).select("vec_id", F.round(V.euclid(F.col("v"), V.quantized(F.col("v"), 255)), 6).alias("error"))


@register("hadamard_rotate", """WITH x AS (SELECT vec_id, j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(j)) SELECT vec_id, CAST(i AS INTEGER) AS i, round(sum(v * (1 - 2 * (bit_count(i & j) % 2))) / 8, 5) AS v FROM x, range(0, 64) u(i) GROUP BY ALL""")
def hadamard_rotate(spark: SparkSession, d: str) -> DataFrame:
    own = doubles(spark, d).select("vec_id", F.posexplode(V.hadamard(F.col("v"))).alias("i", "v"))
    return own.select("vec_id", "i", F.round("v", 5).alias("v"))


also("hadamard_rotate", "hadamard_rotate_all")


@register("softmax_geometry", """WITH x AS (SELECT vec_id, k, CAST(embedding[k] AS DOUBLE) * 5 AS a, CAST(embedding[k + 32] AS DOUBLE) * 5 AS b FROM embeddings, range(1, 33) t(k)), s AS (SELECT vec_id, exp(a) / sum(exp(a)) OVER w AS p, exp(b) / sum(exp(b)) OVER w AS q FROM x WINDOW w AS (PARTITION BY vec_id))
 SELECT vec_id, round(sum(p * ln(p / q)), 6) AS kl, round(2 * acos(LEAST(1.0, sum(sqrt(p * q)))), 5) AS fisher_rao, round(sum(p * (1 - p)), 6) AS fisher FROM s GROUP BY vec_id""")
def softmax_geometry(spark: SparkSession, d: str) -> DataFrame:
    scaled = lambda first: V.softmax(F.transform(F.slice("v", first, 32), lambda x: x * 5))
    own = doubles(spark, d).select("vec_id", scaled(1).alias("p"), scaled(33).alias("q"))
    return own.select("vec_id", F.round(V.kl_divergence(F.col("p"), F.col("q")), 6).alias("kl"), F.round(V.fisher_rao(F.col("p"), F.col("q")), 5).alias("fisher_rao"), F.round(V.total(V.diagonal_fisher(F.col("p"))), 6).alias("fisher"))


def descent_sql(natural: bool) -> str:
    """Logits of every vector after eight steps towards class 1, unrolled."""
    name, slope = ("n", "g / (p * (1 - p) + 0.0001)") if natural else ("v", "g")
    out = [f"{name}0 AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS l FROM embeddings, range(0, 64) t(k))"]
    for k in range(8):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT vec_id, k, l - 0.1 * {slope} AS l FROM (SELECT *, p - CASE WHEN k = 1 THEN 1 ELSE 0 END AS g FROM (SELECT vec_id, k, l, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM {name}{k})))")
    return ", ".join(out) + f", {name} AS (SELECT vec_id, k, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM {name}8)"


@register("gradient_descent", f"WITH {descent_sql(False)}, {descent_sql(True)} SELECT v.vec_id, round(v.p, 6) AS vanilla, round(n.p, 6) AS natural FROM v JOIN n ON n.vec_id = v.vec_id AND n.k = 1 WHERE v.k = 1")
def gradient_descent(spark: SparkSession, d: str) -> DataFrame:
    own = doubles(spark, d).select("vec_id", F.col("v").alias("l"))
    return own.select("vec_id", *[F.round(V.softmax(V.descend(F.col("l"), 1, natural=n))[1], 6).alias(k) for k, n in (("vanilla", False), ("natural", True))])


def sales_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, v): quantity by supplier and part, both modulo 16."""
    own = table(spark, d, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("i"), (F.col("l_partkey") % 16).cast("int").alias("j"), "l_quantity")
    return own.groupBy("i", "j").agg(F.sum("l_quantity").alias("v"))


@register("svd_reconstruct")
def svd_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    m = stored(sales_matrix(spark, d), "matrix")[0]
    return K.matrix_error(m, K.low_rank(m, 4)).select(r6("error"))


@register("outlier_quantisation_plain", """WITH m AS (SELECT l_suppkey % 16 AS i, l_partkey % 16 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), s AS (SELECT *, min(v) OVER (PARTITION BY i) AS lo, (max(v) OVER (PARTITION BY i) - min(v) OVER (PARTITION BY i)) / 15 AS sc FROM m),
 q AS (SELECT v, GREATEST(0, LEAST(15, floor((v - lo) / CASE WHEN sc < 1e-6 THEN 1 ELSE sc END + 0.5))) * CASE WHEN sc < 1e-6 THEN 1 ELSE sc END + lo AS w FROM s) SELECT round(sqrt(sum((v - w) * (v - w))) / (sqrt(sum(v * v)) + 1e-8), 6) AS error FROM q""")
def outlier_quantisation_plain(spark: SparkSession, d: str) -> DataFrame:
    m = stored(sales_matrix(spark, d), "matrix")[0]
    return K.matrix_error(m, K.row_quantized(m)).select(r6("error"))


@register("outlier_quantisation")
def outlier_quantisation(spark: SparkSession, d: str) -> DataFrame:
    m = stored(sales_matrix(spark, d), "matrix")[0]
    out = None
    for name, other in (("plain", K.row_quantized(m)), ("rank1", K.outlier_aware(m, 1)), ("rank2", K.outlier_aware(m, 2))):
        own = K.matrix_error(m, other).select(F.lit(name).alias("way"), r6("error"))
        out = own if out is None else out.unionByName(own)
    return out


@register("frobenius", "WITH m AS (SELECT l_suppkey % 16 AS i, l_partkey % 16 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT round(sqrt(sum(v * v)), 4) AS norm FROM m")
def frobenius(spark: SparkSession, d: str) -> DataFrame:
    return K.frobenius(sales_matrix(spark, d)).select(F.round("norm", 4).alias("norm"))


@register("mps_product_log_norm", """WITH s AS (SELECT label, list_sum(list_transform(embedding[1:2], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) + 1 AS q FROM embeddings) SELECT label AS chain, round(sum(ln(q)), 6) AS log_norm_sq FROM s GROUP BY label""")
def mps_product_log_norm(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector: logarithms, as the product leaves the range of doubles."""
    own = table(spark, d, "embeddings").select(F.col("label").alias("chain"), F.col("vec_id").alias("site"), F.array(F.lit(1), F.lit(3), F.lit(1)).alias("shape"), F.concat(F.array(F.lit(1.0)), F.slice(F.col("embedding").cast("array<double>"), 1, 2)).alias("data"))
    return K.product_chain_log_norm(own).select("chain", r6("log_norm_sq"))


also("mps_product_log_norm", "mps_product_norm")


@register("primes", "WITH n AS (SELECT unnest(range(2, 5001)) AS p) SELECT p FROM n WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 71)) AS q) WHERE q < p AND p % q = 0)")
def primes(spark: SparkSession, d: str) -> DataFrame:
    return N.primes(spark, 5000)


@register("zeta", "SELECT round(sum(1.0 / (CAST(k AS DOUBLE) * k)), 6) AS zeta FROM range(1, 100001) t(k)")
def zeta(spark: SparkSession, d: str) -> DataFrame:
    return N.zeta(spark, 2.0, 100_000).select(r6("zeta"))


@register("circulant", "SELECT u, (u + s) % 13 AS v FROM range(0, 13) t(u), (SELECT unnest([1, 5, 12, 8]) AS s)")
def circulant(spark: SparkSession, d: str) -> DataFrame:
    return N.circulant(spark, [1, 5])


@register("paley", "SELECT u, v FROM range(0, 13) a(u), range(0, 13) b(v) WHERE (v - u + 13) % 13 IN (1, 3, 4, 9, 10, 12)")
def paley(spark: SparkSession, d: str) -> DataFrame:
    return N.paley(spark)


@register("graph_cover", "WITH e AS (SELECT DISTINCT n_regionkey AS u, n_nationkey % 5 AS v, n_nationkey AS g FROM nation) SELECT u * 13 + k AS u, v * 13 + (k + g) % 13 AS v FROM e, range(0, 13) t(k)")
def graph_cover(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("u"), (F.col("n_nationkey") % 5).cast("bigint").alias("v"), F.col("n_nationkey").alias("voltage")).distinct()
    return N.graph_cover(base)


@register("polygon", "SELECT k, round(cos(k * 2 * pi() / 13), 6) AS x, round(sin(k * 2 * pi() / 13), 6) AS y FROM range(0, 13) t(k)")
def polygon(spark: SparkSession, d: str) -> DataFrame:
    return N.polygon(spark).select("k", r6("x"), r6("y"))


@register("fold_symmetry", f"WITH {NODES}, s AS (SELECT CAST(floor((atan2(y, x) + 2 * pi()) / (2 * pi() / 13) + 0.5) AS BIGINT) % 13 AS s, count(*) AS c FROM nodes GROUP BY 1) SELECT round((sum(c * c) - 2 * (sum(c) / 13.0) * sum(c) + 13 * (sum(c) / 13.0) * (sum(c) / 13.0)) / (sum(c) / 13.0), 5) AS chi2, max(c) AS peak FROM s")
def fold_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return N.fold_symmetry(embedding_nodes(spark, d)).select(F.round("chi2", 5).alias("chi2"), "peak")


@register("mass_multiples", "SELECT p_partkey AS name, CAST(GREATEST(round(p_retailprice / 13), 1) AS BIGINT) AS k, round(abs(p_retailprice - 13 * GREATEST(round(p_retailprice / 13), 1)) / 0.5, 5) AS sigma, abs(p_retailprice - 13 * GREATEST(round(p_retailprice / 13), 1)) / 0.5 < 3 AS within FROM part")
def mass_multiples(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("mass"), F.lit(0.5).alias("error"))
    return N.multiples_of_13(own).select("name", "k", F.round("sigma", 5).alias("sigma"), "within")


@register("compression_table", "SELECT source AS name, CAST(count(*) * 64 AS BIGINT) AS raw_bits, round(count(*) * 64 / CAST(count(DISTINCT lang) AS DOUBLE), 6) AS ratio FROM documents GROUP BY source")
def compression_table(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("symbols"), F.countDistinct("lang").alias("info"))
    return N.compression_table(own).select("name", "raw_bits", r6("ratio"))


@register("position_classifier")
def position_classifier(spark: SparkSession, d: str) -> DataFrame:
    own = embedding_nodes(spark, d).withColumn("target", (F.col("x") + F.col("y") > 0).cast("int"))
    return L.position_classifier(own)[0].select("id", "target", "predicted", F.round("p_one", 3).alias("p_one"))


@register("coordinate_branch")
def coordinate_branch(spark: SparkSession, d: str) -> DataFrame:
    """A token is a label of the embeddings: its learned place is the mean of its nodes."""
    own = embedding_nodes(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("token_id")), "id")
    return L.coordinate_branch(own.select("id", "token_id", "x", "y", "z"))[0].select("id", "token_id", *[F.round(c, 3).alias(c) for c in ("px", "py", "pz", "l2_error")])


@register("tumbling_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@register("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"))
