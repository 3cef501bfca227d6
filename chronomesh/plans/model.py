"""Graph model: nodes with a position, a lifetime and properties; edges with a weight and a validity."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = 9223372036854775807  # end of an unbounded lifetime

NODES = "id bigint, x double, y double, z double, begin_ts bigint, end_ts bigint, props map<string,string>"
EDGES = "src bigint, ord int, dst bigint, weight double, begin_ts bigint, end_ts bigint"


@dataclass(frozen=True)
class Window:
    start: int
    end: int


@dataclass(frozen=True)
class Sphere:
    x: float
    y: float
    z: float
    radius: float


@dataclass(frozen=True)
class Context:
    """What a traversal may touch and how it weighs an edge.

    Windows are closed by default (``open_window`` makes them open), the sphere's
    surface counts as inside, ``candidates`` is a frame of allowed ids.
    """

    window: Window | None = None
    sphere: Sphere | None = None
    candidates: DataFrame | None = None
    graph_weight: float = 1.0
    spatial_weight: float = 0.0
    temporal_weight: float = 0.0
    open_window: bool = False

    def holds(self, begin: str = "begin_ts", end: str = "end_ts") -> Column:
        if self.window is None:
            return F.lit(True)
        b, e = F.col(begin), F.col(end)
        if self.open_window:
            return (b < self.window.end) & (e > self.window.start)
        return (b <= self.window.end) & (e >= self.window.start)

    def inside(self, x: str = "x", y: str = "y", z: str = "z") -> Column:
        if self.sphere is None:
            return F.lit(True)
        s = self.sphere
        dx, dy, dz = F.col(x) - s.x, F.col(y) - s.y, F.col(z) - s.z
        near = dx * dx + dy * dy + dz * dz <= s.radius * s.radius
        box = F.col(x).between(s.x - s.radius, s.x + s.radius) & F.col(y).between(s.y - s.radius, s.y + s.radius)
        return box & F.col(z).between(s.z - s.radius, s.z + s.radius) & near  # the box prunes row groups

    def at(self, t: int, half: int) -> Context:
        return replace(self, window=Window(max(0, t - half), t + half))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def within(self, context: Context) -> Graph:
        """Nodes and edges that the context allows; edges keep only allowed ends."""
        nodes = self.nodes.where(context.holds() & context.inside())
        if context.candidates is not None:
            nodes = nodes.join(context.candidates.select(F.col("id")), "id", "left_semi")
        ids = nodes.select("id")
        edges = self.edges.where(context.holds())
        for end in ("src", "dst"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return Graph(nodes, edges.select("src", "ord", "dst", "weight", "begin_ts", "end_ts"))

    def without(self, node: int) -> Graph:
        """The graph after a node's failure: the node and the edges at it are gone."""
        return Graph(self.nodes.where(F.col("id") != node), self.edges.where((F.col("dst") != node) & (F.col("src") != node)))

    def out(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node, ...) once for each edge that leaves their node, with its dst."""
        return rows.join(self.edges.select(F.col("src").alias("node"), "dst"), "node").select(*rows.columns, "dst")

    def successors(self, rows: DataFrame) -> DataFrame:
        """Distinct ``rows`` (node, ...) once for each edge that leaves their node, with its dst, its place nth and their number, degree."""
        links = self.edges.select(F.col("src").alias("node"), "dst", F.col("ord").alias("nth"))
        return rows.join(links, "node").select(*rows.columns, "dst", "nth", F.count("*").over(W.partitionBy(rows.columns)).alias("degree"))

    def between(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, weight) of the ``pairs`` (src, dst) that are edges; of parallel edges the last in order."""
        own = self.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        return own.groupBy("src", "dst").agg(F.max_by("weight", "ord").alias("weight"))

    @staticmethod
    def of(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
        """A literal graph: nodes (id, x, y, z, begin, end[, props]), edges (src, dst, weight, begin, end) in adjacency order."""
        seen: dict[int, int] = {}
        rows = []
        for src, dst, weight, begin, end in edges:
            rows.append((src, seen.get(src, 0), dst, float(weight), begin, end))
            seen[src] = seen.get(src, 0) + 1
        own = [(n[0], float(n[1]), float(n[2]), float(n[3]), n[4], n[5], n[6] if len(n) > 6 else {}) for n in nodes]
        return Graph(spark.createDataFrame(own, NODES), spark.createDataFrame(rows, EDGES))
