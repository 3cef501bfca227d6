"""Deterministic inputs: random graphs, orbits, point clouds, grids, attention tokens, matrices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronomesh.operators.spatial import link_edges, proximity_edges
from chronomesh.plans.model import NODES, Graph

MASK = (1 << 64) - 1
# fixed values: the congruential generator's factor and addend
LCG_FACTOR, LCG_ADDEND = 6364136223846793005, 1442695040888963407


def lcg_jump(state: int, steps: int) -> int:
    """The state ``steps`` later: powers of the affine map by squaring, so any part of a stream starts anywhere."""
    a, c, factor, addend = 1, 0, LCG_FACTOR, LCG_ADDEND
    while steps:
        if steps & 1:
            a, c = a * factor & MASK, (c * factor + addend) & MASK
        addend = addend * (factor + 1) & MASK
        factor = factor * factor & MASK
        steps >>= 1
    return (a * state + c) & MASK


def lcg_states(state: int, n: int) -> list[int]:
    """The ``n`` states after ``state``."""
    out = []
    for _ in range(n):
        state = (state * LCG_FACTOR + LCG_ADDEND) & MASK
        out.append(state)
    return out


def random_nodes(spark: SparkSession, n: int, seed: int, side: float, period: int, life: int = 40, parts: int = 8) -> DataFrame:
    """``n`` nodes in a cube, lifetimes of half to one and a half times ``life`` inside [0, period].

    A node takes five states, x, y, z, begin and life; each part jumps to its own.
    """
    def make(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for first, last in zip(pdf["first"], pdf["last"], strict=True):
                states = np.array(lcg_states(lcg_jump(seed, 5 * first), 5 * (last - first)), np.uint64).reshape(-1, 5)
                place = (states[:, :3] >> np.uint64(33)).astype(np.float32) / np.float32(1 << 31) * np.float32(side)
                begin = (states[:, 3] % np.uint64(max(1, period - life))).astype(np.int64)
                end = begin + life // 2 + (states[:, 4] % np.uint64(life)).astype(np.int64)
                yield pd.DataFrame({
                    "id": np.arange(first, last), "x": place[:, 0].astype(float), "y": place[:, 1].astype(float), "z": place[:, 2].astype(float),
                    "begin_ts": begin, "end_ts": np.minimum(end, period), "props": [{} for _ in range(last - first)],
                })

    cuts = [n * k // parts for k in range(parts + 1)]
    ranges = spark.createDataFrame([(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b], "first bigint, last bigint").repartition(parts)
    return ranges.mapInPandas(make, NODES)


def random_graph(spark: SparkSession, n: int = 300, seed: int = 0xDEADBEEFCAFEBABE, side: float = 10.0, radius: float = 2.5, period: int = 100) -> Graph:
    nodes = random_nodes(spark, n, seed, side, period)
    return Graph(nodes, proximity_edges(nodes, radius))


def xorshift_tokens(n: int, width: int, seed: int, channels: tuple[int, ...] = (3, 11), scale: float = 30.0) -> list[list[float]]:
    """``n`` vectors of noise with a few outlier channels; the generator is sequential, so it runs on the driver."""
    state, rows = seed & MASK or 1, []

    def draw() -> float:
        nonlocal state
        state ^= state << 13 & MASK
        state ^= state >> 7
        state ^= state << 17 & MASK
        return state / MASK - 0.5

    for _ in range(n):
        rows.append([draw() * (2 * scale if d in channels else 0.6) for d in range(width)])
    return rows


def sine_cache(spark: SparkSession, tokens: int = 64, width: int = 32) -> DataFrame:
    """(token, key, value): unit keys of min(8, width) sine modes of frequency 1 + 0.3 m, values 0.5 + 0.3 sin of the same a unit later."""
    modes = min(8, width)
    dims = F.sequence(F.lit(0), F.lit(width - 1))

    def mode(shift: float):
        return lambda m: F.when(m < modes, F.sin((1 + 0.3 * m) * F.col("token") * 0.2 + shift)).otherwise(0.0)

    norm = F.greatest(F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    rows = spark.range(tokens).select(F.col("id").cast("int").alias("token")).withColumn("raw", F.transform(dims, mode(0.0)))
    return rows.select(
        "token", F.transform("raw", lambda v: v / norm).alias("key"), F.transform(F.transform(dims, mode(1.0)), lambda v: 0.5 + 0.3 * v).alias("value")
    )


def constellation(spark: SparkSession, planes: int = 3, each: int = 6, radius: float = 3000.0, inclination: float = 60.0, link: float = 4000.0, time: int = 25, half: int = 10, period: int = 100) -> Graph:
    """Satellites on inclined circular orbits, planes and satellites evenly spread, links below ``link``."""
    p, k = F.floor(F.col("id") / each), F.col("id") % each
    node, turn = p * (2 * math.pi / planes), k * (2 * math.pi / each)
    i = math.radians(inclination)
    x = F.lit(radius) * (F.cos(node) * F.cos(turn) - F.sin(node) * F.sin(turn) * math.cos(i))
    y = F.lit(radius) * (F.sin(node) * F.cos(turn) + F.cos(node) * F.sin(turn) * math.cos(i))
    nodes = spark.range(planes * each).select(
        (F.col("id") + 1).alias("id"), x.alias("x"), y.alias("y"), (F.lit(radius) * F.sin(turn) * math.sin(i)).alias("z"),
        F.lit(0).cast("bigint").alias("begin_ts"), F.lit(period).cast("bigint").alias("end_ts"), F.create_map().cast("map<string,string>").alias("props"),
    )
    return Graph(nodes, link_edges(nodes, link, time, half, period))


def julia_points(spark: SparkSession, side: int = 400, steps: int = 80, re: float = -0.745429, im: float = 0.113008, half: float = 1.5) -> DataFrame:
    """(idx, x, y) of the grid points that stay within 2 under z*z + c; the iteration is one expression."""
    at = spark.range(side * side).select(
        F.col("id").alias("idx"), (F.col("id") % side / F.lit(side - 1) * 2 * half - half).alias("x"),
        (F.floor(F.col("id") / side) / F.lit(side - 1) * 2 * half - half).alias("y"),
    )

    def step(z, _):
        a, b = z["a"] * z["a"] - z["b"] * z["b"] + re, 2 * z["a"] * z["b"] + im
        return F.struct(
            F.when(z["alive"], a).otherwise(z["a"]).alias("a"), F.when(z["alive"], b).otherwise(z["b"]).alias("b"),
            (z["alive"] & (a * a + b * b <= 4)).alias("alive"),
        )

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(True).alias("alive")), step)
    return at.withColumn("z", last).where("z.alive").select("idx", "x", "y")


def spiral_points(spark: SparkSession, n: int = 409, turn: float = 12 * math.pi) -> DataFrame:
    """(idx, x, y) of r = 0.5 exp(0.08 theta)."""
    theta = F.col("id") / F.lit(n - 1.0) * turn
    r = 0.5 * F.exp(0.08 * theta)
    return spark.range(n).select(F.col("id").alias("idx"), (r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


#: fixed values: the digits that the arcs spell
ARC_DIGITS = (3, 1, 4, 1, 5, 9, 2, 6, 5, 4)


def digit_arcs(spark: SparkSession) -> DataFrame:
    """(idx, x, y): arcs along a widening spiral, each as long as its digit, with gaps between."""
    at, first, rows = 0.0, 0, []
    for digit in ARC_DIGITS:
        rows.append((digit, at, first))
        at += digit * 0.3 / 5 + 0.05
        first += digit * 20 + 1
    arcs = spark.createDataFrame(rows, "digit int, start double, first bigint")
    point = arcs.select("digit", "start", "first", F.explode(F.sequence(F.lit(0), F.col("digit") * 20)).alias("k"))
    theta = F.col("start") + F.col("k") / (F.col("digit") * 20) * F.col("digit") * 0.06
    r = 0.1 + 0.15 * theta
    return point.select((F.col("first") + F.col("k")).alias("idx"), (r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


def pixel_grid(spark: SparkSession, columns: int, rows: int, on: str) -> DataFrame:
    """(idx, x, y) of the cells where the SQL condition ``on`` over (x, y) holds."""
    cell = spark.range(columns * rows).select(F.col("id").alias("idx"), (F.col("id") % columns).alias("x"), F.floor(F.col("id") / columns).alias("y"))
    return cell.where(on).select("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def causal_grid(spark: SparkSession, nx: int, nt: int) -> Graph:
    """Nodes t * nx + x, each leading to x - 1, x and x + 1 one tick later."""
    cell = spark.range(nx * nt).select("id", (F.col("id") % nx).alias("cx"), F.floor(F.col("id") / nx).alias("t"))
    nodes = cell.select(
        "id", F.col("cx").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("t").cast("double").alias("z"),
        F.col("t").alias("begin_ts"), F.lit(nt).cast("bigint").alias("end_ts"), F.create_map().cast("map<string,string>").alias("props"),
    )
    to = cell.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).where((F.col("t") < nt - 1) & (F.col("cx") + F.col("step")).between(0, nx - 1))
    return Graph(nodes, to.select(
        F.col("id").alias("src"), (F.row_number().over(W.partitionBy("id").orderBy("step")) - 1).alias("ord"), (F.col("id") + nx + F.col("step")).alias("dst"),
        F.lit(1.0).alias("weight"), F.col("t").alias("begin_ts"), (F.col("t") + 1).alias("end_ts"),
    ))


def tensor_grid(spark: SparkSession, nx: int, ny: int, nz: int, depth: int) -> Graph:
    """Sites by layer, then z, y, x: links both ways inside a layer (begin = end), one link to the next layer."""
    area = nx * ny * nz
    site = spark.range(area * depth).select(
        "id", (F.col("id") % nx).alias("ix"), (F.floor(F.col("id") / nx) % ny).alias("iy"), (F.floor(F.col("id") / (nx * ny)) % nz).alias("iz"),
        F.floor(F.col("id") / area).alias("layer"),
    )
    moves = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("dx", "dy", "dz", "dt"), m, strict=True)]) for m in (
        (1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1))])
    to = site.withColumn("m", F.explode(moves)).where(
        (F.col("ix") + F.col("m.dx")).between(0, nx - 1) & (F.col("iy") + F.col("m.dy")).between(0, ny - 1)
        & (F.col("iz") + F.col("m.dz")).between(0, nz - 1) & (F.col("layer") + F.col("m.dt") < depth)
    )
    dst = F.col("id") + F.col("m.dx") + F.col("m.dy") * nx + F.col("m.dz") * nx * ny + F.col("m.dt") * area
    nodes = site.select("id", *[F.col("i" + c).cast("double").alias(c) for c in "xyz"], F.col("layer").alias("begin_ts"), F.col("layer").alias("end_ts"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(nodes, to.select(
        F.col("id").alias("src"), (F.row_number().over(W.partitionBy("id").orderBy(dst)) - 1).alias("ord"), dst.alias("dst"), F.lit(1.0).alias("weight"),
        F.col("layer").alias("begin_ts"), (F.col("layer") + F.col("m.dt")).alias("end_ts"),
    ))


def attention_vectors(spark: SparkSession, n: int, width: int, outlier: int, scale: float = 8.0) -> DataFrame:
    """(id, v): two heads of sine vectors, one dimension scaled up in the even ones."""
    dims = F.sequence(F.lit(0), F.lit(width - 1))
    v = F.transform(dims, lambda d: F.sin(F.col("id") * 0.7 + d * 1.3) * F.when((d == outlier) & (F.col("id") % 2 == 0), scale).otherwise(1.0))
    return spark.range(n).select("id", v.alias("v"))


def outlier_matrix(spark: SparkSession, n: int = 16, column: int = 3, row: int = 7) -> DataFrame:
    """(i, j, v): ((13 i + 7 j + 3) mod 19) / 9.5 - 1, one column 15 higher, one row 12 lower."""
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    v = (13 * i + 7 * j + 3) % 19 / F.lit(9.5) - 1 + F.when(j == column, 15.0).otherwise(0.0) - F.when(i == row, 12.0).otherwise(0.0)
    return spark.range(n * n).select(i.cast("int").alias("i"), j.cast("int").alias("j"), v.alias("v"))
