"""Embedding whitening over Spark MLlib's BlockMatrix.

Centred rows are indexed and cut into blocks of rows; the transposed matrix times the matrix is the scatter,
summed block by block over the cluster; its eigenvectors, a matrix of the vectors' length squared, are found on the driver;
and a BlockMatrix multiplication by the whitening matrix projects the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, stored, table

ROWS = 4096  # of a block
MULTIPLE, SHIFT = 64, 1_000_000  # an entry c becomes floor(MULTIPLE * c) + SHIFT
LARGEST = float(1 << 52)  # of the scaled entry; what is beyond counts as this
COMPONENTS = 32
NONE = 1e-13  # eigenvalues up to this share of the largest, times the length, are zero in double precision


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector has no null or non-finite entry and the commonest length, the longest of several."""
    c = F.col("embedding")
    good = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.floor(F.greatest(F.least(MULTIPLE * e.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + SHIFT
    own = vectors.where(good & (F.size(c) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, whole).alias("x"))
    sizes = own.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return own.where(F.size("x") == (sizes[0]["size"] if sizes else 0))


def indexed(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with ``index``, numbers from 0 without a gap, stored.

    Rows are numbered inside the task that writes them; a table of how many each task wrote, one row a task, moves those numbers together.
    """
    mid = F.col("mid")
    own, path = stored(rows.withColumn("mid", F.monotonically_increasing_id()), "entries")
    counts = own.groupBy(F.shiftright(mid, 33).alias("part")).count().orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in counts])])
    offsets = rows.sparkSession.createDataFrame([(r["part"], int(s)) for r, s in zip(counts, starts)], "part bigint, start bigint")
    own = own.withColumn("part", F.shiftright(mid, 33)).join(F.broadcast(offsets), "part")
    return own.withColumn("index", F.col("start") + mid.bitwiseAND((1 << 33) - 1)).drop("part", "start", "mid"), path


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Blocks of ROWS rows of (index, v array<double>)."""
    dense = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(dense, n, d).toBlockMatrix(ROWS, d)


def product(a: BlockMatrix, b: BlockMatrix, middle: int) -> BlockMatrix:
    """``a`` times ``b``, with the inner dimension cut into ``middle`` parts that are multiplied apart and summed."""
    found = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, middle)
    return BlockMatrix(found, a.rowsPerBlock, b.colsPerBlock)


def covariance(blocks: BlockMatrix, n: int) -> np.ndarray:
    """Scatter of centred rows over ``n``: as many partial products as blocks, so no task gets all rows."""
    middle = -(-n // ROWS)
    return product(blocks.transpose(), blocks, middle).toLocalMatrix().toArray() / n


def rows_of(blocks: BlockMatrix) -> DataFrame:
    """(index, v array<double>) of a matrix's rows; they don't pass through Python."""
    matrix = blocks.toIndexedRowMatrix()  # a name for it: without one, the JVM may let go of the matrix before the call
    rows = callMLlibFunc("getIndexedRows", matrix._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("v"))


def local_blocks(spark: SparkSession, m: np.ndarray) -> BlockMatrix:
    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*m.shape, m.ravel(order="F").tolist()))], 1)
    return BlockMatrix(one, *m.shape)


def centred(x: Column, sums: list[int], n: int) -> Column:
    """x - S / n in double precision: the whole part of S / n goes first, exactly."""
    whole, rest = [s // n for s in sums], [s % n / n for s in sums]
    return F.zip_with(F.zip_with(x, F.array(*map(F.lit, whole)), lambda e, w: (e - w).cast("double")), F.array(*map(F.lit, rest)), lambda e, r: e - r)


def deviation(x: Column, sums: list[int], n: int) -> Column:
    """Exact sum of (n * x - S) ** 2; null where it is no long."""
    apart = F.zip_with(x, F.array(*map(F.lit, sums)), lambda e, s: F.try_subtract(F.try_multiply(e, F.lit(n)), s))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda a, e: F.try_add(a, F.try_multiply(e, e)))


class Whitening:
    """Components by falling variance: ``variances`` and unit ``vectors`` (columns) of the covariance, and its trace."""

    def __init__(self, v: np.ndarray, components: int):
        self.trace = float(np.trace(v))
        e, u = np.linalg.eigh((v + v.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        kept = (e > NONE * len(e) * max(e[0], 0)) & (np.arange(len(e)) < components)
        self.variances, self.vectors = e[kept], u[:, kept]

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.variances)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error) of each usable row.

    Rows whose vector is null, empty, of another than the commonest length, or has a null or non-finite entry are dropped.  Entries beyond
    2**52 / 64 count as that.  Null and repeated vec_ids keep a row each.  Components without variance (of
    constant or dependent dimensions) are left out, so alike vectors have none; an empty table has no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, path = indexed(entries(vectors))
    sums = rows.select(F.posexplode("x").alias("k", "e")).groupBy("k").agg(F.sum("e").alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    out = "vec_id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if not sums:
        drop_path(spark, path)
        return spark.createDataFrame([], out)
    n, d, sums = sums[0]["n"], len(sums), [r["s"] for r in sums]
    x, x_path = stored(rows.select("index", centred(F.col("x"), sums, n).alias("v")), "centred")
    blocks = block_matrix(x, n, d)
    found = Whitening(covariance(blocks, n), components)
    k = len(found.variances)
    if k:
        done, y_path = stored(rows_of(product(blocks, local_blocks(spark, found.matrix), 1)), "whitened")
        mean = [r["m"] for r in done.select(F.posexplode("v").alias("k", "e")).groupBy("k").agg(F.avg("e").alias("m")).orderBy("k").collect()]
        flat = done.select("index", F.zip_with("v", F.array(*map(F.lit, mean)), lambda e, m: e - m).alias("v"))
        error = float(np.abs(covariance(block_matrix(flat, n, k), n) - np.eye(k)).max())
    else:
        done, error = rows.select("index", F.array().cast("array<double>").alias("v")), 0.0
    drop_path(spark, x_path)
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.variances]).cast("array<double>")
    return rows.join(done, "index").select(
        "vec_id", F.lit(n).cast("long").alias("n"), deviation(F.col("x"), sums, n).alias("deviation"), F.col("v").alias("whitened"),
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", F.posexplode("whitened").alias("place", "whitened"), "n", "deviation", "explained", "identity_error",
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )
