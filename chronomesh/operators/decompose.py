"""Decompositions of tall matrices: QR by a tree of blocks, and what follows from it.

Rows lie in blocks.  Each block has a QR of its own; the R factors of FAN nodes are stacked and decomposed again, up to one root.
The left factor is never gathered: from the root down each node hands its children the small matrix that they multiply
their own Q by, and the rows' blocks are decomposed once more to make their part of the table.  So the condition number is
not squared, and the driver holds matrices of the columns' number at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.plans.storage import drop_path, stored

BLOCK = 4096  # row numbers of a block
FAN = 16  # R factors that are stacked
LONGEST = 2048  # columns that a matrix may have: a factor of so many squared is 32 MB
NODE = "node bigint, n int, data array<double>"


def dense_rows(matrix: DataFrame) -> tuple[DataFrame, int]:
    """(i, row array<double>) of (i, j, v), and the columns' number; places that are not there are 0."""
    n = (matrix.agg(F.max("j")).first()[0] or 0) + 1
    if n > LONGEST:
        raise ValueError(f"{n} columns; a factor may have {LONGEST}")
    cells = matrix.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), F.col("v").cast("double")))).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return cells.select(F.col("i").cast("long").alias("i"), row.alias("row")), n


def factor(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(rows)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


class Tree:
    """R factors of (i, row) from the blocks up to ``root``; ``pieces`` of each level tell what a node's part of its parent's Q is."""

    def __init__(self, rows: DataFrame, n: int):
        self.n, self.spark, self.paths = n, rows.sparkSession, []
        low = rows.agg(F.min("i")).first()[0] or 0  # blocks count from 0, so that all have one ancestor
        self.rows = self._kept(rows.select("i", "row", F.floor((F.col("i") - low) / BLOCK).alias("block")), "rows")
        self.pieces: list[DataFrame] = []
        level = self._kept(self.rows.groupBy("block").applyInPandas(block_factor, NODE), "factors")
        first, last = level.agg(F.min("node"), F.max("node")).first()
        while first != last:
            first, last = first // FAN, last // FAN
            stacked = level.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("parent").applyInPandas(stack_factors, NODE + ", kind string")
            stacked = self._kept(stacked, "stacked")
            self.pieces.append(stacked.where("kind = 'piece'").drop("kind"))
            level = stacked.where("kind = 'factor'").drop("kind")
        top = level.first()
        self.root = np.zeros((0, n)) if top is None else np.array(top.data).reshape(-1, n)
        self.top = None if top is None else top.node

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def left(self, m: np.ndarray) -> DataFrame:
        """(i, u array<double>), stored: Q times ``m``, whose rows are as many as the root has."""
        width = m.shape[1]
        at = self.spark.createDataFrame([(self.top, len(m), m.ravel().tolist())] if self.top is not None else [], NODE)
        for pieces in reversed(self.pieces):
            own = pieces.withColumn("parent", F.floor(F.col("node") / FAN)).join(
                at.select(F.col("node").alias("parent"), F.col("n").alias("k"), F.col("data").alias("m")), "parent"
            ).select("node", "n", "data", "k", "m")
            at = self._kept(own.mapInPandas(handed_down(width), NODE), "handed")
        at = at.select(F.col("node").alias("block"), "n", F.col("data").alias("m"))
        found, _ = stored(self.rows.groupBy("block").cogroup(at.groupBy("block")).applyInPandas(rows_of_left(width), "i bigint, u array<double>"), "left")
        return found

    def close(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


def block_factor(pdf):
    import pandas as pd

    pdf = pdf.sort_values("i")
    r = factor(np.array(pdf["row"].tolist()))[1]
    return pd.DataFrame({"node": pdf["block"].iloc[:1], "n": [len(r)], "data": [r.ravel()]})


def stack_factors(pdf):
    """The factor of a node's stacked children, and each child's rows of its Q."""
    import pandas as pd

    pdf = pdf.sort_values("node")
    q, r = factor(np.concatenate([np.asarray(d).reshape(n, -1) for n, d in zip(pdf["n"], pdf["data"], strict=True)]))
    ends = np.cumsum(pdf["n"].to_numpy())
    parts = [q[e - n : e] for n, e in zip(pdf["n"], ends, strict=True)]
    rows = [(int(k), len(p), p.ravel(), "piece") for k, p in zip(pdf["node"], parts, strict=True)]
    return pd.DataFrame([(int(pdf["parent"].iloc[0]), len(r), r.ravel(), "factor"), *rows], columns=["node", "n", "data", "kind"])


def handed_down(width: int) -> Callable:
    def work(batches):
        import pandas as pd

        for pdf in batches:
            got = [np.asarray(p).reshape(n, k) @ np.asarray(m).reshape(k, width) for n, p, k, m in zip(pdf["n"], pdf["data"], pdf["k"], pdf["m"], strict=True)]
            yield pd.DataFrame({"node": pdf["node"], "n": [len(g) for g in got], "data": [g.ravel() for g in got]})

    return work


def rows_of_left(width: int) -> Callable:
    def work(own, at):
        import pandas as pd

        own = own.sort_values("i")
        u = factor(np.array(own["row"].tolist()))[0] @ np.asarray(at["m"].iloc[0]).reshape(-1, width)
        return pd.DataFrame({"i": own["i"], "u": list(u)})

    return work


def orthonormal(rows: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """((i, u array<double>) with orthonormal columns, R) of (i, row array<double>) of ``n`` columns."""
    tree = Tree(rows, n)
    found = tree.left(np.eye(len(tree.root)))
    tree.close()
    return found, tree.root


def svd(rows: DataFrame, n: int, rank: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(U (i, u array<double>), s, Vt) of (i, row array<double>) of ``n`` columns, cut to ``rank``; an empty table has no singular values."""
    tree = Tree(rows, n)
    u, s, vt = np.linalg.svd(tree.root, full_matrices=False)
    keep = len(s) if rank is None else min(rank, len(s))
    found = tree.left(u[:, :keep])
    tree.close()
    return found, s[:keep], vt[:keep]
