"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector of hashed text features for all
grades, ordered thresholds between them.  Grades are 0 toxic, 1 poor, 2 good;
the expected grade ranks documents and P(grade = top) selects them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .words import batched, mix

BUCKETS = 18  # log2 of the feature space
SAMPLE = 8000  # rated documents to learn from at most, the first by hash of their id
LEAST = 6  # sampled documents that must hold a feature
EVIDENCE = 5.0
SELECT = 0.5  # P(top grade) from which a document is selected
MARKS = re.compile(rb"[!#$%&*|<>=_~^]{1,8}")
STEPS, RATE, RIDGE = 800, 0.05, 1e-5
STEMS = (5, 7)  # opening bytes of a word that are features as well
KINDS = {"caps": 1, "repeat": 2, "marks": 3, "length": 4}


def hashed(kind: int, value: int) -> int:
    return int(mix(np.array([kind << 32 | value], np.uint64))[0]) >> (64 - BUCKETS)


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct hashed features of each whole text: words, their stems, runs of marks, and shares of capitals, repeats and marks in steps."""
    out: list[np.ndarray] = []
    for at, to, raw, value, start, stop, cuts, first in batched(texts):
        bucket = [(value >> np.uint64(64 - BUCKETS)).astype(np.int64)]
        byte = np.frombuffer(raw, np.uint8)
        for n in STEMS:
            stem = np.full(len(value), n, np.uint64)
            for k in range(n):
                stem = (stem << np.uint64(8)) | byte[np.minimum(start + k, len(raw) - 1)]
            longer = stop - start > n
            bucket.append(np.where(longer, mix(stem) >> np.uint64(64 - BUCKETS), bucket[0].astype(np.uint64)).astype(np.int64))
        for k in range(at, to):
            text = texts[k] or ""
            n = int(cuts[k - at + 1] - cuts[k - at])
            kinds = len(np.unique(bucket[0][cuts[k - at] : cuts[k - at + 1]]))
            own = np.unique(np.concatenate([b[cuts[k - at] : cuts[k - at + 1]] for b in bucket]))
            if not n:
                out.append(np.array([hashed(KINDS["length"], 0)]))
                continue
            marks = MARKS.findall(raw[first[k - at] : first[k - at + 1] - 1])
            distinct = {m[:3] for m in marks}
            upper = capitals(text)
            shape = [
                hashed(KINDS["caps"], int(10 * upper)), hashed(KINDS["repeat"], int(10 * kinds / n)),
                hashed(KINDS["marks"], min(10, int(10 * len(marks) / n))), hashed(KINDS["length"], n.bit_length()),
            ]
            shape += [hashed(64 + len(m), int.from_bytes(m, "big")) for m in distinct]
            out.append(np.unique(np.concatenate([own, shape])))
    return out


def capitals(text: str) -> float:
    """Share of ASCII capitals among ASCII letters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    big = int(((raw >= 65) & (raw <= 90)).sum())
    small = int(((raw >= 97) & (raw <= 122)).sum())
    return big / max(1, big + small)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(flat: np.ndarray, own: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Features held by LEAST documents or more whose share above some threshold is EVIDENCE deviations from the usual."""
    held = np.bincount(flat, minlength=1 << BUCKETS)
    most = np.zeros(len(held))
    for j in range(grades - 1):
        share = (grade <= j).mean() if len(grade) else 0
        below = np.bincount(flat[own <= j], minlength=len(held))
        spread = np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
        most = np.maximum(most, np.abs(below - held * share) / spread)
    return np.flatnonzero((held >= LEAST) & (most >= EVIDENCE))


class Ordinal:
    """Weights by feature bucket and thresholds in ascending order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grade: np.ndarray, grades: int) -> Ordinal:
        """Full-batch Adam on the mean log-likelihood with a ridge; thresholds are a first one and positive steps."""
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        often = telling(flat, np.repeat(grade, size), grade, grades)
        place = np.full(1 << BUCKETS, -1)
        place[often] = np.arange(len(often))
        owner = np.repeat(np.arange(len(rows)), size)[place[flat] >= 0]
        column = place[flat][place[flat] >= 0]
        n, cuts = len(rows), grades - 1
        share = np.array([(grade <= j).mean() if n else 0.5 for j in range(cuts)]).clip(0.01, 0.99)
        start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(cuts))
        # parameters: weights, first threshold, logs of the steps to the others
        p = np.concatenate([np.zeros(len(often)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, STEPS + 1 if n else 1):
            w, first, steps = p[: len(often)], p[len(often)], np.exp(p[len(often) + 1 :])
            theta = np.concatenate([[first], first + np.cumsum(steps)])
            eta = np.bincount(owner, w[column], n)
            edge = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - eta[:, None], np.full((n, 1), np.inf)], axis=1)
            below = np.where(np.isinf(edge), (edge > 0).astype(float), sigmoid(np.where(np.isinf(edge), 0, edge)))
            slope = below * (1 - below)
            i = np.arange(n)
            chance = np.maximum(below[i, grade + 1] - below[i, grade], 1e-12)
            high, low = slope[i, grade + 1] / chance, slope[i, grade] / chance
            d_eta = (high - low) / n  # of the negative log-likelihood
            d_theta = np.zeros(cuts)
            np.add.at(d_theta, grade[grade < cuts], -high[grade < cuts] / n)
            np.add.at(d_theta, grade[grade > 0] - 1, low[grade > 0] / n)
            g = np.concatenate([
                np.bincount(column, d_eta[owner], len(often)) + RIDGE * w,
                [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * steps,
            ])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(1 << BUCKETS, np.float32)
        weights[often] = p[: len(often)]
        first, steps = p[len(often)], np.exp(p[len(often) + 1 :])
        return cls(weights, np.concatenate([[first], first + np.cumsum(steps)]))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        eta = np.array([float(self.weights[r].sum(dtype=np.float64)) for r in rows])
        return sigmoid(eta[:, None] - self.thresholds[None, :])


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, grade) of at most SAMPLE rated documents; a grade needs a non-null quality and toxic."""
    own = labels.where("quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality")
    ).select(
        "doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"),
        F.xxhash64("doc_id").alias("h"),
    )
    sample = own.orderBy("h").limit(SAMPLE)  # a top-k: each task keeps SAMPLE rows at most
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return (
        text.join(F.broadcast(sample), "doc_id").withColumn("nth", one).where("nth = 1").select("text", "grade")
    )


def train(docs: DataFrame, labels: DataFrame) -> Ordinal:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.int64())), batch.column(1)], ["x", "grade"])

    got = rated(docs, labels).mapInArrow(work, "x array<bigint>, grade int").toArrow()
    rows = [np.array(x, np.int64) for x in got["x"].to_pylist()]
    return Ordinal.fit(rows, got["grade"].to_numpy().astype(np.int64), 3)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_grade, p_not_toxic, p_good, selected) of every whole text.

    Null and empty texts have a feature of their own.  Rows that repeat a doc_id are
    scored each; without ratings every document has the same score.
    """
    weights, thresholds = model.weights, model.thresholds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(weights, thresholds)
        for batch in batches:
            tail = own.tails(features(batch.column(1).to_pylist())) if len(batch) else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tail.sum(axis=1)), pa.array(tail[:, 0].copy()), pa.array(tail[:, -1].copy()),
                 pa.array(tail[:, -1] >= SELECT)],
                ["doc_id", "expected_grade", "p_not_toxic", "p_good", "selected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, expected_grade double, p_not_toxic double, p_good double, selected boolean"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
