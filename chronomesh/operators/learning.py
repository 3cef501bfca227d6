"""Small dense models trained full-batch on the cluster: tasks sum gradients over all rows, the driver keeps only parameters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.plans.storage import drop_path, stored


def normalised(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean over their population deviation (at least 1e-6), and the numbers used."""
    r = rows.agg(*[F.avg(c).alias("m_" + c) for c in columns], *[F.stddev_pop(c).alias("s_" + c) for c in columns]).first()
    used = {c: (r["m_" + c] or 0.0, max(r["s_" + c] or 0.0, 1e-6)) for c in columns}
    return rows.withColumns({c: (F.col(c) - used[c][0]) / used[c][1] for c in columns}), used


class Adam:
    """Steps against a gradient, each scaled by the running means of the gradient and of its square."""

    def __init__(self, size: int, rate: float = 0.01):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Network:
    """One hidden layer of tanh; cross-entropy over classes or squared error."""

    def __init__(self, inputs: int, hidden: int, outputs: int, seed: int = 1, classes: bool = True):
        rng = np.random.default_rng(seed)
        self.parts = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, outputs)), np.zeros(outputs)]
        self.classes = classes

    @property
    def flat(self) -> np.ndarray:
        """All parameters in one vector: weights then biases of the hidden layer, then those of the output."""
        return np.concatenate([p.ravel() for p in self.parts])

    @flat.setter
    def flat(self, values: np.ndarray) -> None:
        if len(values) != sum(p.size for p in self.parts):
            raise ValueError(f"{len(values)} parameters for a network of {sum(p.size for p in self.parts)}")
        cuts = np.cumsum([p.size for p in self.parts])[:-1]
        self.parts = [v.reshape(p.shape).copy() for p, v in zip(self.parts, np.split(np.asarray(values, float), cuts), strict=True)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.parts[0] + self.parts[1])
        out = h @ self.parts[2] + self.parts[3]
        if self.classes:
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
        return h, out

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """(gradient of all parameters, loss, gradient of each input), summed over the rows and not averaged."""
        h, out = self.forward(x)
        if self.classes:
            at = np.arange(len(y)), y.astype(int)
            loss, d = -np.log(np.maximum(out[at], 1e-12)), out.copy()
            d[at] -= 1
        else:
            loss, d = ((out - y) ** 2).sum(axis=1), 2 * (out - y)
        if weight is not None:
            loss, d = loss * weight, d * weight[:, None]
        back = d @ self.parts[2].T * (1 - h * h)
        own = [x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)]
        return np.concatenate([p.ravel() for p in own]), float(loss.sum()), back @ self.parts[0].T

    def columns(self, inputs: list[Column]) -> list[Column]:
        """Outputs as expressions, so predictions stay in the plan."""
        a, b, c, d = self.parts
        hidden = [F.tanh(sum((x * float(w) for x, w in zip(inputs, a[:, k], strict=True)), F.lit(float(b[k])))) for k in range(a.shape[1])]
        out = [sum((h * float(w) for h, w in zip(hidden, c[:, k], strict=True)), F.lit(float(d[k]))) for k in range(c.shape[1])]
        if not self.classes:
            return out
        top = F.greatest(*out)
        e = [F.exp(o - top) for o in out]
        return [x / sum(e[1:], e[0]) for x in e]


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float)


def summed(parts: DataFrame) -> np.ndarray:
    """Sum, element by element, of the vectors (g) that tasks left: one row a parameter comes to the driver."""
    each = parts.select(F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).collect()
    total = np.zeros(len(each))
    for r in each:
        total[r.k] = r.g
    return total


def train(rows: DataFrame, features: list[str], target: str, net: Network, epochs: int = 200, rate: float = 0.01) -> list[float]:
    """Trains ``net`` on all ``rows`` and returns the mean loss before each epoch and after the last.

    An epoch is one pass: a task adds up its rows' gradients batch by batch and leaves one vector, the vectors are
    added by position.  Rows with a null or non-finite feature or a null target are passed over; without any
    other row the network stays as it is and there are no losses.
    """
    sound = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in features]
    own = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("int").alias("target"))
    own = own.where(F.col("target").isNotNull())
    for c in sound:
        own = own.where(c)
    own, path = stored(own, "train")
    adam, losses = Adam(len(net.flat), rate), []
    for _ in range(epochs + 1):
        total = summed(own.mapInArrow(task_sums(net, features), "g array<double>"))
        if not len(total) or not total[-1]:
            break
        losses.append(total[-2] / total[-1])
        if len(losses) <= epochs:
            net.flat = net.flat - adam.step(total[:-2] / total[-1])
    drop_path(rows.sparkSession, path)
    return losses


def task_sums(net: Network, features: list[str]):
    """Task that leaves one vector: gradient of its rows, their loss, their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(net.flat) + 2)
        for b in batches:
            g, loss, _ = net.sums(matrix(b, features), b.column("target").to_numpy(zero_copy_only=False))
            total += np.concatenate([g, [loss, b.num_rows]])
        yield pa.RecordBatch.from_pydict({"g": pa.array([total], pa.list_(pa.float64()))})

    return task


def save_network(spark: SparkSession, net: Network, path: str, used: dict[str, tuple[float, float]] | None = None) -> None:
    """One JSON object: widths, weights row by row, biases, and the mean and deviation that each input was normalised with."""
    a, b, c, d = net.parts
    own = {
        "input_dim": a.shape[0], "hidden_dim": a.shape[1], "output_dim": c.shape[1], "classes": net.classes,
        "w1": a.tolist(), "b1": b.tolist(), "w2": c.tolist(), "b2": d.tolist(),
        "inputs": list(used or {}), "mean": [m for m, _ in (used or {}).values()], "std": [s for _, s in (used or {}).values()],
    }
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_network(spark: SparkSession, path: str) -> tuple[Network, dict[str, tuple[float, float]]]:
    """What ``save_network`` wrote; raises where the weights do not have the widths stated."""
    own = json.loads(spark.read.text(path).first().value)
    net = Network(own["input_dim"], own["hidden_dim"], own["output_dim"], classes=own["classes"])
    net.flat = np.concatenate([np.ravel(own[k]) for k in ("w1", "b1", "w2", "b2")])
    return net, {c: (m, s) for c, m, s in zip(own["inputs"], own["mean"], own["std"], strict=True)}


def classify(rows: DataFrame, net: Network, used: dict[str, tuple[float, float]]) -> DataFrame:
    """``rows`` with (predicted, p_one) by a network of two classes; null where an input is null."""
    p = net.columns([(F.col(c) - m) / s for c, (m, s) in used.items()])
    return rows.withColumns({"predicted": (p[1] > p[0]).cast("int"), "p_one": p[1]})


def position_classifier(rows: DataFrame, hidden: int = 16, seed: int = 1, epochs: int = 200) -> tuple[DataFrame, list[float], Network, dict[str, tuple[float, float]]]:
    """((id, target, predicted, p_one), losses, network, normalisation) of (id, x, y, z, target 0/1), trained on all rows."""
    own, used = normalised(rows, ["x", "y", "z"])
    net = Network(3, hidden, 2, seed)
    losses = train(own, ["x", "y", "z"], "target", net, epochs)
    return classify(rows, net, used).select("id", "target", "predicted", "p_one"), losses, net, used


def summary(predicted: DataFrame) -> DataFrame:
    """(rows, accuracy) of (target, predicted); rows without either are passed over."""
    own = predicted.where("target is not null and predicted is not null")
    return own.agg(F.count("*").alias("rows"), F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("accuracy"))


class CoordinateBranch:
    """Places of tokens, learned: a code for each token and a network from codes to places, trained together.

    The squared error of a token's rows is its number of rows times the error at their mean, and a constant.  So
    training needs one row a token (its code with the state of its optimiser, number and mean of its places):
    a task moves the codes of its own tokens, and only the network's gradient is added up.  Nothing as long as the
    vocabulary comes to the driver.
    """

    def __init__(self, width: int = 8, hidden: int = 32, seed: int = 42):
        self.width, self.seed = width, seed
        self.net = Network(width, hidden, 3, seed, classes=False)
        self.codes: DataFrame | None = None
        self.error = 0.0  # sum of squares that no code can explain: places of one token apart from their mean
        self.rows = 0

    def fit(self, rows: DataFrame, epochs: int = 200, rate: float = 0.02) -> list[float]:
        """Trains on all (token_id, x, y, z); mean squared error before each epoch and after the last.  Rows with a null are passed over."""
        known = rows.select("token_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna()
        own = known.groupBy("token_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *[F.var_pop(c).alias("v" + c) for c in "xyz"])
        draw = lambda k: F.xxhash64("token_id", F.lit(self.seed), F.lit(k)) / F.lit(float(1 << 63))
        zeros = F.array_repeat(F.lit(0.0), self.width)
        own = own.select("*", F.array(*[draw(k) for k in range(self.width)]).alias("code"), zeros.alias("m"), zeros.alias("s"))
        table, path = stored(own, "codes")
        self.rows, self.error = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("n * (vx + vy + vz)")), F.lit(0.0))).first()
        adam, losses = Adam(len(self.net.flat), rate), []
        for t in range(1, epochs + 2):
            if not self.rows:
                break
            moved, new = stored(table.mapInArrow(self.task(t, rate, t <= epochs), CODES), "codes")
            total = summed(moved.where("g is not null").select("g"))
            losses.append((total[-1] + self.error) / self.rows)
            if t <= epochs:
                self.net.flat = self.net.flat - adam.step(total[:-1] / self.rows)
            drop_path(rows.sparkSession, path)
            table, path = moved.where("g is null").select(own.columns), new
        self.codes = table
        return losses

    def task(self, t: int, rate: float, move: bool):
        net, all_rows = self.net, self.rows

        def lists(x: np.ndarray) -> pa.Array:
            return pa.array(list(x), pa.list_(pa.float64()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, shape = np.zeros(len(net.flat) + 1), None
            for b in batches:
                if not b.num_rows:
                    continue
                code, m, s = (np.stack(b.column(c).to_numpy(zero_copy_only=False)) for c in ("code", "m", "s"))
                g, loss, d = net.sums(code, matrix(b, ["x", "y", "z"]), b.column("n").to_numpy().astype(float))
                total += np.append(g, loss)
                if move:
                    d = d / all_rows
                    m, s = 0.9 * m + 0.1 * d, 0.999 * s + 0.001 * d * d
                    code = code - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
                plain = [b.column(c) for c in ("token_id", "n", "x", "y", "z", "vx", "vy", "vz")]
                out = pa.RecordBatch.from_arrays([*plain, lists(code), lists(m), lists(s), pa.nulls(b.num_rows, pa.list_(pa.float64()))], CODE_NAMES)
                shape = out.schema
                yield out
            if shape is not None:
                empty = [pa.nulls(1, f.type) for f in shape][:-1]
                yield pa.RecordBatch.from_arrays([*empty, lists([total])], CODE_NAMES)

        return work

    def predict(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with (px, py, pz) of their token_id; null for tokens that training did not see."""
        places = self.net.columns([F.get("code", F.lit(k)) for k in range(self.width)])
        known = self.codes.select("token_id", *[p.alias("p" + c) for c, p in zip("xyz", places, strict=True)])
        return tokens.join(known, "token_id", "left")


CODE_NAMES = ["token_id", "n", "x", "y", "z", "vx", "vy", "vz", "code", "m", "s", "g"]
CODES = "token_id bigint, n bigint, x double, y double, z double, vx double, vy double, vz double, code array<double>, m array<double>, s array<double>, g array<double>"


def coordinate_branch(rows: DataFrame, width: int = 8, hidden: int = 32, seed: int = 42, epochs: int = 200) -> tuple[DataFrame, list[float]]:
    """((id, token_id, x, y, z, px, py, pz, l2_error), losses) of (id, token_id, x, y, z)."""
    branch = CoordinateBranch(width, hidden, seed)
    losses = branch.fit(rows.withColumn("token_id", F.col("token_id").cast("bigint")), epochs)
    miss = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)
    out = branch.predict(rows.select("id", F.col("token_id").cast("bigint").alias("token_id"), "x", "y", "z"))
    return out.withColumn("l2_error", miss).select("id", "token_id", "x", "y", "z", "px", "py", "pz", "l2_error"), losses


def error_summary(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg("l2_error").alias("mean_l2"), F.max("l2_error").alias("max_l2"))


def episode_summary(rows: DataFrame) -> DataFrame:
    """(kind, mean, deviation) of (kind, value), population deviation."""
    return rows.groupBy("kind").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def improvement(new: Column, old: Column) -> Column:
    """Per cent; 0 if the old value is 0."""
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) / old * 100)


FEW = 10_000  # values that are sorted together
NEAR = 1 / 2000  # distance in rank of the values that a search is narrowed to


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(median): element n div 2 of the n sorted values that are not null; null if there are none.

    Exact by narrowing: two approximate quantiles around the rank, which each task makes a bounded digest for, are counted
    against, and the search goes on strictly between them until FEW values are left.  Each round leaves about a
    thousandth; many equal values end it at once.
    """
    live = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    spark, v = rows.sparkSession, F.col("v")
    n = live.count()
    rank = n // 2
    kind = live.schema["v"].dataType.simpleString()
    while n > FEW:
        at = (rank + 0.5) / n
        low, high = live.agg(F.percentile_approx("v", [max(0.0, at - NEAR), min(1.0, at + NEAR)], 10_000)).first()[0]
        below, to_low, to_high, all_high = live.agg(*[F.count_if(c) for c in (v < low, v <= low, v < high, v <= high)]).first()
        for first, last, found in ((below, to_low, low), (to_high, all_high, high)):
            if first <= rank < last:
                return spark.createDataFrame([(found,)], f"median {kind}")
        if rank < below:
            live, n = live.where(v < low), below
        elif rank >= all_high:
            live, n, rank = live.where(v > high), n - all_high, rank - all_high
        else:
            live, n, rank = live.where((v > low) & (v < high)), to_high - to_low, rank - to_low
    return live.agg(F.get(F.sort_array(F.collect_list("v")), F.lit(rank)).alias("median"))
