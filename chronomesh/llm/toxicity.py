"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance is a logistic function of its hashed words and word openings, and
a document's is their noisy-or, P = 1 - prod(1 - p_s).  Only documents carry labels; the likelihood of
those labels teaches the sentence weights, and the sentences of a high chance are then the offending ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .words import batched, mix

BUCKETS = 20  # log2 of the feature space
NONE = 1 << BUCKETS  # the bucket of what is no feature; its weight is 0
STEMS = (3, 4, 5, 6, 7, 8, 9)  # opening bytes of a longer word that are features
SAMPLE = 8000  # labelled documents to learn from at most, the first by hash of their id
FEATURES = 4096  # features that may get a weight, those of the strongest evidence
LEAST = 5  # sampled documents that must hold a feature
EVIDENCE = 4.0  # deviations by which toxic documents must outnumber the expected among a feature's holders
NOISE = 0.01  # share of labels taken to be wrong, either way
STEPS, RATE, RIDGE = 500, 0.1, 1e-6
TOXIC = 0.7  # score from which a document is predicted toxic
OFFENDING = 0.5  # chance from which a sentence is an offending one
ENDS = ".!?\n"
BREAK = re.compile(f"[{ENDS}]")
IS_END = np.isin(np.arange(256), list(ENDS.encode()))


class Words:
    """Features and sentences of the words of a run of texts: ``feature`` has a row a kind, sentences are numbered over the run."""

    def __init__(self, raw: bytes, value: np.ndarray, start: np.ndarray, stop: np.ndarray, cuts: np.ndarray, first: np.ndarray):
        byte = np.frombuffer(raw, np.uint8)
        self.feature = np.full((1 + len(STEMS), len(value)), NONE, np.int64)
        self.feature[0] = value >> np.uint64(64 - BUCKETS)
        stem = np.zeros(len(value), np.uint64)
        for n in range(1, max(STEMS) + 1):
            stem = stem * np.uint64(0x100000001B3) + byte[np.minimum(start + n - 1, len(raw) - 1)].astype(np.uint64) + np.uint64(1)
            if n in STEMS:
                longer = np.flatnonzero(stop - start > n)
                self.feature[1 + STEMS.index(n), longer] = mix(stem[longer] ^ np.uint64(n << 56)) >> np.uint64(64 - BUCKETS)
        ends = np.flatnonzero(IS_END[byte])
        self.sentence, self.of = np.unique(np.searchsorted(ends, start), return_inverse=True)
        at = np.searchsorted(ends, first[:-1])  # the line ends between texts count
        self.text = np.searchsorted(at, self.sentence, "right") - 1  # of each sentence
        self.number = self.sentence - at[self.text]  # of a sentence: ends before it in its text
        self.cuts = cuts


def runs(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    for at, to, *rest in batched(texts):
        yield at, to, Words(*rest)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents; of several labels of a document the largest counts."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # a top-k: each task keeps SAMPLE rows at most
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return text.join(F.broadcast(sample), "doc_id").withColumn("nth", one).where("nth = 1").select("text", "toxic")


def telling(sample: DataFrame) -> np.ndarray:
    """At most FEATURES buckets that toxic documents hold oftener than chance allows, ascending; counted on the cluster."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for at, to, w in runs(batch.column(0).to_pylist()):
                for k in range(at, to):
                    own = np.unique(w.feature[:, w.cuts[k - at] : w.cuts[k - at + 1]])
                    own = own[own != NONE]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), toxic[k], np.int32))], ["feature", "toxic"])

    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return np.zeros(0, np.int64)
    share = toxic / n
    count = sample.mapInArrow(held, "feature bigint, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = count.where((F.col("n") >= LEAST) & (z >= EVIDENCE)).orderBy(z.desc(), "feature").limit(FEATURES)
    return np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64))


class Bags:
    """Labelled documents as bags of sentences: a sentence has a count and a list of chosen features, repeats included."""

    def __init__(self, toxic: np.ndarray, owner: np.ndarray, count: np.ndarray, size: np.ndarray, column: np.ndarray):
        self.toxic, self.owner, self.count, self.column = toxic, owner, count, column
        self.row = np.repeat(np.arange(len(owner)), size)

    def nll(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of the labels with a ridge, and its gradient; ``p`` is weights, then the bias."""
        w, bias = p[:-1], p[-1]
        eta = bias + np.bincount(self.row, w[self.column], len(self.owner))
        n = len(self.toxic)
        total = np.bincount(self.owner, self.count * np.logaddexp(0, eta), n)  # -log of the chance that no sentence is toxic
        clean = np.exp(-total)
        one = NOISE + (1 - 2 * NOISE) * (1 - clean)
        slope = (1 - 2 * NOISE) * clean
        d_total = np.where(self.toxic > 0, -slope / one, slope / (1 - one)) / n
        d_eta = d_total[self.owner] * self.count * 0.5 * (1 + np.tanh(0.5 * eta))
        loss = -np.where(self.toxic > 0, np.log(one), np.log(1 - one)).mean() + 0.5 * RIDGE * (w @ w)
        return loss, np.append(np.bincount(self.column, d_eta[self.row], len(w)) + RIDGE * w, d_eta.sum())


def bags(sample: DataFrame, chosen: np.ndarray) -> Bags:
    """The sample's documents with their distinct sentences; a sentence without a chosen feature is told by its count alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, columns = [], [], []
            for at, to, w in runs(batch.column(0).to_pylist()):
                place = np.minimum(np.searchsorted(chosen, w.feature), max(0, len(chosen) - 1))
                good = chosen[place] == w.feature if len(chosen) else np.zeros(w.feature.shape, bool)
                for k in range(at, to):
                    part = slice(w.cuts[k - at], w.cuts[k - at + 1])
                    sentences: dict[int, list[int]] = {}
                    kinds, words = np.nonzero(good[:, part])
                    for kind, word in zip(kinds, words, strict=True):
                        sentences.setdefault(int(w.of[part.start + word]), []).append(int(place[kind, part.start + word]))
                    plain = max(1, len(np.unique(w.of[part]))) - len(sentences)
                    seen: dict[tuple, int] = {(): plain} if plain else {}
                    for s in sentences.values():
                        key = tuple(sorted(s))
                        seen[key] = seen.get(key, 0) + 1
                    counts.append(list(seen.values()))
                    sizes.append([len(s) for s in seen])
                    columns.append([c for s in seen for c in s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (counts, sizes, columns))], ["toxic", "counts", "sizes", "columns"]
            )

    got = sample.mapInArrow(work, "toxic int, counts array<bigint>, sizes array<bigint>, columns array<bigint>").toArrow()
    flat = {c: got[c].combine_chunks() for c in ("counts", "sizes", "columns")}
    each = np.array(flat["counts"].value_lengths(), np.int64)
    return Bags(
        np.array(got["toxic"], np.int64), np.repeat(np.arange(len(each)), each),
        *(np.array(flat[c].flatten(), np.int64) for c in ("counts", "sizes", "columns")),
    )


class Model:
    """Chosen feature buckets, their weights and the bias of a sentence."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.bias, self.table = bias, np.zeros(NONE + 1)
        self.table[chosen] = weights

    @classmethod
    def fit(cls, chosen: np.ndarray, own: Bags) -> Model:
        """Full-batch Adam; without a toxic and a clean document there is nothing to learn, and every score is close to 0."""
        p = np.append(np.zeros(len(chosen)), -8.0)
        if len(own.toxic) and 0 < own.toxic.sum() < len(own.toxic):
            m, v = np.zeros_like(p), np.zeros_like(p)
            for step in range(1, STEPS + 1):
                g = own.nll(p)[1]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        else:
            p[-1] = -16.0
        return cls(chosen, p[:-1], float(p[-1]))

    def sentences(self, w: Words) -> np.ndarray:
        """Log-odds of each sentence of a run."""
        return self.bias + np.bincount(w.of, self.table[w.feature].sum(axis=0), len(w.sentence))

    def documents(self, w: Words, eta: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences of each of the ``n`` texts of a run; a text without a word is one sentence without a feature."""
        total = np.bincount(w.text, np.logaddexp(0, eta), n)
        total[np.diff(w.cuts) == 0] = np.logaddexp(0, self.bias)
        return 1 - np.exp(-total)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the ``toxic`` labels of ``labels``; rows without a label or a doc_id teach nothing."""
    sample = sampled(docs, labels)
    chosen = telling(sample)
    return Model.fit(chosen, bags(sample, chosen))


def spans(text: str, numbers: list[int]) -> list[tuple[int, int]]:
    """(first code point, code point after) of sentences given by how many ends lie before them, without white space around."""
    ends = [m.start() for m in BREAK.finditer(text)]
    found = []
    for k in numbers:
        a, b = ends[k - 1] + 1 if k else 0, ends[k] + 1 if k < len(ends) else len(text)
        part = text[a:b]
        found.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending) of every whole text; offending is an array of (start, end, chance) in order.

    Null and empty texts and texts without a word are one sentence without a feature.  Rows that repeat a doc_id are scored each,
    null doc_ids too; an empty table has no rows; other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            for at, to, w in runs(texts):
                eta = model.sentences(w)
                scores[at:to] = model.documents(w, eta, to - at)
                chance = 0.5 * (1 + np.tanh(0.5 * eta))
                bad = np.flatnonzero(chance >= OFFENDING)
                for k in np.unique(w.text[bad]):
                    own = bad[w.text[bad] == k]
                    places = spans(texts[at + k], w.number[own].tolist())
                    found[at + k] = [(a, b, float(c)) for (a, b), c in zip(places, chance[own], strict=True)]
            rows = [[dict(zip(("start", "end", "chance"), s, strict=True)) for s in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(rows, kind)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, score double, offending array<struct<start: bigint, end: bigint, chance: double>>"
    )


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels.where(~held_out())))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("offending"),
    )
