"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER long.  The code length of a byte
is that of its count in the longest context that has been seen, and of the escapes from the
longer contexts that have not seen the byte (method C, no exclusion); the
shortest code for the whole text names its language.  Statistics are frozen
after training, so the code length of every five bytes in a row that training met is a table entry, and
any other is an escape and the entry of its last four, three or two bytes.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, fresh, row_key, scratch, stored, table

ORDER = 4  # longest context, bytes
SAMPLE = 400  # training documents a language at most, the first by hash of their id
UNKNOWN = "und"
MAYBE_LETTER = re.compile(r"[^\W\d_]")  # number signs as well
CHUNK = 1 << 19
MAX_BITS = 6.5  # a text that its best language needs more bits a byte for is in none of them


def encoded(text: str) -> bytes:
    """Lower-cased, composed (normal form C) UTF-8."""
    return (text if text.isascii() else normalize("NFC", text)).lower().encode()


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in ``text``."""
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def grams(raw: bytes) -> np.ndarray:
    """Every byte of ``raw`` with the ORDER bytes before it, as one number; line ends stand before the start."""
    b = np.frombuffer(b"\n" * ORDER + raw, np.uint8)
    key = np.zeros(len(raw), np.uint64)
    for k in range(ORDER + 1):
        key = (key << np.uint64(8)) | b[k : k + len(raw)]
    return key


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of at most SAMPLE labelled documents a language that are not held out."""
    own = docs.where("lang is not null and text is not null").where(~held_out("doc_id")).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h")
    )
    many = own.groupBy("lang").agg(F.count("*").alias("n"))
    # about twice the sample by hash, so that what is ranked is bounded
    share = F.lit(1 << 20) * F.least(F.lit(1.0), F.lit(2.0 * SAMPLE + 50) / F.col("n"))
    near = own.join(F.broadcast(many), "lang").where(F.pmod("h", F.lit(1 << 20)) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "text")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over the training rows, counted where they lie."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(encoded(text))
            for lang, raws in by.items():
                key, n = np.unique(np.concatenate([grams(r) for r in raws]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    return rows.mapInArrow(work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Open-addressed map from gram to row number."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys = keys
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & (len(self.slots) - 1), left[lost]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.home(keys)
        row = self.slots[at]
        off = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.slots) - 1)
            row[off] = self.slots[at[off]]
            off = off[(row[off] >= 0) & (self.keys[row[off]] != keys[off])]
        return row


class Model:
    """Code lengths of every language, side by side."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language its grams of ORDER + 1 bytes and how often each was met."""
        self.langs = langs
        n = len(langs)
        self.levels: list[tuple[Table, np.ndarray, Table, np.ndarray]] = []
        lower = None  # cost of grams one byte shorter
        for k in range(ORDER + 1):  # context length
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            own = []
            for key, c in counts:
                short, back = np.unique(key & mask, return_inverse=True)
                own.append((short, np.bincount(back, c, len(short)) if len(short) else np.zeros(0)))
            keys = np.unique(np.concatenate([s for s, _ in own] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.zeros((len(keys), n), np.float32), np.zeros((len(contexts), n), np.float32)
            for j, (short, c) in enumerate(own):
                at = np.searchsorted(contexts, short >> np.uint64(8))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escape[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
                below = lower(keys)[:, j] if lower else np.full(len(keys), 8.0)
                cost[:, j] = escape[np.searchsorted(contexts, keys >> np.uint64(8)), j] + below
                cost[np.searchsorted(keys, short), j] = np.log2((total[at] + kinds[at]) / c)
            self.levels.append((Table(keys), cost, Table(contexts), escape))
            lower = lambda g, k=k: self.cost(g, k)
        self.top = len(self.levels) - 1

    def cost(self, key: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each gram in every language, from context length ``k`` down."""
        key = key & np.uint64((1 << (8 * (k + 1))) - 1)
        grams, cost, contexts, escape = self.levels[k]
        row = grams.find(key)
        out = cost[row] if len(cost) else np.zeros((len(key), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            rest = self.cost(key[miss], k - 1) if k else np.full((len(miss), len(self.langs)), 8.0, np.float32)
            at = contexts.find(key[miss] >> np.uint64(8))
            if len(escape):
                rest = rest + np.where((at >= 0)[:, None], escape[at], 0)
            out[miss] = rest
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in every language."""
        total = np.zeros((len(texts), len(self.langs)))
        k = 0
        while k < len(texts):
            if len(texts[k]) > CHUNK:
                raw, pad = texts[k], b"\n" * ORDER
                for at in range(0, len(raw), CHUNK):
                    key = grams((pad if at < ORDER else raw[at - ORDER : at]) + raw[at : at + CHUNK])[ORDER:]
                    total[k] += self.cost(key, self.top).sum(axis=0, dtype=np.float64)
                k += 1
                continue
            first, keys, size = k, [], 0
            while k < len(texts) and size + len(texts[k]) <= CHUNK:
                keys.append(grams(texts[k]))
                size += len(texts[k])
                k += 1
            cost = self.cost(np.concatenate(keys), self.top) if size else np.zeros((0, len(self.langs)), np.float32)
            ends = np.cumsum([len(x) for x in keys])
            for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                total[first + i] = cost[a:b].sum(axis=0, dtype=np.float64)
        return total

    def save(self, uri: str) -> None:
        import pickle

        store, path = file_system(uri)
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(path, compression=None) as out:
            out.write(pickle.dumps(self, protocol=5))

    @staticmethod
    def load(uri: str) -> Model:
        """Read once a Python worker."""
        import pickle

        if uri not in _MODELS:
            store, path = file_system(uri)
            with store.open_input_stream(path, compression=None) as stream:
                _MODELS.clear()
                _MODELS[uri] = pickle.load(io.BytesIO(stream.read()))
        return _MODELS[uri]


_MODELS: dict[str, Model] = {}


def train(docs: DataFrame) -> Model:
    """A model of the languages of the labelled documents; its counts are bounded by the sample."""
    counts = count_grams(training_rows(docs)).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    which = counts["lang"].to_numpy(zero_copy_only=False)
    gram, n = counts["gram"].to_numpy().astype(np.uint64), counts["n"].to_numpy()
    return Model(langs, [(gram[which == x], n[which == x]) for x in langs])


def predict(docs: DataFrame, model_uri: str) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every whole text.

    A null text, and one without a letter, is UNKNOWN with score 0 and no bits, as is every text if training
    saw no language.  Score weighs the code lengths of at most 64 bytes at the
    text's mean rate, so it does not saturate at once.  Ties go to the
    language that sorts first.  Rows that repeat a doc_id are predicted each on its own.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(model_uri)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            good = [bool(model.langs) and has_letter(t) for t in texts]
            raws = [encoded(t) if g else b"" for t, g in zip(texts, good, strict=True)]
            lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if model.langs:
                bits = model.bits(raws)
                best = bits.argmin(axis=1)
                size = np.array([max(1, len(r)) for r in raws])
                gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(size, 64) / size)[:, None]
                share = 1 / np.exp2(-gap).sum(axis=1)
                for k in np.flatnonzero(good):
                    lang[k], score[k], rate[k] = model.langs[best[k]], share[k], float(bits[k, best[k]] / size[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score), pa.array(rate, pa.float64())],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, lang_pred string, score double, bits_per_byte double"
    )


def trained(docs: DataFrame) -> str:
    """Where the model of ``docs`` is stored."""
    uri = scratch(docs.sparkSession, "language") + "/model"
    train(docs).save(uri)
    return uri


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents in one of the languages, columns as they are: a letter, and MAX_BITS a byte or fewer.

    Each row is judged by itself, whatever its doc_id.  If no document tells a language, none can be judged and
    all stay.
    """
    uri = trained(docs)
    if not Model.load(uri).langs:
        return docs
    found = predict(docs.select(row_key().alias("doc_id"), "text"), uri)
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= MAX_BITS))
    row = fresh(docs, "row")
    kept, _ = stored(found.select(F.col("doc_id").alias(row)).distinct(), "known")
    return docs.withColumn(row, row_key()).join(kept, row, "left_semi").select(docs.columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, trained(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
