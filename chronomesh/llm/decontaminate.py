"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of q shingles belongs to the size class c with 2**c <= q < 2**(c + 1).  For
each class in use a document is seen as windows of three blocks of 2**c
shingles, one window a block: an item of the class that lies in the document lies in one window, whose size
is at most three times its own.  So containment of 0.8 is a Jaccard likeness of
a quarter at least, and one of ``HASHES`` minima agrees but once in a thousand times; at
full containment, once in ten thousand.  Candidate pairs, and no others, are then verified by exact
containment of the item's shingles, as text, in the whole document.

Documents send on only minima that a bit map of the items' minima lets
through, and shingles that one of the items' shingles lets through, so
what is shuffled follows the overlap and not the corpus.  The map has sixteen bits or more for each
value of the items, up to MOST_BITS; beyond that it lets more rows through, and nothing is decided by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, row_key, stored, table
from .words import batched, mix, shingles

WORDS, THRESHOLD, HASHES = 5, 0.8, 24
LEAST_BITS, MOST_BITS = 16, 27  # log2 of the size of the bit map
_ODD = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
_XOR = mix(np.arange(101, HASHES + 101, dtype=np.uint64))
_ROW = "id bigint, kind int, value bigint, shingle string, n bigint"


def size_class(n: int) -> int:
    return max(n, 1).bit_length() - 1


def slot(kind: int, value: np.ndarray, bits: int) -> np.ndarray:
    """Position in a map of 2**bits of a value of this kind; kind -1 is a shingle, else class * HASHES + hash."""
    return (mix(value ^ np.uint64((kind + 2) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def text_shingles(raw: bytes, value, start, stop, a: int, b: int) -> tuple[np.ndarray, int]:
    """(hashes, words in each) of the shingles of words a to b; fewer than WORDS words are one shingle."""
    n = min(WORDS, b - a)
    return (shingles(value[a:b], n), n) if n else (value[:0], 0)


def spelled(raw: bytes, start, stop, first: int, n: int) -> str:
    return b" ".join(raw[start[k] : stop[k]] for k in range(first, first + n)).decode("utf-8", "replace")


def item_rows(items: DataFrame) -> DataFrame:
    """Per item its minima (kind >= 0, value) and its distinct shingles (kind -1, value, shingle); n is their number.

    An item of fewer than WORDS words is one row of kind -2, its words, and n is how many.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, to, raw, value, start, stop, cuts, _ in batched(batch.column(1).to_pylist()):
                for k in range(at, to):
                    a, b = int(cuts[k - at]), int(cuts[k - at + 1])
                    own, size = text_shingles(raw, value, start, stop, a, b)
                    distinct, first = np.unique(own, return_index=True)
                    n = len(distinct)
                    if not n:
                        continue
                    if size < WORDS:
                        out.append((ids[k], -2, int(own[0].astype(np.int64)), spelled(raw, start, stop, a, size), size))
                        continue
                    out += [
                        (ids[k], -1, int(v.astype(np.int64)), spelled(raw, start, stop, a + int(f), size), n)
                        for v, f in zip(distinct, first, strict=True)
                    ]
                    for j in range(HASHES):
                        low = ((distinct ^ _XOR[j]) * _ODD[j]).min()
                        out.append((ids[k], size_class(n) * HASHES + j, int(low.astype(np.int64)), None, n))
            yield rows_of(out)

    return items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _ROW)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "kind", "value", "shingle", "n"]
    )


def document_rows(docs: DataFrame, classes: list[int], short: list[int], filter_bytes: bytes) -> DataFrame:
    """Minima of windows and, of documents with any, shingles, as far as the items' bit map lets them through.

    Of each number of words in ``short``, all runs that it lets through are rows of kind -2.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(filter_bytes, np.uint8)).astype(bool)
        bits = len(passes).bit_length() - 1
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, to, raw, value, start, stop, cuts, _ in batched(batch.column(1).to_pylist()):
                out: list[tuple] = []
                sizes = np.diff(cuts)
                # shingles of all texts in one array; those over the edge of a text are left out
                full = shingles(value, WORDS)
                counts = np.maximum(sizes - WORDS + 1, 0)
                pick = np.arange(int(counts.sum())) + np.repeat(cuts[:-1] - (np.cumsum(counts) - counts), counts)
                own = full[pick] if len(full) else value[:0]
                owner = np.repeat(np.arange(to - at), counts)
                length = np.full(len(own), WORDS)
                for k in np.flatnonzero((sizes > 0) & (sizes < WORDS)):  # short texts: one shingle
                    a = int(cuts[k])
                    own = np.append(own, shingles(value[a : a + sizes[k]], int(sizes[k])))
                    pick, owner, length = np.append(pick, a), np.append(owner, k), np.append(length, sizes[k])
                for size in short:
                    runs = shingles(value, size)
                    met: set[tuple[int, int]] = set()
                    for k in np.flatnonzero(passes[slot(-2, runs, bits)]):
                        t = int(np.searchsorted(cuts, k, "right")) - 1
                        if k + size <= cuts[t + 1] and (t, int(runs[k])) not in met:
                            met.add((t, int(runs[k])))
                            out.append((ids[at + t], -2, int(runs[k].astype(np.int64)), spelled(raw, start, stop, int(k), size), size))
                hit: set[int] = set()
                for kind, low, text in window_minima(own, owner, classes):
                    good = passes[slot(kind, low, bits)]
                    if good.any():
                        low, text = low[good], text[good]
                        low, first = np.unique(low ^ (text.astype(np.uint64) << np.uint64(40)), return_index=True)
                        for v, t in zip(low ^ (text[first].astype(np.uint64) << np.uint64(40)), text[first], strict=True):
                            hit.add(int(t))
                            out.append((ids[at + int(t)], kind, int(v.astype(np.int64)), None, 0))
                if hit:
                    good = np.flatnonzero(np.isin(owner, list(hit)) & passes[slot(-1, own, bits)])
                    seen = set()
                    for k in good:
                        key = (int(owner[k]), int(own[k]))
                        if key not in seen:
                            seen.add(key)
                            out.append((ids[at + key[0]], -1, int(own[k].astype(np.int64)), spelled(raw, start, stop, int(pick[k]), int(length[k])), 0))
                if out:
                    yield rows_of(out)

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _ROW)


def window_minima(own: np.ndarray, owner: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, minimum of each window, its text) for each class and hash; ``owner`` is ascending but for a tail of short texts."""
    if not len(own) or not classes:
        return
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(new, len(own)))
    starts, spans = {}, {}
    for c in classes:
        blocks = -(-count // (1 << c))
        base = np.repeat(new, blocks)
        within = np.arange(len(base)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts[c] = base + (within << c)
        spans[c] = np.repeat(np.arange(len(new)), blocks)
    for j in range(HASHES):
        h = (own ^ _XOR[j]) * _ODD[j]
        low, last = h, None
        for c in classes:
            at = starts[c] if last is None else np.searchsorted(starts[last], starts[c])
            low, last = np.minimum.reduceat(low, at), c
            window, span = low.copy(), spans[c]
            for step in (1, 2):
                same = span[step:] == span[:-step]
                np.minimum(window[:-step], low[step:], out=window[:-step], where=same)
            yield c * HASHES + j, window, owner[starts[c]]


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item contained to THRESHOLD or more in a document.

    Items and documents without a word match nothing; null texts are empty.  Items
    with a null or repeated item_id are taken as one item a set of rows; rows that repeat a
    doc_id are judged together, and rows without one each by itself.  An item of fewer than WORDS words is
    one shingle of its own length.  Extra columns are not read.
    """
    spark = docs.sparkSession
    own, _ = stored(item_rows(items), "items")
    kinds = [r.kind for r in own.select("kind").distinct().collect()]  # HASHES a size class
    classes = sorted({k // HASHES for k in kinds if k >= 0})
    short = [r.n for r in own.where("kind = -2").select("n").distinct().collect()] if -2 in kinds else []
    if not kinds:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double")
    nameless = docs.where("doc_id is null").select(row_key().alias("doc_id")).distinct()
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), row_key()).alias("doc_id"), "text")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * own.count()).bit_length()))
    bit_map = np.zeros(1 << bits, bool)
    for batch in own.select("kind", "value").mapInArrow(lambda batches: _slots(bits, batches), "slot bigint").distinct().toArrow().to_batches():
        bit_map[batch.column(0).to_numpy()] = True
    rows, _ = stored(document_rows(docs, classes, short, np.packbits(bit_map).tobytes()), "overlap")
    sets = own.where("kind = -1").groupBy("id").agg(F.countDistinct("shingle").alias("n_item"))
    pairs = (
        rows.where("kind >= 0").select(F.col("id").alias("doc_id"), "kind", "value").distinct()
        .join(own.where("kind >= 0").select(F.col("id").alias("item_id"), "kind", "value").distinct(), ["kind", "value"])
        .select("doc_id", "item_id").distinct()
    )
    same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    held = rows.where("kind = -1").select(F.col("id").alias("doc_id"), "shingle").distinct().join(pairs, "doc_id")
    wanted = own.where("kind = -1").select(F.col("id").alias("item_id"), "shingle").distinct()
    shared = (
        held.alias("s").join(wanted.alias("w"), same("s", "w", ["item_id", "shingle"])).select("s.*")
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    )
    found = shared.alias("s").join(sets.withColumnRenamed("id", "item_id").alias("i"), same("s", "i", ["item_id"])).select("s.*", "i.n_item")
    if short:
        whole = (
            rows.where("kind = -2").select(F.col("id").alias("doc_id"), "shingle").distinct()
            .join(own.where("kind = -2").select(F.col("id").alias("item_id"), "shingle").distinct(), "shingle")
            .select("doc_id", "item_id").distinct()
        )
        found = found.union(whole.select("doc_id", "item_id", F.lit(1).cast("long"), F.lit(1).cast("long")))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= THRESHOLD)
    found = found.join(nameless.withColumn("none", F.lit(True)), "doc_id", "left")
    return found.select(F.when(F.col("none").isNull(), F.col("doc_id")).alias("doc_id"), "item_id", "n_shared", "n_item", "containment")


def _slots(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
        found = [slot(int(k), value[kind == k], bits) for k in np.unique(kind)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found or [np.zeros(0, np.int64)])))], ["slot"])


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that contain no item, each row judged by itself; columns as they are."""
    found = find_items(docs.select(row_key().alias("doc_id"), "text"), items)
    row = fresh(docs, "row")
    found, _ = stored(found.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return docs.withColumn(row, row_key()).join(found, row, "left_anti").select(docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
