"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints of three segments on a ring that differ in at most two bits have a
segment from which the differences of one, two and three segments stay within
0, 1 and 2 (the whole parts of 2/3, 4/3 and 2): the pigeonring principle.  So
candidates agree in that segment and in a half of the next one; a candidate
must then pass the chain test before the full Hamming test.

Links are sought between distinct fingerprints.  Buckets of at most ``BUCKET``
fingerprints are joined with the tests as join conditions.  Larger buckets are divided by further bits: of
three parts of those that are left, two such fingerprints agree in one at least.  That is done twice,
and then 15 bits are left at most, so no bucket has more than 2**15 fingerprints.

That is op1.  The pipeline's stage asks for a likeness of ``LIKENESS`` of five-word shingles.  Such pairs differ
in ten bits of 64 and up to ``RADIUS``, where no run of segments is rare enough to look candidates up by.
So candidates come from MinHash bands there; the chain test and the Hamming test prune them, and the
exact Jaccard likeness of the shingle sets decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_path, fresh, linked, row_key, stored, table
from .words import mix

SEED, SHINGLE = 42, 3
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
BUCKET = 64
WORDS, LIKENESS = 5, 0.8  # of the stage
BANDS, ROWS = 20, 4  # a pair of likeness 0.8 is missed in all bands 3 times in 100,000
RADIUS = 24  # bits: 9.7 on average at LIKENESS, with a deviation of 2.9; one such pair in a million differs in more
EIGHTHS = tuple((8 * k, 8) for k in range(8))
PIECE = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """Words of ``text`` in runs of about PIECE bytes, each run opening with the last ``keep`` words before it."""
    at, held = 0, []
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        words = held + text[at:end].split()
        yield words
        held, at = words[-keep:] if keep else [], end


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, repeats counted, as a signed integer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    raw = (text or "").encode().lower()
    n, ones, short = 0, np.zeros(64, np.int64), []
    for words in word_runs(raw, SHINGLE - 1):
        if len(words) < SHINGLE:
            short = words
            continue
        hashes = np.fromiter(
            (digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2
        )
        for k in range(0, len(hashes), 1 << 15):
            part = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8)
            ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        if not short:
            return 0
        n, ones = 1, np.unpackbits(np.array([digest(b" ".join(short), SEED)], ">u8").view(np.uint8)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; null counts as empty, and an empty text has fingerprint 0."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, fp bigint"
    )


def bits(fp: Column, first: int, size: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1))


def ring_masks() -> list[list[int]]:
    """Bits of each key: for each segment, its own with either half of the next one's; and twice the same with a third of those left."""
    levels = [[]]
    for i, (first, size) in enumerate(SEGMENTS):
        after, n = SEGMENTS[(i + 1) % 3]
        for start, width in ((after, n // 2), (after + n // 2, n - n // 2)):
            levels[0].append((1 << size) - 1 << first | (1 << width) - 1 << start)
    for _ in range(2):
        levels.append([])
        for mask in levels[-2]:
            left = [b for b in range(64) if not mask >> b & 1]
            levels[-1] += [mask | sum(1 << b for b in left[k * len(left) // 3 : (k + 1) * len(left) // 3]) for k in range(3)]
    return [[m - (1 << 64) if m >> 63 else m for m in level] for level in levels]


MASKS = ring_masks()


def chained(x: Column, segments: tuple = SEGMENTS, most: int = 2) -> Column:
    """Whether the differing bits ``x`` are ``most`` at the most and have a segment whose chain stays within its budgets.

    From that segment on, around the ring, the first l segments hold at most l of len(segments) parts of ``most``.
    """
    m = len(segments)
    d = [F.bit_count(bits(x, first, size)) for first, size in segments]
    found = F.lit(False)
    for i in range(m):
        chain = reduce(and_, [sum(d[(i + k) % m] for k in range(n)) <= n * most // m for n in range(1, m)])
        found = found | chain
    return (F.bit_count(x) <= most) & found


def links(fps: DataFrame) -> DataFrame:
    """(a, b) joining the distinct fingerprints ``fps`` (fp) so that components are those of all links of 2 bits or fewer."""
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS[0]])).alias("tag", "part"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    found = None
    for level in range(len(MASKS)):
        keys, _ = stored(keys, "ring")
        size = keys.groupBy("tag", "part").agg(F.count("*").alias("n")).where("n > 1")
        last = level + 1 == len(MASKS)
        few = keys.join(size if last else size.where(F.col("n") <= BUCKET), ["tag", "part"], "left_semi")
        pairs = (
            few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["tag", "part"])
            .where((F.col("a") < F.col("b")) & chained(x)).select("a", "b")
        )
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        masks = F.array(*[F.lit(m) for m in MASKS[level + 1]])
        many = keys.join(size.where(F.col("n") > BUCKET), ["tag", "part"], "left_semi")
        many = many.select("fp", F.explode(F.sequence(3 * F.col("tag"), 3 * F.col("tag") + 2)).alias("tag"))
        keys = many.select("fp", "tag", F.col("fp").bitwiseAND(F.get(masks, F.col("tag"))).alias("part"))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reached over links, itself included.

    Every text without a word has fingerprint 0 and is linked like any other.  Rows that repeat a doc_id
    keep their own fingerprint each; null doc_ids are never a component's name, so a
    component of nothing else has none.  Extra columns are not read.
    """
    own, _ = stored(fingerprints(docs), "fingerprints")
    one, _ = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(one.select("fp")))
    named = one.join(label.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    name = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.join(named.join(name, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def word_shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the WORDS-word shingles, ascending; fewer words are one shingle, and no word is none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, short = [], []
    for words in word_runs((text or "").encode().lower(), WORDS - 1):
        if len(words) < WORDS:
            short = words
            continue
        runs = zip(*(words[k:] for k in range(WORDS)))
        found.append(np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - WORDS + 1))
    if not found:
        return np.array([digest(b" ".join(short), SEED)] if short else [], np.uint64)
    return np.unique(np.concatenate(found))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash minima of a shingle set that is not empty."""
    odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None] | np.uint64(1)
    xor = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))[:, None]
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1 << 13):
        np.minimum(low, ((own[k : k + (1 << 13)] ^ xor) * odd).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key ^ mix(column))
    return key.astype(np.int64)


def set_fingerprint(own: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[k : k + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, id, fp, bands) of every document: id stands for its set of shingles, fp is the set's SimHash."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, prints, bands = [], [], []
            for t in batch.column(2):
                own = word_shingles(t.as_py())
                prints.append(set_fingerprint(own))
                ids.append(int.from_bytes(xxhash.xxh64_digest(own.tobytes(), SEED), "big", signed=True))
                bands.append(band_keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (ids, prints)), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "doc_id", "id", "fp", "bands"],
            )

    own = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(work, "row bigint, doc_id bigint, id bigint, fp bigint, bands array<bigint>")


def similar_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``texts`` (id, text) whose shingle sets have a Jaccard likeness of LIKENESS or more, stored."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            held, keep = 0, []
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if held > 1 << 22:  # hashes kept of the texts met so far
                    sets, held = {}, 0
                for at, column in ((a, 2), (b, 3)):
                    if at not in sets:
                        sets[at] = word_shingles(batch.column(column)[k].as_py())
                        held += len(sets[at])
                n, m = len(sets[a]), len(sets[b])
                if min(n, m) < LIKENESS * max(n, m):
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common >= LIKENESS * (n + m - common):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )
    return stored(both.mapInArrow(work, "a bigint, b bigint"), "similar")[0]


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, all columns as they are.

    Near copies have a Jaccard likeness of LIKENESS or more of their WORDS-word shingles, and a group is what
    such links reach.  Texts without a word are one group.  Null doc_ids come after all others; rows that
    repeat a doc_id are judged one by one, and of rows alike in doc_id and text any one stays.
    """
    own, own_path = stored(shingle_sets(docs), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    one = own.groupBy("id").agg(first, F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp"))
    one, one_path = stored(one, "distinct")
    paths = [own_path, one_path]

    def texts(candidates: DataFrame) -> DataFrame:
        wanted = one.join(candidates, "id", "left_semi").select(F.col("first.row").alias("row"), "id", "fp")
        found = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text")).join(wanted, "row")
        found, path = stored(found.groupBy("id", "fp").agg(F.any_value("text").alias("text")), "texts")
        paths.append(path)
        return found

    def sets(known: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [word_shingles(t.as_py()).astype(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

        return known.select("id", "text").mapInArrow(work, "id bigint, set array<bigint>")

    def near(a: str, b: str) -> Column:
        return chained(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")), EIGHTHS, RADIUS)

    label = linked(one.select("id", F.col("bands").alias("keys"), "fp"), near, texts, similar_texts, sets)
    named = one.join(label.withColumnRenamed("node", "id"), "id", "left").select("first", F.coalesce("component", "id").alias("component"))
    row = fresh(docs, "row")
    names = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    names, _ = stored(names, "kept")
    kept = docs.withColumn(row, row_key()).join(names, row, "left_semi")
    twice, _ = stored(own.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias(row)), "twice")
    for path in paths:
        drop_path(docs.sparkSession, path)
    if twice.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(twice, row, "left_semi").groupBy(row).agg(F.any_value(F.struct(*docs.columns)).alias("one")).select("one.*")
    return kept.join(twice, row, "left_anti").select(docs.columns).union(one)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
