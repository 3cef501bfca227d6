"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms of a band of inverse document frequency.  A document's
fingerprint hashes its sorted distinct lexicon terms once for each of several
random subsets of the lexicon; subsets keep from a half down to a thousandth of it, so that documents
long and short, alike or only partly alike, agree in some of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEAST_SHARE, MOST_SHARE = 1 / 200, 1 / 10  # of documents that hold a term of the lexicon
RATES = (1, 3, 5, 7, 9)  # a subset keeps one term in 2 to the power of this
COPIES = 4  # subsets of each rate
LITERAL_TERMS = 200_000  # a lexicon of more terms is joined to the exploded terms
BOUNDS = 1024  # ranges of doc_id in which texts meet their next


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_distinct(F.filter(words, lambda w: w != "")), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term): hashes of the terms in the band, by document frequency over all documents.

    A term of the band is in a share of LEAST_SHARE of the documents or more, so there are at most
    1 / LEAST_SHARE times the mean number of distinct terms a document.
    """
    n = docs.count()
    # at least two documents: a term of one document likens nothing
    least, most = max(2.0, LEAST_SHARE * n), max(2.0, MOST_SHARE * n)
    return (
        docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("term")
    )



SUBSETS = [(copy * 64 + rate, rate) for rate in RATES for copy in range(COPIES)]


def digests(sorted_terms: Column) -> Column:
    """One 32-bit hash a subset of the sorted terms in it, 0 for none."""
    def digest(seed: int, rate: int) -> Column:
        own = F.filter(sorted_terms, lambda t: F.xxhash64(t, F.lit(seed)).bitwiseAND(F.lit((1 << rate) - 1)) == 0)
        return F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))).otherwise(F.lit(0))

    return F.array(*[digest(*s) for s in SUBSETS])


def spelled(values: Column) -> Column:
    return F.concat_ws("", F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either has terms in; 1 if neither has any."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda z: z))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (x == y)), lambda z: z))
    return F.when(either > 0, same / either).otherwise(F.lit(1.0))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, next_text): each document with the one of the next smaller doc_id, the last with the first.

    Documents meet in ranges of doc_id, so no order over all of them is made in one
    task; the last of a range takes the first of the next range that has rows.
    Rows of equal doc_id are ordered by text, null ids come last.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(BOUNDS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first().q or []
    marks = sorted(set(marks))
    # rank among the marks in two steps of their square root
    step = max(1, int(len(marks) ** 0.5))
    rows = [marks[k : k + step] for k in range(0, len(marks), step)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows]).cast("array<bigint>")
    lists = F.array(*[F.array(*[F.lit(v).cast("long") for v in r]) for r in rows]).cast("array<array<bigint>>")
    row = F.size(F.filter(heads, lambda m: m <= F.col("doc_id")))
    inside = F.size(F.filter(F.get(lists, row - 1), lambda m: m <= F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull() | (row == 0), 0).otherwise((row - 1) * step + inside)
    own = own.withColumn("bucket", bucket if marks else F.lit(0))

    # first of each range: a row a range, put beside the last of the range before
    ends = own.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket")).collect()
    follow = [(a.bucket, b.bucket) for a, b in zip(ends, ends[1:] + ends[:1], strict=True)]
    first = spark.createDataFrame([(r.bucket, r.doc_id) for r in ends], "bucket int, doc_id bigint")
    texts = (
        own.join(F.broadcast(first), (own.bucket == first.bucket) & own.doc_id.eqNullSafe(first.doc_id), "left_semi")
        .groupBy("bucket").agg(F.min("text").alias("after"))
    )
    link = spark.createDataFrame(follow, "into int, bucket int").join(texts, "bucket").select(
        F.col("into").alias("bucket"), "after"
    )
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    inner = own.withColumn("next_text", F.lead("text").over(order))
    return inner.join(link, "bucket", "left").select(
        "bucket", "doc_id", "text", F.coalesce("next_text", "after").alias("next_text")
    )


def chosen(known: Column, every: Column) -> Column:
    """Sorted lexicon terms of a text; all its terms if it has none of them, so that short texts differ."""
    return F.array_sort(F.when(F.size(known) > 0, known).otherwise(every))


def by_literal(rows: DataFrame, words: list[int], keys: list[str], texts: list[str]) -> DataFrame:
    """The lexicon as one constant: short lists of terms by the leading bits of their hash."""
    bits = max(1, len(words).bit_length())
    lists: list[list[int]] = [[] for _ in range(1 << bits)]
    for w in words:
        lists[(w & (1 << 64) - 1) >> (64 - bits)].append(w)
    table = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
    found = rows.select(*keys, *[terms(F.col(c)).alias(c) for c in texts])

    def known(every: Column) -> Column:
        return F.filter(every, lambda t: F.array_contains(F.get(table, F.shiftrightunsigned(t, 64 - bits).cast("int")), t))

    found = found.select(*keys, *[chosen(known(F.col(c)), F.col(c)).alias(c) for c in texts])
    return found.select(*keys, *[digests(F.col(c)).alias(c) for c in texts])


def by_join(rows: DataFrame, words: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """The same for a lexicon of any size: terms are exploded, joined and gathered again by row."""
    def marked(which: int) -> Column:
        return F.transform(terms(F.col(texts[which])), lambda t: F.struct(F.lit(which).alias("which"), t.alias("term")))

    each = rows.select(
        *keys, F.explode_outer(F.concat(*[marked(k) for k in range(len(texts))])).alias("x")
    ).select(*keys, "x.which", "x.term")
    joined = each.join(words.withColumn("known", F.lit(True)), "term", "left")

    def gathered(which: int, also: Column) -> Column:
        return F.collect_list(F.when((F.col("which") == which) & also, F.col("term")))

    found = joined.groupBy(*keys).agg(*[
        gathered(k, also).alias(f"{name}{k}")
        for k in range(len(texts)) for name, also in (("known", F.col("known").isNotNull()), ("every", F.lit(True)))
    ])
    found = found.select(*keys, *[chosen(F.col(f"known{k}"), F.col(f"every{k}")).alias(c) for k, c in enumerate(texts)])
    return found.select(*keys, *[digests(F.col(c)).alias(c) for c in texts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    Null texts are empty; a text without terms has a fingerprint of zeros and is like any other of that kind.
    """
    own, _ = stored(lexicon(docs), "lexicon")
    n = F.char_length("text")
    rows = with_next(docs).select(
        "bucket", "doc_id", n.cast("long").alias("n_chars"), "text", "next_text",
        F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                 F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))")).alias("edited"),
    ).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn(
        "row", F.monotonically_increasing_id()
    )
    keys = ["bucket", "row", "doc_id", "n_chars", "edited_sha256"]
    texts = ["text", "edited", "next_text"]
    if own.count() <= LITERAL_TERMS:
        found = by_literal(rows, [r.term for r in own.collect()], keys, texts)
    else:
        found = by_join(rows, own, keys, texts)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("text")).alias("fingerprint"),
        spelled(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("next_text")).alias("near_next"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
