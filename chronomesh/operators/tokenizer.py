"""Byte-level pair encoding: training on the cluster, encoding, decoding, files.

A text is cut into pieces by PIECE; a piece is its UTF-8 bytes, and merges join neighbours inside pieces.
Ids are specials, then the bytes met in the order of their characters in a vocabulary file, then merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.plans.storage import drop_path, stored

# fixed values: the pieces of byte-level tokenizers, and the special tokens
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIALS = ("<unk>", "<s>", "</s>")

TOP = 4000  # pairs that the driver looks at in a round
KEPT = 16  # rounds of merges that are applied anew before words are stored
IDS = 20  # bits of an id
MOST = (1 << IDS) - 1  # ids that a tokenizer may have
CACHE = 1 << 16  # pieces that a worker remembers


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself where it can be seen, else one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def pieces(text: Column) -> Column:
    """Pieces of a text, which gets a leading space if it has no white space there; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    led = F.when(text.rlike(r"(?U)^\s|^$"), text).otherwise(F.concat(F.lit(" "), text))
    return F.regexp_extract_all(led, F.lit("(?U)" + PIECE), F.lit(0))


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n) over ``docs`` (text, ...)."""
    return docs.select(F.explode(pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def merge_all(symbols: np.ndarray, word: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` of words (``word``: their numbers) after replacing each of ``pairs`` (left << 32 | right, ascending) by its ``made``.

    No pair's left symbol is another's right one; a pair of one symbol twice is replaced from the left.
    """
    if len(symbols) < 2:
        return symbols, word
    key = symbols[:-1] << 32 | symbols[1:]
    place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    hit = (pairs[place] == key) & (word[:-1] == word[1:])
    twice = np.flatnonzero(hit[1:] & hit[:-1]) + 1  # only in runs of one symbol
    for k in twice:
        if hit[k - 1]:
            hit[k] = False
    out = symbols.copy()
    at = np.flatnonzero(hit)
    out[at] = made[place[at]]
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], word[keep]


Round = tuple[np.ndarray, np.ndarray]  # pairs in ascending order, and what each becomes


def applied(batch: pa.RecordBatch, rounds: list[Round]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each) of a batch of (symbols array, n)."""
    column = batch.column(0)
    symbols = np.asarray(column.flatten(), np.int64)
    word = np.repeat(np.arange(len(batch)), np.asarray(column.value_lengths(), np.int64))
    for pairs, made in rounds:
        symbols, word = merge_all(symbols, word, pairs, made)
    return symbols, word


def neighbours(words: DataFrame, rounds: list[Round]) -> DataFrame:
    """(a, b, n, most) of the pairs of neighbours in ``words`` (symbols, n) after ``rounds``: how often they stand together,
    and how often at most with one and the same symbol before or after."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, word = applied(batch, rounds)
            n = np.asarray(batch.column(1), np.int64)
            at = np.flatnonzero(word[:-1] == word[1:])
            if not len(at):
                continue
            a, b = symbols[at], symbols[at + 1]
            before = np.where((at > 0) & (word[at - 1] == word[at]), symbols[at - 1], -1)
            last = np.minimum(at + 2, len(symbols) - 1)
            after = np.where((at + 2 < len(symbols)) & (word[last] == word[at]), symbols[last], -1)
            key = a << IDS | b
            for side, x in ((0, before), (1, after)):
                keys, of = np.unique(key << IDS | x + 1, return_inverse=True)  # three ids in one number
                total = np.bincount(of, n[word[at]], len(keys)).astype(np.int64)
                parts = (keys >> 2 * IDS, keys >> IDS & MOST, np.full(len(keys), side), (keys & MOST) - 1, total)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], ["a", "b", "side", "x", "n"])

    each = words.mapInArrow(work, "a bigint, b bigint, side bigint, x bigint, n bigint").groupBy("a", "b", "side", "x").agg(F.sum("n").alias("n"))
    return each.groupBy("a", "b").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n"), F.coalesce(F.max(F.when(F.col("x") >= 0, F.col("n"))), F.lit(0)).alias("most")
    )


def safe_merges(top: Iterable[tuple[int, int, int, int]], least: int, most: int) -> list[tuple[int, int]]:
    """The first merges that one-by-one training makes, of ``top`` pairs (a, b, n, most) by falling n, then a and b.

    A pair is next as long as no merge before it in the round can touch it (its left symbol is none of their right ones and its
    right symbol none of their left ones) and no pair that they bring about can be as frequent: a merge
    of (a, b) makes pairs with one symbol before or after, which stand no oftener than (a, b) with that symbol did.
    """
    made: list[tuple[int, int]] = []
    bound, left, right = 0, set(), set()
    for a, b, n, near in top:
        if n < least or len(made) == most or made and (n <= bound or a in right or b in left):
            break
        made.append((a, b))
        bound = max(bound, near)
        left.add(a)
        right.add(b)
    return made


@dataclass
class Tokenizer:
    """Byte-level tokenizer: ``alphabet`` are bytes, ``merges`` pairs of ids."""

    specials: tuple[str, ...]
    alphabet: list[int]
    merges: list[tuple[int, int]]
    jobs: int = 0  # that training took
    tokens: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = [s.encode() for s in self.specials] + [bytes([b]) for b in self.alphabet]
        for a, b in self.merges:
            self.tokens.append(self.tokens[a] + self.tokens[b])

    @property
    def first_merge(self) -> int:
        return len(self.specials) + len(self.alphabet)

    def json(self) -> str:
        """The vocabulary file, as libraries for such tokenizers read it."""
        shown = byte_characters()
        name = lambda t: "".join(shown[b] for b in t)
        n = len(self.specials)
        names = [*self.specials, *(name(t) for t in self.tokens[n:])]
        level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
        return json.dumps({
            "version": "1.0", "truncation": None, "padding": None,
            "added_tokens": [{"id": k, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, s in enumerate(self.specials)],
            "normalizer": None, "pre_tokenizer": level, "post_processor": level, "decoder": level,
            "model": {
                "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
                "byte_fallback": False, "ignore_merges": False, "vocab": {t: k for k, t in enumerate(names)}, "merges": [[names[a], names[b]] for a, b in self.merges],
            },
        }, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        found = json.loads(text)
        ids, of = found["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        specials = tuple(t["content"] for t in sorted(found["added_tokens"], key=lambda t: t["id"]))
        single = sorted((k, of[t]) for t, k in ids.items() if len(t) == 1 and t not in specials)
        return cls(specials, [b for _, b in single], [(ids[a], ids[b]) for a, b in found["model"]["merges"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the vocabulary file as a folder of one part; its size is that of the vocabulary."""
        spark.createDataFrame([(self.json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        """From what ``save`` wrote or a vocabulary file."""
        return cls.from_json(spark.read.text(path, wholetext=True).first().value)

    def encode(self, docs: DataFrame, name: str = "ids") -> DataFrame:
        """``docs`` with a column ``name`` of ids of the text; bytes that training has not met are left out."""
        rank = {p: self.first_merge + k for k, p in enumerate(self.merges)}
        single = {b: len(self.specials) + k for k, b in enumerate(self.alphabet)}

        def one(piece: str) -> list[int]:
            own = [single[b] for b in piece.encode() if b in single]
            while len(own) > 1:
                best = min((rank.get(p, 1 << 60) for p in zip(own, own[1:])), default=1 << 60)
                if best == 1 << 60:
                    break
                pair, out, k = self.merges[best - self.first_merge], [], 0
                while k < len(own):
                    hit = k + 1 < len(own) and (own[k], own[k + 1]) == pair
                    out.append(best if hit else own[k])
                    k += 1 + hit
                own = out
            return own

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory: dict[str, list[int]] = {}
            for batch in batches:
                found = []
                for own in batch.column(batch.num_columns - 1).to_pylist():
                    ids: list[int] = []
                    for p in own:
                        if p not in memory:
                            if len(memory) >= CACHE:
                                memory.clear()
                            memory[p] = one(p)
                        ids += memory[p]
                    found.append(ids)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names[:-1], name])

        kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
        return docs.select("*", pieces(F.col("text")).alias("_pieces")).mapInArrow(work, f"{kinds}, `{name}` array<int>")

    def decode(self, docs: DataFrame, ids: str = "ids", name: str = "decoded") -> DataFrame:
        """``docs`` with the text of a column of ids, without specials and without a space at its start, as encoding puts one there."""
        tokens, n = self.tokens, len(self.specials)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [None if x is None else b"".join(tokens[k] for k in x if n <= k < len(tokens)).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t and t.removeprefix(" ") for t in got], pa.string())], [*batch.schema.names, name])

        kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
        return docs.mapInArrow(work, f"{kinds}, `{name}` string")


def train(docs: DataFrame, size: int = 20_000, least: int = 5, specials: tuple[str, ...] = SPECIALS) -> Tokenizer:
    """A tokenizer of at most ``size`` ids: the most frequent pair first, of equal ones that of the smallest ids, down to ``least`` times.

    Words and counts stay on the cluster.  A round is one job: it applies the merges chosen so far to
    the words and returns the TOP pairs, of which the driver takes as many as training one by one would.
    """
    if size > MOST:
        raise ValueError(f"a tokenizer has at most {MOST} ids")
    counts, path = stored(piece_counts(docs), "pieces")
    paths = [path]
    bytes_met = counts.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda k: F.conv(F.hex(F.substring(F.encode("piece", "UTF-8"), k, 1)), 16, 10).cast("int")))).alias("b")).distinct()
    shown = byte_characters()
    alphabet = sorted((r.b for r in bytes_met.collect()), key=lambda b: shown[b])  # 256 rows at most
    place = np.zeros(256, np.int64)
    place[alphabet] = len(specials) + np.arange(len(alphabet))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(p.encode(), np.uint8) for p in batch.column(0).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            flat = place[np.concatenate(raw)] if raw else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)), batch.column(1)], ["symbols", "n"])

    words, path = stored(counts.where(F.octet_length("piece") > 1).mapInArrow(start, "symbols array<bigint>, n bigint"), "words")
    paths.append(path)
    merges: list[tuple[int, int]] = []
    rounds: list[Round] = []
    jobs, first = 0, len(specials) + len(alphabet)
    while (room := size - first - len(merges)) > 0:
        top = neighbours(words, rounds).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(TOP).collect()
        jobs += 1
        made = safe_merges([(r.a, r.b, r.n, r.most) for r in top], least, room)
        if not made:
            break
        order = sorted(range(len(made)), key=lambda k: made[k])
        rounds.append((np.array([made[k][0] << 32 | made[k][1] for k in order], np.int64), np.array([first + len(merges) + k for k in order], np.int64)))
        merges += made
        if len(rounds) == KEPT:
            pending = list(rounds)

            def rewrite(batches: Iterator[pa.RecordBatch], pending: list[Round] = pending) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    symbols, word = applied(batch, pending)
                    cuts = np.searchsorted(word, np.arange(len(batch) + 1))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(symbols)), batch.column(1)], ["symbols", "n"])

            words, path = stored(words.mapInArrow(rewrite, "symbols array<bigint>, n bigint").where(F.size("symbols") > 1), "words")
            paths.append(path)
            rounds, jobs = [], jobs + 1
    for path in paths:
        drop_path(docs.sparkSession, path)
    return Tokenizer(tuple(specials), alphabet, merges, jobs)
