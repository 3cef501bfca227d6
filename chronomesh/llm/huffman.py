"""Token ids in binary files: canonical length-limited Huffman codes, block-wise.

File format, little-endian.  A file holds the documents of one range of doc_id,
ascending, as blocks that decode on their own:

    magic b"CMTOKS1\\n"
    block*:  u32 header bytes, then zlib-packed header:
                 u32 documents, u32 tokens, u64 payload bits,
                 per document i64 doc_id, u8 has_id, u8 goes_on, u32 tokens in this block,
                 per CHECKPOINT tokens u32 bit offset
             payload, padded to 8 bytes

Documents may go on in later blocks (``goes_on``), so a block stays bounded however long
a document is.  The code table is one array of code lengths (u8 an id): canonical
codes follow from the lengths alone.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, table

MAGIC = b"CMTOKS1\n"
MAX_LENGTH = 16
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 18
END_ID = 1


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 where the count is 0.

    Ties are taken in the order of ids, so equal counts give equal tables anywhere.
    """
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) == 1:
        lengths[ids] = 1
    if len(ids) < 2:
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids do not fit codes of {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[ids].astype(np.float64)
    n = len(leaf)
    # each level merges the leaves with the packages of the level below; what is
    # kept of a level is which of its items, in order, are leaves
    weight, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        package = weight[0 : len(weight) // 2 * 2 : 2] + weight[1::2]
        both = np.concatenate([leaf, package])
        order = np.argsort(both, kind="stable")
        weight = both[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    found = np.zeros(n, np.int64)
    for flags in reversed(is_leaf):  # the first ``take`` items of each level, top level first
        leaves = int(flags[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[ids] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.uint64)
    # code of the k-th: the sum of the widths before it, on the scale of its own length
    width = np.uint64(1) << (np.uint64(MAX_LENGTH) - own)
    codes[order] = (np.cumsum(width) - width) >> (np.uint64(MAX_LENGTH) - own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next MAX_LENGTH bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    repeat = 1 << (MAX_LENGTH - lengths[order].astype(np.int64))
    ids = np.zeros(1 << MAX_LENGTH, np.uint32)
    bits = np.ones(1 << MAX_LENGTH, np.uint8)
    n = int(repeat.sum())
    ids[:n] = np.repeat(order, repeat)
    bits[:n] = np.repeat(lengths[order], repeat)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(payload of whole 64-bit words with one word to spare, bits, bit offset of each CHECKPOINT-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    # a code lies in at most two 32-bit words; bits do not overlap, so sums are unions
    shift = (64 - (start & 31) - size).astype(np.uint64)
    wide = codes[ids] << shift
    word = start >> 5
    words = np.zeros((total >> 5) + 4, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        at = word[first]
        words[at] += np.add.reduceat(wide >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    words = words[: len(words) // 2 * 2].astype(">u4")
    return words.tobytes(), total, start[::CHECKPOINT].astype(np.uint32)


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block: all its runs between checkpoints step together through the table."""
    byte = np.frombuffer(payload, np.uint8)
    byte = np.concatenate([byte, np.zeros(8, np.uint8)])
    # the 24 bits from each byte on; 16 of them after the bit offset in that byte
    near = (byte[:-2].astype(np.uint32) << 16) | (byte[1:-1].astype(np.uint32) << 8) | byte[2:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    last = n - (len(at) - 1) * CHECKPOINT  # ids of the last run
    for k in range(CHECKPOINT):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        peek = (near[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k, : len(at)] = ids[peek]
        at = at + bits[peek]
    return out.T.reshape(-1)[:n]


class Writer:
    """Writes documents, in the order given, as blocks."""

    def __init__(self, stream, lengths: np.ndarray):
        self.stream, self.lengths, self.codes = stream, lengths, canonical_codes(lengths)
        self.docs: list[tuple[int | None, int, int]] = []
        self.parts: list[np.ndarray] = []
        self.held = self.tokens = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        while True:
            part, ids = ids[: BLOCK_TOKENS - self.held], ids[BLOCK_TOKENS - self.held :]
            self.parts.append(part)
            self.docs.append((doc_id, int(len(ids) > 0), len(part)))
            self.held += len(part)
            if self.held >= BLOCK_TOKENS or len(self.docs) >= 1 << 16:
                self.flush()
            if not len(ids):
                return

    def flush(self) -> None:
        if not self.docs:
            return
        ids = np.concatenate(self.parts)
        payload, bits, points = pack(ids, self.codes, self.lengths)
        head = struct.pack("<IIQ", len(self.docs), len(ids), bits) + b"".join(
            (
                np.array([d if d is not None else 0 for d, _, _ in self.docs], "<i8").tobytes(),
                np.array([d is not None for d, _, _ in self.docs], np.uint8).tobytes(),
                np.array([g for _, g, _ in self.docs], np.uint8).tobytes(),
                np.array([n for _, _, n in self.docs], "<u4").tobytes(),
                points.astype("<u4").tobytes(),
            )
        )
        head = zlib.compress(head, 1)
        self.stream.write(struct.pack("<II", len(head), len(payload)) + head + payload)
        self.docs, self.parts, self.held = [], [], 0


def read_blocks(stream, lengths: np.ndarray) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, goes on in the next block, ids) of each document's part in each block."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    table_ids, table_bits = decode_table(lengths)
    while fixed := stream.read(8):
        n_head, n_payload = struct.unpack("<II", fixed)
        head = zlib.decompress(stream.read(n_head))
        docs, n, _ = struct.unpack_from("<IIQ", head)
        at = 16
        doc_ids = np.frombuffer(head, "<i8", docs, at)
        has = np.frombuffer(head, np.uint8, docs, at + 8 * docs)
        on = np.frombuffer(head, np.uint8, docs, at + 9 * docs)
        sizes = np.frombuffer(head, "<u4", docs, at + 10 * docs)
        points = np.frombuffer(head, "<u4", -1, at + 14 * docs)
        ids = unpack(stream.read(n_payload), points, n, table_ids, table_bits)
        cuts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        for k in range(docs):
            yield int(doc_ids[k]) if has[k] else None, bool(on[k]), ids[cuts[k] : cuts[k + 1]]


class WordEncoder:
    """Ids of whole texts by the tokenizers library, a distinct word at a time.

    The vocabulary's pattern matches no white space and looks neither ahead nor back, so a
    text's ids are those of the pattern's cuts, one after the other.  A text of
    Latin-1 letters in normal form C is lower-cased and cut here, and the
    library's model encodes the cuts not met yet; any other text goes through the whole
    library, each piece between spaces on its own.  What was encoded is
    remembered, and forgotten when there are ``most`` entries.
    """

    LETTERS = "A-Za-zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff"
    NUMBERS = "0-9²³¹¼½¾"

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[{self.NUMBERS}]|[^{self.LETTERS}{self.NUMBERS}\t-\r \x85\xa0]+"
        ).findall
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in shown]
        self.bytes = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}
        if {chr(x) for x in self.bytes.values()} != set(ByteLevel.alphabet()):
            raise ValueError("the library has another byte alphabet")
        self.most = most
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known: dict[str, int] = {}

    def cuts(self, text: str) -> list[str]:
        """What to look up, in order; a piece for the whole library opens with a space, which no cut does."""
        if "<|" not in text:
            if text.isascii():
                return self.cut(text.lower())
            try:
                text.encode("latin-1")
                if is_normalized("NFC", text):
                    return self.cut(text.lower())
            except UnicodeEncodeError:
                pass
        return [" " + piece for piece in text.split(" ") if piece]

    def learn(self, cuts: set[str]) -> None:
        rows = []
        for cut in cuts:
            if cut[0] == " ":
                rows.append(self.library.encode(cut[1:], add_special_tokens=False).ids)
            else:
                shown = cut if cut.isascii() and cut.isprintable() else cut.encode().decode("latin-1").translate(self.bytes)
                rows.append([t.id for t in self.model.tokenize(shown)])
        size = np.array([len(r) for r in rows], np.int64)
        self.known.update(zip(cuts, range(len(self.known), len(self.known) + len(rows)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter((i for r in rows for i in r), self.flat.dtype)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.known) > self.most:
            self.__init__(self.path, self.most)
        split = [self.cuts(t) for t in texts]
        cuts = list(chain.from_iterable(split))
        try:
            at = np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts))
        except KeyError:
            self.learn(set(cuts).difference(self.known))
            at = np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts))
        size = self.size[at]
        end = np.concatenate([[0], np.cumsum(size)])
        pick = np.arange(int(end[-1])) + np.repeat(self.start[at] - end[:-1], size)
        return self.flat[pick], np.diff(end[np.cumsum([len(s) for s in split])], prepend=0)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder a Python worker, kept between tasks."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]


_ENCODERS: dict[str, WordEncoder] = {}


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids: little-endian u16, or u32 for more than 65,536 ids) of every whole text and END_ID; a null text is empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, sizes = encoder.encode(texts)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                end = np.array([END_ID], ids.dtype).tobytes()
                rows = [ids[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, ids binary"
    )


def count_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """Count of every id over all documents: at most a row an id of the vocabulary."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                own = np.bincount(np.frombuffer(row.as_buffer(), kind))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(rows["id"].to_pylist(), default=0) + 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_tokens(tokens: DataFrame, kind: str, lengths: np.ndarray, folder: str) -> DataFrame:
    """Write ``tokens`` as files in ascending doc_id order; the manifest (part, file, docs, tokens).

    Files are ranges of doc_id: part k holds smaller ids than part k + 1.  Null ids come
    first; equal ids are ordered by their tokens.  The name is the attempt's own, and
    only files in the manifest count, so a task that runs twice does no harm.
    """
    packed = lengths.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
        writer, docs = None, 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store.create_dir(root)
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = Writer(stream, np.frombuffer(packed, np.uint8))
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
                docs += 1
        if writer is not None:
            writer.flush()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [f"{folder}/{name}"], "docs": [docs], "tokens": [writer.tokens]}
            )

    spark = tokens.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(work, "part bigint, file string, docs bigint, tokens bigint")
    )


def read_tokens(manifest: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, ``start`` counting all ids before it."""
    packed = lengths.tobytes()
    files = sorted(manifest.collect(), key=lambda r: r.part)  # a row a file
    start, rows = 0, []
    for r in files:
        rows.append((r.file, start))
        start += r.tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["file"])
                out: list[tuple] = []
                start, n, crc = row["start"], 0, 0
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for doc_id, on, ids in read_blocks(stream, lengths):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        n += len(ids)
                        if on:
                            continue
                        out.append((doc_id, start, n, crc))
                        start, n, crc = start + n, 0, 0
                        if len(out) >= 10_000:
                            yield rows_of(out)
                            out = []
                if out:
                    yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    spark = manifest.sparkSession
    listed = spark.createDataFrame(rows, "file string, start bigint").repartition(max(1, len(rows)))
    return listed.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, path = scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    kind = id_type(path)
    tokens, _ = stored(tokenize(table(spark, sf_dir, "documents"), path), "ids")
    lengths = code_lengths(count_ids(tokens, kind))
    manifest, _ = stored(write_tokens(tokens, kind, lengths, folder), "manifest")
    return read_tokens(manifest, lengths)
