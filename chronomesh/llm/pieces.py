"""SentencePiece encoding and decoding with a BPE piece model.

Merging pieces by rank has one fixed point, and a sequence of pieces is it if and only if each
two neighbours are: merging their joint text gives just the two.  So the encoding is the one
path of compatible neighbours through the lattice of pieces that reaches the
end of the text, and a lattice has a max-plus transfer matrix: for the pieces that can
straddle or end at a chunk's left and right boundary, the best (least negative)
path between them, minus one a piece, or minus infinity.  Giant documents are split into
chunks at fixed places; the matrices are combined associatively, level by level;
the boundary states that come out let every chunk be backtraced on its own.

A unit is a run of spaces and what follows it up to the next.  No piece holds a space after anything else,
so no merge crosses units, and all paths meet at their starts: the lattice of a chunk is walked
up to its first and from its last unit only.  What lies between, and smaller texts, are encoded unit by unit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

GIANT = 1 << 15  # characters from which a text is split
CHUNK = 1 << 13
KNOWN = 1 << 22  # characters of units whose ids a worker keeps
GROUP = 64  # matrices combined at once
SPACE = "▁"
NEVER = -np.inf


class Pieces:
    """The piece model: ranks, merging, and which neighbours stand."""

    def __init__(self, path: str, most: int = 50_000):
        import sentencepiece

        self.path, self.most, self.held = path, most, 0
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [p.id_to_piece(k) for k in range(p.get_piece_size())]
        plain = [k for k in range(len(self.names)) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))]
        self.ids = {self.names[k]: k for k in plain}
        self.score = {self.names[k]: p.get_score(k) for k in plain}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece holds a space after another character")
        if any("\n" in n for n in self.ids):
            raise ValueError("a piece holds a line end")
        self.longest = max(map(len, self.ids))
        self.byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.starts = {n[:k] for n in self.ids for k in range(1, len(n) + 1)}
        self.raw = [self.bytes_of(k) for k in range(len(self.names))]
        self.known: dict[str, list[int]] = {}
        self.stands: dict[tuple[str, str], bool] = {}

    def bytes_of(self, k: int) -> bytes:
        if self.library.is_byte(k):
            return bytes([int(self.names[k][3:5], 16)])
        return b"" if self.library.is_control(k) else self.names[k].replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: the best-ranked pair of neighbours merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                rank = self.score.get(parts[k] + parts[k + 1])
                if rank is not None and rank > best:
                    best, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a``; a character that is no piece stands beside anything."""
        if a not in self.ids or b not in self.ids:
            return True
        found = self.stands.get((a, b))
        if found is None:
            if len(self.stands) > self.most:
                self.stands.clear()
            found = self.stands[a, b] = self.merge(a + b) == [a, b]
        return found

    def spelled(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character that is none."""
        k = self.ids.get(piece)
        return [k] if k is not None else [self.byte[b] for b in piece.encode()]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, by distinct units; the library merges the units not met yet."""
        # a line end is no piece: it stands alone, and no merge crosses it
        return self.encode_units([UNIT((" " + t).replace(SPACE, " ")) if t else [] for t in texts])

    def encode_units(self, split: list[list[str]]) -> list[list[int]]:
        if len(self.known) > self.most or self.held > KNOWN:
            self.known.clear()
            self.held = 0
        new = sorted(set(chain.from_iterable(split)).difference(self.known))
        if new:
            # the library puts a space before a text: one of a unit's own is left out, else a line end keeps them apart
            lead = [u[1:] if u[0] == " " and u[1:2] not in ("", "\n") else "\n" + u for u in new]
            for u, x, ids in zip(new, lead, self.library.encode(lead, num_threads=1), strict=True):
                self.known[u] = ids if x[0] != "\n" or u[0] == "\n" and len(u) > 1 and x == u[1:] else ids[2:]
                self.held += len(u)
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: their bytes, less the space put before the text."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    # lattice of one chunk; a state is (characters of the piece left of a boundary, piece)

    def matches(self, text: str, at: int) -> list[str]:
        """Pieces that ``text`` has at a place, the character itself in any case."""
        out = [text[at]] if text[at] not in self.ids else []
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if text[at:end] not in self.starts:
                break
            if text[at:end] in self.ids:
                out.append(text[at:end])
        return out

    def states(self, text: str, boundary: int) -> list[tuple[int, str]]:
        """Pieces that end at a boundary or lie across it, in a fixed order."""
        if boundary == 0:
            return [(0, "")]
        out = []
        for left in range(1, min(self.longest, boundary) + 1):
            out += [(left, p) for p in self.matches(text, boundary - left) if len(p) >= left]
        return sorted(out)

    def walk(self, text: str, a: int, b: int, sources: list[tuple[int, str]]) -> tuple[dict, list[tuple[int, str]]]:
        """Best value from each source to every piece that starts before ``b``: {(start, piece): vector}, and the states at ``b``.

        ``sources`` are states at ``a``.  A piece is reached from the pieces that end where it starts.
        """
        reach: dict[tuple[int, str], np.ndarray] = {}
        ending: dict[int, list[tuple[int, str]]] = {}

        def put(node: tuple[int, str], value: np.ndarray) -> None:
            reach[node] = value
            ending.setdefault(node[0] + len(node[1]), []).append(node)

        for k, (left, piece) in enumerate(sources):
            unit = np.full(len(sources), NEVER)
            unit[k] = 0.0
            put((a - left, piece), unit)
        for at in range(a, b):
            before = ending.get(at)
            if not before:
                continue
            for piece in self.matches(text, at):
                value = None
                for node in before:
                    if node[1] == "" or self.compatible(node[1], piece):
                        value = reach[node] if value is None else np.maximum(value, reach[node])
                if value is not None and value.max() > NEVER:
                    put((at, piece), value - 1.0)
        return reach, ending

    def core(self, text: str, a: int, b: int) -> tuple[int, int, list[int]] | None:
        """(start, end, ids) of the whole units inside a chunk; none if it has no two starts of units."""
        def opens(k: int) -> bool:
            return text[k] == "\n" or text[k - 1] == "\n" or text[k] == SPACE and text[k - 1] != SPACE

        p = next((k for k in range(max(a, 1), b) if opens(k)), b)
        q = next((k for k in range(min(b, len(text) - 1), p, -1) if opens(k)), p)
        return (p, q, self.encode_units([UNIT(text[p:q].replace(SPACE, " "))])[0]) if p < q else None

    def into_core(self, text: str, a: int, core: tuple, sources: list[tuple[int, str]]) -> tuple[dict, dict, list]:
        """The walk up to the core, and its nodes that the core's first piece may follow."""
        p, _, ids = core
        reach, ending = self.walk(text, a, p, sources)
        return reach, ending, [n for n in ending.get(p, []) if n[1] == "" or self.compatible(n[1], self.names[ids[0]])]

    def out_of_core(self, core: tuple, text: str) -> tuple[int, str]:
        """The state at the core's end: its last piece, or the character that is none."""
        last = self.names[core[2][-1]]
        return (len(last), last) if last in self.ids else (1, text[core[1] - 1])

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """Max-plus matrix of a chunk, states at ``a`` by states at ``b``; ``text`` holds a margin on both sides."""
        sources, sinks = self.states(text, a), self.states(text, b)
        core = self.core(text, a, b)
        out = np.full((len(sources), len(sinks)), NEVER)
        if core is None:
            reach, _ = self.walk(text, a, b, sources)
        else:
            reach, _, ends = self.into_core(text, a, core, sources)
            into = np.max([reach[n] for n in ends], axis=0) if ends else np.full(len(sources), NEVER)
            reach, _ = self.walk(text, core[1], b, [self.out_of_core(core, text)])
            reach = {n: into - len(core[2]) + v[0] for n, v in reach.items()}
        for k, (left, piece) in enumerate(sinks):
            value = reach.get((b - left, piece))
            if value is not None:
                out[:, k] = value
        return out

    def trace(self, reach: dict, ending: dict, node: tuple[int, str], first: tuple[int, str]) -> list[str]:
        out = []
        while node != first:
            out.append(node[1])
            node = max(
                (n for n in ending[node[0]] if n[1] == "" or self.compatible(n[1], node[1])), key=lambda n: (reach[n][0], n)
            )
        return out[::-1]

    def backtrace(self, text: str, a: int, b: int, source: int, sink: int) -> list[int]:
        """Ids of a chunk's pieces after its source state, up to and with its sink state."""
        start, goal = self.states(text, a)[source], self.states(text, b)[sink]
        first, last = (a - start[0], start[1]), (b - goal[0], goal[1])
        core = self.core(text, a, b)
        if core is None:
            found = self.trace(*self.walk(text, a, b, [start]), last, first)
            return list(chain.from_iterable(map(self.spelled, found)))
        reach, ending, ends = self.into_core(text, a, core, [start])
        head = self.trace(reach, ending, max(ends, key=lambda n: (reach[n][0], n)), first)
        left, piece = self.out_of_core(core, text)
        tail = self.trace(*self.walk(text, core[1], b, [(left, piece)]), last, (core[1] - left, piece))
        return [*chain.from_iterable(map(self.spelled, head)), *core[2], *chain.from_iterable(map(self.spelled, tail))]

    @classmethod
    def of(cls, path: str) -> Pieces:
        """One model a Python worker."""
        if path not in _PIECES:
            _PIECES[path] = cls(path)
        return _PIECES[path]


_PIECES: dict[str, Pieces] = {}
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chunk_rows(giant: DataFrame, path: str) -> DataFrame:
    """(doc, part, parts, text, a, b): the chunks of each giant text with margins for the pieces across their ends."""
    schema = "doc bigint, part int, parts int, text string, a int, b int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = Pieces.of(path).longest + 1
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                full = SPACE + text.as_py().replace(" ", SPACE)
                parts = -(-len(full) // CHUNK)
                for at in range(0, parts, GROUP):
                    rows = []
                    for part in range(at, min(parts, at + GROUP)):
                        left, right = max(0, part * CHUNK - margin), min((part + 1) * CHUNK, len(full))
                        rows.append((doc.as_py(), part, parts, full[left : right + margin], part * CHUNK - left, right - left))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "part", "parts", "text", "a", "b"])

    return giant.mapInArrow(work, schema)


_MATRIX = "doc bigint, level int, part int, parts int, rows int, matrix binary"


def scan(giant: DataFrame, path: str) -> DataFrame:
    """(doc, part, ids) of the chunks of giant texts ``giant`` (doc, text), whose doc numbers are unique."""
    spark = giant.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, _ = stored(chunk_rows(giant, path).repartition(4 * n, "doc", "part"), "chunks")
    widest = chunks.agg(F.max("parts")).first()[0]
    if widest is None:
        return spark.createDataFrame([], "doc bigint, part int, ids array<int>")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for r in batch.to_pylist():
                m = model.transfer(r["text"], r["a"], r["b"])
                yield pa.RecordBatch.from_pydict({
                    "doc": [r["doc"]], "level": pa.array([0], pa.int32()), "part": pa.array([r["part"]], pa.int32()),
                    "parts": pa.array([r["parts"]], pa.int32()), "rows": pa.array([len(m)], pa.int32()), "matrix": [m.tobytes()],
                })

    def combine(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        total = None
        for rows, raw in zip(pdf["rows"], pdf["matrix"], strict=True):
            m = np.frombuffer(raw).reshape(rows, -1)
            total = m if total is None else compose(total, m)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["doc"], first["level"] + 1, first["part"] // GROUP, -(-first["parts"] // GROUP), len(total), total.tobytes())],
                            columns=["doc", "level", "part", "parts", "rows", "matrix"])

    levels = [stored(chunks.mapInArrow(matrices, _MATRIX), "level")[0]]
    while widest > GROUP:  # up: products of GROUP neighbours
        up = levels[-1].groupBy("doc", F.floor(F.col("part") / GROUP)).applyInPandas(combine, _MATRIX)
        levels.append(stored(up, "level")[0])
        widest = -(-widest // GROUP)

    def descend(pdf):
        """Boundary states inside a group of neighbours, given the ones at its ends (-1: any, at the text's ends)."""
        import pandas as pd

        pdf = pdf.sort_values("part")
        own = [np.frombuffer(raw).reshape(rows, -1) for rows, raw in zip(pdf["rows"], pdf["matrix"], strict=True)]
        into, out = int(pdf.iloc[0]["into"]), int(pdf.iloc[0]["out"])
        forward = [own[0][max(into, 0)]]
        for m in own[1:]:
            forward.append((forward[-1][:, None] + m).max(axis=0))
        state = out if out >= 0 else int(forward[-1].argmax())
        ends = [state]
        for k in range(len(own) - 1, 0, -1):
            state = int((forward[k - 1] + own[k][:, state]).argmax())
            ends.append(state)
        ends = ends[::-1]
        return pd.DataFrame({"doc": pdf["doc"], "part": pdf["part"], "into": [max(into, 0), *ends[:-1]], "out": ends})

    known = None  # (doc, part of the level above, into, out)
    for level in reversed(levels):  # down: states at every boundary
        rows = level.withColumn("above", F.floor(F.col("part") / GROUP).cast("int"))
        if known is None:
            rows = rows.withColumn("into", F.lit(-1)).withColumn("out", F.lit(-1))
        else:
            rows = rows.join(known.withColumnRenamed("part", "above"), ["doc", "above"])
        known, _ = stored(rows.groupBy("doc", "above").applyInPandas(descend, "doc bigint, part int, into int, out int"), "states")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for r in batch.to_pylist():
                ids = model.backtrace(r["text"], r["a"], r["b"], r["into"], r["out"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc"]], pa.int64()), pa.array([r["part"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))],
                    ["doc", "part", "ids"],
                )

    return chunks.join(known, ["doc", "part"]).mapInArrow(spell, "doc bigint, part int, ids array<int>")


Finish = Callable[["Pieces", list[str | None], list[list[int]]], list[pa.Array]]


def encode(docs: DataFrame, path: str, schema: str = "ids array<int>", finish: Finish | None = None) -> DataFrame:
    """All columns of ``docs`` and ids array<int>, those of the library for the whole text.

    A null or empty text has no ids.  The space mark itself in a text is encoded as a space.  Texts of GIANT
    characters and more go through the parallel scan; their rows are told apart by
    a number of their own, so repeated rows and null ids do no harm.  ``finish`` makes other
    columns, of ``schema``, of model, texts and ids where the ids are, in the same worker.
    """
    fields, spark = docs.schema.names, docs.sparkSession
    at = fields.index("text")
    new = [x.split()[0] for x in schema.split(", ")]
    finish = finish or (lambda model, texts, ids: [pa.array(ids, pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                texts = part.column(at).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, *finish(model, texts, model.encode([t or "" for t in texts]))], [*fields, *new])

    def giant_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for k in range(len(batch)):
                part = batch.slice(k, 1)
                own = part.column(0)
                extra = finish(model, own.field(at).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(own.field(j) for j in range(len(fields))), *extra], [*fields, *new])

    whole_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + schema
    size = F.coalesce(F.char_length("text"), F.lit(0))
    small = docs.where(size < GIANT).mapInArrow(work, whole_schema)
    giant = docs.where(size >= GIANT).select(F.monotonically_increasing_id().alias("doc"), F.struct("*").alias("row"))
    giant, _ = stored(giant, "giant")
    if giant.isEmpty():
        return small
    parts = scan(giant.select("doc", F.col("row.text").cast("string").alias("text")), path)
    whole = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("x"))
    whole = giant.join(whole.select("doc", F.flatten(F.col("x.ids")).alias("ids")), "doc").select("row", "ids")
    return small.union(whole.mapInArrow(giant_work, whole_schema))


DIGESTS = "n_ids bigint, ids_crc32 bigint, text_crc32 bigint, round_trip boolean"


def digests(model: Pieces, texts: list[str | None], lists: list[list[int]]) -> list[pa.Array]:
    """Columns DIGESTS: the ids decoded and held against the text."""
    rows = []
    for text, ids in zip(texts, lists, strict=True):
        back = model.decode(ids)
        rows.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(back.encode()), back == (text or "").replace(SPACE, " ")))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())]


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, DIGESTS, digests).drop("text")
