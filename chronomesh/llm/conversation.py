"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

A dynamic program reads a conversation's turns in order.  Its states are what the repaired conversation ends in
(nothing, s, u or a); Keep, Rerole, Delete and Insert lead from one to another.  The edits so far
are a persistent list: paths share their beginnings as linked nodes, a node has binary-lifting ancestors and
a rolling hash, and paths of equal cost are compared at the end of their longest common beginning, which is verified.

Turns are dealt out by ranges of (conversation, turn, role, text), so a conversation of any length is
spread over tasks.  Each task sums its segment of a conversation up as the cheapest cost from each state to each state, and
the order of their edits.  Edit strings of as many turns are never one the beginning of another, so the least
of two segments together is known from these two tables.  A second pass reads the
tables of a conversation (as many as there are ranges, at most), picks each segment's states, and streams the turns by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is of a truncated turn that stays
BASE, PRIME = 1_000_003, (1 << 61) - 1
STATES = 4  # nothing yet, ends in s, in u, in a
FAR = 1 << 60  # the cost of what cannot be
TURNS = 1024  # turns of one arena of linked nodes
INSERTED = (2, 2, 3, 2)  # the state after an inserted turn
CLOSING = ((0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0))  # (cost, inserted turns) of the end, by state
NAMES = {2: "user", 3: "assistant"}
SPACE = " \t\n\x0b\f\r"
OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Trails:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self) -> None:
        self.up: list[list[int]] = [[0]]
        self.depth, self.letter, self.hash = [0], [""], [0]

    def add(self, parent: int, letter: str) -> int:
        node, depth = len(self.depth), self.depth[parent] + 1
        self.depth.append(depth)
        self.letter.append(letter)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % PRIME)
        up = [parent]
        for k in range(1, depth.bit_length()):  # the ancestor 2**k before
            up.append(self.up[up[-1]][k - 1] if k - 1 < len(self.up[up[-1]]) else 0)
        self.up.append(up)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        left = self.depth[node] - depth
        while left:
            k = left.bit_length() - 1
            node, left = self.up[node][k], left - (1 << k)
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal, letter by letter up to a shared node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` comes before ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y or self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:
            return self.string(a) < self.string(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.string(a) < self.string(b)  # hashes of unlike beginnings agreed

    def string(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))


def moves(initial: str) -> tuple[tuple[int, int, bool, str, int], ...]:
    """(state before, state after, whether a turn is inserted first, edit, cost) for a turn whose role has this initial.

    At most one turn is inserted before a turn that stays, as two more lead back to the same state; none is before a
    deletion, as the deletion comes first in ASCII order.
    """
    found = [(q, q, False, "D", DELETE) for q in range(STATES)]
    for q in range(STATES):
        for insert in (False, True):
            p, cost = (INSERTED[q], INSERT) if insert else (q, 0)
            after = 3 if p == 2 else 2  # u after anything but u
            found.append((q, after, insert, "R", cost + REROLE))
            if initial == " ua"[after - 1]:
                found.append((q, after, insert, "K", cost + KEEP))
            elif initial == "s" and p == 0 and not insert:
                found.append((q, 1, insert, "K", cost + KEEP))
    return tuple(found)


MOVES = {c: moves(c) for c in ("s", "u", "a", "")}


def cheapest(turns: list[tuple[str, bool]], start: int) -> list[tuple[int, str]]:
    """(cost, edits) of the least way from ``start`` to each state over (role initial, truncated) turns."""
    trails = Trails()
    best: list[tuple[int, int] | None] = [None] * STATES
    best[start] = (0, 0)
    for initial, cut in turns:
        offers: list[tuple[int, list[tuple[int, bool, str]]]] = [(FAR, []) for _ in range(STATES)]
        for q, after, insert, letter, cost in MOVES.get(initial, MOVES[""]):
            if best[q]:
                cost += best[q][0] + (TRUNCATED if cut and letter != "D" else 0)
                if cost < offers[after][0]:
                    offers[after] = (cost, [(q, insert, letter)])
                elif cost == offers[after][0]:
                    offers[after][1].append((q, insert, letter))
        made = []
        for cost, ways in offers:
            least = None
            for q, insert, letter in ways:
                node = trails.add(trails.add(best[q][1], "I") if insert else best[q][1], letter)
                if least is None or trails.less(node, least):
                    least = node
            made.append(None if least is None else (cost, least))
        best = made
    return [(b[0], trails.string(b[1])) if b else (FAR, "") for b in best]


class Segment:
    """The least edits of a run of turns from each of ``starts`` to each state, gathered arena by arena."""

    def __init__(self, starts: tuple[int, ...]):
        self.starts, self.turns, self.parts = starts, [], []

    def add(self, initial: str, cut: bool) -> None:
        self.turns.append((initial, cut))
        if len(self.turns) == TURNS:
            self.close()

    def close(self) -> None:
        if self.turns:
            starts = self.starts if not self.parts else range(STATES)
            self.parts.append({p: cheapest(self.turns, p) for p in starts})
            self.turns = []

    def tables(self) -> tuple[list[int], list[int], list[str]]:
        """(costs, places of the edits in ASCII order, edits), each by state before and state after."""
        self.close()
        none = [(FAR, "")] * STATES
        own = [tables_of(part) for part in self.parts]
        whole, ways = together(own) if own else (identity(), [])
        edits = []
        for p in range(STATES):
            for q in range(STATES):
                text = []
                if own and p in self.starts and whole[0][4 * p + q] < FAR:
                    for part, (a, b) in zip(self.parts, way(ways, p, q), strict=True):
                        text.append(part.get(a, none)[b][1])
                edits.append("".join(text))
        return whole[0], whole[1], edits


Tables = tuple[list[int], list[int]]


def identity() -> Tables:
    return [0 if p == q else FAR for p in range(STATES) for q in range(STATES)], [0] * STATES * STATES


def tables_of(part: dict[int, list[tuple[int, str]]]) -> Tables:
    costs, places = [FAR] * 16, [0] * 16
    for p, found in part.items():
        order = sorted(text for cost, text in found if cost < FAR)
        for q, (cost, text) in enumerate(found):
            costs[4 * p + q] = cost
            places[4 * p + q] = order.index(text) if cost < FAR else 0
    return costs, places


def joined(a: Tables, b: Tables) -> tuple[Tables, list[int]]:
    """Tables of two runs one after the other, and the state between them by state before and after."""
    costs, places, middle = [FAR] * 16, [0] * 16, [0] * 16
    for p in range(STATES):
        keys = {}
        for q in range(STATES):
            ways = [(a[0][4 * p + m] + b[0][4 * m + q], a[1][4 * p + m], m) for m in range(STATES) if a[0][4 * p + m] < FAR and b[0][4 * m + q] < FAR]
            if ways:
                cost, place, m = min(ways)
                costs[4 * p + q], middle[4 * p + q] = cost, m
                keys[q] = (place, b[1][4 * m + q])
        for k, q in enumerate(sorted(keys, key=keys.get)):
            places[4 * p + q] = k
    return (costs, places), middle


def together(runs: list[Tables]) -> tuple[Tables, list[list[int]]]:
    whole, ways = runs[0], []
    for run in runs[1:]:
        whole, middle = joined(whole, run)
        ways.append(middle)
    return whole, ways


def way(ways: list[list[int]], p: int, q: int) -> list[tuple[int, int]]:
    """(state before, state after) of each run on the least way from ``p`` to ``q`` over all."""
    ends = [q]
    for middle in reversed(ways):
        ends.append(middle[4 * p + ends[-1]])
    ends.reverse()
    return list(zip([p, *ends[:-1]], ends, strict=True))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of ``conversations`` rows after damage; a row stands for n alike ones.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its
    role to user.  A null conv_id or turn is one space in that key and stays null; a null role or text is one space.
    """
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"),
        text_of("text").alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, n), alike ones once, with ``fault``: 1 blank, 2 duplicate, 3 truncated, 0 none.

    That is the first fault of the first of n alike rows; the others are blank or duplicates.  The first turn of each role
    and text is marked by an aggregate over both, so nothing is joined on a text that many turns repeat.
    """
    own = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    mark = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    mark = mark.select("conv_id", "first.turn", "role", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "digest", F.lit(1).alias("first"))
    one = (
        own.select("conv_id", "turn", "role", "text", "n", "digest", F.lit(0).alias("first")).union(mark)
        .groupBy("conv_id", "turn", "role", "digest").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first"))
    )
    solid = F.rtrim("text", F.lit(SPACE))
    fault = F.when(solid == "", 1).when(F.col("first") == 0, 2).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return one.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


FIELDS = (
    "conv_id bigint, kind int, part int, sub int, at bigint, turn bigint, role string, text string, n bigint, fault int, "
    "costs array<bigint>, places array<int>, edits array<string>"
)
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("sub", pa.int32()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("n", pa.int64()), ("fault", pa.int32()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("edits", pa.list_(pa.string())),
])
BATCH = 4096


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[7] or "") + sum(map(len, row[12] or ()))
        if len(held) == BATCH or size > 1 << 22:
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in held], SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in held], SCHEMA)


def records(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in found:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def segments(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of one range, each with its place, and two rows a segment: kind 0 its tables, kind 1 (sub 0) its edits."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        conv, segment, at, first = None, None, 0, True

        def ended() -> Iterator[tuple]:
            costs, places, edits = segment.tables()
            yield (conv, 0, part, 0, 0, None, None, None, None, None, costs, places, None)
            yield (conv, 1, part, 0, 0, None, None, None, None, None, None, None, edits)

        for conv_id, turn, role, text, n, fault in records(found):
            if segment is None or conv_id != conv:
                if segment is not None:
                    yield from ended()
                # only the first conversation of a range can have begun in another one
                conv, segment, at, first = conv_id, Segment(tuple(range(STATES)) if first else (0,)), 0, False
            if fault not in (1, 2):
                segment.add(role[:1], fault == 3)
            at += 1
            yield (conv_id, 1, part, 1, at, turn, role, text, n, fault, None, None, None)
        if segment is not None:
            yield from ended()

    return batches(rows())


class Report:
    """What is counted of a conversation as its turns go by."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def turn(self, turn: int | None, role: str, n: int, fault: int) -> None:
        initial = role[:1]
        self.blank += n if fault == 1 else 0
        self.duplicate += n if fault == 2 else n - 1 if fault != 1 else 0
        self.truncated += fault == 3
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (n - 1) * (2 * initial not in LEGAL)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def add(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
        self.any = True

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


LEGAL = ("su", "ua", "au")


def conversations(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From rows of ``segments`` by conversation, kind, part, sub and place: ("turn", conv_id, role, text, edit) and ("end", conv_id, cost, report).

    Besides its own counts a conversation keeps its tables and the edits of one segment in memory, and its audit.
    """
    conv, report, tables, states, edits, at, state = None, None, [], {}, "", 0, 0
    cost = closing = 0

    def chosen() -> None:
        nonlocal states, cost, closing
        runs = [t for _, t in tables]
        whole, ways = together(runs) if runs else (identity(), [])
        cost, _, q = min((whole[0][q] + CLOSING[q][0], whole[1][q], q) for q in range(STATES) if whole[0][q] < FAR)
        closing = CLOSING[q][1]
        states = dict(zip([k for k, _ in tables], way(ways, 0, q), strict=True)) if runs else {}

    def inserted() -> tuple:
        nonlocal state
        state = INSERTED[state]
        report.audit.append("I")
        report.add(NAMES[state], "")
        return ("turn", conv, NAMES[state], "", "I")

    def ended() -> Iterator[tuple]:
        if not states:
            chosen()
        for _ in range(closing):
            yield inserted()
        yield ("end", conv, cost + DELETE * (report.blank + report.duplicate), report)

    for conv_id, kind, part, sub, _, turn, role, text, n, fault, costs, places, every in records(found):
        if report is None or conv_id != conv:
            if report is not None:
                yield from ended()
            conv, report, tables, states, edits, at, state = conv_id, Report(), [], {}, "", 0, 0
        if kind == 0:
            tables.append((part, (costs, places)))
        elif kind == 1 and sub == 0:
            if not states:
                chosen()
            p, q = states[part]
            edits, at = every[4 * p + q], 0
        elif kind == 1:
            report.turn(turn, role, n, fault)
            if fault not in (1, 2):
                while edits[at] == "I":
                    yield inserted()
                    at += 1
                edit, at = edits[at], at + 1
                report.audit.append(edit)
                if edit != "D":
                    state = 1 if edit == "K" and role[:1] == "s" else 3 if state == 2 else 2
                    name = role if edit == "K" else NAMES[state]
                    report.add(name, text)
                    yield ("turn", conv, name, text, edit)
                n -= 1
            report.audit.append("D" * n)
    if report is not None:
        yield from ended()


def arranged(turns: DataFrame, every: DataFrame) -> DataFrame:
    """Rows of ``segments`` of ``turns``, those of a conversation together and in order; each conv_id of ``every`` has a row at least."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    named = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", *[F.lit(-1 if c == "kind" else None).cast(kind).alias(c) for c, kind in (f.split(" ") for f in FIELDS.split(", ")[1:])]
    )
    return (
        dealt.mapInArrow(segments, FIELDS).union(named)
        .repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "part", "sub", "at")
    )


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of the turns that conversations have after repair; ``turns`` as ``damaged`` returns."""
    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            at = 0
            for kind, conv, *rest in conversations(found):
                at = 0 if kind == "end" else at + 1
                if at:
                    yield dict(zip(("conv_id", "position", "role", "text", "edit"), (conv, at, *rest), strict=True))

        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        held: list[dict] = []
        for row in rows():
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return arranged(turns, turns).mapInArrow(work, "conv_id bigint, position bigint, role string, text string, edit string")


def reports(turns: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each conv_id of ``every``: faults of its ``turns``, the least cost, the audit of the edits, and the SHA-256 of what repair leaves.

    Rows of one turn number come in the order of role and text.  A null conv_id is a conversation of its own, null turns come first.  A
    conversation without a row left has zeros, an empty audit and the hash of the empty string; an empty table has no rows.
    Other columns are not read.  A hash is one stream, so one task reads the turns of a conversation one after another.
    """
    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        held: list[tuple] = []
        for kind, conv, *rest in conversations(found):
            if kind == "end":
                cost, r = rest
                held.append((conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, cost, "".join(r.audit), r.digest.hexdigest()))
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)

    return arranged(turns, every).mapInArrow(work, f"{OUT}, repaired_sha256 string")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return reports(damaged(rows), rows)
