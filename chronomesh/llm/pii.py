"""Personal data: fixed base patterns, and a semi-Markov CRF that adds whole spans.

The CRF labels segments of tokens.  Features see a candidate span as a whole (its digit groups,
checksum, separators, what stands before it), and dynamic programming over
segments of at most MOST tokens picks boundaries and types together.  It is trained here, by
exact likelihood, on sentences made from a grammar of personal data and of the
numbers that are none.  A segment of several tokens is a candidate if it holds one at sign, plain
or written, or nothing but NUMBERS of digits in some groups; a token alone if it has
so many digits, or digits and letters at length.  Whatever else a line holds is no entity, so
the program runs over stretches of candidates, each from no entity into no entity.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: the base patterns and their order
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMERIC = re.compile(r"[0-9+][0-9+\x20().-]{5,}")

TYPES = ("none", "email", "phone", "ip", "card", "secret", "national_id")
ADDED = {"email": "email_written", "phone": "phone_local", "secret": "secret", "national_id": "national_id"}
ORDER = {k: n for n, k in enumerate((*KINDS, "email_written", "phone_local", "secret", "national_id"))}
MOST = 14
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?[aA][tT]\s?[\])]")
WRITTEN = re.compile(r"[\[(]\s?([aA][tT])\s?[\])]")
DIGIT = re.compile("[0-9]")
NUMBERS, GROUPS, MARKS = range(7, 20), 5, frozenset("-.()/+")  # of a candidate without an at sign; its tokens are NUMERIC_MOST at most
NUMERIC_MOST, LONG_TOKEN = 9, 16


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap within a kind.

    Works outward from "@" and within maximal runs of number characters, which gives the
    same matches as a scan and stays linear on any text.
    """
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, "email", found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for run in NUMERIC.finditer(text):
        a, b = run.span()
        for m in IP.finditer(text, a, b):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        for m in PHONE.finditer(text, a, b):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    out.sort(key=lambda s: (s[0], ORDER[s[1]]))
    return out


# words before a span that tell its type
CONTEXT = {
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api", "auth", "bearer"},
    "phone": {"call", "phone", "tel", "telephone", "mobile", "cell", "fax", "whatsapp"},
    "email": {"mail", "email", "contact", "write"},
    "card": {"card", "visa", "mastercard", "credit"},
    "id": {"ssn", "social", "passport", "iban", "tax"},
}
_BUCKETS = 1 << 12


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % _BUCKETS


_SLOTS: dict[str, int] = {}


def span_features(span: str, tokens: int, before: str, after: str, words: set[str]) -> list[int]:
    """Hashed names of what holds of a whole span; ``before`` and ``after`` are the characters beside it."""
    digits = re.findall("[0-9]+", span)
    n = sum(map(len, digits))
    plain = "".join(digits)
    letters = sum(map(str.isalpha, span))
    names = [
        "bias", f"tokens{min(tokens, 10)}", f"digits{min(n, 20)}", f"groups{'-'.join(str(len(d)) for d in digits[:6])}",
        f"open{'+' if span[0] == '+' else '(' if span[0] == '(' else '9' if span[0].isdigit() else 'a' if span[0].isalpha() else '.'}",
        f"shut{'9' if span[-1].isdigit() else 'a' if span[-1].isalpha() else '.'}",
        f"marks{''.join(sorted({c for c in span if not c.isalnum()}))[:8]}",
        f"dots{min(span.count('.'), 4)}", f"at{min(span.count('@'), 2)}", f"length{min(len(span) // 8, 6)}",
        f"mixed{int(n > 0)}{int(letters > 0)}{int(tokens == 1)}",
        f"beside{int(before.isalnum())}{int(after.isalnum())}{before if before in '.+-@:/=' else ''}|{after if after in '.-@:/%' else ''}",
    ]
    if re.search(r"[\[(]\s?at\s?[\])]", span, re.IGNORECASE):
        names.append(f"written{int(bool(re.search(r'[\[(]\s?dot\s?[\])]|[a-z]\.[a-z]', span, re.IGNORECASE)))}")
    if tokens == 1 and len(span) >= 16 and letters and n:
        names.append("hex" if re.fullmatch("[0-9a-fA-F]+", span) else "random")
    if 12 <= n <= 19 and not letters:
        names.append(f"luhn{int(luhn(plain))}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span):
        names.append(f"quad{int(all(int(p) <= 255 for p in span.split('.')))}")
    names += [f"after_{k}" for k, vocabulary in CONTEXT.items() if words & vocabulary]
    out = []
    for name in names:
        if name not in _SLOTS:
            if len(_SLOTS) > 1 << 16:
                _SLOTS.clear()
            _SLOTS[name] = _slot(name)
        out.append(_SLOTS[name])
    return out


def segments(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[list[int]], list[bool]]:
    """(token spans, candidate segments as token ranges by start, their features, whether each may be an entity) of a text.

    A single token is always a candidate for no entity.  No candidate crosses a line end, and none ends in a mark.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    digits = [len(DIGIT.findall(text, a, b)) for a, b in spans]
    alnum = [text[a].isalnum() for a, _ in spans]
    fresh = [k > 0 and "\n" in text[spans[k - 1][1] : a] for k, (a, _) in enumerate(spans)]  # first of a line
    apart = [k > 0 and a > spans[k - 1][1] for k, (a, _) in enumerate(spans)]
    written = {m.start(1) for m in WRITTEN.finditer(text)}
    signs = [k for k, (a, b) in enumerate(spans) if text[a:b] == "@" or a in written]
    is_sign = set(signs)
    out, features, typed = [], [], []

    def put(i: int, j: int, entity: bool) -> None:
        a, b = spans[i][0], spans[j - 1][1]
        words = set()
        for k in range(i - 1, max(-1, i - 6), -1):
            if fresh[k + 1]:
                break
            if text[spans[k][0]].isalpha():
                words.add(text[slice(*spans[k])].lower())
        out.append((i, j))
        features.append(span_features(text[a:b], j - i, text[a - 1 : a] or " ", text[b : b + 1] or " ", words))
        typed.append(entity)

    for i, (a, b) in enumerate(spans):
        put(i, i + 1, digits[i] in NUMBERS or b - a >= LONG_TOKEN and 0 < digits[i])
        if not (alnum[i] or text[a] in "+("):
            continue
        at = bisect_left(signs, i)
        sign = at < len(signs) and signs[at] < i + MOST
        total, groups, space, numeric, held = digits[i], int(digits[i] > 0), False, digits[i] == b - a or not alnum[i], int(i in is_sign)
        for j in range(i + 2, min(n, i + (MOST if sign else NUMERIC_MOST)) + 1):
            k = j - 1
            if fresh[k]:
                break
            x, y = spans[k]
            total, groups, space, held = total + digits[k], groups + (digits[k] > 0), space or apart[k], held + (k in is_sign)
            numeric = numeric and (digits[k] == y - x or text[x] in MARKS)
            if held > 1 or not sign and (not numeric or groups > GROUPS or total >= NUMBERS.stop):
                break
            if not alnum[k]:
                continue
            if held and (not space or text[spans[signs[at]][0]] != "@"):
                put(i, j, True)
            elif numeric and j - i <= NUMERIC_MOST and groups <= GROUPS and (total in NUMBERS or j - i == 7 and groups == 4):
                put(i, j, True)
    return spans, out, features, typed


def stretches(n: int, ranges: list[tuple[int, int]], typed: list[bool]) -> Iterator[tuple[int, int]]:
    """Token ranges that possible entities cover, those that overlap together."""
    first = last = -1
    for (i, j), entity in zip(ranges, typed, strict=True):
        if not entity:
            continue
        if i >= last:
            if last > first:
                yield first, last
            first = i
        last = max(last, j)
    if last > first:
        yield first, last


def padded(features: list[list[int]]) -> np.ndarray:
    width = max(map(len, features), default=1)
    out = np.full((len(features), width), _BUCKETS, np.int64)  # the last row of the weights stays zero
    for k, f in enumerate(features):
        out[k, : len(f)] = f
    return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class SemiMarkov:
    """Weights of span features by type, and of one type after another."""

    def __init__(self):
        self.weights = np.zeros((_BUCKETS + 1, len(TYPES)))
        self.after = np.zeros((len(TYPES), len(TYPES)))

    def scores(self, ranges: list[tuple[int, int]], features: list[list[int]], typed: list[bool]) -> np.ndarray:
        s = self.weights[padded(features)].sum(axis=1)
        long = np.array([j - i > 1 for i, j in ranges])
        s[long, 0] = -np.inf  # no entity is one token long
        s[~np.array(typed), 1:] = -np.inf
        return s

    def best(self, text: str) -> list[tuple[int, int, str]]:
        """Entities of the best segmentation: (start, end, type); ties go to the shorter segment and the first type."""
        spans, ranges, features, typed = segments(text)
        out, k = [], 0
        for first, last in stretches(len(spans), ranges, typed):
            while ranges[k][0] < first:
                k += 1
            m = k
            while m < len(ranges) and ranges[m][0] < last:
                m += 1
            s = self.scores(ranges[k:m], features[k:m], typed[k:m])
            own = [(i - first, j - first) for i, j in ranges[k:m]]
            for i, j, y in self.path(last - first, own, s, last < len(spans)):
                out.append((spans[first + i][0], spans[first + j - 1][1], TYPES[y]))
            k = m
        return out

    def path(self, n: int, ranges: list[tuple[int, int]], s: np.ndarray, more: bool) -> list[tuple[int, int, int]]:
        """Entities of the best segmentation of ``n`` tokens that stand after no entity, and before one more such token if ``more``."""
        value = np.full((n + 1, len(TYPES)), -np.inf)
        value[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        enter: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(ranges):
            by_end[j].append(k)
        for j in range(n + 1):
            for k in reversed(by_end[j]):  # shorter segments first
                gain, source = enter[ranges[k][0]]
                total = gain + s[k]
                for y in np.flatnonzero(total > value[j]):
                    value[j, y] = total[y]
                    back[j, int(y)] = (ranges[k][0], int(source[y]))
            into = value[j][:, None] + self.after
            enter[j] = (into.max(axis=0), into.argmax(axis=0))
        j, y = n, int((value[n] + (self.after[:, 0] if more else 0)).argmax())
        out = []
        while j:
            i, source = back[j, y]
            if y:
                out.append((i, j, y))
            j, y = i, source
        return out[::-1]

    def step(self, text: str, gold: dict[tuple[int, int], int], sums: tuple[np.ndarray, np.ndarray], rate: float) -> None:
        """One AdaGrad step on the log-likelihood of a sentence; ``gold`` has the type of each entity's (start, end)."""
        spans, ranges, features, typed = segments(text)
        n, k = len(spans), len(TYPES)
        s = self.scores(ranges, features, typed)
        by_start: list[list[int]] = [[] for _ in range(n)]
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for e, (i, j) in enumerate(ranges):
            by_start[i].append(e)
            by_end[j].append(e)
        alpha, enter = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0
        for j in range(n + 1):
            if by_end[j]:
                alpha[j] = lse(np.stack([enter[ranges[e][0]] + s[e] for e in by_end[j]]), 0)
            enter[j] = lse(alpha[j][:, None] + self.after, 0)
        beta, leave = np.full((n + 1, k), -np.inf), np.full((n, k), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            leave[i] = lse(np.stack([s[e] + beta[ranges[e][1]] for e in by_start[i]]), 0)
            beta[i] = lse(self.after + leave[i][None, :], 1)
        z = lse(alpha[n], 0)
        expected = np.exp(np.stack([enter[i] + s[e] + beta[j] for e, (i, j) in enumerate(ranges)]) - z)
        moved = np.exp(alpha[:n, :, None] + self.after[None] + leave[:, None, :] - z).sum(axis=0)
        at, previous = 0, 0
        place = {(spans[i][0], spans[j - 1][1]): (e, j) for e, (i, j) in enumerate(ranges)}
        opens = {a: (b, y) for (a, b), y in gold.items()}
        while at < n:
            a = spans[at][0]
            b, y = opens.get(a, (spans[at][1], 0))
            e, at = place[a, b]
            expected[e, y] -= 1
            moved[previous, y] -= 1
            previous = y
        flat = padded(features)
        g = np.zeros_like(self.weights)
        np.add.at(g, flat, expected[:, None, :])
        g[_BUCKETS] = 0
        for weight, grad, total in ((self.weights, g, sums[0]), (self.after, moved, sums[1])):
            total += grad * grad
            weight -= rate * grad / np.sqrt(total + 1e-6)


def sentence(rng: random.Random) -> tuple[str, dict[tuple[int, int], int]]:
    """A made-up sentence and its entities: a filler of syllables, personal data, and numbers that are none."""
    def word() -> str:
        own = "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "en", "la", "ou", "es", "ge", "mi"]) for _ in range(rng.randint(1, 4)))
        return own.capitalize() if rng.random() < 0.2 else own

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return body if rng.random() < 0.6 else rng.choice("- ").join(body[k : k + 4] for k in range(0, 16, 4))

    def entity() -> tuple[str, str, str]:
        host = rng.choice([f"mail{rng.randint(0, 9)}.example.com", f"{word().lower()}.org", f"{word().lower()}.co.uk"])
        kind = rng.choice(["email", "email", "phone", "phone", "ip", "card", "secret", "secret", "national_id"])
        if kind == "email":
            if rng.random() < 0.5:
                return "", f"{word().lower()}.{rng.randint(1, 99)}@{host}", kind
            at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", ".")])
            return "", word().lower() + at + host.replace(".", dot), kind
        if kind == "phone":
            own = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(3)} {d(4)}"])
            if rng.random() < 0.5:
                return "", f"+{rng.randint(1, 99)} {own}", kind
            return rng.choice(["", "call ", "phone: ", "tel ", "mobile "]), own, kind
        if kind == "ip":
            return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
        if kind == "card":
            return rng.choice(["", "card "]), card(), kind
        if kind == "secret":
            if rng.random() < 0.7:
                own = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
            else:
                own = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(rng.randint(20, 40)))
                own += "7a"
            quote = rng.choice(['"', "'", ""])
            return rng.choice(["token = ", "key: ", "api_key = ", "secret=", "password = "]) + quote, own, kind
        return rng.choice(["SSN ", "social security number "]), f"{d(3)}-{d(2)}-{d(4)}", kind

    def other() -> str:
        return rng.choice([
            f"{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            f"{rng.randint(0, 23)}:{d(2)}", f"${d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)}", f"{d(2)}%", f"page {d(2)}",
            f"{d(1)},{d(3)},{d(3)}", f"{d(5)}", f"{d(7)}", f"version {d(1)}.{d(2)}", f"@{word().lower()}", f"{d(3)}-{d(3)}", f"[{d(1)}]",
            f"({d(4)})", f"{word()}{d(2)}", f"{d(2)} + {d(2)}", f"{d(10)}", f"{d(20)}", f"{d(13)}", f"commit {hashlib.sha1(d(4).encode()).hexdigest()[:7]}",
        ])

    text, gold = "", {}
    for _ in range(rng.randint(1, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ". ", ": "])
        if rng.random() < 0.6:
            lead, own, kind = entity()
            gold[len(text) + len(lead), len(text) + len(lead) + len(own)] = TYPES.index(kind)
            shut = lead[-1] if lead[-1:] in ("'", '"') else ""
            text += lead + own + shut
        else:
            text += other()
        text += rng.choice([" ", ". ", ", ", "\n"])
    return text + word(), gold


def train(sentences: int = 700, rounds: int = 2, seed: int = 7) -> SemiMarkov:
    rng = random.Random(seed)
    made = [sentence(rng) for _ in range(sentences)]
    model = SemiMarkov()
    sums = (np.zeros_like(model.weights), np.zeros_like(model.after))
    for k in range(rounds):
        for text, gold in made:
            places = {a for a, _ in (m.span() for m in TOKEN.finditer(text))}
            if all(a in places for a, _ in gold):
                model.step(text, gold, sums, 0.3 / (1 + k))
    return model


def merged(base: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what base spans, ordered by start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in base:
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[tuple[int, str, int]], model: SemiMarkov) -> list[tuple[int, str, int]]:
    """Entities of the CRF that overlap no base span, under names of their own; lines are judged each by itself."""
    starts, ends = merged(base)

    def covered(a: int, b: int) -> bool:
        k = bisect_left(ends, a + 1)
        return k < len(starts) and starts[k] < b

    out, at = [], 0
    while m := TRIGGER.search(text, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start())
        at = b = len(text) if b < 0 else b
        if all(covered(*x.span()) for x in TRIGGER.finditer(text, a, b)):
            continue
        for start, end, kind in model.best(text[a:b]):
            if kind in ADDED and not covered(start + a, end + a):
                out.append((start + a, ADDED[kind], end + a))
    return out


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find_pii(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """Personal data of every whole text.

    doc_id, counts of the base kinds, the digest of the base spans, and all spans: base
    ones, and those that the CRF adds, by start and kind.  Null texts are empty and
    have none; rows that repeat a doc_id are searched each.
    """
    model = model or train()
    weights, after = model.weights.astype(np.float32), model.after

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkov()
        own.weights, own.after = weights, after
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + added_spans(text, base, own)
                spans.sort(key=lambda s: (s[0], ORDER[s[1]]))
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"doc_id bigint, {counts}, base_sha256 string, spans string"
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
