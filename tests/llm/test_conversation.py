"""Conversation repair against enumeration and a plain dynamic program over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from chronomesh.llm import conversation as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, edits string"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(key.encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def named(turns):
    seen, out = set(), []
    for role, text in turns:
        solid = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(turns):
    """The least (cost, edits) of all ways with up to two insertions anywhere."""
    kinds, best = named(turns), None
    ways = [["D"] if k in ("blank", "duplicate") else ["K", "D", "Ru", "Ra"] for k in kinds]
    for own in itertools.product(*ways):
        cost = sum({"D": 2, "K": 0}.get(w, 1) + 5 * (k == "truncated" and w != "D") for w, k in zip(own, kinds, strict=True))
        steps = [(w[0], "" if w == "D" else turns[i][0][:1] if w == "K" else w[1]) for i, w in enumerate(own)]
        for n in range(3):
            for places in itertools.combinations_with_replacement(range(len(steps) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    full = []
                    for i in range(len(steps) + 1):
                        full += [("I", r) for p, r in zip(places, roles, strict=True) if p == i] + steps[i : i + 1]
                    if SHAPE.match("".join(r or "" for _, r in full)):
                        found = (cost + 5 * n, "".join(e for e, _ in full))
                        best = min(best or found, found)
    return best


def plain(rows):
    """{conv_id: report} by whole strings kept for each state."""
    convs = {r[0]: [] for r in rows}
    for r in spoiled(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = named([r[2:] for r in own])
        states = {"": (0, "", ())}  # by the last role's initial
        for (_, _, role, text), kind in zip(own, kinds, strict=True):
            made = {}
            for last, (cost, audit, kept) in states.items():
                offers = [(last, cost + 2, audit + "D", kept)]
                if kind not in ("blank", "duplicate"):
                    for more in (0, 1):
                        p, fix, extra = last, "", ()
                        if more:
                            p = "a" if last == "u" else "u"
                            fix, extra = "I", ({"u": "user", "a": "assistant"}[p] + ":",)
                        price = cost + 5 * more + 5 * (kind == "truncated")
                        for letter, name, add in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                            i = name[:1]
                            if (i == "s" and p == "") or (i == "u" and p != "u") or (i == "a" and p == "u"):
                                offers.append((i, price + add, audit + fix + letter, (*kept, *extra, f"{name}:{text}")))
                for last_, *rest in offers:
                    made[last_] = min(made.get(last_, tuple(rest)), tuple(rest))
            states = made
        ends = []
        for last, (cost, audit, kept) in states.items():
            extra = {"": (), "s": ("user:", "assistant:"), "u": ("assistant:",), "a": ()}[last]
            ends.append((cost + 5 * len(extra), audit + "I" * len(extra), kept + extra))
        cost, audit, kept = min(ends)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def made(seed, convs, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(turns(rng)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice([f"Say {rng.randrange(6)}.", "cut off", "Ja!  \n", " \t", None, f"é {turn}?"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


def test_strings_compare_as_text(monkeypatch):
    for prime in (c.PRIME, 7):  # with 7, hashes of unlike strings agree
        monkeypatch.setattr(c, "PRIME", prime)
        rng, trails = random.Random(prime % 97), c.Trails()
        nodes = [0]
        for _ in range(400):
            nodes.append(trails.add(rng.choice(nodes), rng.choice("DIKR")))
        for _ in range(4000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert trails.less(a, b) == (trails.string(a) < trails.string(b))
            d = rng.randint(0, trails.depth[a])
            assert trails.string(trails.ancestor(a, d)) == trails.string(a)[:d]


def test_least_edits_equal_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", ""])) for _ in range(rng.randint(0, 4))]
        kinds = named(turns)
        own = [(t[0][:1], k == "truncated") for t, k in zip(turns, kinds, strict=True) if k not in ("blank", "duplicate")]
        ends = []
        for (cost, audit), (more, n) in zip(c.cheapest(own, 0), c.CLOSING, strict=True):
            letters, full = list(audit), []
            for k in kinds:
                if k in ("blank", "duplicate"):
                    full.append("D")
                else:
                    while letters[0] == "I" if letters else False:
                        full.append(letters.pop(0))
                    full += letters[:1]
                    del letters[:1]
            ends.append((cost + more + 2 * (len(turns) - len(own)), "".join(full) + "I" * n))
        assert min(ends) == enumerated(turns), turns


@pytest.mark.parametrize("turns", [1024, 3])
def test_reports(spark, monkeypatch, turns):
    monkeypatch.setattr(c, "TURNS", turns)
    rows = made(1, 120, lambda r: r.randint(1, 9)) + [(500 + k, k, "user", "x.") for k in range(0, 60)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(5)
    got = c.reports(c.damaged(df), df)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(rows) and got.count() == len({r[0] for r in rows})
    none = df.where("false")
    assert c.reports(c.damaged(none), none).count() == 0 and c.repaired(c.damaged(none)).count() == 0


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(c, "TURNS", 50)
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"Turn {k}.", f"Turn {k}.", "Again.", "cut"])) for k in range(1500)]
    rows += made(5, 20, lambda r: 4) + [(7, 9999, "user", "Same.")] * 400
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        parts = c.arranged(c.damaged(df), df).where("kind = 0 and conv_id = 7").count()
        got = {r[0]: tuple(r)[1:] for r in c.reports(c.damaged(df), df).collect()}
        turns = c.repaired(c.damaged(df)).where("conv_id = 7").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = plain(rows)
    assert parts > 2 and got == want
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == want[7][-1]
    assert SHAPE.match("".join(r.role[0] for r in turns)) and "".join(r.edit for r in turns) == want[7][-2].replace("D", "")
