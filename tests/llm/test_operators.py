"""Each operator on small fixtures: against brute force, by round trip or by held-out accuracy, with odd rows among them."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronomesh.llm import common, decontaminate, huffman, imatch, language, lines, pii, pieces, quality, simhash, warc
from chronomesh.llm.words import hashed_words, shingles

ODD = [(None, None), (900, ""), (900, ""), (901, "  \n "), (902, "a"), (903, None), (904, "é漢 😀 ß\r\nx" * 3)]
SCHEMA = "doc_id bigint, text string, lang string, fp string, bucket int"


def prose(seed, n, stems="ta re mi so lu ven dor kal nim pos"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems.split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [(k, "\n".join(prose(10 * k + j, 40) for j in range(3))) for k in range(24)]
    copies = [(100 + k, base[k][1]) for k in range(4)]
    near = [(200 + k, base[k][1].replace(base[k][1].split()[50], "zzz", 1)) for k in range(6)]
    return base + copies + near + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "xx" if d and d % 2 else None, "clash", 1) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    want = union_find(200, pairs)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: want[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}


def test_linked_loses_no_link(spark):
    # items in another order at each reading, as after a lost executor
    rng = random.Random(5)
    buckets = [rng.sample(range(300), rng.choice([1, 2, 3, 8])) for _ in range(90)]
    links = {tuple(sorted(rng.sample(x, 2))) for x in buckets if len(x) > 1 for _ in range(len(x) // 2)}

    def shuffled(batches):
        order = random.SystemRandom()
        for batch in batches:
            yield batch.take(order.sample(range(len(batch)), len(batch)))

    def similar(pairs, texts):
        return spark.createDataFrame(sorted({tuple(r) for r in pairs.collect()} & links), "a bigint, b bigint")

    schema = "id bigint, keys array<bigint>, odd int"
    rows = [(x, [10**15 * k for k, ids in enumerate(buckets) if x in ids], x % 2) for x in range(300)]
    items = spark.createDataFrame(rows, schema).repartition(1).mapInArrow(shuffled, schema)
    never = {p for p in links if p[0] % 2 and p[1] % 2}
    for near, want in ((lambda a, b: F.lit(True), links), (lambda a, b: (F.col(f"{a}.odd") == 0) | (F.col(f"{b}.odd") == 0), links - never)):
        root = union_find(300, want)
        # alike items share an element; what they have besides is their own
        shared = {x: [10**6 + k for k, p in enumerate(sorted(links)) if x in p] for x in range(300)}
        of = spark.createDataFrame([(x, shared[x] or [x]) for x in range(300)], "id bigint, set array<bigint>")
        label = {r.node: r.component for r in common.linked(items, near, lambda ids: items.drop("keys").join(ids, "id", "left_semi"), similar, lambda known: of.join(known, "id", "left_semi").select("id", "set")).collect()}
        assert label == {x: root[x] for p in want for x in p}


def test_large_buckets_cost_in_proportion(spark):
    # 200 items in one bucket, of two kinds that are alike inside; pairs stay far below all
    rows = [(x, [7, 100 + x % 2, 1000 + x % 40]) for x in range(200)]
    asked = []

    def similar(pairs, texts):
        got = [tuple(r) for r in pairs.collect()]
        asked.append(len(got))
        return spark.createDataFrame([p for p in got if (p[0] - p[1]) % 2 == 0], "a bigint, b bigint")

    items = spark.createDataFrame(rows, "id bigint, keys array<bigint>")
    # sets of one kind share what the other has not
    sets = lambda known: known.select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: 10 * (F.col("id") % 2) + k).alias("set"))
    label = common.linked(items, lambda a, b: F.lit(True), lambda ids: ids, similar, sets).collect()
    assert {r.node: r.component for r in label} == {x: x % 2 for x in range(200)} and sum(asked) < 8 * 600


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, rows, empty, monkeypatch, bucket):
    import xxhash

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", t)
        own = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    root = union_find(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[k][0])
    want = sorted((str(d), p, least[r]) for (d, _), p, r in zip(rows, prints, root, strict=True))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each(docs):
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert len(kept) == len(set(kept)) and 900 in kept and not set(kept) & {100, 101, 102, 103}


def test_near_copies_of_the_stage(spark):
    import corpus_pipeline

    rows = []
    for k in range(20):
        base = prose(k, 120).split()
        rows.append((10 * k, " ".join(base)))
        for j in range(1, 6):
            near = list(base)
            for at in random.Random(100 * k + j).sample(range(120), j):
                near[at] = f"new{k}x{j}x{at}"
            rows.append((10 * k + j, " ".join(near)))
    rows += [(None, prose(500, 60)), (None, prose(501, 60)), (None, rows[0][1]), (None, ""), (990, "")]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    want = {rows[k] for k in range(len(rows)) if root[k] == k}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(want) < len(rows) - 40
    assert {t for d, t in want if d is None} == {prose(500, 60), prose(501, 60)}


def test_pigeonring_chain_is_complete():
    rng = random.Random(1)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        d = [(x >> first & (1 << size) - 1).bit_count() for first, size in simhash.SEGMENTS]
        assert any(d[i] == 0 and d[i] + d[(i + 1) % 3] <= 1 for i in range(3))


def test_lines(docs, rows, empty):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    all_lines = [(k, p, x) for k in order if rows[k][1] is not None for p, x in enumerate(rows[k][1].split("\n")) if x.strip(" ")]

    def grams(x):
        u = x.encode("utf-16-be")
        n = len(u) // 2
        return {u} if n <= 10 else {u[2 * i : 2 * i + 10] for i in range(n - 4)}

    sets = [grams(x) for _, _, x in all_lines]
    root = union_find(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    first = {(k, p) for n, (k, p, _) in enumerate(all_lines) if root[n] == n}
    got = {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()}
    want = {(rows[k][0], None if rows[k][1] is None else "\n".join(x for p, x in enumerate(rows[k][1].split("\n")) if not x.strip(" ") or (k, p) in first)) for k in range(len(rows))}
    assert got == want
    assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(empty).count() == 0


def test_lines_of_one_template(spark):
    # every other line is an edited copy; all share most of their text, so all fall into the same buckets
    rng, rows = random.Random(3), []
    head = prose(12, 40)[:100]
    for k in range(150):
        own = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(14, 18)))
        rows += [(2 * k, head + own), (2 * k + 1, head + own[:5] + "#" + own[6:])]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    root = union_find(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id for r in kept if r.text} == {k for k in range(len(rows)) if root[k] == k}


def test_prefix_keys_lose_no_pair(spark):
    rng = random.Random(6)
    sets = [[rng.randrange(40) for _ in range(rng.randint(1, 25))] for _ in range(120)]
    sets += [s[:-1] + [99] for s in sets[:60]]
    rows = common.prefix_keys(spark.createDataFrame(list(enumerate(sets)), "id bigint, set array<bigint>")).collect()
    held = {}
    for r in rows:
        held.setdefault(r.bucket, set()).add(r.id)
    met = {p for ids in held.values() for p in itertools.combinations(sorted(ids), 2)}
    alike = {(i, j) for i, j in itertools.combinations(range(180), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert alike <= met and len(alike) > 30 and len(met) < 180 * 179 / 3


def test_lines_with_one_edit(spark):
    rng, rows, want = random.Random(8), [], set()
    for k in range(120):
        base = prose(7000 + k, 60)[: 50 + k % 50]
        at = rng.randrange(8, len(base) - 8)
        rows.append((2 * k, base))
        rows.append((2 * k + 1, base[:at] + "#" + base[at + 1 :]))
        a, b = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (rows[-2][1], rows[-1][1]))
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id for r in kept if r.text} == want and len(want) < 125


def test_decontamination(spark, docs, rows, empty):
    whole = rows[3][1].split()
    items = [(1, " ".join(whole[10:40])), (2, "X, ".join(whole[45:70]).replace("X", "")), (3, prose(999, 30)), (4, None), (5, "one two")]
    long = (950, prose(5, 4000) + " " + " ".join(whole[10:38]) + " " + prose(6, 4000))
    every = docs.union(spark.createDataFrame([(*long, None, "", 0)], SCHEMA))
    table = spark.createDataFrame(items, "item_id bigint, text string")

    def grams(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(d, i) for d, t in [*rows, long] for i, q in items if grams(q) and len(grams(q) & grams(t)) >= 0.8 * len(grams(q))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(every, table).collect()} == want and (950, 1) in want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(every, table).collect()}
    assert kept == {d for d, _ in [*rows, long]} - {d for d, _ in want}
    assert decontaminate.find_items(empty, table).count() == 0
    assert decontaminate.find_items(docs, table.where("false")).count() == 0


def test_null_keys_and_short_items(spark):
    leak = prose(31, 30)
    rows = [(None, prose(32, 50) + " " + leak), (None, prose(33, 50)), (1, prose(34, 20) + " qx zw " + prose(35, 20)), (2, prose(36, 40)), (3, "qx zw")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(None, leak), (7, "qx zw"), (8, "zw qx")], "item_id bigint, text string")
    got = decontaminate.find_items(df, items).collect()
    assert sorted(map(str, [(r.doc_id, r.item_id) for r in got])) == ["(1, 7)", "(3, 7)", "(None, None)"]
    assert {r.text for r in decontaminate.drop_contaminated(df, items).collect()} == {rows[1][1], rows[3][1]}
    taught = [(k, prose(k, 30), "aa") for k in range(60)] + [(None, prose(99, 30), None), (None, "12 34 !", None)]
    kept = language.keep_known(spark.createDataFrame(taught, "doc_id bigint, text string, lang string")).collect()
    assert [r.text for r in kept if r.doc_id is None] == [prose(99, 30)]


def test_word_hashes():
    raw = "the fox, the é1 fox".encode()
    value, start, stop = hashed_words(raw)
    assert [raw[a:b].decode() for a, b in zip(start, stop, strict=True)] == ["the", "fox", "the", "é1", "fox"]
    assert value[0] == value[2] and value[1] == value[4] and len(set(value.tolist())) == 3
    assert len(shingles(value, 5)) == 1 and len(shingles(value[:3], 5)) == 0


def test_pii(spark, empty):
    def plain(t):
        out = []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")[:4]) if kind == "ip" else True,
                        "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if good:
                    out.append((m.start(), kind, m.end()))
        return sorted(out, key=lambda s: (s[0], pii.ORDER[s[1]]))

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789" * 2 + ".-+ ()@ab%") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("9" * 200_000 + "." + "%" * 200_000) == []
    model = pii.train(300, 2)
    rng = random.Random(77)
    made = [pii.sentence(rng) for _ in range(60)]
    gold = {(k, a, b, y) for k, (_, g) in enumerate(made) for (a, b), y in g.items()}
    got = {(k, a, b, pii.TYPES.index(y)) for k, (t, _) in enumerate(made) for a, b, y in model.best(t)}
    assert len(gold & got) > 0.95 * max(len(gold), len(got))
    secret = "7b" * 20
    df = spark.createDataFrame([(1, f'é token = "{secret}" to a.b@c.de and +1 (187) 555-8851.'), (2, None), (None, "")], "doc_id bigint, text string")
    by = {r.doc_id: r for r in pii.find_pii(df, model).collect()}
    assert by[1].spans == "secret:11:51,email:56:64,phone:69:86"
    assert (by[1].n_email, by[1].n_phone, by[2].spans) == (1, 1, "")
    base = ",".join(f"{k}:{s}:{e}" for s, k, e in plain(df.first().text))
    assert by[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find_pii(empty, model).count() == 0


def test_pii_segments():
    import time

    model = pii.train(300, 2)
    letters = "".join(random.Random(3).choice("abcdefghijk") for _ in range(80))
    for own in (letters + "7a", letters[:60] + "7", "7a" + letters):
        assert model.best(f'api_key = "{own}"') == [(11, 11 + len(own), "secret")]

    def every(i, n, starts):
        if i == n:
            yield []
            return
        for k, j in starts[i]:
            for rest in every(j, n, starts):
                yield [k, *rest]

    rng = random.Random(11)
    pieces_of = ["call ", "0123 555 ", "12-34 ", "key: ", "ab12" * 5, " x (at) y.org ", "a@b.c1 ", "(187) 555-8851 ", ". ", "\n", "77 ", "4111 1111 1111 1111 "]
    for _ in range(60):
        text = "".join(rng.choice(pieces_of) for _ in range(3))
        spans, ranges, features, typed = pii.segments(text)
        if len(spans) > 14:
            continue
        s, n, kinds = model.scores(ranges, features, typed), len(spans), len(pii.TYPES)
        starts = [[(k, j) for k, (i, j) in enumerate(ranges) if i == at] for at in range(n)]
        best, chosen = -np.inf, None
        for way in every(0, n, starts):
            open_types = [range(kinds) if typed[k] else [0] for k in way]
            for ys in itertools.product(*[[y for y in c if s[k, y] > -np.inf] for k, c in zip(way, open_types, strict=True)]):
                total = sum(s[k, y] for k, y in zip(way, ys, strict=True)) + sum(model.after[a, b] for a, b in zip((0, *ys), ys))
                if total > best:
                    best, chosen = total, [(spans[ranges[k][0]][0], spans[ranges[k][1] - 1][1], pii.TYPES[y]) for k, y in zip(way, ys, strict=True) if y]
        assert model.best(text) == chosen
    took = []
    for n in (1500, 6000):
        began = time.time()
        text = "123 45 678 " * n
        pii.added_spans(text, pii.base_spans(text), model)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1  # in proportion to the text


def plain_imatch(texts):
    """Fingerprints by the definition, with the library's hash."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word_hash = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    long_hash = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    own = {t: {word_hash(w) for w in re.findall(r"[^\W_]+", t.lower())} for t in texts}
    held = {}
    for t in texts:
        for x in own[t]:
            held[x] = held.get(x, 0) + 1
    least, most = max(2.0, imatch.LEAST_SHARE * len(texts)), max(2.0, imatch.MOST_SHARE * len(texts))
    words = {x for x, n in held.items() if least <= n <= most}

    def digest(t):
        every = {word_hash(w) for w in re.findall(r"[^\W_]+", t.lower())}
        out = []
        for seed, rate in imatch.SUBSETS:
            h, some = 42, False
            for x in sorted(every & words or every):
                if xxhash.xxh64_intdigest(struct.pack("<i", seed), long_hash(x, 42)) & (1 << rate) - 1 == 0:
                    h, some = long_hash(x, h), True
            out.append(h & 0xFFFFFFFF | 1 if some else 0)
        return out

    return digest


def test_imatch_equals_the_definition(spark, rows):
    own = sorted((r for r in rows if r[0] is not None and r[0] < 900), key=lambda r: -r[0])
    digest = plain_imatch([t for _, t in own])
    df = spark.createDataFrame(own, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}

    def alike(a, b):
        either = [x or y for x, y in zip(a, b)]
        return sum(x != 0 and x == y for x, y in zip(a, b)) / sum(map(bool, either)) if any(either) else 1.0

    for k, (d, t) in enumerate(own):
        after = own[(k + 1) % len(own)][1]
        half = len(t) // 2
        a, b, c = digest(t), digest(t[: len(t) - half] + after[:half]), digest(after)
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:08x}" for x in v) for v in (a, b))
        assert abs(r.near_edited - alike(a, b)) < 1e-12 and abs(r.near_next - alike(a, c)) < 1e-12


@pytest.mark.parametrize("limit", [200_000, -1])
def test_imatch(docs, rows, empty, monkeypatch, limit):
    monkeypatch.setattr(imatch, "LITERAL_TERMS", limit)
    got = imatch.fingerprints(docs.where("doc_id < 900")).collect()
    own = sorted((r for r in rows if r[0] is not None and r[0] < 900), key=lambda r: -r[0])
    by = {r.doc_id: r for r in got}
    for k, (d, t) in enumerate(own):
        half = len(t) // 2
        edited = t[: len(t) - half] + own[(k + 1) % len(own)][1][:half]
        assert by[d].n_chars == len(t) and by[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(by[100 + k].fingerprint == by[k].fingerprint for k in range(4))
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])
    assert imatch.fingerprints(docs).count() == len(rows) and imatch.fingerprints(empty).count() == 0


def test_language(spark, empty):
    stems = {"aa": "ta re mi so lu", "bb": "xu qo zik wam jeb", "cc": "éta ñor ßul öde çim"}
    rows = [(k, prose(k, 30, stems[lang]), lang) for k in range(240) for lang in [list(stems)[k % 3]]]
    df = spark.createDataFrame(rows + [(500, None, "aa"), (501, "12 34 !", None), (502, "", None), (503, stems["bb"] * 20_000, None)], "doc_id bigint, text string, lang string")
    uri = language.trained(df)
    got = {r.doc_id: r for r in language.predict(df, uri).collect()}
    held = [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and all(got[d].lang_pred == rows[d][2] and 0 <= got[d].score <= 1 for d in held)
    assert [got[d].lang_pred for d in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    assert {r.doc_id for r in language.keep_known(df).collect()} == set(range(240)) | {503}
    assert language.predict(empty, language.trained(empty)).count() == 0
    model = language.Model.load(uri)
    raw = language.encoded(rows[0][1])
    assert model.bits([raw])[0].argmin() == 0


class PlainPpm:
    """Method C without exclusion, by dictionaries."""

    def __init__(self, texts):
        self.counts = {}
        for raw in map(language.encoded, texts):
            full = b"\n" * language.ORDER + raw
            for at in range(language.ORDER, len(full)):
                for k in range(language.ORDER + 1):
                    own = self.counts.setdefault(full[at - k : at], {})
                    own[full[at]] = own.get(full[at], 0) + 1

    def bits(self, raw):
        full, total = b"\n" * language.ORDER + raw, 0.0
        for at in range(language.ORDER, len(full)):
            for k in range(language.ORDER, -2, -1):
                own = self.counts.get(full[at - k : at], {}) if k >= 0 else None
                if own is None:
                    total += 8
                elif full[at] in own:
                    total += np.log2((sum(own.values()) + len(own)) / own[full[at]])
                    break
                elif own:
                    total += np.log2((sum(own.values()) + len(own)) / len(own))
        return total


def test_number_signs_are_no_letters():
    assert not language.has_letter("²½ⅷ① 12_ !") and not language.has_letter("")
    assert all(language.has_letter(t) for t in ("²a", "ß", "中", "ª", "1é"))


def test_language_code_lengths(spark):
    stems = {"aa": "ta re mi so lu", "bb": "xu qo zik wam jeb", "cc": "éta ñor ßul öde çim"}
    taught = {lang: [prose(100 * n + k, 12, s) for k in range(5)] for n, (lang, s) in enumerate(stems.items())}
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1][:15]
    flat = [(t, lang) for lang, texts in taught.items() for t in texts]
    df = spark.createDataFrame([(d, t, lang) for d, (t, lang) in zip(held, flat, strict=True)], "doc_id bigint, text string, lang string")
    model = language.train(df)
    tests = [language.encoded(x) for x in (prose(7, 8, stems["bb"]), "Été ñor 42 qo", "zzz", flat[0][0])]
    want = [[PlainPpm(taught[lang]).bits(raw) for lang in model.langs] for raw in tests]
    assert np.allclose(model.bits(tests), want, rtol=1e-4)


def test_token_files(docs, rows, empty, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["\x1c a\x85b\xa0c²½ ª", "<|endoftext|>x don't ΣΑΣ", "é Ǆ ﬁ"]
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(600 + k, t) for k, t in enumerate(odd)], "doc_id bigint, text string"))
    tokens = common.stored(huffman.tokenize(every, path), "t")[0]
    kind = huffman.id_type(path)
    lengths = huffman.code_lengths(huffman.count_ids(tokens, kind))
    manifest = common.stored(huffman.write_tokens(tokens, kind, lengths, common.scratch(spark, "f")), "m")[0]
    got = sorted(huffman.read_tokens(manifest, lengths).collect(), key=lambda r: r.start)
    order = sorted(rows + [(600 + k, t) for k, t in enumerate(odd)], key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [huffman.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.count_ids(huffman.tokenize(empty, path), kind).sum() == 0


def test_huffman_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    counts = np.concatenate([1 << np.arange(30), rng.integers(0, 50, 300)])
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.MAX_LENGTH and (lengths > 0).sum() == (counts > 0).sum() and (2.0**-used).sum() == 1
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1] and huffman.code_lengths(np.zeros(3, int)).sum() == 0


def test_pieces(spark, rows, empty, monkeypatch):
    import sentencepiece

    for name, value in (("GIANT", 600), ("CHUNK", 90), ("GROUP", 3)):
        monkeypatch.setattr(pieces, name, value)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    every = rows[:12] + ODD + [(700, "a" * 900), (700, " " * 700 + "x"), (701, "漢字①\n\t" * 150)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in every], "doc_id bigint, text string, doc string")
    got = pieces.encode(df, path)
    assert all(list(r.ids) == library.encode(r.text or "") for r in got.collect())
    assert pieces.encode(df, path, pieces.DIGESTS, pieces.digests).where("round_trip").count() == len(every)
    assert pieces.encode(empty, path).count() == 0


def test_quality(spark, empty):
    bad, poor = ["vilezzz", "nastyqqq"], "%%% ### "
    text = lambda k, g: prose(k, 60) + (" " + bad[k % 2] if g == 0 else "") + (poor * 20 if g == 1 else "")
    rows = [(k, text(k, k % 3), k % 3) for k in range(300)]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(None, None), (400, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(g == 2), int(g == 0)) for d, _, g in rows if d < 200] + [(200, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [(d, g) for d, _, g in rows if d >= 200]
    assert np.mean([got[d].selected == (g == 2) for d, g in held]) > 0.95
    assert len(got) == 302 and quality.score(empty, quality.train(df, labels.where("false"))).count() == 0


def test_quality_features_are_of_the_text_alone():
    texts = ["hello world", "%%% ### $$$ x", None, "", "!!! At first", "plain " * 9, "\n###\n", "a %%%"]
    assert [x.tolist() for x in quality.features(texts)] == [quality.features([t])[0].tolist() for t in texts]
    assert len(quality.features(["!!! At first"])[0]) > len(quality.features(["At first"])[0])


def test_quality_fit_is_a_maximum():
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 3, 240)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 4), [50 + g] if rng.random() < 0.8 else [50]])) for g in grade]
    model = quality.Ordinal.fit(rows, grade, 3)
    used = np.flatnonzero(model.weights)

    def loss(weights, thresholds):  # by the definition, one document after the other
        total = quality.RIDGE * float((weights[used] ** 2).sum()) / 2
        for r, g in zip(rows, grade, strict=True):
            below = [0.0, *(1 / (1 + np.exp(-(t - weights[r].sum()))) for t in thresholds), 1.0]
            total -= np.log(max(below[g + 1] - below[g], 1e-12)) / len(rows)
        return total

    best = loss(model.weights.astype(float), model.thresholds)
    for _ in range(30):
        weights = model.weights.astype(float).copy()
        weights[used] += rng.normal(0, 0.05, len(used))
        assert loss(weights, model.thresholds + rng.normal(0, 0.05, 2)) > best - 1e-4
    assert len(used) and (np.diff(model.thresholds) > 0).all()


def test_warc(spark):
    pages = [(k, f"http://x/{k}", f"<p>{prose(k % 7, 400)}</p>") for k in range(60)] + [(70, None, None), (71, "a\r\nb", ""), (None, "u", ""), (72, "big", "é" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    manifest = common.stored(warc.write_archives(df, common.scratch(spark, "w")), "m")[0]
    first = {}
    for d, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", d)
    want = sorted((str(d), len((h or "").encode()), warc.base32_sha1((h or "").encode()), "revisit" if d is not None and d > first[h or ""] else "response", first[h or ""] if d is not None and d > first[h or ""] else None) for d, _, h in pages)
    for split in (500, 4 << 20):
        got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, split).collect())
        assert got == want
    none = common.stored(warc.write_archives(df.where("false"), common.scratch(spark, "w")), "m")[0]
    assert warc.read_archives(none).count() == 0


def plain_language(rows):
    texts = {}
    ranked = sorted((r for r in rows if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1), key=lambda r: r["doc_id"])
    for r in ranked:
        texts.setdefault(r["lang"], []).append(r["text"])
    assert all(len(t) <= language.SAMPLE for t in texts.values())
    models = [PlainPpm(t) for t in texts.values()]

    def known(t):
        raw = language.encoded(t or "")
        return any(c.isalpha() for c in t or "") and min(m.bits(raw) for m in models) <= language.MAX_BITS * len(raw)

    return [r for r in rows if known(r["text"])]


def first_of_groups(sets, least=0.8):
    """Of sets in their order, whether each is the first of those that links of this likeness reach."""
    where = {}
    for k, own in enumerate(sets):
        for x in own:
            where.setdefault(x, []).append(k)
    pairs = []
    for k, own in enumerate(sets):
        common = {}
        for x in own:
            for j in where[x]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        pairs += [(j, k) for j, n in common.items() if n >= least * (len(own) + len(sets[j]) - n)]
    root = union_find(len(sets), pairs)
    return [root[k] == k for k in range(len(sets))]


def plain_lines(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    every = [(k, p, x) for k, r in enumerate(rows) for p, x in enumerate((r["text"] or "").split("\n")) if x.strip(" ")]
    first, distinct = {}, []
    for k, p, x in every:
        if x not in first:
            first[x] = (k, p)
            distinct.append(x)
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} if len(x) > 10 else {x} for x in distinct]
    kept = {first[x] for x, good in zip(distinct, first_of_groups(grams), strict=True) if good}
    return [r | {"text": "\n".join(x for p, x in enumerate(r["text"].split("\n")) if not x.strip(" ") or (k, p) in kept)} for k, r in enumerate(rows)]


def plain_near(rows):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r for r, good in zip(rows, first_of_groups([grams(r["text"]) for r in rows]), strict=True) if good]


def plain_decontamination(rows, items):
    def grams(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    wanted = [g for g in map(grams, items) if g]
    return [r for r in rows for own in [grams(r["text"])] if not any(len(g & own) >= 0.8 * len(g) for g in wanted)]


def test_pipeline_equals_the_plain_stages(spark):
    import corpus_pipeline
    import sentencepiece

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {
        "language_id": plain_language, "line_dedup": plain_lines, "near_dedup": plain_near,
        "decontamination": lambda r: plain_decontamination(r, items), "tokens": lambda r: [x | {"ids": library.encode(x["text"])} for x in r],
    }
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, seen, d), name)[0]
        assert out.columns[: len(docs.columns)] == docs.columns
        want = plain[name]([r.asDict() for r in seen.collect()])
        key = ["doc_id", "text", *(["ids"] if name == "tokens" else [])]
        got, want = (sorted(tuple(str(r[c]) for c in key) for r in x) for x in (out.collect(), want))
        if name == "line_dedup":  # candidates are those of MinHash: a link that they miss leaves a line, and none goes for it
            count = lambda rows: sum(len(r[1].split("\n")) for r in rows if r[1])
            before = count([(r.doc_id, r.text) for r in seen.collect()])
            assert [r[0] for r in got] == [r[0] for r in want]
            assert all(not set(w[1].split("\n")) - set(g[1].split("\n")) - {""} for g, w in zip(got, want, strict=True))
            assert before - count(got) >= 0.98 * (before - count(want))
        else:
            assert got == want, name
        seen = out
    assert seen.count() < docs.count()
