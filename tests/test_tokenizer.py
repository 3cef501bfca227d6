"""Byte-level pairs: merges of a plain trainer and of a library, round trips, files."""

import collections
import random

import numpy as np
import pytest
import regex

from chronomesh.operators import tokenizer as B

ODD = [(900, None, "x"), (901, "", "x"), (902, "aaaa aaaaa aaa", "x"), (903, "Don't 12,3  ½ 😀\n\n\tx é", "x"), (None, "  two", "x")]


def made(seed, n):
    rng = random.Random(seed)
    stems = "an in er on th ing ba ly de".split()
    return [(k, " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(30)) + rng.choice([".", "!", "\n"]), "x") for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(1, 60) + ODD, "doc_id bigint, text string, ids_ string").repartition(3)


@pytest.fixture(scope="module")
def trained(docs):
    return B.train(docs, 420, 5)


def plain_pieces(text):
    text = text or ""
    return regex.findall(B.PIECE, text if not text or text[0].isspace() else " " + text)


def plain_merges(texts, alphabet, size, least):
    words = collections.Counter(p for t in texts for p in plain_pieces(t))
    place = {b: 3 + k for k, b in enumerate(alphabet)}
    split = {w: [place[b] for b in w.encode()] for w in words}
    merges, first = [], 3 + len(alphabet)
    while first + len(merges) < size:
        pairs = collections.Counter()
        for w, own in split.items():
            for p in zip(own, own[1:]):
                pairs[p] += words[w]
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < least:
            break
        for w, own in split.items():
            out, k = [], 0
            while k < len(own):
                hit = tuple(own[k : k + 2]) == best
                out.append(first + len(merges) if hit else own[k])
                k += 1 + hit
            split[w] = out
        merges.append(best)
    return merges, split


def test_merges_equal_a_plain_trainers(docs, trained):
    texts = [r.text for r in docs.collect()]
    merges, split = plain_merges(texts, trained.alphabet, 420, 5)
    assert trained.merges == merges and len(merges) > 100 and trained.jobs < len(merges) / 2
    for r in trained.encode(docs).collect():
        assert list(r.ids) == [k for p in plain_pieces(r.text) for k in split[p]]


def test_a_library_reads_the_file(spark, docs, trained, tmp_path):
    from tokenizers import Tokenizer

    trained.save(spark, f"file://{tmp_path}/vocabulary")
    again = B.Tokenizer.load(spark, f"file://{tmp_path}/vocabulary")
    assert (again.specials, again.alphabet, again.merges) == (trained.specials, trained.alphabet, trained.merges)
    library = Tokenizer.from_str(trained.json())
    for r in again.encode(docs).collect():
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids


def test_round_trip(spark, docs, trained):
    for r in trained.decode(trained.encode(docs)).collect():
        assert r.decoded == (r.text or "").removeprefix(" ")
    empty = docs.where("false")
    assert trained.encode(empty).count() == 0 and B.train(empty, 300).merges == []
    other = spark.createDataFrame([(1, "ž~ an")], "doc_id bigint, text string")
    assert trained.decode(trained.encode(other)).first().decoded.endswith(" an")


def test_merging_takes_runs_from_the_left():
    symbols, word = np.array([5, 5, 5, 5, 5, 6, 5, 5]), np.array([0, 0, 0, 1, 1, 1, 2, 2])
    got = B.merge_all(symbols, word, np.array([5 << 32 | 5]), np.array([9]))
    assert got[0].tolist() == [9, 5, 9, 6, 9] and got[1].tolist() == [0, 0, 1, 1, 2]
