"""Toxicity: the noisy-or and its gradient by definition, held-out documents, places of offending sentences, odd rows."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from chronomesh.llm import toxicity

SCHEMA = "doc_id bigint, text string, score string, toxic int"
WORDS = [a + b for a in "ta re mi so lu ven dor kal".split() for b in "nim pos gra stel um".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", "!", "\n", ","]) if rng.random() < 0.15 else "") for _ in range(n))


def made(n, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        text, bad = prose(rng, rng.choice([5, 40, 400])), int(rng.random() < 0.2)
        if bad:
            at = rng.randrange(len(text)) if len(text) > 10 else 0
            at = text.rfind(" ", 0, at) + 1
            text = text[:at] + rng.choice(["blockhead ", "Nitwit ", "quarx" + rng.choice("abcdefgh") + "in "]) + text[at:]
        rows.append((k, text, "clash", 9))
        labels.append((k, bad))
    return rows, labels


def test_gradient():
    rng = np.random.default_rng(0)
    own = toxicity.Bags(np.array([1, 0, 1]), np.array([0, 0, 1, 2]), np.array([3, 1, 2, 1]), np.array([0, 2, 1, 3]), np.array([0, 1, 1, 0, 0, 2]))
    p = rng.normal(size=4)
    eta = [[(3, p[3]), (1, p[0] + p[1] + p[3])], [(2, p[1] + p[3])], [(1, 2 * p[0] + p[2] + p[3])]]
    one = [1 - math.prod((1 - 1 / (1 + math.exp(-e))) ** n for n, e in bag) for bag in eta]
    one = [toxicity.NOISE + (1 - 2 * toxicity.NOISE) * q for q in one]
    want = -(math.log(one[0]) + math.log(1 - one[1]) + math.log(one[2])) / 3 + 0.5 * toxicity.RIDGE * float(p[:3] @ p[:3])
    loss, slope = own.nll(p)
    assert math.isclose(loss, want)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert math.isclose((own.nll(p + step)[0] - own.nll(p - step)[0]) / 2e-6, slope[k], abs_tol=1e-7)


def test_noisy_or_by_definition():
    table = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), -3.0)
    texts = ["Fool me. Once? no\nyes", "", None, "...", "FOOL fool", "é fools"]
    parts = [[s for s in re.split(r"[.!?\n]", t or "") if re.search(r"\w", s)] for t in texts]
    for at, to, w in toxicity.runs(texts):
        for word in ("fool",):
            (k, _, one), = toxicity.runs([word])
            table.table[one.feature[0, 0]] = 2.5
        got = table.documents(w, table.sentences(w), to - at)
    for t, own, score in zip(texts, parts, got, strict=True):
        etas = [-3.0 + 2.5 * sum(x.lower() == "fool" for x in re.findall(r"\w+", s)) for s in own] or [-3.0]
        assert math.isclose(score, 1 - math.prod(1 / (1 + math.exp(e)) for e in etas)), t


def test_held_out_and_places(spark):
    rows, labels = made(1500)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame([(*x, 7) for x in labels] + [(None, 1, 0), (5, None, 0), (10**9, 1, 0)], "doc_id bigint, toxic int, text int")
    model = toxicity.train(docs, marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    truth, text = dict(labels), {r[0]: r[1] for r in rows}
    held = [k for k in truth if got[k].held]
    assert len(held) > 400
    assert sum((got[k].score >= toxicity.TOXIC) == truth[k] for k in held) >= 0.99 * len(held)
    for k in held:
        places = [text[k][s.start : s.end] for s in got[k].offending]
        assert all(re.search("blockhead|Nitwit|quarx", p) and not re.search(r"[.!?\n]\S", p) for p in places) or got[k].score < toxicity.TOXIC
        assert bool(places) == bool(truth[k]) or (got[k].score >= toxicity.TOXIC) != truth[k]


def test_odd_rows(spark):
    rows, labels = made(300, 2)
    odd = [(None, None), (800, ""), (801, None), (802, " \n. "), (803, "a" * 200_000), (804, "Nitwit! " + prose(random.Random(3), 30_000)), (804, "again")]
    docs = spark.createDataFrame(rows + [(k, t, "", 0) for k, t in odd], SCHEMA)
    marks = spark.createDataFrame(labels + labels[:9], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).where("doc_id >= 800 or doc_id is null").collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 804}
    assert by[800].score == by[801].score == by[802].score == by[None].score < 0.1
    assert max(r.score for r in got if r.doc_id == 804) >= toxicity.TOXIC
    none = toxicity.train(docs, marks.where("toxic = 0"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 0.1
    assert toxicity.score(docs.where("false"), none).count() == 0 and toxicity.train(docs.where("false"), marks.where("false")).bias < -10
