import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.functions import numbers as N
from chronomesh.functions import vectors as V
from chronomesh.operators import corpus as C
from chronomesh.operators import decompose
from chronomesh.operators import tensor as K
from chronomesh.sources import generators as G
from chronomesh.sources import store
from chronomesh.streaming import events as E


def test_rotation_and_quantisation(spark):
    rows = [(k, v) for k, v in enumerate(G.xorshift_tokens(32, 16, 42))]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    back = V.hadamard(V.hadamard(F.col("v")))
    rotated = V.hadamard(V.quantized(V.hadamard(F.col("v")), 4))
    r = df.agg(F.min(V.cosine(F.col("v"), back)).alias("same"), F.avg(V.euclid(F.col("v"), V.quantized(F.col("v"), 4))).alias("plain"), F.avg(V.euclid(F.col("v"), rotated)).alias("turned")).first()
    assert r.same > 0.9999 and r.turned < r.plain


def test_outlier_matrix_errors(spark):
    m = G.outlier_matrix(spark).cache()
    assert K.frobenius(m).first().norm == pytest.approx(74.9615, abs=1e-3)
    assert decompose.svd(*decompose.dense_rows(m))[1][:2] == pytest.approx([58.21, 46.44], abs=0.01)
    errors = [K.matrix_error(m, x).first().error for x in (K.row_quantized(m), K.outlier_aware(m, 1), K.outlier_aware(m, 2))]
    assert errors == pytest.approx([0.06468, 0.00897, 0.00689], abs=2e-4)


def test_tensor_chain_norms(spark):
    h = 2**-0.5
    rows = [("product", k, [1, 2, 1], [h, h]) for k in range(4)] + [("bell", 0, [1, 2, 2], [h, 0.0, 0.0, h]), ("bell", 1, [2, 2, 1], [1.0, 0.0, 0.0, 1.0])]
    sites = spark.createDataFrame(rows, "chain string, site int, shape array<int>, data array<double>")
    assert all(r.norm_sq == pytest.approx(1.0) for r in K.chain_norm(sites).collect())
    plus = spark.createDataFrame([("q", 0, [1, 2, 1], [1.0, 0.0]), ("q", 1, [1, 2, 1], [1.0, 0.0])], sites.schema)
    turned = K.apply_gate(plus, 0, [[h, h], [h, -h]])
    bell = K.apply_two_site_gate(turned, 0, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], 2)
    assert K.chain_norm(bell).first().norm_sq == pytest.approx(1.0)
    assert K.largest_bond(bell).first().bond == 2


def test_operator_chain_is_exact_at_full_rank():
    m = np.random.default_rng(1).normal(size=(16, 16))
    assert K.operator_error(m, K.operator_chain(m, 256)) < 1e-10


def test_numbers(spark):
    assert [r.p for r in N.primes(spark, 30).orderBy("p").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert N.nth_prime(100) == 541 and N.is_prime(2**61 - 1) and not N.is_prime(2**61 + 1)
    assert N.legendre(2, 7) == 1 and N.legendre(3, 7) == -1 and N.legendre(2, 17) == 1
    assert N.zeta(spark, 2, 10_000).first().zeta == pytest.approx(math.pi**2 / 6, abs=1e-3)
    assert N.semiprime_factors(221) == (13, 17) and N.holds_13_cubed(N.monster_order())
    assert N.cyclotomic_13(0) == 1 and N.cyclotomic_13(1) == 13
    assert sum(N.real_subfield_basis()) == pytest.approx(-1) and sum(N.gaussian_periods_cubic()) == pytest.approx(-1)
    for x in N.gaussian_periods_cubic():
        assert x**3 + x**2 - 4 * x + 1 == pytest.approx(0, abs=1e-9)
    degree = N.paley(spark).groupBy("u").count().select("count").distinct().collect()
    assert [r[0] for r in degree] == [6]


def test_graph_and_cache_files(spark, tmp_path):
    g = G.causal_grid(spark, 3, 3)
    store.save_graph(g, str(tmp_path / "g"))
    again = store.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    body = np.arange(2 * 1 * 2 * 1 * 3, dtype="<f4")
    (tmp_path / "kv.bin").write_bytes(store.KV_MAGIC + struct.pack("<4I", 1, 1, 3, 2) + b"\0" * 8 + body.tobytes())
    rows = store.read_kv_dump(spark, str(tmp_path / "kv.bin")).orderBy("token").collect()
    assert [r.key for r in rows] == [[0, 1, 2], [3, 4, 5]] and rows[0].value == [6, 7, 8]
    with pytest.raises(ValueError):
        store.kv_header(b"short")
    (tmp_path / "vocab.json").write_text('{"3": "cat", "x": "no", "4": "dog"}')
    assert sorted((r.token_id, r.word) for r in store.read_vocab(spark, str(tmp_path / "vocab.json")).collect()) == [(3, "cat"), (4, "dog")]


def test_corpus_windows_cross_documents(spark):
    docs = spark.createDataFrame([("d", 1, "a b"), ("d", 2, ""), ("d", 3, "c d e f g"), ("e", 1, "a z")], "domain string, doc_seq bigint, text string")
    got = {(r.a, r.b): r.n for r in C.cooccurrence(docs).collect()}
    stream = "a b c d e f g".split()
    want = {}
    for words in (stream, ["a", "z"]):
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 6]:
                want[a, b] = want[b, a] = want.get((a, b), 0) + 1
    assert got == want


def test_stream_equals_table(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.0D as value union all select timestamp_ntz'2024-01-01 02:10:00', 'a', 2.0D").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "ev"))
    source = E.stream(spark, str(tmp_path / "ev"), "ts timestamp, event_type string, value double")
    run = E.tumbling(source, late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    run.processAllAvailable()
    run.stop()
    want = E.tumbling(spark.read.parquet(str(tmp_path / "ev"))).collect()
    assert sorted(map(tuple, spark.sql("select * from hours").collect())) == sorted(map(tuple, want))
