"""Cache dumps by byte ranges, and the exact median by narrowing."""

import struct

import numpy as np
import pytest

from chronomesh.operators import learning as L
from chronomesh.sources import store


def dump(path, layers, heads, width, tokens, extra=0):
    body = np.random.default_rng(1).normal(size=2 * layers * tokens * heads * width).astype("<f4")
    path.write_bytes(store.KV_MAGIC + struct.pack("<4I", layers, heads, width, tokens) + b"\0" * 8 + body.tobytes()[: body.nbytes - extra])
    return body.reshape(2, layers, tokens, heads, width)


def test_dumps_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "d").mkdir()
    want = {n: dump(tmp_path / "d" / n, *shape) for n, shape in (("a.bin", (2, 3, 4, 11)), ("b.bin", (1, 1, 2, 5)), ("c.bin", (0, 1, 2, 5)))}
    df = store.read_kv_dump(spark, f"file://{tmp_path}/d", 4 * 3 * 4 * 4)  # four tokens of the first dump
    assert df.rdd.getNumPartitions() == 2 * 3 + 1
    got = df.collect()
    assert len(got) == 2 * 3 * 11 + 5
    for r in got:
        body = want[r.file.rsplit("/", 1)[1]]
        assert r.key == body[0, r.layer, r.token, r.head].tolist() and r.value == body[1, r.layer, r.token, r.head].tolist()
    (tmp_path / "e").mkdir()
    assert store.read_kv_dump(spark, str(tmp_path / "e")).count() == 0


def test_a_large_dump_has_many_partitions(spark, tmp_path):
    with (tmp_path / "big.bin").open("wb") as f:  # 3 GB of which no byte is written
        f.write(store.KV_MAGIC + struct.pack("<4I", 4, 8, 128, 100_000))
        f.truncate(store.KV_HEADER + 8 * 4 * 8 * 128 * 100_000)
    parts = store.KvReader(str(tmp_path / "big.bin")).partitions()
    assert len(parts) == 4 * -(-100_000 // 4096) and {p.last - p.first for p in parts} == {4096, 100_000 % 4096}
    batch = next(store.KvReader(str(tmp_path / "big.bin")).read(parts[-1]))
    assert batch.num_rows == 8 * (100_000 % 4096) and batch.column(5)[0].as_py() == [0.0] * 128


@pytest.mark.parametrize("bad", ["short", "magic", "cut"])
def test_bad_dumps(spark, tmp_path, bad):
    path = tmp_path / "x.bin"
    dump(path, 1, 1, 2, 3, extra=4 if bad == "cut" else 0)
    if bad != "cut":
        path.write_bytes(b"KVCACHE1" if bad == "short" else b"x" * 100)
    with pytest.raises(ValueError, match="header|no|cut|dump"):
        store.KvReader(str(path)).partitions()


@pytest.mark.parametrize("case", ["spread", "equal", "tails", "few", "none"])
def test_upper_median(spark, monkeypatch, case):
    monkeypatch.setattr(L, "FEW", 50)
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=20_001), "equal": np.r_[np.full(15_000, 2.5), rng.normal(size=9_000)], "tails": np.exp(rng.normal(size=20_000) * 60),
        "few": np.array([3.0, 1.0]), "none": np.zeros(0),
    }[case]
    rows = [(float(v),) for v in values] + [(None,)] * 9
    got = L.upper_median(spark.createDataFrame(rows, "value double").repartition(4), "value").collect()
    assert [r.median for r in got] == ([float(np.sort(values)[len(values) // 2])] if len(values) else [None])


def test_texts_and_shards(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    (tmp_path / "t" / "b.txt").write_text("three")
    got = store.corpus_text(spark, f"prose:{tmp_path}/t").orderBy("doc_seq").collect()
    assert [(r.domain, r.text) for r in got] == [("prose", "one\ntwo"), ("prose", "three")]
    for bad in ("prose", ":x", "x:"):
        with pytest.raises(ValueError, match="name:path"):
            store.corpus_text(spark, bad)
    assert store.dataset_spec("code=place/of:sub|a,b") == {"domain": "code", "place": "place/of", "subset": "sub", "columns": ["a", "b"]}
    assert store.dataset_spec("code=place")["columns"] == ["text"] and store.dataset_spec("code=place")["subset"] is None
    with pytest.raises(ValueError, match="domain=place"):
        store.dataset_spec("code")
    spark.createDataFrame([("x", "y"), ("z", None)], "a string, b string").coalesce(1).write.parquet(f"{tmp_path}/place/sub")
    texts = store.dataset_texts(spark, "code=place:sub|a,b", str(tmp_path))
    assert sorted(r.text for r in texts.collect()) == ["x\ny", "z"]
    assert [(r.domain, r.texts, r.chars) for r in store.shard_report(texts).collect()] == [("code", 2, 4)]


def test_dimension_files_and_reports(spark, tmp_path):
    import json

    words = spark.createDataFrame([(3, "cat"), (12, "dög")], "token_id bigint, word string")
    store.write_object(words, "token_id", "word", f"{tmp_path}/vocab")
    assert sorted(map(tuple, store.read_vocab(spark, f"{tmp_path}/vocab").collect())) == [(3, "cat"), (12, "dög")]
    (tmp_path / "fields.json").write_text(json.dumps({"node_fields": {"k": {"pos": [1, 2, 3], "dom_tid": 5}, "short": {"pos": [1], "dom_tid": 6}}}))
    assert [tuple(r) for r in store.read_activations(spark, f"{tmp_path}/fields.json").collect()] == [(5000, 5, 1.0, 2.0, 3.0)]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    store.write_report(rows, f"{tmp_path}/r.csv")
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/r.csv").collect() if x.value != "n,s") == ["1,a", "2,NA"]
    for form, read in (("json", spark.read.json), ("parquet", spark.read.parquet)):
        store.write_report(rows, f"{tmp_path}/r.{form}", form)
        assert sorted((r.n, r.s) for r in read(f"{tmp_path}/r.{form}").collect()) == [(1, "a"), (2, None)]
    from chronomesh.plans import query as Q

    shown = json.loads(Q.envelope("demo", "what", [("MATCH", {"rows": rows.where("n = 1")})]))
    assert shown["queries"] == [{"query": "MATCH", "result": {"rows": [{"n": 1, "s": "a"}]}}] and shown["demo"] == "demo"


def test_generators_by_their_formulas(spark):
    from chronomesh.sources import generators as G

    cache = G.sine_cache(spark, 5, 12).orderBy("token").collect()
    for r in cache:
        raw = [np.sin((1 + 0.3 * m) * r.token * 0.2) if m < 8 else 0.0 for m in range(12)]
        size = max(np.linalg.norm(raw), 1e-12)
        assert np.allclose(r.key, np.array(raw) / size) and np.allclose(r.value[:8], [0.5 + 0.3 * np.sin((1 + 0.3 * m) * r.token * 0.2 + 1) for m in range(8)])
    got = {(r.x, r.y) for r in G.julia_points(spark, 21, 30).collect()}
    for k in range(441):
        x, y = k % 21 / 20 * 3 - 1.5, k // 21 / 20 * 3 - 1.5
        z, alive = complex(x, y), True
        for _ in range(30):
            z = z * z + complex(-0.745429, 0.113008)
            if abs(z) ** 2 > 4:
                alive = False
                break
        assert ((x, y) in got) == alive
    grid = G.tensor_grid(spark, 2, 2, 1, 3)
    assert grid.nodes.count() == 12 and grid.edges.where("begin_ts = end_ts").count() == 3 * 8 and grid.edges.where("end_ts > begin_ts").count() == 8
    vectors = {r.id: r.v for r in G.attention_vectors(spark, 4, 6, 2).collect()}
    assert np.allclose(vectors[2], [np.sin(1.4 + d * 1.3) * (8 if d == 2 else 1) for d in range(6)]) and np.allclose(vectors[1][2], np.sin(0.7 + 2.6))
