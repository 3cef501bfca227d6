"""Queries of the whole job, beside those whose SQL states a part of it."""

import math
import random

import duckdb
import pytest

from chronomesh.plans import catalog

D = "/root/testdata/sf0.001"


def both(spark, name, d=D):
    db = duckdb.connect()
    for table in ("documents", "embeddings") if d == D else ("documents",):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet')")
    want = db.execute(catalog.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in catalog.queries()[name](spark, d).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(map(tuple, want)), strict=True):
        assert all(x == y or isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4) for x, y in zip(a, b, strict=True))
    return got


def test_product_norm_of_all_vectors(spark):
    n = spark.read.parquet(f"{D}/embeddings.parquet").select("label").distinct().count()
    assert len(both(spark, "mps_product_log_norm")) == n


def test_rotation_has_all_coordinates(spark):
    assert {i for _, i, _ in both(spark, "hadamard_rotate_all")} == set(range(64))


def test_pmi_of_the_whole_vocabulary(spark, tmp_path):
    rows = []
    for k in range(5):
        words = [f"w{n}" for n in range(2100)]
        random.Random(k).shuffle(words)
        rows.append((k, " ".join(words), "xx"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").toPandas().to_parquet(tmp_path / "documents.parquet")
    for name in ("pmi_all", "topk_pmi_all"):
        assert {r[0] for r in both(spark, name, str(tmp_path))} == set(range(2100))


def test_attention_has_all_dimensions(spark):
    assert {dim for _, dim, _ in both(spark, "dense_attention_all")} == set(range(64))


def test_walkers_take_20_episodes_of_30_steps(spark):
    assert max(step for _, step, _ in both(spark, "random_walk_all")) == 30
    got = catalog.queries()["walker_paths"](spark, D).collect()
    assert {r.walker for r in got} == set(range(20)) and max(len(r.path.split()) for r in got) > 5
