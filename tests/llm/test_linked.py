"""Pairs inside buckets of alike items."""

from pyspark.sql import functions as F

from chronomesh.llm import common


def test_pairs_that_are_not_near_stay_in_the_join(spark):
    """A bucket of members in many parts: only near pairs leave the join by bucket, and every link between near ones is found."""
    numbers = [0b0001, 0b0011, 0b11110000, 0b11100000, 0xFF0000, 0xFFFF00000000]
    items = spark.createDataFrame([(k, [7], v) for k, v in enumerate(numbers)], "id bigint, keys array<bigint>, fp bigint")
    plans = []

    def near(a, b):
        return F.bit_count(F.col(a + ".fp").bitwiseXOR(F.col(b + ".fp"))) <= 2

    def similar(pairs, known):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return common.stored(pairs, "similar")[0]  # what is near is alike

    def texts(ids):
        return common.stored(items.drop("keys").join(ids, "id", "left_semi"), "texts")[0]

    def sets(known):
        return known.select("id", F.array("id").alias("set"))

    found = {r.node: r.component for r in common.linked(items, near, texts, similar, sets).collect()}
    label = [found.get(k, k) for k in range(len(numbers))]
    assert label == [0, 0, 2, 2, 4, 5]
    assert any("Join Inner" in line and "bucket" in line and "bit_count" in line for plan in plans for line in plan.splitlines())
