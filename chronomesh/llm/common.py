"""What the operators of this package share: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """A number of a document's doc_id and text that is never null: rows are told apart by it where doc_ids are null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` has not."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


_LOCAL: dict[str, str] = {}  # a temporary folder for each application on a local master


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local master gets a temporary folder, and a cluster
    the warehouse if that is no folder of each machine's own; else there is no shared store, and this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chronomesh-")
        base = _LOCAL[app]
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise RuntimeError("spark.checkpoint.dir is unset: there is no folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it back: cuts lineage, outlives executors.

    The shuffle files behind the table are removed once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(uri: str):
    """(pyarrow file system, path) of a file or folder in shared storage."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def components(edges: DataFrame, a: str = "a", b: str = "b", paths: list[str] | None = None) -> DataFrame:
    """Distributed union-find: (node, component), component being the smallest node reached; its table's path is added to ``paths``.

    ``edges`` joins two long columns; nodes without an edge are not returned.
    Each round draws a new random order, points every node at the first of its
    neighbours and itself, then at what that one points at, and contracts the edges to the nodes pointed at.  Those
    are an expected three quarters of the nodes at most, whatever the graph, so
    rounds grow with the logarithm of the largest component.  Every round is an
    aggregate with map-side combine and equi-joins whose one side has a row a
    node: a hub with a third of all edges is combined before the shuffle, and AQE
    may split its side of a join.  Nothing but "is it empty" comes to the driver.
    """
    spark, labels = edges.sparkSession, paths
    live, path = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )
    paths = [path]
    levels: list[DataFrame] = []
    while not live.isEmpty():
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(levels)))  # noqa: B023, E731
        up = (
            live.select(F.col("a").alias("node"), F.col("b").alias("to"))
            .union(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
            .groupBy("node").agg(F.min_by("to", order("to")).alias("to"))
            .select("node", F.when(order("to") < order("node"), F.col("to")).otherwise(F.col("node")).alias("to"))
        )
        over = up.select(F.col("node").alias("to"), F.col("to").alias("over"))
        up, path = stored(up.join(over, "to").select("node", F.col("over").alias("to")), "up")
        paths.append(path)
        levels.append(up)
        ends = live
        for c in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(c), F.col("to").alias("_" + c)), c)
        live, path = stored(
            ends.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
            .where("a <> b").distinct(), "edges"
        )
        paths.append(path)
    if not levels:
        return spark.createDataFrame([], "node bigint, component bigint")
    # from the last level down: a node's root is that of the node it points at
    root = levels[-1].withColumnRenamed("to", "root")
    for up in reversed(levels[:-1]):
        root = (
            up.join(root.withColumnRenamed("node", "to"), "to", "left")
            .select("node", F.coalesce("root", "to").alias("root"))
        )
    root, path = stored(root, "roots")
    paths.append(path)
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    label, path = stored(root.join(least, "root").select("node", "component"), "labels")
    if labels is not None:
        labels.append(path)
    for path in paths:
        drop_path(spark, path)
    return label


FEW = 32  # pairs for each member that a bucket may compare all of
HUBS = 4  # members that a bucket with more is compared with first


def linked(
    items: DataFrame, near: Callable[[str, str], Column], texts: Callable[[DataFrame], DataFrame], similar: Callable[[DataFrame, DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(node, component) of the items (id, keys, ...) that are alike and share a key.

    ``texts`` stores the text of given ids, with the other columns of the items, and ``sets`` gives (id, set array<bigint>) of such texts.
    ``similar`` stores those of its pairs (a, b) that are alike, with a likeness of their sets of four fifths at least; only pairs
    that are ``near`` by the items' other columns get there.

    A bucket's members are first compared with the one of the largest id alone, its hub.  Where that leaves members in
    different components, only pairs across components matter.  A bucket with at most FEW of them a member compares them
    all.  One with more compares its members with HUBS others, drawn by the hash of their ids, which is enough for near copies; if
    components still differ by more pairs than FEW a member, its members get new keys, which alike sets share without fail
    (``prefix_keys``), and are compared with a hub and then across components again.  So no link inside a bucket is lost, and
    groups of copies cost in proportion to their size.
    """
    spark = items.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        paths.append(path)
        return df

    members = items.select("id", F.explode("keys").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("hub")).where("low < hub").select("bucket", "hub")
    met = kept(members.join(hubs.hint("shuffle_hash"), "bucket").where("id <> hub"), "met")
    if met.isEmpty():
        drop_path(spark, paths[0])
        return spark.createDataFrame([], "node bigint, component bigint")
    known = texts(met.select("id").union(met.select(F.col("hub").alias("id"))).distinct())
    names = items.drop("keys").columns
    marks = known.select("id", F.struct(*names).alias("mark"))

    def once(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def close(pairs: DataFrame) -> DataFrame:
        """The ``near`` ones of pairs with hubs, a few a member."""
        pairs = once(pairs)
        for c in ("a", "b"):
            pairs = pairs.join(marks.toDF(c, "of_" + c), c)
        return pairs.where(near("of_a", "of_b")).select("a", "b")

    def mixed(rows: DataFrame, label: DataFrame, name: str) -> DataFrame:
        """(bucket, id, part, largest, few, hubs, mark) of the buckets (bucket, id) whose members are in several parts, stored."""
        rows = rows.join(label.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("part"))
        drawn = [F.max(F.struct(F.xxhash64("id", F.lit(k)), "id")) for k in range(HUBS)]
        each = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"), *[d.alias(f"h{k}") for k, d in enumerate(drawn)])
        n = F.sum("n").cast("double")
        size = each.groupBy("bucket").agg(
            F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("largest"), (n * n - F.sum(F.col("n").cast("double") * F.col("n")) <= 2 * FEW * n).alias("few"),
            *[F.max(f"h{k}").alias(f"h{k}") for k in range(HUBS)],
        ).where("parts > 1").select("bucket", F.col("largest.part").alias("largest"), "few", F.array_distinct(F.array(*[f"h{k}.id" for k in range(HUBS)])).alias("hubs"))
        return kept(rows.join(size, "bucket").join(marks, "id"), name)

    def across(rows: DataFrame) -> DataFrame:
        """The ``near`` pairs of a bucket's members in different parts; one side is without the largest part, so few more are looked at.

        Members bring what ``near`` asks for, so pairs that are not near never leave the join.
        """
        left = rows.where("part <> largest").select("bucket", F.col("id").alias("a"), F.col("part").alias("p"), F.col("mark").alias("of_a"))
        right = rows.select("bucket", F.col("id").alias("b"), F.col("part").alias("q"), (F.col("part") == F.col("largest")).alias("top"), F.col("mark").alias("of_b"))
        return left.join(right, "bucket").where(F.expr("p <> q and (top or p < q)") & near("of_a", "of_b")).select("a", "b")

    def with_hubs(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("a"), F.explode("hubs").alias("b")).where("a <> b")

    links = similar(close(met.select(F.col("id").alias("a"), F.col("hub").alias("b"))), known)

    def grown(pairs: DataFrame) -> None:
        """Joins the components that alike ones of the near ``pairs`` link: a search over components, not over all links anew."""
        nonlocal label
        more = similar(once(pairs), known)
        if more.isEmpty():
            return
        ends = more
        for c in ("a", "b"):
            ends = ends.join(label.select(F.col("node").alias(c), F.col("component").alias("of_" + c)), c, "left")
        ends = kept(ends.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "ends")
        top = components(ends, "of_a", "of_b", paths).select(F.col("node").alias("component"), F.col("component").alias("over"))
        new = ends.select(F.col("a").alias("node"), F.col("of_a").alias("component")).union(ends.select("b", "of_b")).distinct()
        every = label.union(new.join(label, "node", "left_anti"))
        label = kept(every.join(top, "component", "left").select("node", F.coalesce("over", "component").alias("component")), "labels")

    label = components(links, paths=paths)
    own = mixed(met.select("bucket", "id"), label, "mixed")  # a hub has met all its bucket
    many = own.where("not few")
    grown(across(own.where("few")).union(close(with_hubs(many))))
    own = mixed(many.select("bucket", "id"), label, "mixed")
    if not own.isEmpty():
        grown(across(own.where("few")))
        left = own.where("not few").select("id").distinct()
        if not left.isEmpty():
            rows = kept(prefix_keys(sets(known.join(left, "id", "left_semi"))), "prefixes")
            grown(close(with_hubs(mixed(rows, label, "mixed"))))
            grown(across(mixed(rows, label, "mixed")))
    label, _ = stored(label, "components")
    for path in paths:
        drop_path(spark, path)
    return label


def prefix_keys(sets: DataFrame) -> DataFrame:
    """(id, bucket) such that two of the ``sets`` (id, set) with a likeness of 4/5 or more share a bucket.

    Prefix filtering: what such sets have in common is 4/5 of either at least, so of each set's n - ceil(4n/5) + 1 elements that
    come first in one order of all elements they share one.  The order begins with the elements that the fewest sets hold.
    """
    each = sets.select("id", F.explode(F.array_distinct("set")).alias("bucket"))
    held = each.groupBy("bucket").agg(F.count("*").alias("n"))
    first = each.join(held, "bucket").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("x"))
    size = F.size("x")
    return first.select("id", F.explode(F.slice("x", F.lit(1), size - F.expr("(4 * size(x) + 4) div 5").cast("int") + 1)).alias("e")).where("e.n > 1").select("id", "e.bucket")
