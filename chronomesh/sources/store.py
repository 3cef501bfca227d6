"""Sources and sinks: graphs, texts, dimension files, activations, binary caches, reports."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronomesh.plans.model import EDGES, NODES, Graph


def save_graph(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"))


def corpus_text(spark: SparkSession, spec: str) -> DataFrame:
    """(domain, doc_seq, text) of ``name:path``: a whole file is one text, files in the order of their names."""
    domain, sep, path = spec.partition(":")
    if not sep or not domain or not path:
        raise ValueError(f"{spec!r} is not name:path")
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    return files.select(F.lit(domain).alias("domain"), F.col("file").alias("doc_seq"), "text")


def dataset_spec(spec: str) -> dict:
    """``domain=place[:subset][|column,column]``."""
    domain, sep, rest = spec.partition("=")
    if not sep or not domain or not rest:
        raise ValueError(f"{spec!r} is not domain=place[:subset][|columns]")
    place, _, columns = rest.partition("|")
    place, _, subset = place.partition(":")
    return {"domain": domain, "place": place, "subset": subset or None, "columns": [c for c in columns.split(",") if c] or ["text"]}


def dataset_texts(spark: SparkSession, spec: str, root: str = "") -> DataFrame:
    """(domain, shard, text) of local shards (Parquet or JSON lines); the chosen columns are joined by a line end."""
    own = dataset_spec(spec)
    path = "/".join(x for x in (root, own["place"], own["subset"]) if x)
    reader = spark.read.json if path.rstrip("*").endswith((".json", ".jsonl")) else spark.read.parquet
    return reader(path).select(
        F.lit(own["domain"]).alias("domain"), F.col("_metadata.file_path").alias("shard"), F.concat_ws("\n", *own["columns"]).alias("text")
    )


def shard_report(texts: DataFrame) -> DataFrame:
    return texts.groupBy("domain", "shard").agg(F.count("*").alias("texts"), F.sum(F.char_length("text")).alias("chars"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, word) of a JSON object id -> word; keys that are no number and null values are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "word"))
    return raw.select(F.expr("try_cast(key as bigint)").alias("token_id"), "word").where("token_id is not null and word is not null")


def write_object(pairs: DataFrame, key: str, value: str, path: str) -> None:
    """A small dimension as one JSON object in one file."""
    pairs.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    """(id, token_id, x, y, z) of {"node_fields": {key: {"pos": [x, y, z], "dom_tid": n}}}; other lengths of pos are left out."""
    schema = "node_fields map<string, struct<pos: array<float>, dom_tid: bigint>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("node_fields").alias("key", "f")).where("size(f.pos) = 3")
    return rows.select((F.col("f.dom_tid") * 1000).alias("id"), F.col("f.dom_tid").alias("token_id"), *[F.col("f.pos")[k].alias(c) for k, c in enumerate("xyz")])


KV_MAGIC = b"KVCACHE1"  # fixed value: opening bytes of a cache dump, before four little-endian u32
KV_HEADER = 32
KV = "file string, layer int, head int, token int, key array<float>, value array<float>"


KV_SPLIT = 16 << 20  # bytes of keys that a task reads at a time, and of values


@dataclass
class KvRange(InputPartition):
    """Some tokens of a layer of a dump, whose keys, like their values, are one run of bytes."""

    file: str
    shape: tuple[int, int, int, int]
    layer: int
    first: int
    last: int


class KvReader(DataSourceReader):
    def __init__(self, path: str, split: int = KV_SPLIT):
        self.path, self.split = path, split

    def partitions(self) -> list[KvRange]:
        """Ranges of all dumps of a file or folder, from their headers and lengths alone."""
        from pyarrow import fs

        system, base = opened(self.path)
        info = system.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        found = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            with system.open_input_file(f.path) as source:
                layers, heads, width, tokens = shape = kv_header(source.read(KV_HEADER))
            if f.size < KV_HEADER + 8 * layers * heads * width * tokens:
                raise ValueError(f"{f.path} is cut off")
            step = max(1, self.split // max(1, 4 * heads * width))
            found += [KvRange(f.path, shape, layer, t, min(t + step, tokens)) for layer in range(layers) for t in range(0, tokens, step)]
        return found

    def read(self, part: KvRange | None) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if part is None:  # what Spark asks for where there are no partitions
            return
        layers, heads, width, tokens = part.shape
        n, rows = part.last - part.first, heads * (part.last - part.first)
        at = KV_HEADER + 4 * heads * width * (part.layer * tokens + part.first)
        both = []
        with opened(self.path)[0].open_input_file(part.file) as source:
            for start in (at, at + 4 * layers * tokens * heads * width):
                flat = np.frombuffer(source.read_at(4 * rows * width, start), "<f4")
                cuts = np.arange(rows + 1, dtype=np.int32) * width
                both.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.float32())))
        head, token = np.tile(np.arange(heads, dtype=np.int32), n), np.repeat(np.arange(part.first, part.last, dtype=np.int32), heads)
        layer = np.full(rows, part.layer, np.int32)
        names = ["file", "layer", "head", "token", "key", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([part.file] * rows), pa.array(layer), pa.array(head), pa.array(token), *both], names)


class KvDumps(DataSource):
    """Cache dumps by byte ranges, so a dump of any size is read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "kv_dump"

    def schema(self) -> str:
        return KV

    def reader(self, schema) -> KvReader:
        return KvReader(self.options["path"], int(self.options.get("split", KV_SPLIT)))


def opened(path: str):
    """(pyarrow file system, path in it); a path without a scheme is a local one."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def read_kv_dump(spark: SparkSession, path: str, split: int = KV_SPLIT) -> DataFrame:
    """(file, layer, head, token, key, value) of dumps: a header (layers, heads, width, tokens), all keys, then all values, f32.

    Raises where a file is no dump or cut off; an empty folder has no rows.
    """
    spark.dataSource.register(KvDumps)
    return spark.read.format("kv_dump").option("split", split).load(path)


def kv_header(content: bytes) -> tuple[int, int, int, int]:
    if len(content) < KV_HEADER:
        raise ValueError("shorter than a header")
    if content[:8] != KV_MAGIC:
        raise ValueError("not a cache dump")
    return struct.unpack_from("<4I", content, 8)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with header and NA for null, JSON lines, or Parquet."""
    if form == "csv":
        df.write.mode("overwrite").csv(path, header=True, nullValue="NA")
    else:
        getattr(df.write.mode("overwrite"), form)(path)
