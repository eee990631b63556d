"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where a session names none, one is made here, in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholium-cp-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but compressed and by column: for rows with long texts, of which some readers need the short columns only."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files and broadcasts of finished steps.

    Spark removes them when the driver's collector finds their plans unused,
    by itself every half hour only; between steps that end in checkpoints, the
    files of all steps would lie on the executors' disks together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A broadcast object whose class goes along, so executors need no copy of this package.

    A broadcast pickles by reference; here the bytes of cloudpickle, which
    carries this package by value, are broadcast and opened once per worker.
    """

    def __init__(self, spark: SparkSession, value: object):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if self.__dict__.get("_value") is None:
            self._value = pickle.loads(self._bytes.value)
        return self._value

    def __getstate__(self):
        return {"_bytes": self._bytes}


def batches_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from a list of row tuples."""
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a scan); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_per_bucket: int = 4 << 20) -> int:
    """How many hash buckets an input with a ``text`` column is dealt into, in proportion to its size.

    The size is Catalyst's estimate. Where that is too large to be one (no
    statistics: a checkpoint or local rows), the texts are measured by a scan.
    """
    size = input_bytes(df)
    if size > 1 << 53:
        size = (df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // 2
    return int(max(shuffle_parts(df.sparkSession), size // bytes_per_bucket + 1))


def bytes_column(batch: pa.RecordBatch, name: str) -> list:
    """A string column's values as UTF-8 bytes, without decoding them."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def groups_for(df: DataFrame, n_buckets: int) -> int:
    """How many groups the documents' own short lists (positions, ranges) are dealt into."""
    return max(shuffle_parts(df.sparkSession), n_buckets // 8)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; the component is its smallest node.

    Every node points to the smallest node of its neighbourhood, pointers are
    doubled until they end in a root, edges are rewritten to roots and
    deduplicated, until no edge is left; then the moves are composed from the
    last to the first. Each step is a partial aggregate or an equi-join, so a
    hub is never collected, and long chains cost the logarithm of their length.
    """
    moves = []
    e = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")))
        while True:
            root = m.select(F.col("node").alias("to"), F.col("to").alias("root"))
            further = checkpoint(m.join(root, "to").select("node", F.col("root").alias("to"), (F.col("root") != F.col("to")).alias("moved")))
            m = further.select("node", "to")
            if further.where("moved").isEmpty():
                break
        moves.append(m)
        ma, mb = m.select(F.col("node").alias("a"), F.col("to").alias("ta")), m.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(ma, "a").join(mb, "b").where("ta <> tb")
        e = checkpoint(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    release(edges.sparkSession)
    out = moves[-1].withColumnRenamed("to", "component")
    for m in reversed(moves[:-1]):
        up = out.select(F.col("node").alias("to"), F.col("component").alias("up"))
        out = checkpoint(m.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("component")))
    return out
