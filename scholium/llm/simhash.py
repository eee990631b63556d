"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits all variants within half the link
radius. Two fingerprints within the radius share a variant, so one shuffle on
the variants brings every linked pair together; a bucket holds at most the
ball around its variant (65 fingerprints for radius 2), however often a
document is copied, because equal fingerprints are collapsed first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_column, checkpoint, connected_components, shuffle_parts

SEED = 42
_SLICE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority bit per position over the XXH64 of all word shingles; no words give zero."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + k - 1 : hi + k - 1])], dtype="<u8")
        lanes = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).view(np.uint64)
        for i in range(0, len(lanes), 255):  # byte lanes hold up to 255
            total += lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in bytes_column(b, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """XOR masks (signed longs) of all patterns with at most ``radius`` bits."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs (doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; the radius is even.
    component_id is the smallest doc_id reachable over links. Null and empty
    texts have fingerprint zero and link like any other; repeated rows give
    repeated rows; a null doc_id is kept and names no component unless its
    fingerprint has no other document (then null). An empty table gives none.
    """
    fps, nodes, linked = linked_fingerprints(docs, radius, shingle)
    comps = connected_components(linked)
    of_fp = nodes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked_fingerprints(docs: DataFrame, radius: int = 2, shingle: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row, ``(fp, rep)`` with the smallest doc_id of each fingerprint, and links ``(a, b)`` between these."""
    if radius % 2:
        raise ValueError("the radius must be even: each side emits half of it")
    fps = checkpoint(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    # as many tasks as there are partitions, as each node becomes 65 rows or more
    dealt = nodes.repartition(shuffle_parts(docs.sparkSession), F.xxhash64("fp"))
    balls = dealt.select("rep", "fp", F.explode(masks).alias("mask")).select("rep", "mask", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    # few variants recur: plain rows are sorted, since an aggregate that collects would hold a buffer for each variant.
    # all of a bucket lie within radius / 2 of its variant, so a star from its smallest member loses no reachability
    bucket = Window.partitionBy("variant").orderBy("rep", "mask")
    stars = balls.withColumns({"a": F.first("rep").over(bucket), "ma": F.first("mask").over(bucket)}).where("mask <> ma")
    pairs = stars.select("a", F.col("variant").bitwiseXOR(F.col("ma")).alias("fa"), F.col("rep").alias("b"), F.col("variant").bitwiseXOR(F.col("mask")).alias("fb"))
    return fps, nodes, pairs.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius).select("a", "b")
