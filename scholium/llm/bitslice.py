"""Exact top-k inner products over a bit-sliced index.

The index holds, per block of rows, one bitmap for every (dimension, bit) of
the quantised components. A query adds the slices it needs, weight by weight,
with carry-save adders on whole bitmaps; the k best rows are found from the
most significant score slice downward. The lowest ``drop`` bits of a component
are left out of the slices, so a score has a known error; every row that the
error leaves undecided is scored exactly from its integers.

What is written once are blocks of packed integers; a task slices a block when
it reads it. Queries come in bounded parts, each a broadcast of known size that
every block answers in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, batches_of, checkpoint

SCALE = 1024
#: Vectors with larger integers are scored one by one in exact integers of any size, as sums of products could leave 64 bits.
LARGE = 1 << 20
_PACK = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vals", pa.binary())])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, x)`` of the rows that take part: an id, and every component a finite double."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def packed_blocks(batches, rows_per_block: int):
    """``(dim, kind, ids, vals)``: blocks of at most so many rows of one dimension.

    vals are floor(1024 * x) in the smallest integer kind that holds them, or
    the doubles themselves (kind f8) of vectors with a large component.
    """
    held: dict[tuple[int, bool], tuple[list, list]] = {}

    def out(key):
        ids, x = (np.concatenate(c) for c in held.pop(key))
        if key[1]:
            return (key[0], "f8", ids.astype("<i8").tobytes(), x.astype("<f8").tobytes())
        top = int(np.abs(x).max(initial=0))
        kind = "i2" if top < 1 << 15 else "i4"
        return (key[0], kind, ids.astype("<i8").tobytes(), x.astype(f"<{kind}").tobytes())

    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        ends = v.offsets.to_numpy()
        flat, dims = v.values.to_numpy(zero_copy_only=False), np.diff(ends)
        for dim in np.unique(dims).tolist():
            at = np.nonzero(dims == dim)[0]
            for lo in range(0, len(at), rows_per_block):
                part = at[lo : lo + rows_per_block]
                x = flat[(ends[part][:, None] + np.arange(dim)).ravel()].reshape(len(part), dim)
                with np.errstate(over="ignore"):
                    q = np.floor(x * SCALE)
                large = (np.abs(q) >= LARGE).any(axis=1)
                for wide, rows in ((False, q[~large]), (True, x[large])):
                    if not len(rows):
                        continue
                    h = held.setdefault((dim, wide), ([], []))
                    h[0].append(ids[part][large == wide])
                    h[1].append(rows)
                    if sum(map(len, h[0])) >= rows_per_block:
                        yield out((dim, wide))
    for key in list(held):
        yield out(key)


def opened(row) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values (a row each) of a packed block."""
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vals"], f"<{row['kind']}").reshape(len(ids), row["dim"])


def whole(vals: np.ndarray) -> list[list[int]]:
    """The quantised components as integers of any size."""
    if vals.dtype.kind == "i":
        return vals.tolist()
    return [[int(np.floor(x * SCALE)) if abs(x) < 2.0**52 else int(x) * SCALE for x in row] for row in vals.tolist()]


def exact_top(ids: list[int], rows: list[list[int]], q: list[int], own: int, k: int) -> list[tuple[int, int]]:
    """The k best ``(score, id)`` in integers of any size; a score beyond a long is an error, not another score."""
    best = sorted((-sum(a * b for a, b in zip(r, q)), i) for i, r in zip(ids, rows) if i != own)[:k]
    if best and not all(-(1 << 63) <= -s < 1 << 63 for s, _ in best):
        raise OverflowError("an inner product does not fit a long")
    return [(-s, i) for s, i in best]


class SlicedBlock:
    """The bit-sliced index of one block."""

    def __init__(self, ids: np.ndarray, vals: np.ndarray, drop: int):
        self.ids, self.vals, self.n, self.drop = ids, vals, len(ids), drop
        self.low = vals.min(axis=0).astype(np.int64) if self.n else np.zeros(vals.shape[1], np.int64)
        up = (vals.astype(np.int64) - self.low).astype(np.uint64)
        self.width = [max(0, int(c).bit_length() - drop) for c in up.max(axis=0)] if self.n else [0] * vals.shape[1]
        self.words = (self.n + 63) // 64
        self.valid = self.bitmap(np.ones(self.n, bool))
        self.slices = [[self.bitmap((up[:, d] >> np.uint64(drop + b)) & np.uint64(1)) for b in range(w)] for d, w in enumerate(self.width)]

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(bool), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])[0]

    def score_slices(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum |q_d| * (component or its complement), and the largest error of what was dropped."""
        weights: list[list[np.ndarray]] = []
        error = 0
        for d, qd in enumerate(q.tolist()):
            if not qd or not self.width[d] and not self.drop:
                continue
            error += abs(qd) * ((1 << self.drop) - 1)
            for j in range(abs(qd).bit_length()):
                if abs(qd) >> j & 1:
                    for b, s in enumerate(self.slices[d]):
                        while len(weights) <= j + b:
                            weights.append([])
                        weights[j + b].append(s if qd > 0 else ~s)
        out, t = [], 0
        while t < len(weights):
            col = weights[t]
            if len(col) > 1 and t + 1 == len(weights):
                weights.append([])
            while len(col) > 2:  # full adders: three bitmaps of a weight give a sum and a carry
                nxt = []
                for i in range(0, len(col) - 2, 3):
                    a, b, c = col[i : i + 3]
                    x = a ^ b
                    nxt.append(x ^ c)
                    weights[t + 1].append((a & b) | (x & c))
                col = nxt + col[len(col) - len(col) % 3 :]
            if len(col) == 2:
                weights[t + 1].append(col[0] & col[1])
                col = [col[0] ^ col[1]]
            out.append(col[0] if col else np.zeros(self.words, np.uint64))
            t += 1
        return out, error

    def top(self, q: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` of the block, ties to the smaller id; rows with the query's id take no part."""
        alive = self.valid & ~self.bitmap(self.ids == own) if own is not None else self.valid.copy()
        size = int(np.bitwise_count(alive).sum())
        if size > k:
            slices, error = self.score_slices(q)
            sure, edge, least = np.zeros(self.words, np.uint64), alive, 0
            for t in range(len(slices) - 1, -1, -1):
                ones = edge & slices[t]
                have = int(np.bitwise_count(sure | ones).sum())
                if have >= k:
                    edge, least = ones, least | 1 << t  # the k-th score has this bit
                else:
                    sure, edge = sure | ones, edge & ~slices[t]
            need = max(0, least - (-(-error >> self.drop) if self.drop else 0))
            over, same = np.zeros(self.words, np.uint64), alive
            for t in range(max(len(slices), need.bit_length()) - 1, -1, -1):
                s = slices[t] if t < len(slices) else np.zeros(self.words, np.uint64)
                if need >> t & 1:
                    same = same & s
                else:
                    over, same = over | (same & s), same & ~s
            alive = over | same
        at = self.rows(alive)
        exact = self.vals[at].astype(np.int64) @ q
        best = np.lexsort((self.ids[at], -exact))[:k]
        return [(int(exact[i]), int(self.ids[at[i]])) for i in best]


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, rows_per_block: int = 1 << 16, part_bytes: int = 32 << 20, drop: int = 2) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows of ``base``.

    Both inputs are ``(vec_id, embedding)``. Vectors that are null or hold null
    or non-finite components take no part; an empty vector scores 0 against
    empty ones; vectors of other lengths never meet. Components of any size
    count; a score among the best that does not fit a long is an error. Rows
    that share the query's vec_id are its own and are not returned. Repeated
    rows of ``base`` are ranked one by one; repeated rows of a query are one
    query, and different vectors under one id are queries of their own, each
    with its own ranks. The queries come in parts of at most about
    ``part_bytes`` (dealt by a hash), each of which is one pass over the packed
    index; a row pair is never a Spark row, and each meeting keeps k rows.
    """
    spark = base.sparkSession

    def pack(batches):
        for row in packed_blocks(batches, rows_per_block):
            yield batches_of([row], _PACK)

    index = checkpoint(usable(base, "vec_id", "embedding").mapInArrow(pack, "dim int, kind string, ids binary, vals binary"))
    asked = usable(queries, "vec_id", "embedding").distinct()
    size = asked.agg(F.sum(8 * (F.size("x") + 1))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    w = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    out = None
    for i in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(parts)) == i) if parts > 1 else asked
        rows = mine.toArrow().combine_chunks().to_batches()  # part_bytes
        shared = Shared(spark, [dict(zip(_PACK.names, r)) for r in packed_blocks(rows, 1 << 30)])

        def run(batches, shared=shared):
            for b in batches:
                for r in b.to_pylist():
                    ids, vals = opened(r)
                    sliced, plain = (SlicedBlock(ids, vals, drop) if r["kind"] != "f8" else None), None
                    for nr, asked_block in enumerate(shared.value):
                        if asked_block["dim"] != r["dim"]:
                            continue
                        q_ids, qs = opened(asked_block)
                        numbered = range(nr << 40, (nr << 40) + len(q_ids))  # within a part
                        if sliced and asked_block["kind"] != "f8":
                            got = [(q, at, v, s) for q, at, x in zip(q_ids.tolist(), numbered, qs.astype(np.int64)) for s, v in sliced.top(x, q, k)]
                        else:
                            plain = plain or whole(vals)
                            got = [(q, at, v, s) for q, at, x in zip(q_ids.tolist(), numbered, whole(qs)) for s, v in exact_top(ids.tolist(), plain, x, q, k)]
                        for lo in range(0, len(got), 20_000):
                            yield batches_of(got[lo : lo + 20_000], schema)

        found = index.mapInArrow(run, "query_id long, query long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = checkpoint(found) if parts > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
