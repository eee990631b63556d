"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and divided into blocks of few dimensions. If two of
them lie within a squared distance, they lie within a block's share of it in
one block at least, so a range join per block on its coordinates meets every
linked pair. Blocks are joined on grid cells: a vector is at home in one cell
and visits every other cell that its range reaches. Candidates are verified in
the cell from the whole vectors; a pair counts in the first block in which it is
within the share, so the union of the blocks needs no list of pairs. What
leaves a cell is a number per vector and a forest of links.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpoint, connected_components

#: Dimensions of a block; home vectors of a cell that one group holds; vectors that a cell should hold.
BLOCK, CHUNK, CELL = 8, 2_048, 4_096
#: Pairs that are verified at a time, and visitors that meet a group's home vectors at a time.
PAIRS, VISITORS = 1 << 15, 1_024
SLACK = 1e-9
_CELLS = pa.schema([("node", pa.int64()), ("block", pa.int32()), ("cell", pa.string()), ("home", pa.bool_())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def rotated(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """The rows under an orthogonal map: two rounds of random signs and a Walsh-Hadamard transform (padded to a power of two)."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(2):
        y *= rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            z = y.reshape(len(x), n // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        y /= np.sqrt(n)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component comes to one first, so no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks(dim: int) -> tuple[int, int]:
    """How many blocks the rotated vectors have, and of how many dimensions."""
    n = 1 << max(0, (dim - 1).bit_length())
    size = min(BLOCK, n)
    return n // size, size


def depth(rows: int, size: int, radius: float, dim: int) -> int:
    """How many coordinates of a block divide the cells, so that a cell of a label's rows holds about ``CELL``."""
    per_axis = max(1.5, 4 / (np.sqrt(blocks(dim)[0] * blocks(dim)[1]) * 2 * radius))
    return int(min(size, max(0, np.ceil(np.log(max(1, rows) / CELL) / np.log(per_axis)))))


def visits(y: np.ndarray, depth: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, cell)`` of all grid cells (width of two radii, first ``depth`` coordinates) within the radius of each row; its own comes first."""
    own = np.floor(y[:, :depth] / (2 * radius)).astype(np.int64)
    rows, cells = [np.arange(len(y))], [own]
    below = y[:, :depth] - own * 2 * radius
    for step in product((0, -1, 1), repeat=depth):
        if any(step):
            away = np.where(np.array(step) < 0, below, np.where(np.array(step) > 0, 2 * radius - below, 0.0))
            near = np.nonzero((away * away).sum(axis=1) <= radius * radius * (1 + SLACK) + SLACK)[0]
            rows.append(near)
            cells.append(own[near] + np.array(step))
    return np.concatenate(rows), np.concatenate(cells)


class Group:
    """The home vectors of a cell (or of one chunk of them), which visitors meet batch by batch."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, block: int, threshold: float, turn: np.ndarray):
        self.nodes, self.x, self.block, self.threshold, self.turn = nodes, x, block, threshold, turn
        self.count, self.size = blocks(x.shape[1])
        self.share = (2 - 2 * threshold) / self.count
        mine = self.coordinates(x)
        self.mine = np.column_stack([mine, -(mine**2).sum(axis=1) / 2, np.ones(len(x))])
        self.links = np.zeros(len(nodes), np.int64)
        self.root = np.arange(len(nodes))
        self.edges: list[tuple[int, int]] = []
        self._y: np.ndarray | None = None

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """The block's coordinates; their rounding depends on the batch, which the slack allows for."""
        return unit(x) @ self.turn[: x.shape[1], self.block * self.size : (self.block + 1) * self.size]

    def owner(self, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first block in which each pair is within the share; the closest one if rounding leaves none. Alike from both sides."""
        self._y = rotated(unit(self.x)) if self._y is None else self._y
        apart = ((self._y[i] - y[j]) ** 2).reshape(len(i), self.count, self.size).sum(axis=2)
        within = apart <= self.share
        return np.where(within.any(axis=1), within.argmax(axis=1), apart.argmin(axis=1))

    def meet(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray) -> None:
        """Counts the links of the home vectors to some visitors, and joins them to the forest."""
        theirs = self.coordinates(x)
        theirs = np.column_stack([theirs, np.ones(len(x)), -(theirs**2).sum(axis=1) / 2])
        at = np.flatnonzero(self.mine @ theirs.T >= -(self.share + SLACK) / 2)  # minus half the squared distance
        i, j = at // len(x), at % len(x)
        keep = self.nodes[i] != nodes[j]
        i, j = i[keep], j[keep]
        linked, y = [], None
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            ok = cosine(self.x[a], x[b]) >= self.threshold
            a, b = a[ok], b[ok]
            if len(a):
                y = rotated(unit(x)) if y is None else y
                ok = self.owner(a, b, y) == self.block
                a, b = a[ok], b[ok]
                np.add.at(self.links, a, weights[b])
                linked.append(np.stack([a, b]))
        if linked:
            a, b = np.concatenate(linked, axis=1)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            ends = np.append(np.nonzero(np.diff(b, prepend=-1))[0], len(b))
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                trees, at = np.unique(self.root[a[lo:hi]], return_index=True)
                self.edges += [(int(nodes[b[lo]]), int(self.nodes[a[lo + k]])) for k in at.tolist()]
                if len(trees) > 1:
                    self.root[np.isin(self.root, trees)] = trees[0]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision."""
    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def near_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``rows (vec_id, embedding, label)``.

    Two vectors link if they have the same label (not null), the same length
    and a cosine of ``threshold`` (0 to 1) or more, in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows whose vec_id is null, link with nothing: no links, and the
    component is their own id. Equal vectors of a label are one node of the join
    with a weight, so copies are never paired; repeated rows are vectors of
    their own that link. ``kept`` says whether the id is its component's smallest.
    """
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    all_rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(F.coalesce(fit, F.lit(False)), x).alias("x"))
    all_rows = all_rows.withColumn("key", F.when(F.col("x").isNotNull(), F.struct(F.xxhash64("label", "x").alias("h"), F.xxhash64(F.reverse("x"), "label").alias("g"))))
    nodes = checkpoint(all_rows.where("x is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("x").alias("x")).withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    placed = nodes.join(sizes.withColumnRenamed("label", "l"), (F.col("label") == F.col("l")) & (F.size("x") == F.col("dim")))
    radius = lambda dim: float(np.sqrt((2 - 2 * threshold) / blocks(dim)[0]))

    def cells(batches):
        for b in batches:
            node, v, many = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for dim, total in {(int(d), int(m)) for d, m in zip(dims, many)}:
                at = np.nonzero((dims == dim) & (many == total))[0]
                for lo in range(0, len(at), 4_096):
                    part = at[lo : lo + 4_096]
                    y = rotated(unit(flat[(ends[part][:, None] + np.arange(dim)).ravel()].reshape(len(part), dim)))
                    count, size = blocks(dim)
                    r = radius(dim)
                    g = depth(total, size, r, dim)
                    for k in range(count):
                        row, cell = visits(y[:, k * size : (k + 1) * size], g, r)
                        names = [".".join(map(str, c)) for c in cell.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(node[part][row]), pa.array(np.full(len(row), k, np.int32)), pa.array(names, pa.string()), pa.array(np.arange(len(row)) < len(part))], schema=_CELLS)

    # cells travel with ids alone; vectors join those of them that have a home vector
    visit = checkpoint(placed.select("node", "x", "rows").mapInArrow(cells, "node long, block int, cell string, home boolean"))
    thin = placed.select("node", F.xxhash64("label", "dim").alias("kind"))
    visit = visit.join(thin, "node")
    homes = visit.where("home").groupBy("kind", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    visit = visit.join(homes, ["kind", "block", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    visit = visit.withColumn("mine", F.when(F.col("home"), mine)).select("node", "kind", "block", "cell", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    visit = visit.withColumn("home", F.coalesce(F.col("mine") == F.col("chunk"), F.lit(False))).drop("mine")
    return _linked(all_rows, nodes, visit, threshold)


def _linked(all_rows: DataFrame, nodes: DataFrame, visit: DataFrame, threshold: float) -> DataFrame:
    """The links within every group of ``visit (node, kind, block, cell, chunk, home)``, and the result."""

    def search(batches):
        key, held, group, turns = None, [], None, {}

        def close():
            if group is None:
                return
            n = group.links > 0
            yield pa.RecordBatch.from_arrays([pa.array(group.nodes[n]), pa.nulls(int(n.sum()), pa.int64()), pa.array(group.links[n])], schema=_LINKS)
            for lo in range(0, len(group.edges), 1 << 16):
                part = group.edges[lo : lo + (1 << 16)]
                yield batches_of([(a, b, None) for a, b in part], _LINKS)

        def meet(nodes, weights, x):
            for lo in range(0, len(nodes), VISITORS):
                group.meet(nodes[lo : lo + VISITORS], weights[lo : lo + VISITORS], x[lo : lo + VISITORS])

        def start():
            """The home vectors come first; when they are all there, they meet one another, and then every batch of visitors."""
            nodes, weights, x = (np.concatenate(c) for c in zip(*held))
            if x.shape[1] not in turns:
                turns[x.shape[1]] = rotated(np.eye(1 << max(0, (x.shape[1] - 1).bit_length())))
            return Group(nodes, x, key[1], threshold, turns[x.shape[1]]), nodes, weights, x

        def begun():
            nonlocal group
            if group is None and held:  # else a chunk that no home vector fell into
                group, *home = start()
                held.clear()
                meet(*home)

        for b in batches:
            kind, block, chunk, home, node, weight = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5, 6))
            cell = b.column(2).dictionary_encode()
            code, names = cell.indices.to_numpy(), cell.dictionary.to_pylist()
            ends, flat = b.column(7).offsets.to_numpy(), b.column(7).values.to_numpy(zero_copy_only=False)
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])
            bounds = np.append(np.nonzero(new)[0], len(kind)).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                at = (int(kind[lo]), int(block[lo]), names[code[lo]], int(chunk[lo]))
                if at != key:
                    begun()
                    yield from close()
                    key, group = at, None
                    held.clear()
                x = flat[ends[lo] : ends[hi]].reshape(hi - lo, -1)
                mid = lo + int(home[lo:hi].sum())
                if mid > lo:
                    held.append((node[lo:mid], weight[lo:mid], x[: mid - lo]))
                if mid < hi:
                    begun()
                    if group is not None:
                        meet(node[mid:hi], weight[mid:hi], x[mid - lo :])
        begun()
        yield from close()

    dealt = visit.join(nodes.select("node", "weight", "x"), "node").select("kind", "block", "cell", "chunk", "home", "node", "weight", "x")
    dealt = dealt.repartition("kind", "block", "cell", "chunk").sortWithinPartitions("kind", "block", "cell", "chunk", F.col("home").desc())
    found = checkpoint(dealt.mapInArrow(search, "a long, b long, n long"))
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("b is not null").select("a", "b").distinct())
    least = nodes.select("node", "id").join(comps, "node").groupBy("component").agg(F.min("id").alias("least"))
    of = nodes.select("key", "node", "id", "weight").join(links, "node", "left").join(comps.join(least, "component").select("node", "least"), "node", "left")
    of = of.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "id").alias("least"))
    out = all_rows.select("vec_id", "key").join(of, "key", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
