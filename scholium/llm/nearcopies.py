"""Near copies by exact Jaccard similarity of word shingles, without missed pairs.

Two shingle sets with a Jaccard similarity of at least t share an element among
the first n - ceil(t * n) + 1 of each, in any order that holds for all sets
(prefix filtering). The order puts shingles that are frequent in a bounded
sample last, so a common line seldom brings documents together. Elements travel
as packed blobs. Before texts travel, members of a group meet with signatures of 128
bytes, whose differing bits are a lower bound of the elements in which two sets differ:
who can be similar to nobody in a group is left out of it, and no text of it moves.
Everyone is then compared with the smallest of those it could be similar to, from the
compressed texts. Where a group still has such pairs in different components, small
groups emit them, to be verified. A larger group is cut into chunks that share a core
of its members; the members with such pairs are searched chunk against chunk, from
member to member until none is left, so that a search gives a tree of links and not
its pairs. The holders of a shingle that the sample shows to be
very frequent are dealt to parts by hash before they meet, so no task holds them all;
the parts' chunks share one core.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, batches_of, buckets_for, bytes_column, checkpoint, connected_components, release
from .repeats import mix, packed, starts_of, unpacked

#: Texts in the sample for frequent shingles, its counts that make one frequent, how many are kept.
SAMPLE, FREQUENT, KEPT = 5_000, 4, 65_536
#: Members of a small group at most; of a chunk; of the core of a larger one.
SMALL, CHUNK, CORE = 32, 2_048, 32
#: Holders of a frequent shingle in one part, as the sample foretells.
PART = 8_192
#: Bits of a signature; sets of over twice as many elements are told apart less and less, but no pair is ever lost.
BITS = 1_024
#: Rows of signatures that are compared at once.
_ROWS = 8_192
_FILTER = 27
_FLUSH = 1 << 20
#: Words that are hashed at once, the weights of a byte's place in its word and of a word's in its shingle, and the codes of bytes.
_WORDS, _PLACE, _STEP = 1 << 16, np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)
POWERS = np.multiply.accumulate(np.full(64, _PLACE))
CODES = mix(np.arange(1, 257, dtype=np.uint64) * _PLACE)
CODES[65:91] = CODES[97:123]
CODES[[9, 10, 11, 12, 13, 32]] = 0


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, upper and lower case alike: the sum of its bytes' codes by place; white space has code zero.

    Words are those of ``bytes.split``; so many of them are hashed at once.
    """
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    space = (b == 32) | (b - np.uint8(9) < 5)  # 9 to 13, as smaller bytes wrap around
    starts = np.flatnonzero(space[1:] < space[:-1]) + 1
    ends = np.append(starts if space[0] else np.insert(starts, 0, 0), len(b))
    starts, ends, out = ends[:-1], ends[1:], np.zeros(len(ends) - 1, np.uint64)
    for lo in range(0, len(starts), _WORDS):
        s, e = starts[lo : lo + _WORDS], ends[lo : lo + _WORDS]
        size = e - s
        place = np.arange(s[0], e[-1]) - np.repeat(s, size)
        most = int(size.max())
        powers = POWERS if most <= len(POWERS) else np.multiply.accumulate(np.full(most, _PLACE))
        out[lo : lo + _WORDS] = np.add.reduceat(CODES.take(b[s[0] : e[-1]]) * powers.take(place), s - s[0])
    return out


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of all shingles of k words (of all words, if fewer) as ascending signed longs."""
    words = word_hashes(text or b"")
    if not len(words):
        return np.zeros(0, np.int64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += words[j : j + n]
    s = np.sort(mix(h).view(np.int64))
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def prefix(s: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set: shingles that are not hot by hash, then the hot ones by count."""
    rank = np.zeros(len(s), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - -(-4 * len(s) // 5) + 1]]


def similar(common, n, m):
    """Whether sets of n and m elements with so many in common have a Jaccard similarity of 0.8 or more."""
    return 5 * common >= 4 * (n + m - common)


def signature(s: np.ndarray) -> np.ndarray:
    """Of each residue modulo BITS the parity of its elements' number, as bytes: an element in one of two sets changes one bit."""
    return np.packbits((np.bincount(s & (BITS - 1), minlength=BITS) & 1).astype(np.uint8))


def partners(group: np.ndarray, n: np.ndarray, sig: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Of each row the first other row of its group that could be similar to it, and is of another component ``of``; -1 for none.

    Rows of a group stand together. Sets of n and m elements with Jaccard >= 0.8
    differ in (n + m) / 9 elements at most, and so in as many bits.
    """
    bits, n = np.ascontiguousarray(sig).view(np.uint64), n.astype(np.int64)
    out = np.full(len(n), len(n))
    first = starts_of(group)
    size = np.diff(np.append(first, len(group)))
    few = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, len(n))):  # rows that stand d apart in a small group
        i = np.nonzero((group[d:] == group[:-d]) & few[d:])[0]
        i = i[5 * np.minimum(n[i], n[i + d]) >= 4 * np.maximum(n[i], n[i + d])]
        if of is not None:
            i = i[of[i] != of[i + d]]
        i = i[9 * np.bitwise_count(bits[i] ^ bits[i + d]).sum(axis=1, dtype=np.int64) <= n[i] + n[i + d]]
        out[i], out[i + d] = np.minimum(out[i], i + d), np.minimum(out[i + d], i)
    for lo, k in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own, words = n[lo : lo + k], bits[lo : lo + k].T.copy()
        for x in range(0, k, 256):
            y = slice(x, min(k, x + 256))
            apart = np.zeros((y.stop - x, k), np.int64)
            for w in words:
                apart += np.bitwise_count(w[y, None] ^ w)
            near = (9 * apart <= own[y, None] + own) & (5 * np.minimum(own[y, None], own) >= 4 * np.maximum(own[y, None], own))
            near[np.arange(len(near)), np.arange(x, y.stop)] = False
            if of is not None:
                near &= of[lo + x : lo + y.stop, None] != of[lo : lo + k]
            out[lo + x : lo + y.stop] = np.where(near.any(axis=1), lo + near.argmax(axis=1), len(n))
    return np.where(out < len(n), out, -1)


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph of similar sets: each search compares with sets not yet reached only."""
    n = np.array([len(s) for s in sets])
    words, of = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(n)])
    owner, held = np.repeat(np.arange(len(sets)), n), of
    left, out = np.ones(len(sets), bool), []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue and left.any():
            keep = left[owner]
            if 2 * keep.sum() < len(owner):  # forget the elements of sets that are reached
                owner, held = owner[keep], held[keep]
            x = queue.pop()
            mine = np.zeros(len(words), bool)
            mine[of[ends[x] : ends[x + 1]]] = True
            common = np.bincount(owner[mine[held]], minlength=len(sets))
            near = np.nonzero(left & similar(common, n[x], n))[0].tolist()
            left[near] = False
            out += [(x, y) for y in near]
            queue += near
    return out


def parted(tok: np.ndarray, node: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of its shingle's holders that each node is in, and the number of these parts (one, unless the shingle is hot)."""
    if not len(hot):
        return np.zeros(len(tok), np.int64), np.ones(len(tok), np.int64)
    at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
    many = np.where(hot[at] == tok, parts[at], 1)
    return (((mix(node.view(np.uint64)) >> np.uint64(32)) * many.astype(np.uint64)) >> np.uint64(32)).astype(np.int64), many


def _frequent(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles of a bounded sample of texts, ascending, their counts in it and the parts for their holders in all texts."""
    share = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(2 * SAMPLE)

    def run(batches):
        for b in batches:
            for t in bytes_column(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, k), pa.int64())], names=["s"])

    top = sample.select("text").mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "s").limit(KEPT).toPandas().sort_values("s")
    counts = top["count"].to_numpy(np.int64)
    return top["s"].to_numpy(np.int64), counts, np.minimum(-(-counts * share // PART), 1 << 20)


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``(a, b)``: links between doc_ids whose components are those of all pairs with Jaccard >= 0.8.

    ``docs (doc_id, text)``. Words are lower-case (A-Z) and divided by ASCII
    white space. Equal texts are one node, named by its smallest doc_id, and
    link to nothing here but through it; texts without words and null ids link
    to nothing.
    """
    return grouped(docs, shingle)[0]


def grouped(docs: DataFrame, shingle: int = 5, names: DataFrame | None = None, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links of ``near_copies``, and ``(node, component)`` over them and ``more (a, b)``.

    ``names (doc_id, name)`` gives documents that are known to be alike one
    name, under which they stand in both; the components are found once for all
    links, and again only if groups had to be searched further.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("node", F.xxhash64("text"))
    frequent = _frequent(texts, shingle)
    hot = Shared(spark, frequent)
    nb = buckets_for(texts, 8 << 20)
    blobs = pa.schema([("bucket", pa.int32()), ("signed", pa.bool_()), ("data", pa.binary())])

    def pack(held):
        sizes = [len(t) for *_, t in held]
        tok = np.concatenate([t for *_, t in held])
        node, n = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
        at = np.concatenate([np.arange(k) for k in sizes])
        part = parted(tok, node, hot.value[0], hot.value[2])[0]
        bucket = (mix(tok.view(np.uint64) + part.astype(np.uint64)) >> np.uint64(32)) % np.uint64(nb)
        order = np.lexsort((tok, bucket))
        out = [(int(bucket[i[0]]), False, packed(tok[i], node[i], n[i].astype("<i4"), at[i].astype("<i4"))) for i in np.split(order, starts_of(bucket[order])[1:])]
        node, sig = np.array([h[0] for h in held], np.int64), np.stack([h[2] for h in held])
        bucket = (mix(node.view(np.uint64)) >> np.uint64(32)) % np.uint64(nb)
        order = np.argsort(bucket, kind="stable")
        return batches_of(out + [(int(bucket[i[0]]), True, packed(sig[i], node[i])) for i in np.split(order, starts_of(bucket[order])[1:])], blobs)

    def prefixes(batches):
        held, n, seen = [], 0, set()
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), bytes_column(b, "text")):
                if node in seen:
                    continue
                seen.add(node)
                s = shingles(t, shingle)
                if len(s):
                    held.append((node, len(s), signature(s), prefix(s, *hot.value[:2])))
                    n += len(held[-1][3])
                if n >= _FLUSH:
                    yield pack(held)
                    held, n, seen = [], 0, set()
        if held:
            yield pack(held)

    rows = pa.schema([("node", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("sig", pa.binary())])

    def batch(*cols):
        """A batch of members; their signatures stand in rows of their own."""
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, rows)), pa.nulls(len(cols[0]), pa.binary())], schema=rows)

    def meet(data):
        """Members of groups: of small ones those that could be similar to another, of larger ones and of parts all, by chunk.

        The chunks of a part have numbers of their own; ``chunks`` is 0 there, as one part doesn't know the others.
        """
        tok, node, n, at = (np.concatenate(c) for c in zip(*(unpacked(x, "<i8", "<i8", "<i4", "<i4") for x in data)))
        part, many = parted(tok, node, hot.value[0], hot.value[2])
        order = np.lexsort((node, part, tok))
        tok, node, n, at, part, many = tok[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64), part[order], many[order]
        own = np.concatenate([[True], (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])])
        tok, node, n, at, part, many = tok[own], node[own], n[own], at[own], part[own], many[own]
        first = np.nonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])]))[0]
        size = np.diff(np.append(first, len(tok)))
        few = np.repeat((size <= SMALL) & (many[first] == 1), size)
        viable = np.zeros(len(tok), bool)
        for d in range(1, min(SMALL, len(tok))):  # members that stand d apart in their group
            i = np.nonzero((tok[d:] == tok[:-d]) & few[d:])[0]
            j = i + d
            # in the group of a pair's first common shingle, all common ones stand at its place or behind it
            ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]))
            viable[i[ok]] = viable[j[ok]] = True
        i, each = np.nonzero(viable)[0], np.repeat(size, size)
        zero = np.zeros(len(i), np.int32)
        yield batch(node[i], tok[i], n[i], at[i], each[i], zero, zero + 1)
        for g in np.nonzero((size > SMALL) | (many[first] > 1))[0].tolist():
            i = np.arange(first[g], first[g] + size[g])
            i = i[np.argsort(mix(node[i].view(np.uint64)))]
            chunks = -(-len(i) // CHUNK)
            if many[first[g]] > 1:
                chunk, chunks = part[first[g]] + many[first[g]] * (np.arange(len(i)) % chunks), 0
            else:
                chunk = np.concatenate([np.repeat(np.arange(chunks), min(CORE, len(i))), np.arange(max(0, len(i) - CORE)) % chunks])
                i = np.concatenate([np.tile(i[:CORE], chunks), i[CORE:]])
            yield batch(node[i], tok[i], n[i], at[i], each[i], chunk, np.full(len(i), chunks))

    def meetings(batches):
        now, data = None, []
        for b in batches:
            for bucket, signed, x in zip(*(c.to_pylist() for c in b.columns)):
                if signed:
                    sig, node = unpacked(x, BITS // 8, "<i8")
                    none = pa.nulls(len(node), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(node), none, *(none.cast(f.type) for f in list(rows)[2:-1]), pa.array([z.tobytes() for z in sig], pa.binary())], schema=rows)
                    continue
                if bucket != now and data:
                    yield from meet(data)
                    data = []
                now = bucket
                data.append(x)
        if data:
            yield from meet(data)

    dealt = texts.select("node", "text").mapInArrow(prefixes, "bucket int, signed boolean, data binary").repartition(min(nb, 1 << 16), "bucket").sortWithinPartitions("bucket")
    met = checkpoint(dealt.mapInArrow(meetings, "node long, s long, n int, at int, size int, chunk int, chunks int, sig binary"))
    member, sigs = met.where("sig is null").drop("sig"), met.where("sig is not null").select("node", "sig").dropDuplicates(["node"])
    cols, parts, in_chunks = member.columns, member.where("chunks = 0"), member
    if dealt_out := bool((frequent[2] > 1).any()):  # at most as many shingles as are kept: their true sizes fit a broadcast
        whole = checkpoint(parts.groupBy("s").agg(F.count("*").cast("int").alias("size")).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")))
        nth = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("node"), "node"))  # pruned before the shuffle
        core = parts.withColumn("nth", nth).where(F.col("nth") <= CORE).drop("nth")
        others = parts.select("s", F.col("chunk").alias("other")).distinct()
        in_chunks = in_chunks.unionByName(core.join(others, "s").where("chunk <> other").withColumn("chunk", F.col("other")).select(*cols))

    def probe(batches):
        """The rows; ``to`` is the smallest node of their group ``(s, i, j)``, and of another component, that could be similar. Of groups in one chunk only rows with such a node."""
        held = None

        def told(t):
            same = np.concatenate([[0], np.cumsum(np.any([np.diff(t.column(c).to_numpy()) != 0 for c in "sij"], axis=0))])
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), -1)
            node, of = t.column("node").to_numpy(), t.column("component").to_numpy() if "component" in t.column_names else None
            to = partners(same, t.column("n").to_numpy(), sig, of)
            t = t.drop_columns(["sig"]).append_column("to", pa.array(node[to], mask=to < 0))
            return t.filter(pa.array((to >= 0) | (t.column("chunks").to_numpy() != 1))).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) >= _ROWS:
                held = held.combine_chunks()
                last = np.nonzero(np.any([held.column(c).to_numpy() != held.column(c)[-1].as_py() for c in "sij"], axis=0))[0]
                if len(last):  # the last group may go on
                    yield from told(held.slice(0, int(last[-1]) + 1))
                    held = held.slice(int(last[-1]) + 1)
        if held is not None and len(held):
            yield from told(held.combine_chunks())

    def probed(rows: DataFrame, *more_cols: str) -> DataFrame:
        cols = ["node", "s", "n", "at", "size", "chunks", "i", "j", *more_cols]
        dealt = rows.select(*cols).join(sigs, "node").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "node").select(*cols, "sig")
        return dealt.mapInArrow(probe, ", ".join(f"{c} {t}" for c, t in dealt.drop("sig").dtypes) + ", to long")

    some = checkpoint(probed(in_chunks.withColumn("i", F.col("chunk")).withColumn("j", F.col("chunk"))))
    release(spark)
    nodes, member = some.select("node"), some
    if dealt_out:
        member = some.where("chunks > 0").unionByName(some.where("chunks = 0").drop("size", "chunks").join(F.broadcast(whole), "s").select(*some.columns))

    # texts of nodes that a filter of fixed size names; it names some more as well
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - _FILTER}) & 63 as int))")
    words = nodes.groupBy(F.shiftrightunsigned("node", 70 - _FILTER).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << _FILTER - 6, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    del words
    needed = Shared(spark, table)

    def chosen(batches):
        shrink = zstandard.ZstdCompressor(level=3)
        for b in batches:
            node = b.column(0).to_numpy().view(np.uint64)
            p = node >> np.uint64(64 - _FILTER)
            there = np.nonzero(needed.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1))[0]
            there = there[np.unique(node[there], return_index=True)[1]]
            t = bytes_column(b, "text")
            yield pa.RecordBatch.from_arrays([pa.array(node[there].view(np.int64)), pa.array([shrink.compress(t[i]) for i in there.tolist()], pa.binary())], names=["node", "body"])

    bodies = checkpoint(texts.select("node", "text").mapInArrow(chosen, "node long, body binary").dropDuplicates(["node"]))
    release(spark)

    @F.pandas_udf("boolean")
    def verified(x: pd.Series, y: pd.Series) -> pd.Series:
        last, out = (None, None), []
        for a, b in zip(x, y):
            if b != last[0]:  # pairs come sorted by y
                last = b, shingles(zstandard.decompress(b), shingle)
            a, b = shingles(zstandard.decompress(a), shingle), last[1]
            out.append(bool(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
        return pd.Series(out, dtype=bool)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs ``(x, y)`` of nodes that are similar."""
        bx, by = (bodies.select(F.col("node").alias(c), F.col("body").alias(f"b{c}")) for c in "xy")
        return pairs.join(bx, "x").join(by, "y").where(verified("bx", "by")).select("x", "y")

    def search(batches):
        key, nodes, held = None, [], []

        def out():
            got = [(nodes[i], nodes[j]) for i, j in links(held)] if held else []
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["x", "y"])

        for b in batches:
            for *at, node, z in zip(*(c.to_pylist() for c in b.columns)):
                if at != key:
                    yield out()
                    key, nodes, held = at, [], []
                nodes.append(node)
                held.append(shingles(zstandard.decompress(z), shingle))
        yield out()

    def searched(rows: DataFrame) -> DataFrame:
        """Links within each group of ``rows (s, i, j, node)``."""
        dealt = rows.join(bodies, "node").select("s", "i", "j", "node", "body").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "node")
        return dealt.mapInArrow(search, "x long, y long")

    each = member.select("node", "s", "n", "at", "size", "chunks").dropDuplicates(["s", "node"])
    # everyone with the smallest node that could be similar: the same few trees from all groups of alike members
    least = member.groupBy("node").agg(F.min("to").alias("to")).where("to is not null")
    found = checkpoint(confirmed(checkpoint(least.select(F.greatest("node", "to").alias("x"), F.least("node", "to").alias("y")).distinct())))
    release(spark)
    wanted = nodes.distinct()
    ids = texts.select("node", "doc_id").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"))
    if names is not None:
        ids = ids.join(names.select(F.col("doc_id").alias("id"), "name"), "id").select("node", F.col("name").alias("id"))
    ids = checkpoint(ids)

    def named(pairs: DataFrame) -> DataFrame:
        a, b = (ids.select(F.col("node").alias(c), F.col("id").alias(d)) for c, d in (("x", "a"), ("y", "b")))
        out = pairs.join(a, "x").join(b, "y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return (out if more is None else out.unionByName(more.select("a", "b"))).distinct()

    edges = checkpoint(named(found))
    comps = connected_components(edges)
    of = each.join(ids, "node").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = of.groupBy("s").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("s")
    of = checkpoint(of.join(open_, "s", "left_semi"))
    # who could be similar to a member of another component, in a larger group chunk against chunk
    again = of.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cross = checkpoint(probed(again.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")}), "component").where("to is not null"))
    x, y = (cross.where(F.col("size") <= SMALL).select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "at", "component")]) for k in "xy")
    two = x.join(y, "s").where("node_x < node_y and component_x <> component_y and 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y) and 9 * least(n_x - at_x, n_y - at_y) >= 4 * (n_x + n_y)")
    pairs = two.select(F.col("node_x").alias("x"), F.col("node_y").alias("y")).distinct()
    larger = searched(cross.where(F.col("size") > SMALL).select("s", "i", "j", "node"))
    added = checkpoint(named(checkpoint(confirmed(pairs).unionByName(larger))).join(edges, ["a", "b"], "left_anti"))
    if added.isEmpty():
        return edges, comps
    # components of components: few rows beside all links
    roots = comps.select(F.col("node").alias("a"), F.col("component").alias("ra")), comps.select(F.col("node").alias("b"), F.col("component").alias("rb"))
    joined = added.join(roots[0], "a", "left").join(roots[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    last = connected_components(checkpoint(joined)).withColumnRenamed("component", "last")
    old = comps.join(last.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    new = last.join(comps, "node", "left_anti").select("node", F.col("last").alias("component"))
    return edges.unionByName(added), checkpoint(old.unionByName(new))
