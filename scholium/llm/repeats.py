"""Finding every repeated window of a corpus without shuffling every window.

Shared by the suffix-array and the repeated-phrase deduplication. A document
is a sequence of symbols (bytes or words); a *window* is ``window`` symbols.
Every window holds at least one *anchor*: the k-gram with the smallest hash in
it. Equal windows have equal anchors, so

1. ``survivors`` keeps only anchors whose k-gram occurs again. Per task,
   k-grams that already repeat there need no proof elsewhere and send one
   counted representative, so a k-gram of every third document costs one
   record per task, not one per occurrence;
2. the caller compares the surroundings of surviving anchors, first within the
   task (what repeats there is settled) and then within hash or range buckets;
3. anchors that occur more than ``HOT`` times, so that one bucket should not
   hold their distinct surroundings, are compared window by window, spread by
   the window's digest. A filter of fixed size names them in every task; a
   k-gram that it names wrongly goes that way as well, to the same result.

A document is known by its id and a ``copy`` number, 0 unless rows share an id
with different texts. Such rows are documents of their own, and none of them
comes before the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

#: Occurrences that make an anchor hot, and the bits (as a power of two) of the filter that names hot anchors.
HOT = 20_000
_FILTER = 26
#: Partitions at most; further buckets share them, one after the other.
_PARTS = 1 << 16
_FLUSH = 1 << 20
_SEGMENT = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("doc", pa.int64()), ("data", pa.binary())])
ROWS_SQL = "bucket int, kind byte, doc long, data binary"
#: Kinds of rows: compared in a bucket; settled for a document; a hot k-gram; a sampled leading k-gram.
COMPARE, SETTLED, OFTEN, SAMPLE = 0, 1, 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def gram_hashes(sym: np.ndarray, k: int, mul: np.uint64 = _MUL) -> np.ndarray:
    """A mixed polynomial hash of every k consecutive symbols."""
    have, out, powers = 0, None, sym.astype(np.uint64) + np.uint64(1)
    step, p = 1, mul
    with np.errstate(over="ignore"):
        while True:  # square and multiply over the length
            if k & step:
                if out is None:
                    out, have = powers, step
                else:  # the longer block first, then what was gathered
                    n = len(sym) - have - step + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    out, have = powers[:n] * pow_mul(mul, have) + out[step : step + n], have + step
            step <<= 1
            if step > k:
                break
            h = step >> 1
            powers = powers[:-h] * p + powers[h:] if len(powers) > h else powers[:0]
            p = p * p
        return mix(out)


def pow_mul(mul: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(mul), n, 1 << 64))


def _slide(x: np.ndarray, w: int, f: Callable) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def anchors(sym: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors: each k-gram that is smallest in some window (ties: all)."""
    if len(sym) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w, pos, hashes = window - k + 1, [], []
    for lo in range(0, len(sym) - window + 1, _SEGMENT):  # segments share window - 1 symbols, so each window is whole in one
        h = gram_hashes(sym[lo : lo + _SEGMENT + window - 1], k)
        least = _slide(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        at = np.nonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)[0]
        pos.append(at + lo)
        hashes.append(h[at])
    p, h = np.concatenate(pos), np.concatenate(hashes)
    if len(pos) > 1:
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return p, h & np.uint64(0xFFFFFFFFFFFFFF00)


def packed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as one compressed blob, byte planes first (sorted or small numbers shrink well)."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays]
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, *kinds: str | int) -> list[np.ndarray]:
    """The arrays of a blob, by dtype; a number stands for a byte matrix of that width."""
    n, raw, at, out = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:]), 0, []
    for kind in kinds:
        width = kind if isinstance(kind, int) else np.dtype(kind).itemsize
        m = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T)
        out.append(m if isinstance(kind, int) else m.view(kind).reshape(n))
        at += width * n
    return out


def by_doc(doc: np.ndarray, copy: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """``(doc, copy, slices...)`` per document."""
    if not len(doc):
        return
    order = np.lexsort((copy, doc))
    doc, copy = doc[order], copy[order]
    cuts = np.nonzero((doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]))[0] + 1
    parts = [np.split(c[order], cuts) for c in cols]
    first = np.concatenate([[0], cuts])
    for i, (d, c) in enumerate(zip(doc[first].tolist(), copy[first].tolist())):
        yield (d, c, *(p[i] for p in parts))


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Indexes where a run of equal keys begins."""
    return np.concatenate([[0], np.nonzero(sorted_keys[1:] != sorted_keys[:-1])[0] + 1]) if len(sorted_keys) else np.zeros(0, np.int64)


def doc_groups(doc: np.ndarray, copy: np.ndarray, n: int, *cols: np.ndarray) -> list[tuple]:
    """SETTLED rows: the documents' values, one blob per document group."""
    if not len(doc):
        return []
    g = mix(doc.astype(np.uint64)) % np.uint64(n)
    order = np.argsort(g, kind="stable")
    cuts = starts_of(g[order])
    return [(int(g[i[0]]), SETTLED, 0, packed(doc[i].astype("<i8"), copy[i].astype("<i8"), *(c[i].astype("<i8") for c in cols))) for i in np.split(order, cuts[1:])]


def settled(doc: np.ndarray, copy: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple]:
    """Rows of removed symbol ranges, overlapping ones of a document joined."""
    if not len(doc):
        return []
    order = np.lexsort((starts, copy, doc))
    doc, copy, starts, ends = doc[order], copy[order], starts[order], ends[order]
    other = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])
    base = np.cumsum(np.concatenate([[0], other])) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + base) - base  # furthest end so far within the document
    new = np.concatenate([[True], other | (starts[1:] > reach[:-1])])
    first = np.nonzero(new)[0]
    return doc_groups(doc[first], copy[first], n, starts[first], reach[np.append(first[1:] - 1, len(doc) - 1)])


def regrouped(rows: DataFrame, n: int, width: int, name: str) -> DataFrame:
    """``doc_id, _copy, <name>``: per document its ``width`` settled columns one after the other, as little-endian longs."""
    schema = pa.schema([("doc_id", pa.int64()), ("_copy", pa.int64()), (name, pa.binary())])

    def run(batches):
        now, blobs = None, []

        def out():
            cols = [np.concatenate(c) for c in zip(*(unpacked(x, *["<i8"] * (2 + width)) for x in blobs))]
            got = [(d, copy, b"".join(c.tobytes() for c in parts)) for d, copy, *parts in by_doc(*cols)]
            for lo in range(0, len(got), 5000):
                yield batches_of(got[lo : lo + 5000], schema)

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now and blobs:
                    yield from out()
                    blobs = []
                now = bucket
                blobs.append(data)
        if blobs:
            yield from out()

    return buckets(rows.where(F.col("kind") == SETTLED).select("bucket", "data"), n).mapInArrow(run, f"doc_id long, _copy long, {name} binary")


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal runs."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])] if len(first) else e[:0]


def buckets(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt by bucket, each bucket's together."""
    return df.repartition(min(n, _PARTS), "bucket").sortWithinPartitions("bucket")


def each_bucket(batches) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Per bucket: the rows that pass through, and the blobs to compare."""
    now, blobs, through = None, [], []
    for b in batches:
        for bucket, kind, doc, data in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now and blobs:
                yield through, blobs
                blobs, through = [], []
            now = bucket
            if kind == COMPARE:
                blobs.append(data)
            else:
                through.append((bucket, kind, doc, data))
                if len(through) >= 20_000:
                    yield through, []
                    through = []
    if blobs or through:
        yield through, blobs


def survivors(docs: DataFrame, symbols: Callable, k: int, window: int, n_buckets: int, groups: int, same_doc: bool, lead: Callable | None = None, sample_every: int = 4096) -> DataFrame:
    """Rows of kind SETTLED (surviving anchor positions by document group), OFTEN (a hot k-gram) and SAMPLE (leading symbols).

    ``docs`` is ``(doc_id, _copy, text)`` without null ids; ``symbols(text)`` gives the
    symbols. ``same_doc`` says whether a repetition within one document counts.
    """

    hot = HOT

    def flush(doc, copy, pos, h, leads):
        order = np.lexsort((pos, doc, h))
        doc, copy, pos, h = doc[order], copy[order], pos[order], h[order]
        first = starts_of(h)
        size = np.diff(np.append(first, len(h)))
        group = np.repeat(np.arange(len(first)), size)
        many = size > 1 if same_doc else doc[first] != doc[first + size - 1]
        known = many[group]
        send = ~known
        send[first] = True  # one representative of what is settled here
        count = np.where(known, size[group], 1)
        rows = doc_groups(doc[known], copy[known], groups, pos[known])
        rows += [(int.from_bytes(x[:4], "little") % n_buckets, SAMPLE, 0, x) for x in leads]
        doc, copy, pos, h, count = doc[send], copy[send], pos[send], h[send], count[send]
        b = (h >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.argsort(b, kind="stable")
        cuts = starts_of(b[order])
        for i in np.split(order, cuts[1:]) if len(order) else []:
            rows.append((int(b[i[0]]), COMPARE, 0, packed(h[i], doc[i].astype("<i8"), copy[i].astype("<i4"), pos[i].astype("<i4"), count[i].astype("<i4"))))
        return batches_of(rows, ROWS)

    def scan(batches):
        held, leads, n = [], [], 0
        for b in batches:
            for d, copy, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                sym, raw = symbols(text or b"")
                p, h = anchors(sym, k, window)
                if len(p):
                    held.append((np.full(len(p), d, np.int64), np.full(len(p), copy, np.int64), p, h))
                    n += len(p)
                    if lead:
                        leads += [lead(raw, int(x)) for x in p[(mix(h ^ np.uint64(d & (1 << 62) - 1)) % np.uint64(sample_every)) == 0]]
                if n >= _FLUSH:
                    yield flush(*(np.concatenate(c) for c in zip(*held)), leads)
                    held, leads, n = [], [], 0
        if held:
            yield flush(*(np.concatenate(c) for c in zip(*held)), leads)

    def prove(batches):
        for through, blobs in each_bucket(batches):
            rows = through
            if blobs:
                h, doc, copy, pos, count = (np.concatenate(c) for c in zip(*(unpacked(x, "<u8", "<i8", "<i4", "<i4", "<i4") for x in blobs)))
                order = np.lexsort((doc, h))
                h, doc, copy, pos, count = h[order], doc[order], copy[order], pos[order], count[order]
                first = starts_of(h)
                size = np.diff(np.append(first, len(h)))
                total = np.add.reduceat(count.astype(np.int64), first)
                again = np.maximum.reduceat(count, first) > 1
                again |= size > 1 if same_doc else doc[first] != doc[first + size - 1]
                keep = np.repeat(again, size) & (count == 1)
                rows += doc_groups(doc[keep], copy[keep], groups, pos[keep].astype(np.int64))
                rows += [(0, OFTEN, x, None) for x in h[first][total > hot].view(np.int64).tolist()]
            if rows:
                yield batches_of(rows, ROWS)

    dealt = docs.select("doc_id", "_copy", F.col("text").cast("binary")).mapInArrow(scan, ROWS_SQL)
    return buckets(dealt, n_buckets).mapInArrow(prove, ROWS_SQL)


def hot_filter(found: DataFrame) -> np.ndarray:
    """A bit set that names the hot k-grams; 2 ** (_FILTER - 6) rows at most come to the driver, however many there are."""
    h = F.col("doc")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(doc, {64 - _FILTER}) & 63 as int))")
    rows = found.where(F.col("kind") == OFTEN).groupBy(F.shiftrightunsigned(h, 70 - _FILTER).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << _FILTER - 6, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def named(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes the filter names."""
    p = h >> np.uint64(64 - _FILTER)
    return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def later(group: np.ndarray, doc: np.ndarray, copy: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an equal one lies in a smaller document, or further up in the same."""
    order = np.lexsort((pos, copy, doc, group))
    g, d, c, p = group[order], doc[order], copy[order], pos[order]
    first = starts_of(g)
    hit = d > np.repeat(d[first], np.diff(np.append(first, len(d))))
    own = np.nonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))[0] if len(g) else first
    hit |= p > np.repeat(p[own], np.diff(np.append(own, len(p))))
    out = np.zeros(len(order), bool)
    out[order] = hit
    return out


def settle_windows(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an equal window (by two digests) lies in a smaller document."""
    order = np.lexsort((doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.nonzero(new)[0]
    lead = np.repeat(first, np.diff(np.append(first, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > doc[order][lead]
    return out
