"""Exact removal of repeated byte strings by a distributed, sampled suffix array.

The suffixes that are sorted start at the surviving anchors of ``repeats``:
every repeated string holds one, so nothing is lost, and only a few hundredths
of all suffixes travel. Splitters sampled from the corpus range-partition them
by their leading k bytes (equal leads are never cut apart, so runs do not cross
a boundary; leads too common for one bucket go by the digest of the whole
string instead). Each bucket sorts its suffixes, and the reversed bytes before
them, by multikey quicksort; neighbours' common lengths then give every class
of equal strings around an anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import Shared, batches_of, buckets_for, checkpoint, groups_for

K = 16
_RECORDS = 100_000
_SLICE = 1 << 15
#: Suffix buckets per document bucket: a suffix travels with its surroundings.
_FINER = 4
#: A bucket of 4 MB of compressed text has about so many anchors.
_ANCHORS_PER_BUCKET = 400_000
_HASH2 = np.uint64(0xC2B2AE3D27D4EB4F)


def byte_symbols(text: bytes) -> tuple[np.ndarray, bytes]:
    return np.frombuffer(text, np.uint8), text


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Sorted order of the rows of a matrix of words by multikey quicksort: after each word only ties are sorted further."""
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.concatenate([[0], words[order[1:], 0] != words[order[:-1], 0]])) if n else np.zeros(0, np.int64)
    for c in range(1, width):
        if not n:
            break
        same = group[1:] == group[:-1]
        tied = np.nonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))[0]
        if not len(tied):
            break
        sub = order[tied]
        sub = sub[np.lexsort((words[sub, c], group[tied]))]
        order[tied] = sub
        new = np.concatenate([[False], group[1:] != group[:-1]])
        new[tied[1:]] |= (words[order[tied[1:]], c] != words[order[tied[:-1]], c]) | (tied[1:] - tied[:-1] > 1)
        group = np.cumsum(new)
    return order


def sorted_suffixes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common length of each with the row before (0 for the first)."""
    n, width = m.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = m
    order = multikey_order(wide.view(">u8").astype(np.uint64))
    del wide
    common = np.zeros(n, np.int64)
    for lo in range(1, n, _SLICE):
        hi = min(n, lo + _SLICE)
        differ = m[order[lo:hi]] != m[order[lo - 1 : hi - 1]]
        common[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Per row the number of its class of rows that share ``length`` leading bytes."""
    c = common < length
    if len(c):
        c[0] = False
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(c)
    return out


def repeated_offsets(ctx: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Bit o of a row: its window that starts o bytes before the anchor also starts in a smaller document of the rows.

    ``ctx`` holds window - K bytes before and window bytes from each anchor; lo..hi are the offsets inside the document.
    """
    left, out = window - K, np.zeros(len(doc), np.uint64)
    lead = np.ascontiguousarray(ctx[:, left : left + K]).view("<u8").reshape(len(doc), -1)
    order = multikey_order(lead)
    cut = np.concatenate([[True], (lead[order[1:]] != lead[order[:-1]]).any(axis=1)]) if len(doc) else np.zeros(0, bool)
    first = np.nonzero(cut)[0]
    size = np.diff(np.append(first, len(doc)))
    some = order[np.repeat((np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)) if len(first) else cut, size)]
    if not len(some):
        return out
    whole, (ctx, doc, lo, hi) = out, (a[some] for a in (ctx, doc, lo, hi))  # only leads of two documents or more
    n, out = len(doc), np.zeros(len(doc), np.uint64)
    right_order, right_common = sorted_suffixes(ctx[:, left:])
    left_order, left_common = sorted_suffixes(ctx[:, left - 1 :: -1] if left else ctx[:, :0])
    by = np.argsort(doc, kind="stable")
    sorted_doc = doc[by]
    for o in range(left + 1):
        ok = ((lo <= o) & (o <= hi))[by]
        if not ok.any():
            continue
        at = by[ok]
        key = classes(right_order, right_common, window - o)[at] * n + (classes(left_order, left_common, o)[at] if o else 0)
        order = np.argsort(key, kind="stable")  # documents ascend within a class
        first = R.starts_of(key[order])
        d = sorted_doc[ok][order]
        later = d > np.repeat(d[first], np.diff(np.append(first, len(d))))
        out[at[order[later]]] |= np.uint64(1 << o)
    whole[some] = out
    return whole


def _ranges(doc, copy, pos, mask, window, n):
    """The byte ranges of the windows that a mask names."""
    rows, starts = [], []
    for o in range(window - K + 1):
        hit = np.nonzero(mask >> np.uint64(o) & np.uint64(1))[0]
        rows.append(hit)
        starts.append(pos[hit] - o)
    at, s = np.concatenate(rows), np.concatenate(starts)
    return R.settled(doc[at], copy[at], s, s + window, n)


def removed_ranges(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, _copy, _ranges`` of documents (non-null ids) with bytes that a smaller document has."""
    nb = buckets_for(docs, 4 << 20)
    left, n_suffix, groups = window - K, _FINER * nb, groups_for(docs, nb)
    # about a million leads at most come to the driver as the sample for the splitters, however large the input is
    every = max(4096, nb * _ANCHORS_PER_BUCKET >> 20)
    found = checkpoint(R.survivors(docs, byte_symbols, K, window, nb, groups, same_doc=False, lead=lambda raw, p: raw[p : p + K], sample_every=every))
    names = R.hot_filter(found)
    any_hot, hot = bool(names.any()), Shared(docs.sparkSession, names)
    sample = sorted(r[0] for r in found.where(F.col("kind") == R.SAMPLE).select("data").collect())
    splitters = np.array(sorted(set(sample[:: max(1, len(sample) // n_suffix)])), dtype=f"S{K}")  # at most about one for each bucket
    per_doc = R.regrouped(found, groups, 1, "data")
    where = docs.join(per_doc, ["doc_id", "_copy"]).select("doc_id", "_copy", F.col("text").cast("binary"), "data")

    def flush(held, hot_held):
        rows = []
        if held:
            ctx, doc, copy, pos, lo, hi = (np.concatenate(c) for c in zip(*held))
            mask = repeated_offsets(ctx, doc, lo, hi, window)
            rows += _ranges(doc, copy, pos, mask, window, groups)
            every = (np.uint64(1) << (hi - lo + 1).astype(np.uint64)) - np.uint64(1) << lo.astype(np.uint64)
            todo = mask != every
            ctx, doc, copy, pos, lo, hi = (a[todo] for a in (ctx, doc, copy, pos, lo, hi))
            leads = np.ascontiguousarray(ctx[:, left : left + K]).view(f"S{K}")[:, 0]
            b = np.searchsorted(splitters, leads, side="right")
            for i in np.split(np.argsort(b, kind="stable"), np.nonzero(np.diff(np.sort(b)))[0] + 1) if len(b) else []:
                data = R.packed(ctx[i].astype(np.uint8), doc[i].astype("<i8"), copy[i].astype("<i4"), pos[i].astype("<i4"), lo[i].astype("i1"), hi[i].astype("i1"))
                rows.append((int(b[i[0]]), R.COMPARE, 0, data))
        if hot_held:
            h1, h2, doc, copy, pos = (np.concatenate(c) for c in zip(*hot_held))
            done = R.settle_windows(h1, h2, doc)
            rows += R.settled(doc[done], copy[done], pos[done], pos[done] + window, groups)
            h1, h2, doc, copy, pos = (a[~done] for a in (h1, h2, doc, copy, pos))
            b = (h1 >> np.uint64(32)) % np.uint64(nb)
            for i in np.split(np.argsort(b, kind="stable"), np.nonzero(np.diff(np.sort(b)))[0] + 1) if len(b) else []:
                rows.append((2 * n_suffix + int(b[i[0]]), R.COMPARE, 1, R.packed(h1[i], h2[i], doc[i].astype("<i8"), copy[i].astype("<i4"), pos[i].astype("<i4"))))
        return batches_of([(b, k, d, x) if k != R.COMPARE else (b, k, 0, bytes([d]) + x) for b, k, d, x in rows], R.ROWS)

    def surroundings(batches):
        held, hot_held, n = [], [], 0
        for b in batches:
            for d, copy, text, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = np.frombuffer(text, np.uint8)
                size = len(raw)
                pos = np.unique(np.frombuffer(data, "<i8"))
                pos = pos[pos + K <= size]
                if size < window or not len(pos):
                    continue
                for lo_at in range(0, len(pos), _RECORDS):
                    p = pos[lo_at : lo_at + _RECORDS]
                    base = max(0, int(p[0]) - left)
                    part = raw[base : int(p[-1]) + window]
                    wide = np.concatenate([np.zeros(left, np.uint8), part, np.zeros(window, np.uint8)])
                    ctx = wide[(p - base)[:, None] + np.arange(left + window)]
                    lo, hi = np.maximum(0, p + window - size), np.minimum(left, p)
                    if any_hot:
                        h = np.ascontiguousarray(ctx[:, left : left + K])
                        g = np.zeros(len(p), np.uint64)
                        for c in range(K):
                            g = g * R._MUL + (h[:, c].astype(np.uint64) + np.uint64(1))
                        is_hot = R.named(R.mix(g), hot.value)
                        if is_hot.any():
                            s, e = R.merged(p[is_hot] - hi[is_hot], p[is_hot] - lo[is_hot] + 1)
                            at = np.concatenate([np.arange(x, y) for x, y in zip(s.tolist(), e.tolist())])
                            at = at[(at >= 0) & (at + window <= size)]
                            seg = raw[int(at[0]) : int(at[-1]) + window]
                            h1, h2 = R.gram_hashes(seg, window)[at - at[0]], R.gram_hashes(seg, window, _HASH2)[at - at[0]]
                            hot_held.append((h1, h2, np.full(len(at), d, np.int64), np.full(len(at), copy, np.int64), at))
                            n += len(at) // 4
                            p, ctx, lo, hi = p[~is_hot], ctx[~is_hot], lo[~is_hot], hi[~is_hot]
                    if len(p):
                        held.append((ctx, np.full(len(p), d, np.int64), np.full(len(p), copy, np.int64), p, lo, hi))
                        n += len(p)
                    if n >= _RECORDS:
                        yield flush(held, hot_held)
                        held, hot_held, n = [], [], 0
        if held or hot_held:
            yield flush(held, hot_held)

    def compare(batches):
        for through, blobs in R.each_bucket(batches):
            rows = through
            suffixes, digests = [x[1:] for x in blobs if not x[0]], [x[1:] for x in blobs if x[0]]
            if suffixes:
                ctx, doc, copy, pos, lo, hi = (np.concatenate(c) for c in zip(*(R.unpacked(x, left + window, "<i8", "<i4", "<i4", "i1", "i1") for x in suffixes)))
                mask = repeated_offsets(ctx, doc, lo, hi, window)
                rows += _ranges(doc, copy, pos.astype(np.int64), mask, window, groups)
            if digests:
                h1, h2, doc, copy, pos = (np.concatenate(c) for c in zip(*(R.unpacked(x, "<u8", "<u8", "<i8", "<i4", "<i4") for x in digests)))
                done = R.settle_windows(h1, h2, doc)
                at = pos[done].astype(np.int64)
                rows += R.settled(doc[done], copy[done], at, at + window, groups)
            if rows:
                yield batches_of(rows, R.ROWS)

    told = R.buckets(where.mapInArrow(surroundings, R.ROWS_SQL), 2 * nb + 2).mapInArrow(compare, R.ROWS_SQL)
    return R.regrouped(told, groups, 2, "_ranges")


def removal(docs: DataFrame, finish, schema: pa.Schema, schema_sql: str, ranges_of) -> DataFrame:
    """Applies ``finish(text, starts, ends)`` to every document with its removed ranges; the columns of docs stay in front."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")).where("doc_id is not null")
    several = checkpoint(ids.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("doc_id"))
    known = docs.where("doc_id is not null")
    if several.isEmpty():
        known = known.withColumn("_copy", F.lit(0).cast("long"))
    else:  # rows that share an id with different texts are told apart by a hash of the text
        told = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 31))
        known = known.join(several.withColumn("_several", F.lit(True)), "doc_id", "left").withColumn("_copy", F.when(F.col("_several"), told).otherwise(F.lit(0).cast("long")))
    parts = [
        known.select(*docs.columns, "_copy").join(ranges_of(known.select("doc_id", "_copy", "text")), ["doc_id", "_copy"], "left").select(*docs.columns, "_ranges"),
        docs.where("doc_id is null").withColumn("_ranges", F.lit(None).cast("binary")),
    ]
    names, made_names = docs.columns, schema.names
    text_at, n_cols = names.index("text"), len(names)

    def run(batches):
        for b in batches:
            out = []
            for text, data in zip(b.column(text_at).cast(pa.binary()).to_pylist(), b.column(n_cols).to_pylist()):
                if data:
                    s, e = R.merged(*np.frombuffer(data, "<i8").reshape(2, -1))
                else:
                    s = e = np.zeros(0, np.int64)
                out.append(finish(text, s, e))
            cols = [b.column(i) for i in range(n_cols)]
            made = [pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[] for _ in schema], schema)]
            kept = [pa.field(names[i], c.type) for i, c in enumerate(cols) if names[i] not in made_names]
            cols = [c for i, c in enumerate(cols) if names[i] not in made_names]
            yield pa.RecordBatch.from_arrays(cols + made, schema=pa.schema(kept + list(schema)))

    front = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in schema.names)
    return parts[0].unionByName(parts[1]).mapInArrow(run, f"{front}, {schema_sql}" if front else schema_sql)


def kept_bytes(text: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    """The bytes outside the ranges."""
    cuts = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs (doc_id, text)``.

    A byte goes when a ``window``-byte string over it also starts in a document
    with a smaller id, judged on the input. Null and short texts lose nothing.
    A null doc_id is kept whole and is no source for others. Rows that share a
    doc_id never repeat each other, whether their texts are the same or not.
    Very long texts are read in overlapping segments. Other columns do
    not matter; an empty table gives none.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def finish(text, s, e):
        text = text or b""
        return (len(text), int((e - s).sum()), len(s), hashlib.sha256(kept_bytes(text, s, e)).hexdigest(), None)

    out = removal(docs.select("doc_id", "text"), finish, schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string", lambda d: removed_ranges(d, window))
    return out.drop("text")


def cleaned(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (bytes of a character that is cut in part are dropped)."""
    schema = pa.schema([("text", pa.string())])
    finish = lambda text, s, e: (None if text is None else kept_bytes(text, s, e).decode("utf-8", "ignore") if len(s) else text.decode(),)
    return removal(docs, finish, schema, "text string", lambda d: removed_ranges(d, window)).select(*docs.columns)
