"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under a zero are ignored,
so a substituted word there does not hide the match. Every position of every
document is hashed under every mask and joined with the hashes of the
benchmark. Around each hit the two word sequences are compared on the hit's
diagonal, and the best stretch (substitutions cost, matches gain) decides.

A benchmark of up to ``BLOCK_WORDS`` words is a hash table in every task, and
documents never move. A larger one is joined by a shuffle on the seed hashes;
a filter of fixed size keeps hashes that the benchmark lacks out of it. Both
ways compare the same diagonals and give the same rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, batches_of, checkpoint
from .repeats import mix

#: Five words of up to nine count under each mask.
MASKS = ("11111", "1101011", "1011101", "110100101", "101001011")
#: A shorter item counts only whole and unchanged.
SHORT = 8
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\W_]+")
_TABLE_BITS = 22
_FILTER_BITS = 27
_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(8)]

FOUND = "matched int, length int, doc_start int, item_start int"
_FOUND = [(c, pa.int32()) for c in ("matched", "length", "doc_start", "item_start")]


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def seed_hashes(w: np.ndarray, mask: str, number: int) -> np.ndarray:
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for j, i in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out += w[i : i + n] * _MUL[j]
    return mix(out)


def item_seeds(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, positions)`` of an item under every mask; a short item has one seed, itself."""
    if 0 < len(w) < SHORT:
        return [(seed_hashes(w, "1" * len(w), 100 + len(w)), np.zeros(1, np.int64))]
    return [(h, np.arange(len(h))) for m, mask in enumerate(MASKS) if len(h := seed_hashes(w, mask, m))]


def text_seeds(w: np.ndarray, short: tuple[int, ...]) -> list[np.ndarray]:
    """The hashes of a text at its positions: under every mask, and of runs as long as the short items."""
    return [seed_hashes(w, mask, m) for m, mask in enumerate(MASKS)] + [seed_hashes(w, "1" * n, 100 + n) for n in short]


def stretch(w: np.ndarray, t: np.ndarray, shift: int, least: int) -> tuple[int, int, int, int] | None:
    """``(matched, length, doc_start, item_start)`` of the best accepted stretch of one diagonal: the best gain, or else most equal words."""
    lo, hi = max(0, shift), min(len(w), shift + len(t))
    same = w[lo:hi] == t[lo - shift : hi - shift]
    if len(t) < SHORT:
        return (len(t), len(t), lo, 0) if hi - lo == len(t) and same.all() else None
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(np.nonzero(total[: end + 1] == total[: end + 1].min())[0][-1])
    matched, need = int(same[start:end].sum()), min(least, -(-4 * len(t) // 5))
    if matched < need:  # the longest stretches, of which at most a quarter differs
        equal = np.concatenate([[0], np.cumsum(same)])
        first = np.searchsorted(-np.minimum.accumulate(total), -total)  # the earliest start for each end
        end = int((equal - equal[first]).argmax())
        hits = np.nonzero(same[first[end] : end])[0] + first[end]
        if len(hits):
            start, end, matched = int(hits[0]), int(hits[-1]) + 1, len(hits)
    return (matched, end - start, lo + start, lo + start - shift) if matched >= need else None


def best(w: np.ndarray, t: np.ndarray, shifts, least: int) -> tuple[int, int, int, int] | None:
    """The stretch with most equal words over diagonals, the first on a tie."""
    got = None
    for shift in sorted(shifts):
        s = stretch(w, t, shift, least)
        if s and (got is None or s[0] > got[0]):
            got = s
    return got


class Block:
    """The seeds of a bounded benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if len(w := word_hashes(t))]
        self.short = tuple(sorted({len(w) for _, w in self.items if len(w) < SHORT}))
        parts = [(h, np.full(len(h), n), at) for n, (_, w) in enumerate(self.items) for h, at in item_seeds(w)]
        h, item, at = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def overlaps(self, w: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, matched, length, doc_start, item_start)`` of the best accepted stretch per item."""
        shifts: dict[int, set[int]] = {}
        for h in text_seeds(w, self.short):
            at = np.nonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])[0]
            if len(at):
                lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
                for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    for n, q in zip(self.item[a:b].tolist(), self.at[a:b].tolist()):
                        shifts.setdefault(n, set()).add(p - q)
        found: dict[int, tuple[int, int, int, int, int]] = {}
        for n in sorted(shifts):
            item_id, t = self.items[n]
            s = best(w, t, shifts[n], least)
            if s and s[0] > found.get(item_id, (0, 0))[1]:
                found[item_id] = (item_id, *s)
        return [found[i] for i in sorted(found, key=lambda i: (i is None, i))]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _words(benchmark: DataFrame) -> int:
    return (_items(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0) // 6


def _block(benchmark: DataFrame) -> Shared:
    """Up to BLOCK_WORDS words of items, as every task's hash table."""
    return Shared(benchmark.sparkSession, Block([tuple(r) for r in _items(benchmark).orderBy("item_id", "text").collect()]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _joined(docs: DataFrame, benchmark: DataFrame, min_match: int) -> DataFrame:
    """``_key, item_id, matched, length, doc_start, item_start`` of documents (by key) and items, by a shuffle on seed hashes."""
    spark = docs.sparkSession
    items = _items(benchmark).withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    seeds = pa.schema([("h", pa.int64()), ("item", pa.int64()), ("at", pa.int32())])

    def of_items(batches):
        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                for h, at in item_seeds(word_hashes(t)):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i), pa.int64()), pa.array(at, pa.int32())], schema=seeds)

    bench = checkpoint(items.select("item", "text").mapInArrow(of_items, "h long, item long, at int"))

    def lengths(batches):
        for b in batches:
            n = {k for t in b.column(0).to_pylist() if 0 < (k := len(word_hashes(t))) < SHORT}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(n), pa.int32())], names=["n"])

    short = tuple(sorted(r[0] for r in items.select("text").mapInArrow(lengths, "n int").distinct().collect()))  # fewer than SHORT
    place = F.shiftrightunsigned("h", 64 - _FILTER_BITS)
    words = bench.groupBy(F.shiftright(place, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 as int)))" % (64 - _FILTER_BITS)).alias("bits")).toArrow()  # 2 ** (_FILTER_BITS - 6) rows at most
    table = np.zeros(1 << _FILTER_BITS - 6, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    have = Shared(spark, table)
    hits = pa.schema([("h", pa.int64()), ("_key", pa.int64()), ("pos", pa.int32())])

    def of_docs(batches):
        for b in batches:
            for key, t in zip(*(c.to_pylist() for c in b.columns)):
                for h in text_seeds(word_hashes(t), short):
                    p = h >> np.uint64(64 - _FILTER_BITS)
                    at = np.nonzero(have.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1))[0]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), key), pa.int64()), pa.array(at, pa.int32())], schema=hits)

    texts = docs.select("_key", F.col("text").cast("string").alias("text")).where("text is not null")
    met = texts.mapInArrow(of_docs, "h long, _key long, pos int").join(bench, "h").select("_key", "item", (F.col("pos") - F.col("at")).alias("shift"))
    pairs = checkpoint(met.groupBy("_key", "item").agg(F.collect_set("shift").alias("shifts")))
    near = texts.join(pairs.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    both = pairs.join(near, "_key").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    schema = pa.schema([("_key", pa.int64()), ("item_id", pa.int64()), *_FOUND])

    def verify(batches):
        for b in batches:
            rows = [(k, i, *s) for k, i, shifts, t, u in zip(*(c.to_pylist() for c in b.columns)) if (s := best(word_hashes(t), word_hashes(u), shifts, min_match))]
            yield batches_of(rows, schema)

    out = both.select("_key", "item_id", "shifts", "text", "item_text").mapInArrow(verify, f"_key long, item_id long, {FOUND}")
    # several texts of one item: the one with most equal words
    top = F.max_by(F.struct("matched", "length", "doc_start", "item_start"), F.struct("matched", -F.col("doc_start"), -F.col("item_start")))
    return checkpoint(out.groupBy("_key", "item_id").agg(top.alias("s")).select("_key", "item_id", "s.*"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, matched, length, doc_start, item_start`` for every document and item that overlap.

    They overlap if, on one alignment without gaps, a stretch in which at most
    about a quarter of the words differs holds ``min_match`` equal words, or four
    fifths of a shorter item; an item of fewer than eight words counts only
    whole and unchanged. Words are lower-case runs of letters and digits. Items
    without words, and null or empty texts of either table, overlap nothing;
    repeated rows give repeated results; a null id is carried as null. The whole
    text counts, however long. Further columns are ignored. Up to
    ``block_words`` words of benchmark stand in every task and documents don't
    move; beyond, seed hashes are joined by a shuffle, where AQE splits a hash
    that many documents have.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _words(benchmark) > block_words:
        keyed = _keyed(docs)
        return keyed.select("_key", "doc_id").join(_joined(keyed, benchmark, min_match), "_key").drop("_key")
    shared = _block(benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *_FOUND])

    def run(batches):
        for b in batches:
            yield batches_of([(d, *x) for d, t in zip(*(c.to_pylist() for c in b.columns)) for x in shared.value.overlaps(word_hashes(t), min_match)], schema)

    return docs.mapInArrow(run, f"doc_id long, item_id long, {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item (see ``contaminated``); rows and columns are otherwise unchanged."""
    if _words(benchmark) > block_words:
        keyed = _keyed(docs)
        return keyed.join(_joined(keyed, benchmark, min_match).select("_key").distinct(), "_key", "left_anti").select(*docs.columns)
    shared, at = _block(benchmark), docs.columns.index("text")

    def run(batches):
        for b in batches:
            clean = [not shared.value.overlaps(word_hashes(t), min_match) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
