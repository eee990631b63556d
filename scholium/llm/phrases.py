"""Exact removal of repeated word windows by sharded Aho-Corasick automata.

Anchors of ``repeats`` (over words) bring recurring passages together. Every
document is streamed, and its passages (windows around surviving anchors) go
through automata twice: through one of the task's own batch, which settles what
recurs there, and, where that leaves the earliest occurrences of a batch,
through the automaton of their anchor's shard. An automaton confirms which
windows recur among its passages, holds each such window once (pyahocorasick),
and is run over all of the passages to locate every occurrence; every one but
the earliest is removed. Nothing is removed that an automaton did not locate.

An automaton's symbols are not words but the numbers of groups of words: a
window of 20 is four groups of five, and a text is streamed once for each of
the five ways to begin. A number is written in a few letters of a small
alphabet, one alphabet for each digit, as a node's children are searched one
after the other.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import Shared, batches_of, buckets_for, checkpoint, groups_for
from .suffix import removal

K = 5
_WINDOWS = 200_000
#: Bits of a letter, and the first one.
_LETTER, _FIRST = 5, 0x100
#: What parts two passages.
_GAP = np.zeros(1, np.uint64)


def word_symbols(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    words = text.split()  # bytes: exactly the words of [^\x20\x09-\x0D]+
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), words


def spelled(symbols: np.ndarray, digits: int) -> str:
    """Numbers as letters, the same count for each; no letter stands for two places of a number."""
    places = np.arange(digits)
    letters = _FIRST + (places << _LETTER) + (symbols[:, None] >> places * _LETTER & (1 << _LETTER) - 1)
    return letters.astype("<u2").tobytes().decode("utf-16-le")


def locate(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, passages: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of the passages (word hashes) that also occurs earlier among them: its passage, and its place in it."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(p) + 1 for p in passages])
    if not len(ends) or ends[-1] < window:
        return none
    words = np.concatenate([x for p in passages for x in (p, _GAP)])
    size = next(n for n in range(5, 0, -1) if window % n == 0)
    letters, windows = R.gram_hashes(words, size), R.gram_hashes(words, window)
    # the windows that lie inside a passage, and of those one of each that recurs
    inside = np.ones(len(words), bool)
    for i in range(window):
        inside[np.maximum(ends - 1 - i, 0)] = False
    inside = np.nonzero(inside[: len(windows)])[0]
    order = inside[np.argsort(windows[inside], kind="stable")]
    first = R.starts_of(windows[order])
    patterns = order[first[np.diff(np.append(first, len(order))) > 1]]
    if not len(patterns):
        return none
    keys = np.stack([letters[patterns + i] for i in range(0, window, size)], axis=1)
    of = np.unique(keys)  # groups in patterns are numbered from one on; all others are zero
    digits = -(-len(of).bit_length() // _LETTER)
    place = np.minimum(np.searchsorted(of, letters), len(of) - 1)
    number = np.where(of[place] == letters, place + 1, 0)
    text = spelled(np.searchsorted(of, keys).ravel() + 1, digits)
    n = digits * (window // size)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in range(len(keys)):
        machine.add_word(text[i * n : (i + 1) * n], i)
    machine.make_automaton()
    begin, what = [], []
    for phase in range(size):
        hits = np.fromiter(chain.from_iterable(machine.iter(spelled(number[phase::size], digits))), np.int64).reshape(-1, 2)
        begin.append(phase + ((hits[:, 0] + 1) // digits - window // size) * size)
        what.append(hits[:, 1])
    begin, what = np.concatenate(begin), np.concatenate(what)
    same = np.ones(len(begin), bool)  # word by word, so that equal hashes of different groups remove nothing
    for i in range(window):
        same &= words[begin + i] == words[patterns[what] + i]
    begin, what = begin[same], what[same]
    passage = np.searchsorted(ends, begin, side="right")
    at = begin - np.concatenate([[0], ends])[passage]
    gone = R.later(what, doc[passage], copy[passage], start[passage] + at)
    return passage[gone], at[gone]


def removed_ranges(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, _copy, _ranges`` (of word numbers) of documents (non-null ids) with windows that occur earlier."""
    nb = buckets_for(docs, 2 << 20)
    grams, groups = window - K + 1, groups_for(docs, nb)
    found = checkpoint(R.survivors(docs, word_symbols, K, window, nb, groups, same_doc=True))
    hot = Shared(docs.sparkSession, R.hot_filter(found))
    per_doc = R.regrouped(found, groups, 1, "data")
    where = docs.join(per_doc, ["doc_id", "_copy"]).select("doc_id", "_copy", F.col("text").cast("binary"), "data")

    def candidates(sym: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts of the windows around surviving anchors, the anchor and its hash, and a digest of each."""
        h = R.gram_hashes(sym, K)
        size = len(sym) - window + 1
        s, e = R.merged(np.maximum(0, pos - grams + 1), np.minimum(size, pos + 1))
        at = np.concatenate([np.arange(x, y) for x, y in zip(s.tolist(), e.tolist())] or [np.zeros(0, np.int64)])
        lead = np.lib.stride_tricks.sliding_window_view(h, grams)[at].argmin(axis=1) + at  # its first smallest k-gram
        alive = np.zeros(len(sym), bool)
        alive[pos] = True
        ok = alive[lead]
        at, lead = at[ok], lead[ok]
        return at, lead, h[lead], R.gram_hashes(sym, window)[at]

    def cut(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index of each run of windows that follow each other and share the other keys."""
        at, *same = keys
        new = at[1:] != at[:-1] + 1
        for k in same:
            new |= k[1:] != k[:-1]
        first = np.nonzero(np.concatenate([[True], new]))[0]
        return first, np.append(first[1:], len(at)) - 1

    def flush(held):
        number = np.concatenate([np.full(len(x[2]), i) for i, x in enumerate(held)])
        ids, copies = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        at, lead, h, h1 = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
        first, last = cut(at, number)
        own, s, e = number[first], at[first], at[last] + window
        passages = [held[i][7][a:b] for i, a, b in zip(own.tolist(), s.tolist(), e.tolist())]
        p, place = locate(ids[own], copies[own], s, passages, window)
        rows = R.settled(ids[own[p]], copies[own[p]], s[p] + place, s[p] + place + window, groups)
        done = np.zeros(len(at), bool)  # windows of a passage stand together
        done[first[p] + place] = True
        # what is left goes to the anchor's shard, or window by window to one of its digest
        is_hot = R.named(h, hot.value)
        shard = np.where(is_hot, np.uint64(nb) + (h1 >> np.uint64(32)) % np.uint64(nb), (h >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)
        i = np.nonzero(~done)[0]
        if len(i):
            first, last = cut(at[i], number[i], lead[i], np.where(is_hot[i], i, -1))
            own, s, e, to = number[i[first]], at[i[first]], at[i[last]] + window, shard[i[first]]
            order = np.argsort(to, kind="stable")
            for part in np.split(order, R.starts_of(to[order])[1:]):
                text = b"\n".join(b" ".join(held[int(own[j])][6][int(s[j]) : int(e[j])]) for j in part.tolist())
                head = R.packed(ids[own[part]].astype("<i8"), copies[own[part]].astype("<i4"), s[part].astype("<i4"))
                rows.append((int(to[part[0]]), R.COMPARE, 0, len(head).to_bytes(4, "little") + head + R.zstandard.ZstdCompressor(level=1).compress(text)))
        return batches_of(rows, R.ROWS)

    def passages(batches):
        held, n = [], 0
        for b in batches:
            for d, copy, text, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                sym, words = word_symbols(text)
                if len(sym) < window:
                    continue
                pos = np.unique(np.frombuffer(data, "<i8"))
                got = candidates(sym, pos[pos + K <= len(sym)])
                if len(got[0]):
                    held.append((d, copy, *got, words, sym))
                    n += len(got[0]) + len(words) // 4
                if n >= _WINDOWS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def shards(batches):
        for through, blobs in R.each_bucket(batches):
            rows, got, texts = through, [], []
            for x in blobs:
                size = int.from_bytes(x[:4], "little")
                got.append(R.unpacked(x[4 : 4 + size], "<i8", "<i4", "<i4"))
                texts.extend(R.zstandard.ZstdDecompressor().decompress(x[4 + size :]).split(b"\n"))
            if texts:
                doc, copy, start = (np.concatenate(c).astype(np.int64) for c in zip(*got))
                p, place = locate(doc, copy, start, [word_symbols(t)[0] for t in texts], window)
                rows += R.settled(doc[p], copy[p], start[p] + place, start[p] + place + window, groups)
            if rows:
                yield batches_of(rows, R.ROWS)

    told = R.buckets(where.mapInArrow(passages, R.ROWS_SQL), 2 * nb).mapInArrow(shards, R.ROWS_SQL)
    return R.regrouped(told, groups, 2, "_ranges")


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs (doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes when a window of
    ``window`` words over it also starts earlier (smaller id, or the same
    document further up), judged on the input. Null and short texts lose
    nothing. A null doc_id is kept whole and is no source for others. Rows that
    share a doc_id are one document if they hold the same text, else documents
    none of which comes before the other. Other columns do not matter; an empty table gives none.
    """
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def finish(text, s, e):
        words = (text or b"").split()
        cuts = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(words)]
        kept = [w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]
        return (len(words), int((e - s).sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), None)

    out = removal(docs.select("doc_id", "text"), finish, schema, "n_words long, n_removed long, kept_sha256 string, text string", lambda d: removed_ranges(d, window))
    return out.drop("text")
