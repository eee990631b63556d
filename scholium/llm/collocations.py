"""Phrase collocations: all short word n-grams as rows, counted per language and scored in decimals.

Two passes over the texts. The first explodes every word and pair, the second
every longer phrase all of whose pairs reach the least count: a phrase is never
more frequent than a pair in it, so nothing that can be a candidate is left
out. A filter of fixed size names the pairs; where it names too many, the
aggregate of the second pass only gets more rows. Both passes combine equal
phrases of a few megabytes of text before the rows leave the task, so a word
that is everywhere costs a row per task. The rest is joins of counted phrases
with the counts of their parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, checkpoint
from .repeats import mix

#: Bits of the filter of pairs, as a power of two.
FILTER = 26
#: Bytes of text that are combined at a time. A text goes whole; a longer one is cut at piece ends.
FLUSH = 1 << 20
#: Salts of the first of the two rankings: a language's candidates are ranked apart before its best ones meet.
SALTS = 32
_ROWS = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

# what a byte is: 0 part of a word, 1 blank, 2 end of a piece; letters A-Z become a-z
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """The words of some texts: ``data`` holds each with one blank behind it, ``at[i]:at[i + 1]`` is word i."""

    def __init__(self, raw: np.ndarray, doc_starts: np.ndarray, doc_langs: np.ndarray):
        kind = _KIND[raw]
        word = kind == 0
        first = np.empty(len(raw), bool)  # where a word starts: a word byte behind another kind or at a text's start
        if len(raw):
            first[0] = word[0]
            first[1:] = word[1:] & ~word[:-1]
            inner = doc_starts[doc_starts < len(raw)]
            first[inner] = word[inner]
        starts = np.nonzero(first)[0]
        last = np.empty(len(raw), bool)
        if len(raw):
            last[-1] = word[-1]
            last[:-1] = word[:-1] & (~word[1:] | first[1:])
        sizes = np.nonzero(last)[0] + 1 - starts
        self.n = len(starts)
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.data = np.full(int(self.at[-1]), 0x20, np.uint8)
        keep = np.ones(len(self.data), bool)
        keep[self.at[1:] - 1] = False
        self.data[keep] = _LOWER[raw[word]]
        doc = np.searchsorted(doc_starts, starts, "right") - 1
        breaks = np.searchsorted(np.nonzero(kind == 2)[0], starts)
        # whether word i + 1 follows word i in one piece
        self.joined = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1]) if self.n else np.zeros(0, bool)
        self.lang = doc_langs[doc]
        bare = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(self.data[keep])])
        encoded = bare.dictionary_encode()
        self.ids, self.words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that start with the words ``at``, joined by one blank."""
        lo, size = self.at[at], self.at[at + n] - self.at[at] - 1
        ends = np.cumsum(size)
        where = np.repeat(lo - np.concatenate([[0], ends[:-1]]), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(self.data[where])])


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key comes first, the number of every row's key, and the counts."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    nr = np.empty(len(key), np.int64)
    nr[order] = np.cumsum(new) - 1
    begins = np.nonzero(new)[0]
    return order[begins], nr, np.diff(np.append(begins, len(key)))


def hashes(words: pa.Array) -> np.ndarray:
    """A polynomial hash of the bytes of each word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1) if ends[-1] > ends[0] else np.zeros(0, np.uint64)
    sizes = np.diff(ends)
    power = np.multiply.accumulate(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    raw = np.append(raw * power[np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], sizes)], np.uint64(0))
    return mix(np.where(sizes > 0, np.add.reduceat(raw, ends[:-1] - ends[0]), np.uint64(0)))


def pair_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of pairs from those of their language and words."""
    return mix(mix(mix(lang) + first) + second)


def combined(w: Words, langs: list[str], sizes: tuple[int, int], known: np.ndarray | None):
    """Record batches ``(lang, n_words, phrase, n)`` of the distinct phrases of ``sizes[0]..sizes[1]`` words.

    With ``known`` (the filter's words) only phrases whose pairs are all in it.
    """
    n_langs = len(langs)
    start = np.arange(w.n)
    words = number = w.ids * n_langs + w.lang
    if sizes[0] == 1:
        first, number, counts = _distinct(words)
    names = np.array(langs, object)
    follows = np.append(w.joined, False)[: w.n]  # whether another word follows a word, from the pairs on: in a pair of the filter
    for n in range(1, sizes[1] + 1):
        if n > 1:
            go = follows[start + n - 2]
            start, number = start[go], number[go]
            if n == 2 and known is not None:
                h, of = hashes(w.words), hashes(pa.array(langs).cast(pa.binary()))
                p = pair_hash(of[w.lang[start]], h[w.ids[start]], h[w.ids[start + 1]]) >> np.uint64(64 - FILTER)
                ok = (known[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                start, number = start[ok], number[ok]
                follows = np.zeros(w.n, bool)
                follows[start] = True
            first, number, counts = _distinct(number * (int(words.max(initial=0)) + 1) + words[start + n - 1])
        if n >= sizes[0] and len(start):
            at = start[first]
            for lo in range(0, len(at), 1 << 15):
                part = at[lo : lo + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(names[w.lang[part]], pa.string()), pa.array(np.full(len(part), n, np.int32)), w.phrases(part, n), pa.array(counts[lo : lo + (1 << 15)])], schema=_ROWS)


def _cut(raw: np.ndarray, starts: np.ndarray) -> list[int]:
    """Where the bytes of some texts are divided: at a text's start or the end of a piece, about every ``FLUSH`` bytes."""
    out, at = [0], FLUSH
    while at < len(raw):
        k = int(np.searchsorted(starts, at))
        nxt = int(starts[k]) if k < len(starts) else len(raw)
        while at < nxt:
            stop = np.nonzero(_KIND[raw[at : min(nxt, at + FLUSH)]] == 2)[0]
            if len(stop):
                nxt = at + int(stop[0])
                break
            at += FLUSH
        if nxt >= len(raw):
            break
        out.append(nxt)
        at = nxt + FLUSH
    return [*out, len(raw)]


def exploded(docs: DataFrame, sizes: tuple[int, int], known: Shared | None = None) -> DataFrame:
    """``lang, n_words, phrase, n`` of the phrases in ``docs (lang, text)``, combined per few megabytes of text."""

    def flush(texts: list[np.ndarray], of: list[str]):
        raw = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
        names = sorted(set(of))
        nr = {x: i for i, x in enumerate(names)}
        langs = np.array([nr[x] for x in of], np.int64)
        ends = _cut(raw, starts)
        for lo, hi in zip(ends[:-1], ends[1:]):
            a, b = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi))
            w = Words(raw[lo:hi], np.maximum(starts[a:b] - lo, 0), langs[a:b])
            yield from combined(w, names, sizes, known.value if known is not None else None)

    def run(batches):
        texts, of, size = [], [], 0
        for b in batches:
            bodies = b.column(1).cast(pa.binary())
            for i, lang in enumerate(b.column(0).to_pylist()):
                t = bodies[i].as_buffer()
                if t is not None and len(t):
                    texts.append(np.frombuffer(t, np.uint8))
                    of.append(lang)
                    size += len(t)
                if size >= FLUSH:
                    yield from flush(texts, of)
                    texts, of, size = [], [], 0
        if texts:
            yield from flush(texts, of)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, n_words int, phrase string, n long")


def counted(docs: DataFrame, max_n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, n_words, phrase, a)`` of all phrases that occur ``least`` times or more, and ``(lang, n)``: all words."""

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("a"))

    both = summed(exploded(docs, (1, min(2, max_n))))
    # words of each language are summed beside the phrases that are kept, in one pass: a row per language and task
    kept = F.col("a") >= least
    short = checkpoint(both.groupBy("lang", F.when(kept, F.col("n_words")).alias("n_words"), F.when(kept, F.col("phrase")).alias("phrase")).agg(F.sum(F.when(kept, F.col("a"))).alias("a"), F.sum(F.when(F.col("n_words") == 1, F.col("a")).otherwise(0)).alias("n")))
    words = short.groupBy("lang").agg(F.sum("n").alias("n"))
    short = short.where("phrase is not null").select("lang", "n_words", "phrase", "a")
    if max_n < 3:
        return short, words

    def positions(batches):
        for b in batches:
            lang, one, two = (hashes(c.cast(pa.binary())) for c in b.columns)
            p = pair_hash(lang, one, two) >> np.uint64(64 - FILTER)
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["w", "bit"])

    pairs = short.where("n_words = 2").select("lang", F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))
    bits = pairs.mapInArrow(positions, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^FILTER / 64 rows at most
    table = np.zeros(1 << FILTER - 6, np.uint64)
    table[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
    long_ = checkpoint(summed(exploded(docs, (3, max_n), Shared(docs.sparkSession, table))).where(F.col("a") >= least))
    return short.unionByName(long_), words


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    ``docs (lang, text)``; a null language is ``und``, a null text is empty.
    Letters A-Z are lower-cased, texts divided into pieces at ``.,;:!?`` and
    line ends, pieces into words at blanks and tabs. A candidate has 2 to
    ``max_n`` words and occurs ``least`` times or more within pieces (``a``,
    overlaps included). Of its cuts into a first part (``l`` times) and a rest
    (``r`` times) the one with the lowest score ``floor(2000000 a / (l + r))``
    counts, ties to the shortest first part. A candidate within a longer one
    that occurs at least ``share`` percent as often is dropped. Scores are
    decimals of 38 digits. ``n`` is the number of words of the language. Order:
    score, ``a`` (both falling), phrase. Repeated rows count each; an empty
    table, or one without frequent phrases, gives no rows.
    """
    freq, words = counted(docs, max_n, least)
    cand = freq.where("n_words >= 2")
    cuts = cand.select("lang", "phrase", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    left, right = (freq.select("lang", F.col("phrase").alias(c), F.col("a").alias(k)) for c, k in (("head", "l"), ("rest", "r")))
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    # a longer candidate within which all words lie contains one that is longer by a word and at least as frequent
    longer = cand.where("n_words >= 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("above")).withColumnRenamed("lang", "lang_").withColumnRenamed("phrase", "phrase_")
    within = (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("phrase_")) & (F.col("above").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share)
    left_ = best.join(longer, within, "left_anti")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    apart = Window.partitionBy("lang", "salt").orderBy(*order)
    first = left_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("nth", F.row_number().over(apart)).where(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
e AS (SELECT lang, 1 AS n_words, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i : i + 1], ' '))) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) FROM w
      UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) FROM w),
f AS (SELECT lang, n_words, phrase, count(*) AS a FROM e GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE n_words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE n_words >= 2 AND a >= 30),
s AS (SELECT c.lang, c.phrase, c.n_words, c.a, k, l.a AS l, r.a AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (l.a + r.a) AS BIGINT) AS score
      FROM c, range(1, 4) AS x(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : k], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1 :], ' ') WHERE k < c.n_words),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT c.lang, c.a, array_to_string(c.ws[i : i + m - 1], ' ') AS phrase FROM c, range(2, 4) AS x(m), range(1, 4) AS y(i) WHERE m < c.n_words AND i + m - 1 <= c.n_words),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * CAST(o.a AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT)))
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
