"""Quality by weak labels: overlapping heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer on the posterior labels."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

GOOD, NONE, BAD = 2, 1, 0
LABELLERS = ("capitals", "symbols", "purity", "doubled", "isolated", "repeats", "variety", "dominance", "endings")
BITS = 12
_SIGNS = frozenset("#%&$*|!<>{}[]=_~^@\\")
_SHAPE = np.array([1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (32, 9, 10, 11, 12, 13) else 5 + c % 27 for c in range(256)], np.int64)


def _three(good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else NONE


_PURE = re.compile(r"(?<!\S)[^\W\d_]+[.,;:!?]?(?!\S)")
_DOUBLED = re.compile(r"[^\w\s]{2,}")
_ISOLATED = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


def votes(text: str) -> list[int]:
    """One vote per labeller; on an empty text each votes bad."""
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] * len(LABELLERS)
    letters = len(text) - sum(map(text.count, " \n.,;:!?|#%&$*"))
    caps = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(1, letters)
    signs = sum(map(text.count, _SIGNS)) / len(text)
    pure, doubled, isolated = (len(rx.findall(text)) / n for rx in (_PURE, _DOUBLED, _ISOLATED))
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    count = Counter(words)
    variety, top = len(count) / n, count.most_common(1)[0][1] / n
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?…:\"'" for x in lines) / len(lines)
    long = n >= 20
    return [
        _three(caps < 0.15, caps > 0.3),
        _three(signs < 0.004, signs > 0.015),
        _three(pure > 0.85, pure < 0.6),
        _three(doubled < 0.02, doubled > 0.1),
        _three(isolated < 0.02, isolated > 0.1),
        _three(again < 0.05, again > 0.12) if n >= 5 else NONE,
        _three(variety > 0.4, variety < 0.15 and n < 2000) if long else NONE,
        _three(top < 0.15, top > 0.25) if long else NONE,
        _three(ended > 0.6, ended < 0.2),
    ]


def pattern(v: list[int]) -> int:
    return int(sum(x * 3**i for i, x in enumerate(v)))


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """EM over vote patterns: each labeller's vote distribution per class, the class prior, the posterior of good per pattern."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([[k // 3**i % 3 for i in range(len(LABELLERS))] for k in keys])
    # start from the majority of the votes
    post = np.clip(((v == GOOD).sum(1) - 1.5 * (v == BAD).sum(1) + 1.0) / 4 + 0.5, 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        acc = np.stack([[(w[:, v[:, i] == x].sum(1) + 0.5) for x in range(3)] for i in range(len(LABELLERS))])  # labeller, vote, class
        acc /= acc.sum(1, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(acc[i][v[:, i]]).T for i in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return acc, prior, dict(zip(keys, post.tolist()))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indexes and weights: trigrams of character shapes, and levels of word repetition; unit length."""
    dim = 1 << BITS
    total = np.zeros(dim)
    raw = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    for lo in range(0, max(1, len(raw) - 2), 1 << 20):
        s = _SHAPE[raw[lo : lo + (1 << 20) + 2]]
        if len(s) >= 3:
            total += np.bincount((s[:-2] * 1021 + s[1:-1] * 131 + s[2:] * 17) % (dim - 64), minlength=dim)
    total = np.sqrt(total / max(1.0, total.sum()))
    words = text.split()
    n = len(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    variety = len(set(words)) / n if n else 0.0
    total[dim - 64 + min(15, int(again * 16))] = 0.5
    total[dim - 48 + min(15, int(variety * 16))] = 0.5
    total[dim - 32 + min(15, int(np.log2(n + 1)))] = 0.3
    at = np.nonzero(total)[0]
    return at, total[at]


def fit(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    dim = 1 << BITS
    if not rows:
        return np.zeros(dim), 0.0
    at = np.concatenate([np.array(r[0], np.int64) for r in rows])
    x = np.concatenate([np.array(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    share = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    share /= share.sum()
    w, b, pw, pb, rate = np.zeros(dim), 0.0, np.zeros(dim), 0.0, 2.0
    for k in range(1, rounds + 1):
        m = (k - 1) / (k + 2)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        f = np.bincount(row, x * yw[at], len(rows)) + yb
        g = share * (1 / (1 + np.exp(-np.clip(f, -50, 50))) - y)
        pw, pb = w, b
        w = yw - rate * (np.bincount(at, x * g[row], dim) + ridge * yw)
        b = yb - rate * g.sum()
    return w, float(b)


def scored(docs: DataFrame, max_fit: int = 4000, threshold: float = 0.5) -> DataFrame:
    """``doc_id, pattern, posterior, score, keep`` per row of ``docs (doc_id, text)``.

    All rows vote and count in the EM; the scorer is fitted on at most
    ``max_fit`` rows, taken evenly from both sides of the posterior in the order
    of a hash of the id. Null texts count as empty, which is bad quality. Null
    ids and repeated rows are carried, ties need no order, further columns are
    ignored, an empty table gives none.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def vote(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern(votes(t)) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "pattern"])

    voted = checkpoint(base.mapInArrow(vote, "doc_id long, pattern int"))
    counts = {r[0]: r[1] for r in voted.groupBy("pattern").count().collect()}  # at most 3 ** 9 patterns
    post = estimate(counts)[2] if counts else {}
    good = sorted(k for k, p in post.items() if p > 0.5)
    ids = None
    for side in (F.col("pattern").isin(good), ~F.col("pattern").isin(good)):
        part = voted.where("doc_id is not null").where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit // 2)
        ids = part if ids is None else ids.unionByName(part)

    def featured(batches):
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())), pa.array([g[1].tolist() for g in got], pa.list_(pa.float32())), b.column(2)], names=["at", "x", "pattern"])

    chosen = base.join(F.broadcast(checkpoint(ids.select("doc_id", "pattern"))), "doc_id").select("doc_id", "text", "pattern")  # max_fit ids at most
    rows = chosen.mapInArrow(featured, "at array<int>, x array<float>, pattern int").orderBy("pattern", F.xxhash64("at", "x")).collect()  # max_fit sparse rows
    w, bias = fit([(r[0], r[1], post[r[2]]) for r in rows])
    by_pattern = dict(post)

    def score(batches):
        for b in batches:
            ids_, texts = b.column(0), b.column(1).to_pylist()
            out = []
            for t in texts:
                at, x = features(t)
                out.append(float(1 / (1 + np.exp(-np.clip(x @ w[at] + bias, -50, 50)))))
            pats = [pattern(votes(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids_, pa.array(pats, pa.int32()), pa.array([by_pattern.get(p, 0.5) for p in pats], pa.float64()), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())],
                names=["doc_id", "pattern", "posterior", "score", "keep"],
            )

    return base.mapInArrow(score, "doc_id long, pattern int, posterior double, score double, keep int")
