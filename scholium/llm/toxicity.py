"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Landmarks are word beginnings that labelled toxic documents share and clean
ones seldom have. Every word of a text is compared with them: a common
subsequence of most of a landmark's letters, found for all words at once, is
what makes a word worth the kernel, so letters may be missing, and any may be
inserted; signs inside a word and blanks between single letters are taken out.
The gap-weighted subsequence kernel gives a word's likeness to each landmark; a
document's value per landmark is the largest over its words. The Nyström map
turns these values into features, beside them stands how many different words
are alike; a linear SVM separates the classes and Platt's sigmoid makes a score
of its margin. A beginning also occurs in clean texts by chance, the more of
them the longer they are, so beside the largest values stands the evidence of
all words, as it is and against their number.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, batches_of, checkpoint

#: Length of the compared subsequences, and what each further character of span costs.
P, DECAY = 3, 0.6
RIDGE = 0.1
#: The normalised kernel is raised to this power (which is a kernel, too), so that faint likeness counts little.
POWER = 6
#: Longest compared span; longer words are cut into overlapping ones.
WIDTH = 24
#: Kernel values of words that a worker remembers.
_MEMO = 300_000
#: About so many unknown words of a batch's texts are compared at once.
_AT_ONCE = 10_000
#: Features beside the landmarks, and from about how many different words on evidence is held against their number.
EXTRAS, SHARE = 3, 50
#: How much more often a landmark occurs among the words of toxic documents.
TIMES = 3.0
_INNER = re.compile(r"[\W_]+")
_LETTERS = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def coded(words: list[str], width: int, pad: int) -> np.ndarray:
    """Character codes of words, a row each, padded to a width."""
    codes = np.array(words, f"U{max(1, width)}").view(np.uint32).reshape(len(words), max(1, width)).astype(np.int64)
    return np.where(codes > 0, codes, pad)


def gap_kernel(s: np.ndarray, t: np.ndarray, p: int = P, decay: float = DECAY) -> np.ndarray:
    """Per pair of rows (character codes; the two paddings differ) the sum over common subsequences of p
    characters of decay ** (length of both spans), by the usual dynamic program over all pairs at once."""
    out = np.zeros(len(s))
    for lo in range(0, len(s), 2_000):
        a, b = s[lo : lo + 2_000], t[lo : lo + 2_000]
        same = a[:, :, None] == b[:, None, :]
        inner, sq = np.ones((len(a), a.shape[1] + 1, b.shape[1] + 1)), decay * decay
        for level in range(1, p + 1):
            hit = same * inner[:, :-1, :-1] * sq
            if level == p:
                out[lo : lo + len(a)] = hit.sum(axis=(1, 2))
                break
            inner = np.zeros_like(inner)
            for j in range(1, b.shape[1]):
                hit[:, :, j] += decay * hit[:, :, j - 1]
            for i in range(a.shape[1]):
                inner[:, i + 1, 1:] = decay * inner[:, i, 1:] + hit[:, i]
    return out


class Model:
    def __init__(self, landmarks: list[str], worth: list[float] | None = None):
        self.landmarks = landmarks
        self.worth = np.ones(len(landmarks)) if worth is None else np.array(worth, float)
        self.codes = coded(landmarks, max(map(len, landmarks), default=0), -1)
        self.own = gap_kernel(np.where(self.codes < 0, 0, self.codes), self.codes)
        # for each character the landmark positions that hold it, as bits
        self.places = np.zeros((max(0, int(self.codes.max(initial=0))) + 1, len(landmarks)), np.uint16)
        for i, w in enumerate(landmarks):
            for j, c in enumerate(w):
                self.places[ord(c), i] |= np.uint16(1 << j)
        size = np.array([len(w) for w in landmarks], np.int64)
        self.full, self.least, self.most = ((1 << size) - 1).astype(np.uint16), -(-7 * size // 10), 2 * size + 2
        self.weights, self.bias, self.slope, self.shift = np.zeros(len(landmarks) + EXTRAS), 0.0, -1.0, 0.0
        self.memo: dict[str, tuple[np.ndarray, float] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def kernel(self, spans: list[str], pairs: np.ndarray) -> np.ndarray:
        """Normalised kernel, to the power, of (span, landmark) pairs; 1 for the landmark itself."""
        who = np.unique(pairs[:, 0])
        codes = coded([spans[i] for i in who.tolist()], WIDTH, 0)
        own = gap_kernel(codes, np.where(codes == 0, -1, codes))
        at = np.searchsorted(who, pairs[:, 0])
        k = gap_kernel(codes[at], self.codes[pairs[:, 1]])
        return (k / np.sqrt(np.maximum(own[at], 1e-300) * self.own[pairs[:, 1]])) ** POWER

    def alike(self, spans: list[str]) -> np.ndarray:
        """The pairs (span, landmark) in which the span has seven tenths of the landmark's letters in order, and at
        most about as many others; all spans at once, a landmark's letters as bits."""
        out = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(spans), 20_000):
            codes = coded(spans[lo : lo + 20_000], WIDTH, 0)
            n = (codes > 0).sum(axis=1)
            codes[codes >= len(self.places)] = 0
            v = np.broadcast_to(self.full, (len(codes), len(self.full))).copy()
            for j in range(int(n.max(initial=0))):  # a zero bit marks where the common length grows
                u = v & self.places[codes[:, j]]
                v = ((v + u) | (v - u)) & self.full
            common = np.bitwise_count(self.full) - np.bitwise_count(v).astype(np.int64)
            out.append(np.argwhere((common >= self.least) & (n[:, None] <= self.most)) + [lo, 0])
        return np.concatenate(out)

    def remember(self, words: list[str]) -> None:
        """Kernel values of words that are not known yet; None for those unlike every landmark."""
        spans: dict[str, list[str]] = {}
        for w in words:
            core = w if w.isalpha() else _INNER.sub("", w)
            self.memo[w] = None
            if len(core) <= WIDTH:
                if len(core) >= P:
                    spans.setdefault(core, []).append(w)
                continue
            for i in range(0, len(core) - WIDTH // 2, WIDTH // 2):
                spans.setdefault(core[i : i + WIDTH], []).append(w)
        if not spans:
            return
        names = list(spans)
        pairs = self.alike(names)
        for i, m, k in zip(*pairs.T.tolist(), self.kernel(names, pairs).tolist()):
            worth = float(self.worth[m]) * (1.0 if names[i].startswith(self.landmarks[m]) else k)
            for w in spans[names[i]]:
                v, most = self.memo[w] or (np.zeros(len(self.landmarks)), 0.0)
                v[m] = max(v[m], k)
                self.memo[w] = v, max(most, worth)

    def values(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text and landmark the largest kernel value over the words, then how many words are alike, what evidence
        they are, and that against the number of words; None where none is."""
        if not self.landmarks:
            return [None] * len(texts)
        out: list[np.ndarray | None] = []
        waiting: list[set[str]] = []
        fresh: set[str] = set()

        def tell():
            if len(self.memo) + len(fresh) > _MEMO:
                self.memo.clear()
                fresh.update(*waiting)
            self.remember(list(fresh))
            out.extend(map(self.value, waiting))
            waiting.clear()
            fresh.clear()

        for t in texts:
            low = (t or "").lower()
            words = set(low.split())
            words.update(_LETTERS.findall(low))
            waiting.append(words)
            fresh.update(w for w in words if w not in self.memo)
            if len(fresh) > _AT_ONCE:
                tell()
        tell()
        return out

    def value(self, words: set[str]) -> np.ndarray | None:
        k = [v for w in words if (v := self.memo[w]) is not None]
        if not k:
            return None
        worth = sum(e for _, e in k)
        more = [sum(float(v.max()) for v, _ in k), worth, worth * SHARE / (SHARE + len(words))]
        return np.append(np.max([v for v, _ in k], axis=0), np.log1p(more))

    def scores(self, texts: list[str | None]) -> list[float]:
        f = np.array([self.bias + (float(v @ self.weights) if v is not None else 0.0) for v in self.values(texts)])
        return (1 / (1 + np.exp(np.clip(self.slope * f + self.shift, -60, 60)))).tolist()

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Nyström features of the kernel values, squared-hinge SVM with balanced classes, Platt's sigmoid."""
        m = len(self.landmarks)
        if m and 0 < y.sum() < len(y):
            k = self.kernel(self.landmarks, np.argwhere(np.ones((m, m), bool))).reshape(m, m)
            count = x[:, m:]
            x = x[:, :m]
            val, vec = np.linalg.eigh((k + k.T) / 2)
            root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 0.05))) @ vec.T
            z = np.hstack([x @ root, count, np.ones((len(x), 1))])
            sign = np.where(y > 0, 1.0, -1.0)
            share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
            w, ridge = np.zeros(z.shape[1]), np.append(np.full(m, RIDGE), [*[RIDGE / 100] * count.shape[1], 0.0])
            for _ in range(60):  # Newton steps on the active rows
                miss = np.maximum(0, 1 - sign * (z @ w))
                active = miss > 0
                g = ridge * w - 2 * (z * (share * sign * miss)[:, None]).sum(0)
                h = np.diag(ridge + 1e-9) + 2 * (z[active] * share[active][:, None]).T @ z[active]
                step = np.linalg.solve(h, g)
                w = w - step
                if np.abs(step).max() < 1e-8:
                    break
            self.weights, self.bias = np.append(root @ w[:m], w[m:-1]), float(w[-1])
            f = z @ w
        else:
            f = np.zeros(len(y))
        a, b = (-2.0 if y.sum() else 0.0), 0.0
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
        t = np.where(y > 0, hi, lo)
        for _ in range(100):
            p = 1 / (1 + np.exp(np.clip(a * f + b, -60, 60)))
            d1, d2 = t - p, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(f * f * d2).sum() + 1e-6, (f * d2).sum()], [(f * d2).sum(), d2.sum() + 1e-6]])
            da, db = np.linalg.solve(h, [(f * d1).sum(), d1.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
            if max(abs(da), abs(db)) < 1e-7:
                break
        self.slope, self.shift = float(a), float(b)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, landmarks: int = 64, min_docs: int = 3, evidence: float = 14.0) -> Model:
    """Fits on at most ``max_rows`` labelled rows of each class (the first by a hash of the id), none of them held out.

    Landmarks are at most ``landmarks`` beginnings (3 to 12 characters) of words
    of the sample. Each occurs in ``min_docs`` toxic documents with different
    openings (copies count once). Counted are a document's different words, as
    a clean text of some length may hold any beginning by chance: a landmark's
    rate among the words of toxic documents is ``TIMES`` that of clean ones, with
    a log-likelihood ratio over ``evidence`` (14: about one chance in a million, as so
    many beginnings compete); one that only prolongs a chosen one is left out.
    The logarithm of the two rates' ratio is what a word with it is worth as evidence.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1)).distinct()
    ids = None
    for t in (0, 1):
        part = lab.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        ids = part if ids is None else ids.unionByName(part)
    ids = checkpoint(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).join(F.broadcast(ids), "doc_id")  # 2 * max_rows ids at most
    sample = checkpoint(texts.where("text is not null"))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        model = Model([])
        model.fit(np.zeros((sum(n.values()), EXTRAS)), np.repeat(1.0 if n.get(1) else 0.0, sum(n.values())))
        return model
    opening = F.when(F.col("toxic") == 1, F.xxhash64(F.substring("text", 1, 24))).otherwise(F.xxhash64("text"))
    single = sample.groupBy("toxic", opening.alias("opening")).agg(F.min_by("text", "doc_id").alias("text"))
    words = F.array_sort(F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)))
    # equal beginnings are neighbours in the order, so the first of a document is the one its predecessor does not have
    pairs = single.select("toxic", words.alias("words")).select("toxic", F.explode(F.arrays_zip("words", F.concat(F.array(F.lit("")), "words").alias("before"))).alias("p")).where("p.words is not null")
    pairs = pairs.select("toxic", F.col("p.words").alias("word"), F.col("p.before").alias("before"))
    starts = pairs.select("toxic", "before", F.explode(F.transform(F.sequence(F.lit(3), F.least(F.lit(12), F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("w"))
    new = ~F.startswith("before", F.col("w"))
    bad, good = F.col("toxic") == 1, F.col("toxic") == 0
    stat = starts.groupBy("w").agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(good, 1)).alias("good"), F.count(F.when(bad & new, 1)).alias("docs"))
    all_words = {r[0]: r[1] for r in pairs.groupBy("toxic").count().collect()}
    chance = (F.col("good") + 1) * F.lit(all_words.get(1, 0) / max(1, all_words.get(0, 0)))
    gain = F.col("bad") * F.log(F.col("bad") / chance) - F.col("bad") + chance
    stat = stat.where(F.col("docs") >= min_docs).where((F.col("bad") >= TIMES * chance) & (gain >= evidence))
    marks: list[str] = []
    worth: list[float] = []
    for r in stat.orderBy(gain.desc(), F.length("w").desc(), "w").limit(20 * landmarks).select("w", F.log(F.col("bad") / chance).alias("worth")).collect():
        if len(marks) < landmarks and not any(r["w"].startswith(m) or m.startswith(r["w"]) for m in marks):
            marks.append(r["w"])
            worth.append(r["worth"])
    model = Model(marks, worth)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    shared = Shared(docs.sparkSession, model)

    def features(batches):
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), (None if v is None else v.tolist() for v in shared.value.values(b.column(1).to_pylist()))))
            yield batches_of(rows, schema)

    rows = sample.select("toxic", "text").mapInArrow(features, "y int, x array<double>").collect()  # 2 * max_rows vectors at most
    rows = sorted((r[0], r[1] if r[1] is not None else [0.0] * (len(marks) + EXTRAS)) for r in rows)
    model.fit(np.array([r[1] for r in rows], float).reshape(len(rows), len(marks) + EXTRAS), np.array([r[0] for r in rows], float))
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) of every row's whole text.

    ``params`` go to ``train``. Only ``text`` enters a score. Null and empty
    texts have the score of a text without suspicious words; without labels of
    both classes every score is the same. Rows, ties and repeated rows stay as
    they are; docs' own columns named score or predicted are replaced.
    """
    shared = Shared(docs.sparkSession, train(docs, labels, **params))
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
