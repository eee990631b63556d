"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A naive Bayes classifier over letter frequencies, fitted on the documents of
the labelled table (the letters are those that tell its domains apart), gives every document a posterior over the domains. Rates
r >= 0 then minimise the distance between the expected domain totals
sum_d r_d * tokens_d * posterior_d and the targets by projected gradient steps.
A step needs one aggregate of K sums over the corpus; a document's rate follows
from its posterior and the K-vectors of the steps so far, so nothing per
document is rewritten between steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, written

#: How many letters' counts are the classifier's input, and which where no labelled document has any.
N_LETTERS, NO_LETTERS = 32, "abcdefghijklmnopqrstuvwxyz"
#: A posterior weighs the evidence of so many letters at most, which keeps memberships soft.
EVIDENCE = 60.0


def telling_letters(docs: DataFrame, labelled_ids: DataFrame, domain: str, domains: list[str], most: int = N_LETTERS, max_fit: int = 1000) -> str:
    """The letters of any script whose frequencies differ most between the domains, the commonest first.

    Counted over about ``max_fit`` labelled documents of each domain, a share of
    them by a hash of the id (all, where a domain has no more).
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), F.lower(F.col("text").cast("string")).alias("low")).where(F.col("domain").isin(domains))
    have = named.select("doc_id", "domain").join(labelled_ids, "doc_id", "left_semi").groupBy("domain").count().collect()  # one row a domain
    chosen = F.lit(False)
    for r in have:
        share = min(1 << 20, -(-(max_fit << 20) // r["count"]))
        chosen = chosen | ((F.col("domain") == r["domain"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share))
    sample = named.where(chosen).join(labelled_ids, "doc_id", "left_semi")
    chars = sample.select("domain", F.explode(F.split("low", "")).alias("c")).where(F.col("c").rlike(r"^\p{L}$"))
    rows = chars.groupBy("domain", "c").count().collect()  # domains x letters of their scripts
    if not rows:
        return NO_LETTERS
    letters = sorted({r["c"] for r in rows})
    at, of = {c: i for i, c in enumerate(letters)}, {d: i for i, d in enumerate(domains)}
    n = np.zeros((len(domains), len(letters)))
    for r in rows:
        n[of[r["domain"]], at[r["c"]]] = r["count"]
    p = (n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True)
    mean = p.mean(axis=0)
    gain = (p * np.abs(np.log(p / mean))).sum(axis=0)
    best = sorted(range(len(letters)), key=lambda i: (-gain[i], letters[i]))[:most]
    return "".join(letters[i] for i in sorted(best, key=lambda i: (-n[:, i].sum(), letters[i])))


def profile(docs: DataFrame, domain: str, letters: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, domain, n_tokens, counts`` of every row, and ``carry`` as they are; counts per letter.

    A letter is counted by taking it out of what the letters before it have left, in bytes.
    """
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    start = F.struct(low.alias("left"), F.array().cast("array<int>").alias("sizes"))
    taken = F.aggregate(
        F.array(*[F.lit(c) for c in letters]),
        start,
        lambda x, c: F.struct(F.replace(x["left"], c, F.lit("")).alias("left"), F.concat(x["sizes"], F.array(F.octet_length(x["left"]))).alias("sizes")),
        lambda x: F.zip_with(x["sizes"], F.concat(F.slice(x["sizes"], 2, len(letters)), F.array(F.octet_length(x["left"]))), lambda a, b: a - b),
    )
    counts = F.zip_with(taken, F.array(*[F.lit(len(c.encode())) for c in letters]), lambda n, m: (n / m).cast("int"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(domain).cast("string").alias("domain"),
        F.regexp_count(low, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        counts.alias("counts"),
        *carry,
    )


def dot(values: Column, weights: list[float]) -> Column:
    """Sum of an array column's products with fixed weights."""
    return sum((values[i] * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def learned(known: DataFrame, labelled_ids: DataFrame, domains: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log priors, and per domain the log probability of each letter, from the labelled documents' domains."""
    train = known.join(labelled_ids, "doc_id", "left_semi").where(F.col("domain").isin(domains))
    sums = train.groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(size)]).collect()  # one row per domain
    by = {r["domain"]: r for r in sums}
    n = np.array([by[d]["n"] if d in by else 0 for d in domains], float)
    c = np.array([[by[d][f"c{i}"] if d in by else 0 for i in range(size)] for d in domains], float) + 1.0
    return np.log((n + 1) / (n + 1).sum()), np.log(c / c.sum(axis=1, keepdims=True))


def with_posterior(known: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds ``posterior``: array<double> over the domains."""
    prior, logp = model
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    scale = F.when(F.col("_letters") > 0, F.least(F.lit(1.0), F.lit(EVIDENCE) / F.col("_letters"))).otherwise(0.0)
    logs = F.array(*[F.lit(float(prior[k])) + scale * dot(F.col("counts"), logp[k].tolist()) for k in range(len(prior))])
    out = known.withColumn("_letters", total).withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    out = out.withColumn("_e", F.transform("_logs", lambda x: F.exp(x - F.col("_top")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return out.select(*known.columns, F.transform("_e", lambda x: x / F.col("_z")).alias("posterior"))


def rate_after(steps: list[list[float]]) -> Column:
    """The rate of a document after projected steps: r <- max(0, r - <posterior, g>)."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    inner = lambda g: F.aggregate(F.zip_with("posterior", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(table, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - inner(g)))


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", tokens: float | None = None, max_steps: int = 40, tolerance: float = 1e-6, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, domain, posterior, rate`` of every row of ``docs``, and the columns ``carry`` names.

    ``targets`` are weights of domains (scaled to sum 1) of ``tokens`` in all
    (the corpus's own number if None). ``domain`` names the column that holds a
    labelled document's domain; other documents' values are not used, and the
    ``domain`` returned is the likeliest of the posterior. A domain without
    labelled documents keeps a flat profile. Null and empty texts have no
    tokens and the prior as posterior; null ids, repeated rows and further
    columns are carried; an empty table gives none. Where targets can't be met
    with rates of zero or more, the closest totals in the metric of the
    memberships result. Carried columns are written once beside the profile of
    their row, so that letters are counted once; nothing of them is shuffled.
    """
    domains = sorted(targets)
    weight = np.array([max(0.0, targets[d]) for d in domains], float)
    weight /= weight.sum()
    k = len(domains)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    letters = telling_letters(docs, ids, domain, domains)
    known = written(profile(docs, domain, letters, carry)) if carry else checkpoint(profile(docs, domain, letters))
    model = learned(known, ids, domains, len(letters))
    soft = checkpoint(with_posterior(known, model).select("doc_id", "n_tokens", "posterior"))
    t = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    gram = soft.agg(F.sum(t).alias("t"), *[F.sum(t * F.col("posterior")[i] * F.col("posterior")[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()  # K * (K + 1) / 2 sums
    total = gram["t"] or 0.0
    steps: list[list[float]] = []
    if total:
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = gram[f"m{i}_{j}"]
        metric = np.linalg.pinv(m + 1e-9 * total * np.eye(k))
        target = weight * (tokens if tokens is not None else total)
        for _ in range(max_steps):
            now = soft.select(rate_after(steps).alias("r"), t.alias("t"), "posterior").agg(*[F.sum(F.col("r") * F.col("t") * F.col("posterior")[i]).alias(f"a{i}") for i in range(k)]).first()
            gap = np.array([now[f"a{i}"] or 0.0 for i in range(k)]) - target
            if np.abs(gap).max() <= tolerance * max(target.max(), 1.0):
                break
            step = metric @ gap
            if steps and np.abs(step).max() < 1e-12:
                break
            steps.append(step.tolist())
    top = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = with_posterior(known, model) if carry else soft
    return out.select("doc_id", "n_tokens", top.alias("domain"), "posterior", rate_after(steps).alias("rate"), *carry)


def copies(rate: Column) -> Column:
    """A whole number of copies with the rate as its mean, from a hash of the id."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("int")
