"""Near vectors against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import vectors


def brute(rows, threshold):
    ok = [i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, c in rows]
    links = [[] for _ in rows]
    for a, (i, v, c) in enumerate(rows):
        for b, (j, w, d) in enumerate(rows):
            if a != b and ok[a] and ok[b] and c == d and len(v) == len(w):
                if sum(x * y for x, y in zip(v, w)) / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))) >= threshold:
                    links[a].append(b)
    least = [r[0] for r in rows]
    while True:
        new = [min([least[a], *(least[b] for b in links[a])]) if links[a] else least[a] for a in range(len(rows))]
        if new == least:
            break
        least = new
    return sorted(((r[0], len(links[a]), least[a], None if r[0] is None else r[0] == least[a]) for a, r in enumerate(rows)), key=repr)


def got(spark, rows, threshold):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("rows", F.lit("x")).repartition(3)
    return sorted((tuple(r) for r in vectors.near_vectors(df, threshold).collect()), key=repr)


def cluster(rng, dim, n, noise):
    c = rng.standard_normal(dim)
    return [(c * rng.uniform(0.5, 3) + noise * np.linalg.norm(c) * rng.standard_normal(dim) / math.sqrt(dim)).tolist() for _ in range(n)]


@pytest.mark.parametrize("dim,threshold", [(64, 0.93), (20, 0.9), (3, 0.99), (1, 0.93)])
def test_equals_all_pairs(spark, dim, threshold):
    rng, pick = np.random.default_rng(dim), random.Random(dim)
    vs = [v for _ in range(12) for v in cluster(rng, dim, 8, pick.choice([0.1, 0.3, 0.4]))] + [rng.standard_normal(dim).tolist() for _ in range(60)]
    vs += vs[:10] + [[2 * x for x in v] for v in vs[10:15]]
    rows = [(k, v, pick.choice([1, 1, 2])) for k, v in enumerate(vs)]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, [None] * dim, 1), (904, [], 1), (905, vs[0], None), (906, [float("inf")] * dim, 1), (907, [1e200] * dim, 1), (908, [1e-200] * dim, 1)]
    rows += [(7, vs[7], 1), (7, vs[7], 1), (909, vs[3] + [0.5], 1), (-5, vs[20], 1)]
    pick.shuffle(rows)
    # plain Python cannot square 1e200 or 1e-200
    want = brute([(i, [x / 1e200 for x in v] if i == 907 else [x * 1e200 for x in v] if i == 908 else v, c) for i, v, c in rows], threshold)
    assert any(r[1] for r in want)
    assert got(spark, rows, threshold) == want


def test_divided_cells_and_chunks(spark, monkeypatch):
    for k, v in {"CHUNK": 7, "CELL": 16, "VISITORS": 5, "PAIRS": 11}.items():
        monkeypatch.setattr(vectors, k, v)
    rng = np.random.default_rng(1)
    vs = cluster(rng, 16, 60, 0.25) + [v for _ in range(20) for v in cluster(rng, 16, 4, 0.2)] + [rng.standard_normal(16).tolist() for _ in range(60)]
    rows = [(k, v, 1) for k, v in enumerate(vs)]
    assert got(spark, rows, 0.93) == brute(rows, 0.93)


def test_null_ids_and_empty(spark):
    v = [1.0, 2.0]
    assert got(spark, [(None, v, 1), (1, v, 1), (2, v, 1)], 0.93) == sorted([(None, 0, None, None), (1, 1, 1, True), (2, 1, 1, False)], key=repr)
    assert got(spark, [], 0.93) == []
