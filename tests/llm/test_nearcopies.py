"""Near copies against brute-force Jaccard, in the operator and in the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from scholium.llm import nearcopies, simhash

SF = "/root/testdata/sf0.001"


def sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out[d] = {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def jaccard_pairs(s):
    ids = sorted(s)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]


@pytest.mark.parametrize(("chunk", "part"), [(2048, 8192), (24, 8192), (24, 16)])
def test_near_copies(spark, chunk, part, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    monkeypatch.setattr(nearcopies, "PART", part)  # 16: groups are dealt to parts
    monkeypatch.setattr(nearcopies, "CORE", min(chunk, 2))
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    base, line = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = []
    for i in range(90):  # a group beyond a small bucket, its members unlike each other in part
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([word() for _ in range(40)] + line)) for i in range(60)]  # a common line
    for i in range(40):
        w = [word() for _ in range(rng.randrange(1, 60))]
        rows += [(200 + 2 * i, " ".join(w)), (201 + 2 * i, " ".join(w[:-1] + [word()]).upper())]
    rows += [(400, ""), (401, None), (402, rows[3][1])]
    got = nearcopies.near_copies(spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")).collect()
    s = sets(rows)
    assert all(5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]) for a, b in got)
    same = [(a, b) for a, x in rows for b, y in rows if a < b and x and x == y]  # equal texts are one node
    assert components(s, [*got, *same]) == components(s, jaccard_pairs(s))
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links():
    s = [np.arange(a, a + 20) for a in (0, 1, 2, 3, 100, 101, 300)]
    assert components(range(7), nearcopies.links(s)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}


def test_partners():
    """Signatures lose no similar pair, and leave out members of a group that are unlike each other."""
    rng = np.random.default_rng(5)
    sets, group = [], []
    for g, k in enumerate((3, 32, 33, 300, 1)):  # small groups, larger ones, one over several blocks
        base = rng.integers(-(1 << 62), 1 << 62, 120)
        for i in range(k):  # every other member is a near copy; all hold the same ten elements
            own = rng.integers(-(1 << 62), 1 << 62, 400)
            sets.append(np.unique(np.concatenate([base[:10], base[rng.integers(0, 12) :], own[: rng.integers(0, 12)]]) if i % 2 else np.concatenate([base[:10], own[: rng.integers(90, 400)]])))
            group.append(g)
    group, n = np.array(group), np.array([len(s) for s in sets])
    sig = np.stack([nearcopies.signature(s) for s in sets])
    to, of = nearcopies.partners(group, n, sig), np.arange(len(n)) % 4
    across = nearcopies.partners(group, n, sig, of)
    assert all((group[j] == group[i]) and i != j for i, j in enumerate(to) if j >= 0)
    for i, s in enumerate(sets):
        alike = [j for j in range(len(n)) if j != i and group[j] == group[i] and nearcopies.similar(len(np.intersect1d(s, sets[j])), len(s), len(sets[j]))]
        assert to[i] == (alike[0] if alike else -1)
        assert across[i] == next((j for j in alike if of[j] != of[i]), -1)


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = sets(docs.select("doc_id", "text").collect())
    simhashes = [tuple(r) for r in simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id", "component_id").collect()]
    want = components(s, simhashes + jaccard_pairs(s))
    got = {r[0] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).select("doc_id").collect()}
    assert got == {d for d, c in want.items() if d == c}
    assert len(got) < len(components(s, simhashes)) - len(simhashes)  # pairs that fingerprints miss


@pytest.mark.parametrize("radius", [2, 4])
def test_linked_fingerprints(spark, radius, monkeypatch):
    """Links have the components of all pairs within the radius; no aggregate gathers the variants of the fingerprints."""
    rng = random.Random(7)
    some = []
    for base in (0, rng.getrandbits(64), rng.getrandbits(64)):
        some += [base, *(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)), *(base ^ (1 << i) for i in range(0, 64, 3))]
    some += [rng.getrandbits(64) for _ in range(20)] + [1 << 63, (1 << 64) - 1]
    rows = [(None if i == 5 else i // 2 if i < 20 else i, f) for i, f in enumerate([*some, *some[::7]])]  # some ids and fingerprints repeat
    table = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: table)
    _, nodes, linked = simhash.linked_fingerprints(table, radius)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect" not in plan
    rep = {f: min(d for d, g in rows if g == f and d is not None) for f in {f for d, f in rows if d is not None}}
    assert {(f % (1 << 64), d) for f, d in nodes.collect()} == set(rep.items())
    want = [(a, b) for f, a in rep.items() for g, b in rep.items() if f < g and (f ^ g).bit_count() <= radius]
    got = [tuple(r) for r in linked.collect()]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
    assert components(rep.values(), got) == components(rep.values(), want)


def test_words_are_hashed_whole_and_each_once(monkeypatch):
    """The same words and shingles as by splitting, whatever the bytes; pieces of few words give the same hashes."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abAB\x00\xff \t\n\x0b\x0c\r\x1c\x85\xa0\x08\x0e") for _ in range(rng.randrange(60))) for _ in range(3000)] + [b"x" * 300 + b" " * 200 + b"y"]
    one = lambda w: int(nearcopies.word_hashes(w)[0])
    for size in (1 << 16, 3):
        monkeypatch.setattr(nearcopies, "_WORDS", size)
        for t in texts:
            w = t.lower().split()
            h = nearcopies.word_hashes(t).tolist()
            assert h == [one(x) for x in w] and len(set(h)) == len(set(w))
            k = min(5, len(w))
            assert len(nearcopies.shingles(t)) == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ())
