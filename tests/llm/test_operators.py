"""Whole operators on small tables with nulls, empty and long texts, ties, copies and clashing columns, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scholium.llm import bitslice, chat, common, decontaminate, extract, mixing, phrases, quality, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, data binary, score double, component_id long, tier string"


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ti", "on", "er", "sh", "wh") for b in ("an", "ou", "en", "st", "ha", "é")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(40), "a very common line of text"
    base = say(120)
    docs = [base, base, base + " tail", say(30) + "\n" + passage + "\n" + say(30), passage, say(10) + passage[20:], "", None, "x", line]
    docs += [f"{say(8)}\n{line}\n{say(12)}" for _ in range(25)]
    docs += ["-" * 400, "=" * 30 + "-" * 90, say(6000) + " " + passage, " \t\n ", passage + " " + passage]
    return [*enumerate(docs), (None, base)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", None, 1, b"x", 0.5, 9, "z") for d, t in corpus()]
    return common.checkpoint(spark.createDataFrame([*rows, rows[1]], SCHEMA))  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_simhash(docs, empty):
    prints = {}
    for d, t in corpus():
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = [d for d in prints if d is not None]
    parent = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus()) + 1
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == (0 if r["doc_id"] is None else find(parent, r["doc_id"]))
    assert simhash.near_duplicates(empty).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    got = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}


def brute_bytes(window=50):
    out = {None: None}
    seen: dict[bytes, int] = {}
    for d, t in sorted((x for x in corpus() if x[0] is not None)):
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if seen.setdefault(raw[i : i + window], d) < d:
                cut[i : i + window] = b"\1" * window
        kept = bytes(x for x, c in zip(raw, cut) if not c)
        out[d] = (len(raw), sum(cut), sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut)), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(docs, empty):
    want = brute_bytes()
    base = corpus()[0][1].encode()
    want[None] = (len(base), 0, 0, hashlib.sha256(base).hexdigest(), base)
    for r in suffix.dedup(docs).collect():
        assert tuple(r)[1:] == want[r["doc_id"]][:4], r["doc_id"]
    cleaned = suffix.cleaned(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        assert r["text"] is None if r["doc_id"] == 7 else r["text"].encode() == want[r["doc_id"]][4]
        assert r["data"] == b"x" and r["tier"] == "z"
    assert suffix.dedup(empty).count() == 0 and suffix.cleaned(empty).count() == 0


def test_suffix_dedup_of_hot_grams(docs, monkeypatch):
    from scholium.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 1)
    want = brute_bytes()
    assert all(tuple(r)[1:] == want[r["doc_id"]][:4] for r in suffix.dedup(docs.where("doc_id is not null")).collect())


def test_rows_that_share_an_id(spark, monkeypatch):
    """Rows of one id with different texts are compared with smaller ids, not with each other."""
    from scholium.llm import repeats

    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    base, other = say(60), say(60)
    rows = [(5, base), (5, "x y " + base), (5, base), (7, other), (7, base + " " + other), (3, other[20:]), (7, other + " " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_copy", F.lit("clash")).withColumn("_ranges", F.lit(1))
    want_bytes, want_words = [], []
    for d, t in rows:
        raw, w = t.encode(), t.encode().split()
        cut, gone = bytearray(len(raw)), [0] * len(w)
        before = [x.encode() for e, x in rows if e < d]
        for i in range(len(raw) - 49):
            if any(raw[i : i + 50] in x for x in before):
                cut[i : i + 50] = b"\1" * 50
        seen = {tuple(x.split()[i : i + 20]) for x in before for i in range(len(x.split()) - 19)}
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen or k in {tuple(w[j : j + 20]) for j in range(i)}:
                gone[i : i + 20] = [1] * 20
        want_bytes.append((d, len(raw), sum(cut)))
        want_words.append((d, len(w), sum(gone)))
    for hot in (20_000, 1):
        monkeypatch.setattr(repeats, "HOT", hot)
        assert sorted(tuple(r)[:3] for r in suffix.dedup(df).collect()) == sorted(want_bytes)
        assert sorted(tuple(r)[:3] for r in phrases.dedup(df).collect()) == sorted(want_words)


def brute_words(window=20):
    out, seen = {}, set()
    for d, t in sorted((x for x in corpus() if x[0] is not None)):
        w = (t or "").encode().split()
        cut = [0] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                cut[i : i + window] = [1] * window
            seen.add(k)
        out[d] = (len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_phrase_dedup(docs, empty, hot, monkeypatch):
    if hot:
        from scholium.llm import repeats

        monkeypatch.setattr(repeats, "HOT", 2)
    want = brute_words()
    w = corpus()[0][1].encode().split()
    want[None] = (len(w), 0, hashlib.sha256(b" ".join(w)).hexdigest())
    for r in phrases.dedup(docs).collect():
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert phrases.dedup(empty).count() == 0


def test_bitsliced_topk(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, rng.normal(size=6).tolist()) for i in range(80)] + [(i, [0.5] * 6) for i in range(100, 130)]
    vecs += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (3, vecs[3][1]), (None, [1.0] * 6)]
    vecs += [(600, [5000.0, -0.1, 0.2, 0.0, 1.5, 3.0]), (601, [-(2.0**30), 0.1, 0.2, 0.3, 0.4, 0.5]), (610, [1e-300, 2.0**41, 0.0, 0.0, 0.0, -0.0])]  # large but finite
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("block", F.lit(1))
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 6]
    for part_bytes in (32 << 20, 200):
        got: dict[int, list] = {}
        for r in bitslice.top_k(df, df.where("vec_id % 10 = 0 and vec_id <> 610"), k=5, rows_per_block=32, part_bytes=part_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q, v in ok:
            if q % 10 == 0 and q != 610:
                want = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ok if i != q)[:5]
                assert got.pop(q) == [(i, -s) for s, i in want]
        assert got == {}
    assert bitslice.top_k(df.limit(0), df.limit(0)).count() == 0
    with pytest.raises(Exception, match="does not fit a long"):
        bitslice.top_k(spark.createDataFrame([(1, [1e18]), (2, [1e18])], "vec_id long, embedding array<double>"), df.limit(0).unionByName(spark.createDataFrame([(1, [1e18])], "vec_id long, embedding array<double>"), allowMissingColumns=True)).collect()


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob", None), (1, 3, "Ann", "x" * 50), (1, 3, "Ann", "x" * 50), (2, 0, "system", "only"), (None, 0, "Ann", "solo"), (3, None, None, "late"), (4, 70, "Ann", "far"), (4, 1, "Bob", "near"), (4, None, "Cy", "when?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(7)).withColumn("mask", F.lit("m"))
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df).collect()}
    r = got[(1, "Ann")]
    long = "<|im_start|>assistant\n" + "x" * 50 + "<|im_end|>\n"
    assert r["text"] == "<|im_start|>system\nbe < |im_end|> kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=Bob\n<|im_end|>\n" + 2 * long
    masked = [r["text"][int(a) : int(b)] for a, b in (m.split(":") for m in r["mask"].split(","))]
    assert masked == ["hi<|im_end|>", *2 * ["x" * 50 + "<|im_end|>"]] and r["n_turns"] == 5
    assert got[(1, "Bob")]["text"].count("assistant") == 1
    assert (None, "Ann") in got and not any(k[0] == 2 for k in got)
    assert {k[1] for k in got if k[0] == 4} == {"Ann", "Bob", "Cy"}
    assert [x.split("\n")[1] for x in got[(4, "Bob")]["text"].split("<|im_start|>")[1:]] == ["near<|im_end|>", "far<|im_end|>", "when?<|im_end|>"]
    assert [k[1] for k in got if k[0] == 3] == ["unknown"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_rotation_of_a_dialogue_of_thousands_of_turns(spark):
    rows = [(1, i, ("Ann", "Bob", "Cy")[i % 3], f"turn {i}") for i in range(3000)] + [(1, 7, "Ann", f"again {i}") for i in range(200)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3
    want = [t for _, _, _, t in sorted(rows, key=lambda x: (x[1], x[2], x[3]))]
    for r in got:
        assert r["n_turns"] == 3200
        assert [x.split("\n")[1].removesuffix("<|im_end|>") for x in r["text"].split("<|im_start|>")[1:]] == want
        own = [t for _, _, who, t in sorted(rows, key=lambda x: (x[1], x[2], x[3])) if who == r["perspective"]]
        assert [r["text"][int(a) : int(b)] for a, b in (m.split(":") for m in r["mask"].split(","))] == [t + "<|im_end|>" for t in own]


def test_decontamination(spark, docs, empty):
    item = " ".join(f"w{i * 7919 % 1000}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item), (4, "...")], "item_id long, text string")
    rows = [(900, "start " + item + " end"), (901, " ".join(item.split()[:6])), (None, item), (900, "start " + item + " end"), (902, "It is Too, short!"), (903, "too very short"), (904, None), (905, "")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash")).withColumn("h", F.lit("clash"))
    for block_words in (decontaminate.BLOCK_WORDS, 0):
        got = decontaminate.contaminated(more, bench, block_words=block_words).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, got), key=repr) == [(900, 1), (900, 1), (902, 3), (None, 1)], block_words
        if block_words:
            left = decontaminate.decontaminate(docs.unionByName(more.drop("_key", "h"), allowMissingColumns=True), bench)
            assert left.count() == docs.count() + len(rows) - 4 and left.columns == docs.columns
        else:
            left = decontaminate.decontaminate(docs.unionByName(more.drop("_key", "h"), allowMissingColumns=True), bench, block_words=0)
            assert left.count() == docs.count() + len(rows) - 4 and left.columns == docs.columns
        assert decontaminate.contaminated(empty, bench, block_words=block_words).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_against_brute_force(spark):
    """Both ways of the join against every diagonal of every pair that a seed can reach."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 9, 14, 30])))) for i in range(25)]
    texts = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(60))]
        if d % 2:
            part = items[rng.randrange(25)][1].split()
            part = [word() if rng.random() < 0.12 else x for x in part]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        texts.append((d, " ".join(w)))
    want = {}
    for d, text in texts:
        w = text.split()
        for i, item in items:
            t = item.split()
            need, found = min(13, -(-4 * len(t) // 5)), 0
            for shift in range(1 - len(t), len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == t[j] for j in range(len(t))]
                if len(t) < 8:
                    found = max(found, len(t) if all(same) else 0)
                    continue
                if not any(all(same[j + k] for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for j in range(len(t) - len(m) + 1)):
                    continue
                lo, hi = max(0, -shift), min(len(t), len(w) - shift)
                found = max([found] + [n for a in range(lo, hi) for b in range(a + 1, hi + 1) if (n := sum(same[a:b])) >= need and 4 * (b - a - n) <= b - a])
            if found:
                want[d, i] = found
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 0):
        got = {(r[0], r[1]): r for r in decontaminate.contaminated(docs, bench, block_words=block_words).collect()}
        assert set(got) == set(want) and len(want) > 30
        words = {d: t.split() for d, t in texts}
        for (d, i), r in got.items():
            assert r["matched"] <= want[d, i]
            a, b = words[d][r["doc_start"] :][: r["length"]], dict(items)[i].split()[r["item_start"] :][: r["length"]]
            assert sum(x == y for x, y in zip(a, b)) == r["matched"]


def test_toxicity_held_out(spark):
    import zlib

    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "sh", "wh", "an"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(30)]
        if bad:
            for x in rng.sample(["vlokk", "grubzig", "zumpf"], 2):
                w.insert(rng.randrange(30), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "grubzig vlokk zumpf"), (1002, "you v-l-okk gru.bzig and z.umpf there"), (1003, "plain " * 20000), (1004, "an zmpf word"), (1005, "a g--r--u--b--z--i--g here"), (5, "repeated id"), (5, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("toxic", F.lit(9))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert got[1000]["predicted"] == got[1001]["predicted"] == got[1003]["predicted"] == 0 and got[None]["predicted"] == 1
    assert min(got[i]["score"] for i in (1002, 1004, 1005)) > got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.scored(docs, lab, min_docs=10**6).select("score").distinct().count() == 1  # params reach the training: no word is common enough
    flat = toxicity.scored(docs, lab.limit(0)).select("score").distinct().collect()
    assert len(flat) == 1
    assert toxicity.scored(docs.limit(0), lab).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, "the and with this " * (1 + i % 5), "en") for i in range(60)] + [(100 + i, "über größe schön ßü " * (1 + i % 7), "de") for i in range(20)]
    rows += [(500, None, "en"), (501, "", "de"), (None, "the and", None), (502, "the " * 30000, "en"), (0, "the and with this ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit("x"))
    labels = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), *range(100, 120, 2)]], "doc_id long")
    out = mixing.fitted(docs, labels, {"en": 0.4, "de": 0.6}).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 for r in out)
    total = sum(r["n_tokens"] for r in out)
    de = sum(r["rate"] * r["n_tokens"] * r["posterior"][0] for r in out)
    assert de == pytest.approx(0.6 * total, rel=1e-4)
    assert {r["domain"] for r in out if r["n_tokens"] > 2} == {"en", "de"}
    # brute force: the same projected steps in numpy
    t, p = np.array([r["n_tokens"] for r in out], float), np.array([r["posterior"] for r in out])
    m, rate = np.linalg.pinv((p * t[:, None]).T @ p + 1e-9 * t.sum() * np.eye(2)), np.ones(len(t))
    for _ in range(40):
        gap = (p * (t * rate)[:, None]).sum(0) - t.sum() * np.array([0.6, 0.4])
        if abs(gap).max() <= 1e-6 * 0.6 * t.sum():
            break
        rate = np.maximum(0, rate - p @ (m @ gap))
    assert [r["rate"] for r in out] == pytest.approx(rate.tolist(), rel=1e-6)
    carried = mixing.fitted(docs, labels, {"en": 0.4, "de": 0.6}, carry=("text", "lang")).collect()
    assert sorted(repr((r["doc_id"], r["rate"], r["text"], r["lang"])) for r in carried) == sorted(repr((a["doc_id"], a["rate"], t, x)) for a, (_, t, x) in zip(out, rows))
    assert mixing.fitted(docs.limit(0), labels, {"en": 1.0}).count() == 0


def test_mixing_counts_the_letters_of_a_text_once(spark, monkeypatch):
    """Carried columns bring no second pass over the texts, and are the same rows."""
    rows = [(i, None if i == 3 else ("the cat " if i % 2 else "der Hund ") * (i % 5), "en" if i % 2 else "de", None) for i in range(40)] + [(None, "the", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    seen = []
    monkeypatch.setattr(mixing, "profile", lambda *a, f=mixing.profile, **b: seen.append(a) or f(*a, **b))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    plain = mixing.fitted(docs, labels, {"en": 0.4, "de": 0.6}).collect()
    assert len(seen) == 1
    carried = mixing.fitted(docs, labels, {"en": 0.4, "de": 0.6}, carry=("text", "lang", "n"))
    assert carried.columns == ["doc_id", "n_tokens", "domain", "posterior", "rate", "text", "lang", "n"]
    assert sorted([(r["doc_id"], r["text"], r["lang"], r["n"]) for r in carried.collect()], key=repr) == sorted(rows, key=repr)
    assert sorted([(r["doc_id"], r["n_tokens"], round(r["rate"], 9)) for r in carried.collect()], key=repr) == sorted([(r["doc_id"], r["n_tokens"], round(r["rate"], 9)) for r in plain], key=repr)
    assert len(seen) == 2


def test_mixing_of_other_scripts_and_domains(spark):
    rng = random.Random(5)
    say = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(30))
    kinds = {"el": "αβγδεζη", "ru": "абвгдежз", "zh": "函数极限导数积分矩阵", "code": "abcdefgz"}
    rows = [(i, say(kinds[k]), k) for i, k in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    labels = spark.createDataFrame([(i,) for i in range(0, 160, 3)], "doc_id long")
    out = {r["doc_id"]: r for r in mixing.fitted(docs, labels, dict.fromkeys(kinds, 1.0), domain="topic").collect()}
    assert np.mean([out[i]["domain"] == k for i, _, k in rows]) == 1.0
    # held against a count of letters in plain Python: every text's likeliest domain is the one whose letters it has
    assert all(max(kinds, key=lambda d: sum(t.count(c) for c in set(kinds[d]))) == out[i]["domain"] for i, t, _ in rows)


def test_quality_against_labels(spark):
    """Held against the labels, which the operator never sees: most bad documents are rejected, hardly any good one."""
    sf = "/root/testdata/sf0.01"
    out = quality.scored(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["keep"]): r["count"] for r in out.groupBy("quality", "keep").count().collect()}
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.8 and n.get((1, 0), 0) / (n[1, 1] + n.get((1, 0), 0)) < 0.02


def test_quality_of_repeated_rows_and_ties(spark):
    clean, junk = "A plain line of words that say little. " * 4, "XX!! ## XX!! ## " * 8
    rows = [(i, clean if i % 3 else junk) for i in range(60)] + [(1, clean), (1, clean), (None, junk), (None, junk)]
    got = quality.scored(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("clash"))).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) == 2 and all(r["keep"] == int(r["doc_id"] is not None and r["doc_id"] % 3 > 0) for r in got)


def test_quality(spark, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "sh", "wh", "an"]) for _ in range(3))
    clean = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) + "."
    junk = [lambda: " ".join(word().upper() + "!!" for _ in range(50)), lambda: " | ".join(word() for _ in range(50)), lambda: " ".join(word() + "***" for _ in range(50)), lambda: (word() + " ") * 60]
    rows = [(i, clean() if i % 5 else junk[i // 5 % 4]()) for i in range(400)] + [(900, None), (901, ""), (None, clean()), (902, clean() * 400)]
    got = {r["doc_id"]: r["keep"] for r in quality.scored(spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(3))).collect()}
    assert np.mean([got[i] == int(i % 5 > 0) for i in range(400)]) > 0.97
    assert got[None] == got[902] == 1 and got[900] == got[901] == 0
    assert quality.scored(empty).count() == 0


def test_main_text(spark):
    page = lambda body, host, i: (i, f"https://{host}/a/{i:03}?q=1", f"<body><div>Shop the sale</div><div>Latest news</div><div>{body}</div><div>All rights kept by {host}</div></body>")
    rows = [page(f"<p>Story number {i}</p><p>told at length {i}</p>", "h.org", i) for i in range(12)]
    rows += [(100, None, "<article><p>Kept &lt;whole&gt;</p></article><p>by</p>"), (101, "u", None), (102, "u", ""), (103, "http://solo.org/x", "<p>Alone</p>"), rows[0], (104, "http://long.org", "<p>" + "word " * 50000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("sig", F.lit(1))
    out = extract.main_text(df).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    for i in range(12):
        assert got[i] == f"Story number {i}\ntold at length {i}"
    assert got[100] == "Kept <whole>" and got[101] == got[102] == "" and got[103] == "Alone" and len(got[104]) == 249_999
    assert extract.main_text(df.limit(0)).count() == 0


def test_main_text_against_brute_force(spark, monkeypatch):
    """One path with many contents, copies, hosts of one page; the same result from any number of partitions and blocks."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
    furniture = [line() for _ in range(6)]
    rows = []
    for i in range(300):
        host = rng.choice(["big.org", "big.org", "big.org", f"h{i % 9}.org", f"solo{i}.org"])
        body = "".join(f"<p>{line()}</p>" for _ in range(rng.randrange(1, 5)))
        body = f"<article>{body}<p>{furniture[5]}</p></article>" if i % 3 == 0 else body
        html = f"<div>{furniture[0]}</div><div>{furniture[i % 2 + 1]}</div>{body}<div>{furniture[3]}</div>"
        rows.append((i, f"http://{host}/p/{rng.randrange(40) if i % 4 else 7}", html))
    rows += [(1000 + i, rows[3][1] if i % 2 else f"http://big.org/p/{i}", rows[3][2]) for i in range(40)]
    rows.append((2000, None, rows[3][2]))
    # brute force: the contents of each host in the order of path and hash, each with its two nearest on either side
    of_host: dict[str, dict[bytes, tuple]] = {}
    for _, url, html in rows:
        host, path = (url or "").removeprefix("http://").partition("/")[::2]
        own = extract.outline(extract.lines_of(html)).tobytes()
        key = ("/" + path if url else "", xxhash.xxh3_64_intdigest(own) - (1 << 63), own)
        of_host.setdefault(host, {})[own] = min(key, of_host.get(host, {}).get(own, key))
    stays = {}
    for host, contents in of_host.items():
        order = [np.frombuffer(k[2], extract._LINE) for k in sorted(contents.values())]
        for i, own in enumerate(order):
            stays[host, own.tobytes()] = extract.kept(own, [*reversed(order[max(0, i - 2) : i]), *order[i + 1 : i + 3]])
    want = []
    for pid, url, html in rows:
        lines = extract.lines_of(html)
        keep = stays[(url or "").removeprefix("http://").partition("/")[0], extract.outline(lines).tobytes()]
        want.append((pid, "\n".join(t for (_, t), k in zip(lines, keep) if k)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts, block in ((1, 1000), (12, 7), (211, 3)):
        monkeypatch.setattr(extract, "BLOCK", block)
        assert sorted((r["page_id"], r["text"]) for r in extract.main_text(df.repartition(parts)).collect()) == sorted(want), parts


def test_bitsliced_topk_repeated_queries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[20], (20, rows[21][1])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.top_k(df, df.where("vec_id in (10, 20)"), k=5, rows_per_block=16).collect())
    q = lambda v: [int(np.floor(1024 * x)) for x in v]
    want = []
    for own, asked in ((10, rows[10][1]), (20, rows[20][1]), (20, rows[21][1])):
        scored = sorted((-sum(a * b for a, b in zip(q(asked), q(v))), i) for i, v in rows if i != own)
        want += [(own, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_decontamination_is_alike_for_short_items_of_any_script(spark):
    docs = spark.createDataFrame([(1, "नमस्ते दुनिया"), (2, "x नमस्ते दुनिया y"), (3, "é́́ à la carte"), (4, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "नमस्ते दुनिया"), (8, "é́́ à la"), (9, "१२३")], "item_id long, text string")
    small, large = (sorted(tuple(r) for r in decontaminate.contaminated(docs, bench, block_words=n).collect()) for n in (1000, 0))
    assert small == large and {(r[0], r[1]) for r in small} >= {(1, 7), (2, 7), (3, 8)}
