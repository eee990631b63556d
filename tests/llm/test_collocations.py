"""Collocations against plain Python: every phrase counted, every cut and every longer phrase looked at."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholium.llm import collocations


def brute(docs, max_n, least, top, share=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, words, out = Counter(), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            f.update((lang, *ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for lang in words:
        mine = []
        for p, a in cand.items():
            if p[0] != lang or any(q[0] == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in cand.items()):
                continue
            s, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            mine.append((-s, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        out += [(lang, i + 1, p.decode(), -a, lo, r, words[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def got(spark, docs, **kw):
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


@pytest.mark.parametrize("max_n,top", [(4, 2000), (2, 2000), (4, 3)])
def test_equals_brute_force(spark, max_n, top):
    rng = random.Random(max_n)
    vocab = ["the", "THE", "of", "Müller", "È", "naïve", "x", "|", "a-b", " ", "नमस्ते"]
    docs = []
    for _ in range(160):
        n = rng.choice([0, 1, 5, 60])
        docs.append((rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "; "]) for _ in range(n))))
    docs += [("en", "one two three four five six")] * 12 + [("en", None), (None, None), ("de", ""), ("en", "no end"), ("en", "no start")]
    want = brute(docs, max_n, 8, top)
    assert want and got(spark, docs, max_n=max_n, least=8, top=top) == want


def test_long_texts_are_cut_at_pieces_and_count_alike(spark, monkeypatch):
    docs = [("en", "ab cd ef gh. " * 500 + "ab cd " * 300), ("en", "q" * 5000 + " r" * 40), ("en", ", ,. \t.")]
    want = brute(docs, 4, 30, 2000)
    monkeypatch.setattr(collocations, "FLUSH", 64)
    assert got(spark, docs) == want


def test_nothing_frequent(spark):
    assert got(spark, [("en", "a b c")]) == []
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
