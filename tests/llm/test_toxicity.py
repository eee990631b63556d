"""Insults made of the syllables that clean texts are made of: their rate tells, not that one occurs."""

import random
import zlib

import numpy as np

from scholium.llm import toxicity


def test_beginnings_that_long_clean_texts_hold_by_chance(spark):
    rng = random.Random(7)
    parts = "ach lich sch ver keit ge zu en er pf be un tz st ung ein".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(rng.choice([40, 120, 300, 900]))]
        bad = i % 8 == 0
        for _ in range((2 + len(w) // 60) * bad):
            w.insert(rng.randrange(len(w)), "achlich" + rng.choice(parts))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    by_chance = [i for (i, t), (_, bad) in zip(rows, labels) if not bad and any(x.startswith("achlich") for x in t.split())]
    assert len(by_chance) > 300
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(i, bad) for i, bad in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    caught, left = np.mean([got[i] for i, bad in held if bad]), np.mean([1 - got[i] for i, bad in held if not bad])
    assert caught > 0.8 and left > 0.95, (caught, left)


def test_texts_of_a_batch_do_not_change_each_other(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["idiots", "i.d.i.o.t", "stpid", "plain", "word", "x y z", "stupidity"]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(rng.randrange(12))) for _ in range(80)] + [None, ""]
    one = [toxicity.Model(["idiot", "stupid"], [3.0, 2.0]).values([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "_AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "_MEMO", 20)
    for got, want in zip(toxicity.Model(["idiot", "stupid"], [3.0, 2.0]).values(texts), one):
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want))
