"""The registered training-data queries against their SQL, and the pipeline stage by stage."""

import random

import pytest

import corpus_pipeline
from scholium.llm import queries
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.ORACLE[name]).df())


def test_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())


def made(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "sh", "wh", "an"]) for _ in range(rng.randrange(2, 5)))
    say = lambda n: " ".join(word() for _ in range(n))
    base, item, passage = say(120), say(30), say(25)
    rows = [(i, say(40)) for i in range(60)]
    rows += [(100 + i, say(30) + " grubzig vlokk " + say(10)) for i in range(30)]
    rows += [(200, base), (201, base), (202, base + " tail"), (203, " ".join(w for w in base.split() if w != base.split()[50]))]
    rows += [(300 + i, say(20) + " " + passage + " " + say(20)) for i in range(5)]
    rows += [(400, say(10) + " " + item + " " + say(10)), (401, item)]
    rows += [(500, None), (501, ""), (502, say(4000)), (None, say(40)), (None, None), (3, rows[3][1]), (503, "x")]
    docs = spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else "de", "s", len(t) if t else 0, "extra", 0.5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _copy string, score double")
    labels = spark.createDataFrame([(d, 1, int(100 <= d < 130)) for d, _ in rows if d is not None and d < 200], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    return rows, docs, labels, bench


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns; each stage against plain Python."""
    rows, docs, labels, bench = made(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, stages = str(tmp_path), [f for _, f in corpus_pipeline.STAGES]

    def step(k, df):
        stages[k](spark, df, sf).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    one = step(0, docs)
    assert one.columns == corpus_pipeline.COLUMNS
    assert plain(one) == sorted(((d, t) for d, t in rows if d is None or not 100 <= d < 130), key=repr)
    two = step(1, one)
    gone = {201, 202, 203, 501}  # copies, near copies; no words: as the null text
    want = sorted({(d, t) for d, t in rows if d is not None and not 100 <= d < 130 and d not in gone}, key=repr)
    assert plain(two.where("doc_id is not null")) == want and two.where("doc_id is null").count() == 2
    three = step(2, two)
    texts = dict(want)
    seen: dict[bytes, int] = {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], d) < d:
                cut[i : i + 50] = b"\1" * 50
        texts[d] = None if texts[d] is None else bytes(x for x, c in zip(raw, cut) if not c).decode()
    assert plain(three.where("doc_id is not null")) == sorted(texts.items(), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in three.collect())
    four = step(3, three)
    assert plain(four.where("doc_id is not null")) == sorted(((d, t) for d, t in texts.items() if d != 400 and not (d == 401 and t)), key=repr)
    five = step(4, four)
    assert plain(five) == plain(four) and five.where("rate < 0 or copies < 0").count() == 0
    assert set(corpus_pipeline.COLUMNS) <= set(five.columns)


def test_stages_on_empty_tables(spark, tmp_path):
    for name, df in zip(("documents", "labels", "benchmark"), made(spark)[1:]):
        df.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
