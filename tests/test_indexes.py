"""Indexes that are kept: changes, what a search reads, and failures between writing and committing."""

import os
import random
import re

import pytest

from scholium.functions import batch
from scholium.operators import retrieval as R
from scholium.operators import structure as S
from scholium.sources.indexes import TextIndex, VectorIndex

WORDS = "alpha beta gamma delta theory 中文 of the".split()


def fragments(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id int, text string")


def some(rng, docs):
    return [(f"{d}/{k}", d, " ".join(rng.choices(WORDS, k=rng.choice([0, 3, 20])))) for d in docs for k in range(rng.randint(1, 4))]


def same(index, live, spark, query):
    want = {r[0]: round(r[1], 9) for r in R.bm25(fragments(spark, live), query).collect()}
    got = index.search(query).select("chunk_id", "bm25").collect()
    return len(got) == len(want) and {r[0]: round(r[1], 9) for r in got} == want


def test_text_index_follows_its_documents(spark, tmp_path):
    rng, index = random.Random(1), TextIndex(spark, str(tmp_path / "text"), 16)
    first = some(rng, range(30)) + [("n", 99, None)]
    index.replace(fragments(spark, first))
    assert same(index, first, spark, "alpha theory 中文")
    files = {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    second = some(rng, range(10, 15))
    index.replace(fragments(spark, second))
    live = [r for r in first if not 10 <= r[1] < 15] + second
    assert same(index, live, spark, "alpha theory 中文")
    assert files <= {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names}, "a change appends"
    index.delete(spark.createDataFrame([(0,), (12,), (12,), (500,)], "document_id int"))
    live = [r for r in live if r[1] not in (0, 12)]
    assert same(index, live, spark, "beta of the nowhere")
    index.replace(fragments(spark, [("0/new", 0, "beta beta")]))
    live.append(("0/new", 0, "beta beta"))
    assert same(index, live, spark, "beta")
    assert same(index.compacted(str(tmp_path / "compact")), live, spark, "beta gamma")
    assert index.search("zeta").collect() == [] and index.search("").collect() == []


def test_text_index_reads_its_terms_buckets(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "text"), 64)
    index.replace(fragments(spark, some(random.Random(2), range(20))))
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_a_change_that_was_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "text"))
    index.replace(fragments(spark, [("a", 1, "alpha")]))
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            index.replace(fragments(spark, [("b", 1, "alpha beta")]))
    assert [r[0] for r in index.search("alpha").collect()] == ["a"]
    index.replace(fragments(spark, [("c", 1, "alpha")]))
    assert [r[0] for r in index.search("alpha beta").collect()] == ["c"]


def test_vector_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    rows = lambda x: spark.createDataFrame(x, "course_id string, chunk_id string, embedding array<double>")
    seen = lambda: {(r[0], r[1]): r[2] for r in index.vectors().collect()}
    index.rebuild(rows([("x", "1", [3.0, 4.0]), ("x", "2", [0.0, 1.0]), ("y", "1", [1.0, 0.0])]))
    index.upsert(rows([("x", "2", [1.0, 0.0]), ("z", "9", [0.0, 2.0])]))
    assert seen() == {("x", "1"): [0.6, 0.8], ("x", "2"): [1.0, 0.0], ("y", "1"): [1.0, 0.0], ("z", "9"): [0.0, 1.0]}
    index.delete(rows([("x", "1", None)]))
    index.rebuild(rows([("y", "7", [0.0, 1.0])]))
    assert seen() == {("x", "2"): [1.0, 0.0], ("y", "7"): [0.0, 1.0], ("z", "9"): [0.0, 1.0]}
    q = spark.createDataFrame([(1, [1.0, 0.2])], "q_id int, q array<double>")
    assert [(r["course_id"], r["chunk_id"]) for r in index.search(q, 1, ["x", "y"]).orderBy("course_id").collect()] == [("x", "2"), ("y", "7")]
    f = spark.createDataFrame([("w", "5", "alpha beta"), ("w", "6", "gamma")], "course_id string, chunk_id string, text string")
    assert index.has("x") and not index.has("w")
    assert [r[0] for r in index.search_text(f, "w", "alpha", [1.0, 0.0], 5).collect()] == ["5"]
    assert [r[0] for r in index.search_text(f, "x", "alpha", [1.0, 0.0], 5).collect()] == ["2"]


def test_as_of_crosses_partitions(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(300)])) for k in range(500)]
    marks = [(p, rng.choice([None, p * 10, p])) for p in [5, 90, 91, 200, 200, 299]]
    got = {r["k"]: r["v"] for r in S.as_of(spark.createDataFrame(rows, "k int, at int").repartition(7), spark.createDataFrame(marks, "m int, v int"), "at", "m", "v").collect()}
    def want(at):
        at_or_before = [m for m, _ in marks if at is not None and m <= at]
        return max((v for m, v in marks if m == max(at_or_before) and v is not None), default=None) if at_or_before else None
    assert got == {k: want(at) for k, at in rows}


def test_partial_ratio_is_the_best_window():
    rng = random.Random(1)

    def plain(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        n = len(a)
        ends = [b[:k] for k in range(1, n)] + [b[-k:] for k in range(1, n)]
        return max(batch.ratio(a, w) for w in [b[i : i + n] for i in range(len(b) - n + 1)] + ends) if a else 0.0 if b else 100.0

    for _ in range(400):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz 中文é"])
        a, b = ("".join(rng.choices(letters, k=rng.choice(k))) for k in ([0, 1, 3, 10, 63, 64, 65, 130], [0, 1, 5, 20, 150]))
        assert batch.partial_ratio(a, b) == plain(a, b)


def test_automaton_finds_overlapping_terms():
    rng = random.Random(4)
    for _ in range(200):
        terms = list({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(6)})
        lines = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(6)]
        want = {t: n for t in terms if (n := next((i for i, x in enumerate(lines) if t in x), None)) is not None}
        assert batch.Automaton(terms).first_lines(lines) == want


def test_spans_of_names(spark):
    long = "p" * 40
    pages = spark.createDataFrame([("d", 1, f"{long}\nOne text Two more"), ("d", 2, "no name"), ("d", 3, "short Three"), ("e", 1, "x"), ("d", 4, None)], "document_id string, page_no int, text string")
    names = spark.createDataFrame([("d", 1, "One", 1), ("d", 2, "Two ", 1), ("d", 3, "Three", 3), ("d", 4, "", 3), ("d", 5, "Gone", 3)], "document_id string, chapter_index int, name string, page_start int")
    got = sorted(tuple(r) for r in S.name_spans(pages, names).collect())
    assert got == [("d", 1, 0, 0, long), ("d", 1, 1, 1, "One text"), ("d", 1, 2, 2, "Two more"), ("d", 2, 0, 2, "no name"), ("d", 3, 0, 3, "Three"), ("d", 4, 0, 5, ""), ("e", 1, 0, 0, "x")]
