"""What only larger tables have: more than 999 chapters, many equal scores, vectors by the batch, tokens that cancel out."""

import hashlib
import math
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.operators import retrieval as R
from scholium.plans import catalogue
from tests.oracle import rows

WORDS = ("small", "large", "hot", "red", "gear", "bolt", "rod")


def by_sql(folder, table, name):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return rows(con.execute(catalogue.ORACLE[name]).df())


def test_similarity_pairs_are_exact_in_batches(spark):
    """Repeated, zero, huge, tiny, odd-sized and broken vectors against the scores one by one; a batch has fewer rows than the table."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    v[20:60] = [v[7]] * 40
    v[60], v[61], v[62], v[63] = [0.0] * 8, [3e38] * 8, [1e-44] * 8, [float("nan")] * 8
    v[64], v[65], v[66], v[67] = None, [], v[7][:3], [None] + v[7][1:]
    vectors = spark.createDataFrame([(i if i < 299 else None, x, i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    usual = vectors.where("vec_id in (0, 7, 100, 200)").select(F.concat(F.lit("q"), "vec_id").alias("q_id"), F.col("embedding").alias("q"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        plan = R.vector_topk(vectors, usual, 6)
        assert "MapInArrow" in plan._jdf.queryExecution().toString()  # not one by one
        for queries in (usual, usual.unionByName(spark.createDataFrame([("z", [0.0] * 8), ("s", [1.0]), ("n", None)], "q_id string, q array<float>"))):
            low = lambda r: (r.score is None, -math.inf if r.score is not None and math.isnan(r.score) else -(r.score or 0.0), -1 if r.vec_id is None else r.vec_id)
            first = lambda df: {q: [(r.vec_id, repr(r.score)) for r in sorted((r for r in found if r.q_id == q), key=low)[:6]] for found in [df.select("q_id", "vec_id", "score").collect()] for q in {r.q_id for r in found}}
            every = vectors.crossJoin(queries).withColumn("score", R.cosine(F.col("embedding"), F.col("q")))
            assert first(R.vector_topk(vectors, queries, 6)) == first(every)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def long_book(spark, tmp_path_factory):
    """Two documents of 1,030 and 8 chapters, with a section, a definition, an example and a sentence in each."""
    folder = str(tmp_path_factory.mktemp("book"))
    of = lambda p: (p, " ".join((WORDS[p // 12 % 7], WORDS[p // 84 % 7])), "Brand#2" if p < 96 else "Brand#1", WORDS[p // 12 % 5].upper(), p // 12 % 50 + 1)
    made = [of(p) for p in range(12 * 1038) if p % 12 in (0, 1, 2, 4, 6)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["page_spans", "kp_extract", "chapter_point_counts", "graph_nodes", "graph_edges"])
def test_over_999_chapters(spark, long_book, name):
    got = rows(catalogue.QUERIES[name](spark, long_book).toPandas())
    assert got == by_sql(long_book, "part", name)


def test_course_outline_over_999_chapters(spark, long_book):
    """The SQL leaves the order within an id open; here it is the chapters' own."""
    got = {r.document_id: r for r in catalogue.QUERIES["course_outline"](spark, long_book).collect()}
    name = lambda c: f"第{c % 50 + 1}章 {WORDS[c % 7]} {WORDS[c // 7 % 7]}"
    ids = sorted(range(1, 1031), key=lambda n: (str(n).rjust(3, "0")[:3], n))
    assert got["Brand#1"].names == [name(n + 7) for n in ids] and got["Brand#1"].chapter_count == 1030
    assert got["Brand#2"].names == [name(c) for c in range(8)]


def test_keyword_ranks_of_equal_scores_go_by_chunk(spark):
    made = [("c", f"{chr(97 + i)}", "k", "s", "t", "small gear", 9 - i) for i in range(6)] + [("c", "z", "k", "s", "t", "rod", 1)] * 20
    f = spark.createDataFrame(made, "course_id string, chunk_id string, chapter_name string, section_name string, chunk_type string, text string, page_start int")
    got = {r.chunk_id: r["rank"] for r in R.keyword_search(f, "c", "small gear").collect()}
    assert got == {c: i + 1 for i, c in enumerate("abcdef")}
    by_page = {r.chunk_id: r["rank"] for r in R.keyword_search(f.where("chunk_id < 'z'"), "c", "small OR gear", k=3).collect()}
    assert by_page == {"f": 1, "e": 2, "d": 3}


def test_tokens_that_cancel_out_are_kept_once(spark, tmp_path):
    """Two tokens with one slot and two signs: a zero vector, but a vector."""
    seen = {}
    for a in map("".join, product("abcdefghij", repeat=4)):
        h = hashlib.md5(a.encode()).digest()
        slot, sign = int.from_bytes(h[:4], "little") % 384, h[4] % 2
        if (slot, 1 - sign) in seen:
            break
        seen[slot, sign] = a
    texts = [f"{a} {seen[slot, 1 - sign]}", f"{a} {seen[slot, 1 - sign]}", a, "é ...", "", "a b c"]
    spark.createDataFrame([(i, t, "de" if i % 2 else "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(catalogue.QUERIES["embedding_cache"](spark, str(tmp_path)).toPandas()) == by_sql(tmp_path, "documents", "embedding_cache")
