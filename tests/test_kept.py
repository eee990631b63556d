"""Rows by document and embeddings by content: changes, what is touched, and tries after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from scholium.sources.indexes import BucketTable, EmbeddingCache


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(table):
    return sorted((tuple(r) for r in table.rows().collect()), key=repr)


def test_only_buckets_of_the_change_are_written(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), buckets=8)
    assert t.rows() is None
    t.delete(spark.createDataFrame([(1,)], "document_id int"))  # nothing to forget
    assert t.rows() is None
    first = spark.createDataFrame([(d, f"{d}/{k}") for d in range(40) for k in range(3)] + [(None, "n"), (None, "n")], "document_id int, v string")
    t.replace(first)
    assert rows(t) == sorted((tuple(r) for r in first.collect()), key=repr)
    before = files(tmp_path / "rows")
    t.replace(spark.createDataFrame([(7, "new", 1.5)], "document_id int, v string, extra double"))
    after = files(tmp_path / "rows")
    assert {f: after[f] for f in before} == before and len({os.path.dirname(f) for f in after} - {os.path.dirname(f) for f in before}) == 1
    got = t.rows()
    assert got.columns == ["document_id", "v", "extra"] and [tuple(r) for r in got.where("document_id = 7").collect()] == [(7, "new", 1.5)]
    assert got.count() == 120 and got.where("extra IS NULL").count() == 119
    t.delete(spark.createDataFrame([(None,)], "document_id int"))
    assert t.rows().where("document_id IS NULL").count() == 0
    t.delete(first)
    assert t.rows().count() == 0
    t.replace(first)
    assert t.rows().count() == 122


def test_a_change_that_was_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, str(tmp_path), buckets=4)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, v string")
    t.replace(one)
    two = spark.createDataFrame([(1, "c")], "document_id int, v string")

    def fails(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", fails)  # between the rows and their commit
        with pytest.raises(OSError):
            t.replace(two)
    assert rows(t) == [(1, "a"), (2, "b")]
    t.replace(two)
    assert rows(t) == [(1, "c"), (2, "b")]


def counted(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(df):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf.assign(embedding=[[float(len(t))] if t != "bad" else None for t in pdf["text"]])

        return df.mapInPandas(run, "digest string, text string, embedding array<double>")

    return seen, embed


def test_embeddings_once_per_content(spark, tmp_path):
    seen, embed = counted(spark)
    cache = EmbeddingCache(spark, str(tmp_path), "m", 4)
    f = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "abcdX"), (5, "abcdY"), (6, "bad")], "chunk_id int, text string")
    cache.fill(f, embed, "one")
    got = {r.chunk_id: r.embedding for r in cache.embedded(f).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: [0.0], 4: [4.0], 5: [4.0], 6: None} and seen.value == 4
    cache.fill(f, embed, "two")
    assert seen.value == 5  # the one that failed, again
    assert cache.embedded(f).where("chunk_id = 4").first().text == "abcdX"
    n = cache.stored().count()
    cache.fill(f, embed, "one")  # the same batch again, as after a failure
    assert cache.stored().count() == n == cache.stored().select("digest").distinct().count()
    other = EmbeddingCache(spark, str(tmp_path), "another model", 4)
    assert other.embedded(f).where(F.col("embedding").isNotNull()).count() == 0
    assert cache.embedded(f.limit(0)).count() == 0
    cache.fill(f.limit(0), embed, "empty")
