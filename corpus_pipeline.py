"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Documents that the toxicity model rejects go; one document of each near-duplicate
group stays; repeated byte strings are cut from the texts; documents that overlap
a benchmark item go; every remaining document gets its mixing rate and keeps its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm import decontaminate, mixing, nearcopies, simhash, suffix, toxicity
from scholium.llm.common import checkpoint, checkpoint_dir
from scholium.llm.queries import MIX

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the input's labelled rows, none of them held out; null and empty texts stay."""
    return toxicity.scored(docs.select(*COLUMNS), _table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, once if its row repeats; rows with a null id are kept.

    Documents link if their SimHash fingerprints do (as in op10; all exact copies)
    or if their five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    docs = docs.select(*COLUMNS)
    fps, nodes, linked = simhash.linked_fingerprints(docs.select("doc_id", "text"))
    names = checkpoint(fps.where("doc_id is not null").distinct().join(nodes, "fp").select("doc_id", F.col("rep").alias("name")))
    comps = nearcopies.grouped(docs.select("doc_id", "text"), 5, names, checkpoint(linked.distinct()))[1]
    of = names.join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn("first", F.coalesce("component", "name"))
    gone = checkpoint(of.where("doc_id <> first").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = checkpoint(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return left
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    once = left.join(again, "doc_id", "left_semi").withColumn("_nth", nth).where("_nth = 1").select(*COLUMNS)
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 50-byte string that also starts in a document with a smaller id goes; no row does.

    A null text stays null, a null id's text stays whole; ``n_chars`` is counted anew.
    """
    out = suffix.cleaned(docs.select(*COLUMNS), window=50)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, substitutions tolerated; null and empty texts overlap nothing."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left with ``n_tokens, domain, posterior, rate, copies``; texts without words count no tokens."""
    out = mixing.fitted(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"), MIX, carry=tuple(c for c in COLUMNS if c != "doc_id"))
    return out.withColumn("copies", mixing.copies(F.col("rate")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("repeated strings", cut_repeats),
    ("benchmark overlaps", drop_benchmark_overlaps),
    ("mixing", mix),
]

#: SQL can't express a trained model; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
