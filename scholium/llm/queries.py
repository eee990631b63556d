"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, chat, collocations, decontaminate, extract, mixing, phrases, quality, repair, simhash, suffix, toxicity, vectors


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(_t(spark, sf_dir, "pages"))


def op2_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, _t(spark, sf_dir, "labels"), threshold=0.7).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: Target token shares of the query and of the pipeline.
MIX = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.fitted(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), MIX)
    return out.withColumn("copies", mixing.copies(out["rate"]))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_t(spark, sf_dir, "documents"), window=50)


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_t(spark, sf_dir, "conversations"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(_t(spark, sf_dir, "documents"), window=20)


def op8_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings")
    return bitslice.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_t(spark, sf_dir, "documents"))


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"), radius=2, shingle=3)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_t(spark, sf_dir, "documents").select("lang", "text"), max_n=4, least=30, top=2000)


def op12_pigeonhole_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_t(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_t(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_page_differencing, op2_toxicity_kernel, op3_soft_mixing, op4_suffix_dedup, op5_spaced_seed_decontamination, op6_chat_rotation, op7_phrase_dedup, op8_bitsliced_topk, op9_weak_label_quality, op10_simhash_neardup, op11_collocations, op12_pigeonhole_neardup, op13_conversation_repair)}

ORACLE: dict[str, str] = {
    "op11_collocations": collocations.ORACLE,
    "op12_pigeonhole_neardup": vectors.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
    "op6_chat_rotation": chat.ORACLE,
    "op8_bitsliced_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
