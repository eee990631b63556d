"""Reads of stored rows: decoding, ordered lists, optional filters, tiers of filters, defaults for what generated JSON lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T
from scholium.operators.retrieval import cosine, filtered, keep_first

REFS = "array<struct<doc_id:string,doc_name:string,page:int,extraction_method:string,is_ocr_text:boolean>>"
FLAGS = ("is_ocr", "has_formula", "has_example", "has_exercise")


def decoded(rows: DataFrame) -> DataFrame:
    """Stored fragments with their JSON columns as arrays (empty where missing or broken) and flags as booleans."""
    none = lambda t: F.array().cast(t)
    out = rows
    for c, t in (("knowledge_points", "array<string>"), ("tags", "array<string>"), ("source_refs", REFS), ("embedding", "array<double>")):
        if c in rows.columns:
            out = out.withColumn(c, F.coalesce(F.from_json(c, t), none(t)))
    for c in FLAGS:
        if c in rows.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return out


def pages_of(pages: DataFrame, document_id: str | None = None) -> DataFrame:
    """Pages in reading order: by number, or by id where there is none."""
    some = pages if document_id is None else pages.where(F.col("document_id") == document_id)
    return some.orderBy("document_id", F.coalesce("page_no", "id"), "id")


def points_of(points: DataFrame, course_id: str, chapter_id: str | None = None, kp_type: str | None = None) -> DataFrame:
    """A course's knowledge points in the order they were made; filters that are None or empty don't count."""
    return filtered(points, {"course_id": course_id, "chapter_id": chapter_id, "kp_type": kp_type}).orderBy("created_at", "kp_id")


def answers_of(answers: DataFrame, exercises: DataFrame) -> DataFrame:
    """Answers to any of the exercises: a semi-join, so an exercise listed twice doubles nothing."""
    return answers.join(exercises.select("exercise_id"), "exercise_id", "left_semi")


def chapter_counts(chapters: DataFrame, points: DataFrame, per: str = "course_id") -> DataFrame:
    """Every chapter with the number of its knowledge points."""
    n = points.groupBy(per, "chapter_name").agg(F.count("*").alias("kp_count"))
    return chapters.join(n, [per, "chapter_name"], "left").fillna(0, ["kp_count"])


def laddered(fragments: DataFrame, tiers: list[Column], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the first tier of filters that has any, without repetitions, with ``tier`` (from 0): one scan for all tiers."""
    tier = reduce(lambda acc, t: acc.when(t[1], t[0]), list(enumerate(tiers))[1:], F.when(tiers[0], 0))
    seen = fragments.withColumn("tier", tier).where("tier IS NOT NULL")
    best = seen.agg(F.min("tier").alias("_best"))
    return keep_first(seen.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best"), keys, order)  # best is one row


def section_tiers(fragments: DataFrame, section: str, base: Column, least: float = 70.0) -> list[Column]:
    """The section by its normalised name; sections like it; only the other filters; all."""
    name, wanted = T.heading_name(F.col("section_name")), T.heading_name(F.lit(section))
    near = F.greatest(batch.partial_ratio_udf(F.lit(section), T.text_or_empty(F.col("section_name"))), batch.token_set_ratio_udf(F.lit(section), T.text_or_empty(F.col("section_name")))) >= least
    return [base & (name == wanted), base & near, base, F.lit(True)]


def concepts(rows: DataFrame, session_id: str, wanted: str, vector: list[float] | None = None, k: int = 3) -> DataFrame:
    """A session's concepts most like a vector, or without one those that hold the words."""
    mine = rows.where(F.col("session_id") == session_id)
    if vector is None:
        return mine.where(F.contains(F.lower("concept"), F.lit(wanted.lower()))).orderBy("concept").limit(k)
    return mine.withColumn("score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))).orderBy(F.col("score").desc(), "concept").limit(k)


def rerank_share(score: Column) -> Column:
    """A model's score of about -10 to 10 as a share."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 10) / 20))


def with_required(rows: DataFrame, doc: str, key: str, fallback: str) -> DataFrame:
    """``doc``, or the fallback JSON where it is broken or lacks the key; ``warning`` says which."""
    broken, lacks = F.try_parse_json(F.col(doc)).isNull(), F.get_json_object(doc, f"$.{key}").isNull()
    warning = F.when(broken, "not JSON").when(lacks, F.lit(f"no {key}"))
    return rows.withColumn("warning", warning).withColumn(doc, F.when(broken | lacks, fallback).otherwise(F.col(doc)))


def unpacked(c: Column, depth: int = 3) -> Column:
    """A JSON value out of the strings it was packed into, up to ``depth`` times."""
    for _ in range(depth):
        inner = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
        quoted = F.substring(F.trim(c), 1, 1) == '"'
        c = F.when(quoted & F.try_parse_json(inner).isNotNull(), inner).otherwise(c)
    return c


def first_of(doc: Column, *names: str) -> Column:
    """The first of several fields of a JSON object that is there: generated results name the same thing in different ways."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{n}"), F.lit("")) for n in names])
