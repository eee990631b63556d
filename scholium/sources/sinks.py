"""Sinks: JSON lines, graph JSON, Markdown, and replacing the rows of given documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.batch import render_markdown


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON lines of nodes, then edges, then one line of counts; no row holds the whole graph."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
    counts = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    return line(nodes, "node").unionByName(line(edges, "edge")).unionByName(line(counts, "counts"))


def markdown(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("markdown", render_markdown(F.col(column)))


def replaced(old: DataFrame, new: DataFrame, key: str | list[str] = "document_id") -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced; columns missing on a side are null."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_pages(old: DataFrame, good: DataFrame, failed: DataFrame) -> DataFrame:
    """Pages of a parse: readable ones and those that failed, in place of the documents' former pages."""
    return replaced(old, good.unionByName(failed, allowMissingColumns=True))


def overwrite_documents(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Writes only the partitions of the documents in ``df``; those of other documents stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def removed(tables: dict[str, DataFrame], documents: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the documents: a cascading delete."""
    gone = documents.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def with_embedding_ids(fragments: DataFrame, embedded: DataFrame) -> DataFrame:
    """``embedding_id`` of the fragments that got a vector; others keep theirs."""
    e = embedded.select("chunk_id", F.lit(True).alias("_new")).distinct()
    return fragments.join(e, "chunk_id", "left").withColumn("embedding_id", F.when(F.col("_new"), F.concat(F.lit("emb_"), F.col("chunk_id"))).otherwise(F.col("embedding_id"))).drop("_new")


def vectors(fragments: DataFrame) -> DataFrame:
    """What a vector index takes: rows with an id and a text, and their other columns as JSON without nulls."""
    rest = [c for c in fragments.columns if c not in ("chunk_id", "text", "embedding")]
    return fragments.where("chunk_id <> '' AND text <> ''").select("chunk_id", "text", "embedding", F.to_json(F.struct(*rest)).alias("metadata"))


def live(rows: DataFrame, now, at: str = "ts", seconds: int = 86_400) -> DataFrame:
    """Cached rows that are not yet too old."""
    return rows.where(F.col(at) > now - F.make_interval(secs=F.lit(seconds)))


def student_version(questions: DataFrame) -> DataFrame:
    """Questions without what gives the answer away."""
    return questions.drop("answer", "correct_answer", "explanation", "detailed_explanation", "grading_criteria", "common_mistakes")


def graph_object(nodes: DataFrame, edges: DataFrame, per: str = "course_id") -> DataFrame:
    """``per, value``: one JSON object of counts, nodes and edges per course, for courses that a client can show whole."""
    n = nodes.groupBy(per).agg(F.count("*").alias("node_count"), F.array_sort(F.collect_list(F.struct("node_id", "node_type", "name", "confidence"))).alias("nodes"))
    e = edges.groupBy(per).agg(F.count("*").alias("edge_count"), F.array_sort(F.collect_list(F.struct("source", "target", "relation", "weight"))).alias("edges"))
    both = n.join(e, per, "left").fillna(0, ["edge_count"])
    return both.select(per, F.to_json(F.struct("node_count", "edge_count", "nodes", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,relation:string,weight:double>>")).alias("edges"))).alias("value"))
