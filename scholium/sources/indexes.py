"""What outlives a query: postings for BM25, vectors, rows by document, embeddings by content; kept in generations.

A change appends a generation (a folder) and at last its rows in the small
table that says which generation of a document, or of a course, is live; until
then no reader sees it, and after a failure the same change can be made again.
Nothing is rewritten in place but by ``compacted``.
"""

from __future__ import annotations

import json
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scholium.functions import text as T
from scholium.operators import retrieval as R


def _number(spark: SparkSession, path: str) -> int:
    """The number of the next generation: one more than the largest that was committed."""
    try:
        last = spark.read.parquet(f"{path}/live").agg(F.max("generation")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return last + 1


class TextIndex:
    """Postings in term buckets, maintained by document.

    ``path/postings/generation=g/bucket=b`` holds ``term, chunk_id, document_id,
    tf, dl`` sorted by term; ``path/live`` a row ``document_id, chunks, words,
    generation`` for each document of a generation (none left: zero chunks). A
    bucket is the CRC-32 of the term modulo ``buckets``, so a search reads the
    folders of its terms only, and their row groups by term.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(self.buckets)).cast("int")

    def replace(self, fragments: DataFrame) -> None:
        """Puts ``fragments (chunk_id, document_id, text)`` in place of all that the index has of their documents."""
        g = _number(self.spark, self.path)
        toks = fragments.select("chunk_id", "document_id", T.tokens(T.text_or_empty(F.col("text"))).alias("toks"))
        p = toks.select("chunk_id", "document_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
        p = p.groupBy("term", "chunk_id", "document_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).withColumn("bucket", self._bucket(F.col("term")))
        # a bucket with a word that every text has becomes several files, by size
        p.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={g}")
        self._commit(toks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.size("toks")).cast("long").alias("words")), g)

    def delete(self, documents: DataFrame) -> None:
        """Forgets the documents of ``documents (document_id)``: rows without chunks, no file of postings is touched."""
        self._commit(documents.select("document_id").distinct().select("document_id", F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("words")), _number(self.spark, self.path))

    def _commit(self, documents: DataFrame, g: int) -> None:
        documents.withColumn("generation", F.lit(g)).write.mode("append").parquet(f"{self.path}/live")

    def live(self) -> DataFrame:
        """``document_id, chunks, words, generation`` of the documents that are there."""
        rows = self.spark.read.parquet(f"{self.path}/live")
        return rows.groupBy("document_id").agg(F.max_by(F.struct("chunks", "words", "generation"), "generation").alias("x")).select("document_id", "x.*").where("chunks > 0")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The live postings, of some terms or of all."""
        p = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        if terms is not None:
            p = p.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(terms))
        return p.join(self.live().select("document_id", "generation"), ["document_id", "generation"])

    def search(self, query: str, most_terms: int = 12) -> DataFrame:
        """``chunk_id, document_id, bm25`` as ``retrieval.bm25`` over the live fragments: statistics from the live table, postings of the query's terms alone."""
        terms = sorted({t.lower() for t in R._terms(query)[:most_terms]})
        tf = self.postings(terms)
        stats = self.live().agg(F.sum("chunks").alias("n"), (F.sum("words") / F.sum("chunks")).alias("avgdl"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most most_terms rows
        return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("chunk_id", "document_id").agg(F.sum(R.bm25_part()).alias("bm25"))

    def compacted(self, path: str) -> TextIndex:
        """A copy with the live postings as one generation."""
        new = TextIndex(self.spark, path, self.buckets)
        p = self.postings().drop("generation")
        p.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation=0")
        new._commit(self.live().drop("generation"), 0)
        return new


class VectorIndex:
    """Normalised vectors of courses, maintained by fragment.

    ``path/vectors/generation=g`` holds ``course_id, chunk_id, embedding``
    (null: deleted); ``path/live`` a row ``course_id, base, generation`` for each course
    of a generation: what is older than the largest ``base`` was rebuilt and is
    not read again. Of a fragment the newest generation counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, rows: DataFrame, rebuild: bool) -> None:
        g = _number(self.spark, self.path)
        out = rows.select("course_id", "chunk_id", R.normalised(F.col("embedding")).alias("embedding"))
        out.hint("rebalance", "course_id").sortWithinPartitions("course_id", "chunk_id").write.mode("overwrite").parquet(f"{self.path}/vectors/generation={g}")
        courses = rows.select("course_id").distinct()
        courses.select("course_id", F.lit(g if rebuild else 0).alias("base"), F.lit(g).alias("generation")).write.mode("append").parquet(f"{self.path}/live")

    def upsert(self, rows: DataFrame) -> None:
        """Adds or replaces the fragments of ``rows (course_id, chunk_id, embedding)``."""
        self._write(rows, False)

    def rebuild(self, rows: DataFrame) -> None:
        """``rows`` become all that their courses have."""
        self._write(rows, True)

    def delete(self, rows: DataFrame) -> None:
        """Forgets the fragments of ``rows (course_id, chunk_id)``."""
        self._write(rows.select("course_id", "chunk_id", F.lit(None).cast("array<double>").alias("embedding")), False)

    def vectors(self, courses: list | None = None) -> DataFrame:
        """``course_id, chunk_id, embedding`` that are live, of some courses or of all."""
        rows = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors")
        bases = self.spark.read.parquet(f"{self.path}/live")
        if courses is not None:
            rows, bases = rows.where(F.col("course_id").isin(courses)), bases.where(F.col("course_id").isin(courses))
        bases = bases.groupBy("course_id").agg(F.max("base").alias("base"), F.max("generation").alias("_last"))
        rows = rows.join(bases, "course_id").where("generation >= base AND generation <= _last")
        newest = rows.groupBy("course_id", "chunk_id").agg(F.max_by("embedding", "generation").alias("embedding"))
        return newest.where(F.col("embedding").isNotNull())

    def has(self, course_id) -> bool:
        """Whether a course has a vector: only then is it searched by vectors."""
        return not self.vectors([course_id]).limit(1).isEmpty()

    def search(self, queries: DataFrame, k: int, courses: list | None = None) -> DataFrame:
        """``q_id, course_id, chunk_id, score, rank``: the k most similar of each course for every query of ``(q_id, q)``."""
        v = self.vectors(courses)
        parts = max(1, -(-queries.count() // 2048))
        w = Window.partitionBy("q_id", "course_id").orderBy(F.col("score").desc(), "chunk_id")
        out = None
        for i in range(parts):
            q = queries.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == i).select("q_id", R.normalised(F.col("q")).alias("q"))
            scored = v.crossJoin(F.broadcast(q)).withColumn("score", R.cosine(F.col("embedding"), F.col("q"))).drop("q", "embedding")
            top = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            out = top if out is None else out.unionByName(top)
        return out

    def search_text(self, fragments: DataFrame, course_id, query: str, embedded: list[float] | None, k: int) -> DataFrame:
        """``chunk_id, vector_score`` of a course: from the index if it has vectors and the query has one, else by the offline embedder over its fragments."""
        if embedded is not None and self.has(course_id):
            q = self.spark.createDataFrame([(0, [float(x) for x in embedded])], "q_id int, q array<double>")
            return self.search(q, k, [course_id]).select("chunk_id", F.col("score").alias("vector_score"))
        scores = R.hash_search(fragments.where(F.col("course_id") == course_id), query)
        return scores.orderBy(F.col("vector_score").desc(), "chunk_id").limit(k)


class BucketTable:
    """Rows kept by document in a fixed number of buckets, of which a change rewrites only its own.

    ``path/rows/live_generation=g/live_bucket=b`` holds the rows of a bucket as
    of a change; ``path/live`` says, in a row for each bucket of a change, which
    generation counts, and with which columns it was written. A change is seen
    when its rows of ``live`` are there and not before, and after a failure it
    can be made again; files of other buckets are neither read nor written. One
    writer at a time. Rows without a document belong to one document of that
    name, null. ``live_generation`` and ``live_bucket`` can't be columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        name = F.coalesce(F.col(self.key).cast("string"), F.lit("")).cast("binary")
        return df.withColumn("live_bucket", F.pmod(F.crc32(name), F.lit(self.buckets)).cast("int"))

    def live(self) -> dict[int, tuple[int, str]]:
        """The live generation of each bucket and its columns, one entry a bucket."""
        if not _number(self.spark, self.path):
            return {}
        rows = self.spark.read.parquet(f"{self.path}/live").groupBy("bucket").agg(F.max(F.struct("generation", "columns")).alias("x"))
        return {r.bucket: (r.x.generation, r.x.columns) for r in rows.collect()}

    def rows(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The live rows, of some buckets or of all; None if there never were any. Columns that came later are null in earlier rows."""
        live = {b: x for b, x in self.live().items() if buckets is None or b in buckets}
        if not live:
            return None
        fields = {f.name: f for _, columns in sorted(set(live.values())) for f in StructType.fromJson(json.loads(columns)).fields}
        number = [StructField("live_generation", IntegerType()), StructField("live_bucket", IntegerType())]
        made = sorted({g for g, _ in live.values()})
        read = self.spark.read.schema(StructType([*fields.values(), *number])).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/live_generation={g}" for g in made])
        mine = [(F.col("live_generation") == g) & F.col("live_bucket").isin([b for b, (h, _) in live.items() if h == g]) for g in made]
        return read.where(reduce(lambda x, y: x | y, mine)).drop("live_generation", "live_bucket")

    def _change(self, new: DataFrame | None, gone: DataFrame) -> None:
        """Writes ``new`` and what its buckets keep, which is all but the rows of the keys in ``gone``."""
        touched = {r.live_bucket for r in self._bucketed(gone).select("live_bucket").distinct().collect()}
        kept = self.rows(touched) if touched else None
        if kept is not None:
            keys = gone.select(F.col(self.key).alias("_key")).distinct()
            stay = kept.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            new = stay if new is None else stay.unionByName(new, allowMissingColumns=True)
        if not touched or new is None:
            return
        g = _number(self.spark, self.path)
        # a bucket with a very large document becomes several files, by size
        self._bucketed(new).hint("rebalance", "live_bucket").write.mode("overwrite").partitionBy("live_bucket").parquet(f"{self.path}/rows/live_generation={g}")
        self.spark.createDataFrame([(b, g, new.schema.json()) for b in sorted(touched)], "bucket int, generation int, columns string").coalesce(1).write.mode("append").parquet(f"{self.path}/live")

    def replace(self, new: DataFrame) -> None:
        """Puts the rows of ``new`` in place of all that its documents have."""
        self._change(new, new.select(self.key))

    def delete(self, documents: DataFrame) -> None:
        """Forgets the documents of ``documents``."""
        self._change(None, documents.select(self.key))


class EmbeddingCache:
    """Vectors by what was embedded: the digest of a model's name and a text as the model sees it.

    ``path/vectors/batch=id`` holds ``digest, embedding``. Only texts that no
    batch has are embedded, each once; a batch is named by whoever asks and is
    overwritten when it is tried again, so no digest is there twice. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, most_chars: int = 8000):
        self.spark, self.path, self.model, self.most_chars = spark, path, model, most_chars

    def digested(self, fragments: DataFrame) -> DataFrame:
        """``fragments`` with ``seen``, the text as far as the model takes it (null: empty), and ``digest``."""
        seen = fragments.withColumn("seen", F.substring(T.text_or_empty(F.col("text")), 1, self.most_chars))
        return seen.withColumn("digest", F.sha2(F.concat_ws("\u0000", F.lit(self.model), "seen"), 256))

    def stored(self, but: str | None = None) -> DataFrame:
        """``digest, embedding`` of all batches but one."""
        empty = self.spark.createDataFrame([], "digest string, embedding array<double>")
        try:
            rows = self.spark.read.schema("digest string, embedding array<double>, batch string").option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty
        return rows.where(F.lit(True) if but is None else F.col("batch") != but).select("digest", "embedding")

    def fill(self, fragments: DataFrame, embed, batch: str) -> None:
        """Embeds what is missing and keeps it as a batch. ``embed`` adds ``embedding`` to rows with ``text``; where that is null nothing is kept, and the next batch tries again."""
        texts = self.digested(fragments.select("text")).groupBy("digest").agg(F.min("seen").alias("text"))
        missing = texts.join(self.stored(but=batch).select("digest"), "digest", "left_anti")
        got = embed(missing).where(F.col("embedding").isNotNull()).select("digest", "embedding")
        got.write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")

    def embedded(self, fragments: DataFrame) -> DataFrame:
        """``fragments`` with their whole texts and ``embedding`` (null: not in the cache)."""
        return self.digested(fragments).drop("seen").join(self.stored(), "digest", "left").drop("digest")
