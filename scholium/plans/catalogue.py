"""The engine's named queries over the driver tables, and the SQL that gives the same rows in DuckDB.

Bindings: a document is a one-page fragment of the course ``source``; events
are a learner's activity (an ``error`` is a wrong answer and a mistake);
customers and orders stand for mistakes and exercises, parts and line items for
exercises and answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import batch
from scholium.functions import text as T
from scholium.operators import analysis as AN
from scholium.operators import analytics as A
from scholium.operators import generators as G
from scholium.operators import knowledge as KN
from scholium.operators import lookups as L
from scholium.operators import parsing as P
from scholium.operators import rendering as RE
from scholium.operators import retrieval as R
from scholium.operators import structure as S
from scholium.session import scratch, written
from scholium.sources.indexes import BucketTable, EmbeddingCache, TextIndex, VectorIndex
from scholium.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

QUERY = "the worthless theory of inthis and onon"
PHRASE = "and the"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents")


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("course_id"), "text", "lang", "n_chars")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("concept")).when(k % 4 == 2, F.lit("method"))
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), F.floor("value").cast("long").alias("seconds"), (F.col("event_type") != "error").alias("is_correct"), kind.alias("error_type"), (F.col("event_id") % 2 == 0).alias("mastered"))


def r(x: Column, n: int = 6) -> Column:
    """A double rounded half up at a fixed scale, for comparable results."""
    return F.round(x.cast("decimal(30,12)"), n).cast("double")


ANSWERS_SQL = """a AS (SELECT event_id, user_id, ts, event_type AS action, CAST(floor(value) AS BIGINT) AS seconds, event_type <> 'error' AS is_correct,
  CASE CAST(json_extract(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN 'concept' WHEN 2 THEN 'method' END AS error_type, event_id % 2 = 0 AS mastered FROM events)"""
LINES_SQL = r"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l1 AS (SELECT doc_id, i, regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM l0),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no, line FROM l1 WHERE line <> '')"""
BM25_SQL = """tok AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
x AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM x WHERE term IN ('the', 'worthless', 'theory', 'of', 'inthis', 'and', 'onon') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term), st GROUP BY 1)"""
R6 = "CAST(round(CAST({} AS DECIMAL(30,12)), 6) AS DOUBLE)"


# --- retrieval ---
@query(
    f"WITH {BM25_SQL} SELECT doc_id AS chunk_id, source AS course_id, {R6.format('bm25')} AS score, source || ' 正文 第 1 页 doc-' || CAST(doc_id AS VARCHAR) AS citation "
    "FROM bm JOIN documents USING (doc_id) WHERE source = 'src0' ORDER BY bm25 DESC, doc_id LIMIT 10"
)
def bm25_topk(spark, sf):
    f = _fragments(spark, sf)
    top = R.bm25(f, QUERY).join(f.where("course_id = 'src0'").select("chunk_id", "course_id"), "chunk_id").orderBy(F.col("bm25").desc(), "chunk_id").limit(10)
    cite = T.citation(F.col("course_id"), F.lit(None).cast("string"), F.lit(1), F.lit(1), F.concat(F.lit("doc-"), F.col("chunk_id").cast("string")))
    return top.select("chunk_id", "course_id", r(F.col("bm25")).alias("score"), cite.alias("citation"))


@query(f"WITH {BM25_SQL} SELECT doc_id AS chunk_id, {R6.format('1 / (1 + abs(bm25))')} AS keyword_score FROM bm")
def bm25_compat_score(spark, sf):
    return R.bm25(_fragments(spark, sf), QUERY).select("chunk_id", r(R.compat_score(F.col("bm25"))).alias("keyword_score"))


@query("SELECT doc_id AS chunk_id, CAST(0.5 AS DOUBLE) AS keyword_score FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'inthis') ORDER BY doc_id LIMIT 20")
def like_search(spark, sf):
    return R.like_search(_fragments(spark, sf), "Worthless inthis").select("chunk_id", "keyword_score").orderBy("chunk_id").limit(20)


@query(
    "WITH q AS (SELECT item_id, text AS query, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM benchmark) "
    "SELECT item_id, doc_id AS chunk_id, " + R6.format("0.5 + CASE WHEN contains(text, query) THEN 1 ELSE 0 END + 0.2 * len(list_filter(toks, lambda t: contains(text, t)))") + " AS score "
    "FROM documents, q WHERE contains(text, query)"
)
def keyword_score(spark, sf):
    hit = R.containing(_fragments(spark, sf), _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("query")))
    return hit.select("item_id", "chunk_id", r(R.keyword_score(F.lit(0.5), F.col("text"), F.col("query"))).alias("score"))


@query("SELECT doc_id AS chunk_id, source AS course_id, n_chars FROM documents WHERE source = 'src1' AND lang = 'en' AND n_chars >= 500 ORDER BY doc_id LIMIT 50")
def fragment_filter(spark, sf):
    f = R.filtered(_fragments(spark, sf), {"course_id": "src1", "lang": "en", "difficulty": None}).where("n_chars >= 500")
    return f.select("chunk_id", "course_id", "n_chars").orderBy("chunk_id").limit(50)


@query("SELECT source AS course_id, lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') GROUP BY ALL")
def fragment_filter_in(spark, sf):
    return R.filtered(_fragments(spark, sf), {"course_id": ["src1", "src2", "src3"], "lang": ["en", "de"]}).groupBy("course_id", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS chunk_id, n_chars FROM documents WHERE n_chars >= 120 AND n_chars <= 900 AND lang IN ('fr', 'es') AND source = 'src4'")
def metadata_where(spark, sf):
    w = {"n_chars": {"$gte": 120, "$lte": 900}, "$and": [{"lang": {"$in": ["fr", "es"]}}, {"course_id": "src4"}]}
    return _fragments(spark, sf).where(R.compiled(w)).select("chunk_id", "n_chars")


@query("SELECT DISTINCT source AS chapter FROM documents ORDER BY 1")
def distinct_chapters(spark, sf):
    return _docs(spark, sf).select(F.col("source").alias("chapter")).distinct().orderBy("chapter")


@query("SELECT doc_id AS chunk_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (coalesce(toxic, 0) = 1 AND coalesce(CAST(quality AS DOUBLE), 1.0) < 0.55)")
def quality_filter(spark, sf):
    d = _docs(spark, sf).join(_t(spark, sf, "labels"), "doc_id", "left")
    d = d.select(F.col("doc_id").alias("chunk_id"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_ocr"), F.col("quality").cast("double").alias("source_quality_score"))
    return R.quality_filter(d).select("chunk_id")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_tokens FROM documents")
def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, "
    "list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))) AS s FROM embeddings, q) "
    f"SELECT vec_id, label, {R6.format('s')} AS score FROM s ORDER BY s DESC, vec_id LIMIT 10"
)
def vector_topk(spark, sf):
    v = _t(spark, sf, "embeddings")
    top = R.vector_topk(v, v.where("vec_id = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), 10)
    return top.select("vec_id", "label", r(F.col("score")).alias("score"))


@query(
    "WITH x AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS n FROM x) "
    "SELECT vec_id, " + R6.format("CASE WHEN n > 0 THEN list_sum(list_transform(v, lambda z: z / n)) ELSE list_sum(v) END") + " AS total, len(v) AS dims FROM n"
)
def l2_normalise(spark, sf):
    n = R.normalised(F.col("embedding"))
    return _t(spark, sf, "embeddings").select("vec_id", r(F.aggregate(n, F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("embedding").cast("long").alias("dims"))


@query(
    "WITH a AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS q_id, v AS q FROM a WHERE vec_id % 50 = 0), "
    "s AS (SELECT q_id, vec_id, list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda z: z * z))) * sqrt(list_sum(list_transform(q, lambda z: z * z)))) AS s FROM a, q WHERE vec_id <> q_id), "
    f"t AS (SELECT q_id, vec_id, {R6.format('s')} AS score, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT q_id, vec_id, score, rank FROM t WHERE rank <= 5"
)
def similarity_pairs(spark, sf):
    v = _t(spark, sf, "embeddings")
    top = R.vector_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), 6)
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    return top.where("vec_id <> q_id").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("q_id", "vec_id", r(F.col("score")).alias("score"), "rank")


HASH_SQL = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tok FROM documents), h AS (SELECT doc_id, md5(tok) AS h FROM t),
i AS (SELECT doc_id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 384 AS idx, CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM h),
s AS (SELECT doc_id, idx, sum(s) AS v FROM i GROUP BY ALL HAVING sum(s) <> 0), e AS (SELECT doc_id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS val FROM s)"""


@query(f"WITH {HASH_SQL} SELECT doc_id AS chunk_id, idx, {R6.format('val')} AS val FROM e")
def hash_embedding(spark, sf):
    return R.hash_embedding(_fragments(spark, sf)).select("chunk_id", "idx", r(F.col("val")).alias("val"))


def _hybrid(spark, sf) -> DataFrame:
    f = _fragments(spark, sf)
    kw = R.bm25(f, QUERY).orderBy(F.col("bm25").desc(), "chunk_id").limit(20).select("chunk_id", F.col("bm25").alias("keyword_score"))
    vec = R.hash_search(f, QUERY).withColumn("vector_score", r(F.col("vector_score"), 9)).orderBy(F.col("vector_score").desc(), "chunk_id").limit(20)
    return R.fused(kw, vec)


HYBRID_SQL = f"""{BM25_SQL}, kw AS (SELECT doc_id, bm25 AS k FROM bm ORDER BY bm25 DESC, doc_id LIMIT 20), {HASH_SQL},
qt AS (SELECT unnest(['the', 'worthless', 'theory', 'of', 'inthis', 'and', 'onon']) AS tok), qh AS (SELECT md5(tok) AS h FROM qt),
qi AS (SELECT CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 384 AS idx, CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM qh),
qs AS (SELECT idx, sum(s) AS v FROM qi GROUP BY 1 HAVING sum(s) <> 0), q AS (SELECT idx, v / sqrt(sum(v * v) OVER ()) AS q FROM qs),
vv AS (SELECT doc_id, CAST(round(CAST(sum(val * q) AS DECIMAL(30,12)), 9) AS DOUBLE) AS v FROM e JOIN q USING (idx) GROUP BY 1), ve AS (SELECT * FROM vv ORDER BY v DESC, doc_id LIMIT 20),
fu AS (SELECT doc_id, coalesce(k / (SELECT coalesce(nullif(max(k), 0), 1) FROM kw), 0) AS k, coalesce(v / (SELECT coalesce(nullif(max(v), 0), 1) FROM ve), 0) AS v FROM kw FULL JOIN ve USING (doc_id))"""


@query(f"WITH {HYBRID_SQL} SELECT doc_id AS chunk_id, {R6.format('0.45 * k + 0.55 * v')} AS score, CASE WHEN k <> 0 AND v <> 0 THEN '关键词+向量召回' WHEN k <> 0 THEN '关键词召回' WHEN v <> 0 THEN '向量召回' ELSE '规则排序' END AS why FROM fu")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).select("chunk_id", r(F.col("score")).alias("score"), F.col("why_matched").alias("why"))


@query(
    f"WITH {HYBRID_SQL}, rr AS (SELECT doc_id, 0.45 * k + 0.55 * v + CASE WHEN contains(text, 'and the') THEN 0.25 ELSE 0 END AS s FROM fu JOIN documents USING (doc_id)) SELECT doc_id AS chunk_id, {R6.format('s')} AS rerank_score FROM rr"
)
def rerank_rules(spark, sf):
    c = _hybrid(spark, sf).join(_fragments(spark, sf).select("chunk_id", "text"), "chunk_id")
    return R.reranked(c, PHRASE).select("chunk_id", r(F.col("rerank_score") - F.when(F.arrays_overlap(T.tags(F.lit(PHRASE)), T.tags(F.col("text"))), 0.1).otherwise(0.0)).alias("rerank_score"))


@query("WITH s AS (SELECT doc_id, CASE WHEN source = 'src3' AND lang = 'xx' THEN 1 ELSE 2 END AS tier FROM documents WHERE source = 'src3') SELECT doc_id AS chunk_id, tier FROM s WHERE tier = (SELECT min(tier) FROM s)")
def relax_filters(spark, sf):
    f = _fragments(spark, sf)
    return R.relaxed(f, F.col("lang") == "xx", F.col("course_id") == "src3").select("chunk_id", "tier")


@query("WITH s AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 80) ORDER BY doc_id) AS n FROM documents) SELECT doc_id AS chunk_id FROM s WHERE n = 1")
def dedupe_fragments(spark, sf):
    f = _fragments(spark, sf).withColumn("head", F.substring("text", 1, 80))
    return R.keep_first(f, ["course_id", "lang", "head"], ["chunk_id"]).select("chunk_id")


@query(
    "WITH h0 AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank, text FROM documents), h AS (SELECT * FROM h0 WHERE rank <= 50), "
    "b AS (SELECT *, length('[' || CAST(rank AS VARCHAR) || '] ' || text || chr(10) || '来源：' || source) AS n FROM h), "
    "u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank) AS used FROM b), o AS (SELECT *, max(CASE WHEN used > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) AS over FROM u) "
    "SELECT source AS course_id, doc_id AS chunk_id, CAST(rank AS BIGINT) AS rank, CAST(used AS BIGINT) AS used FROM o WHERE over = 0"
)
def context_budget(spark, sf):
    """The newest 50 fragments of each course as its result list."""
    d = A.latest(_fragments(spark, sf).select("course_id", "chunk_id"), "course_id", [F.col("chunk_id").desc()], 50)
    d = d.join(_fragments(spark, sf).select("chunk_id", "text"), "chunk_id").withColumn("citation", F.col("course_id"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("course_id").orderBy(F.col("chunk_id").desc())).cast("long"))
    return R.context(d, "rank", 4000, ["course_id"]).select("course_id", "chunk_id", "rank", F.col("used").cast("long").alias("used"))


@query(
    "WITH s AS (SELECT doc_id, text, (CASE WHEN contains(lower(text), 'worthless') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS hits FROM documents) "
    "SELECT doc_id AS chunk_id, CAST(hits AS BIGINT) AS hits FROM s WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 15"
)
def keyword_fallback(spark, sf):
    return R.keyword_fallback(_fragments(spark, sf), "Worthless idiot the").orderBy(F.col("hits").desc(), "chunk_id").limit(15).select("chunk_id", "hits")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('Worthless')) ORDER BY doc_id LIMIT 3")
def concept_ilike(spark, sf):
    return _docs(spark, sf).where(F.col("text").ilike("%Worthless%")).select("doc_id").orderBy("doc_id").limit(3)


# --- indexes that are kept: built, changed by document, searched ---
@query(
    "WITH d2 AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || ' theory of the worthless theory' ELSE text END AS text FROM documents WHERE lang <> 'es'), "
    + BM25_SQL.replace("FROM documents", "FROM d2") + f" SELECT doc_id AS chunk_id, {R6.format('bm25')} AS score FROM bm"
)
def text_index_search(spark, sf):
    """All documents indexed, those in German replaced, those in Spanish deleted; then every hit of a query, from its terms' buckets alone."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", "lang")
    index = TextIndex(spark, f"{scratch(spark)}/text-index-{uuid.uuid4().hex}")
    index.replace(d)
    index.replace(d.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" theory of the worthless theory"))))
    index.delete(d.where("lang = 'es'"))
    return index.search(QUERY).select("chunk_id", r(F.col("bm25")).alias("score"))


@query(
    "WITH v0 AS (SELECT label, vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), "
    "v AS (SELECT label, vec_id, CASE WHEN label = 3 THEN list_transform(v, lambda z: -z) ELSE v END AS v FROM v0 WHERE NOT (label = 5 AND v[1] <= 0) AND NOT (label = 7 AND v[1] < 0)), "
    "q AS (SELECT v AS q FROM v0 WHERE vec_id = 0), s AS (SELECT label, vec_id, list_cosine_similarity(v, q) AS s FROM v, q), "
    "t AS (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s) "
    f"SELECT label AS course_id, vec_id AS chunk_id, {R6.format('s')} AS score, rank FROM t WHERE rank <= 5"
)
def vector_index_search(spark, sf):
    """All vectors indexed with their labels as courses; one course upserted, one rebuilt from fewer vectors, some of one deleted; then five of each course."""
    v = _t(spark, sf, "embeddings").select(F.col("label").alias("course_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    index = VectorIndex(spark, f"{scratch(spark)}/vector-index-{uuid.uuid4().hex}")
    index.rebuild(v)
    index.upsert(v.where("course_id = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index.rebuild(v.where("course_id = 5 AND embedding[0] > 0"))
    index.delete(v.where("course_id = 7 AND embedding[0] < 0"))
    top = index.search(v.where("chunk_id = 0").select(F.col("chunk_id").alias("q_id"), F.col("embedding").alias("q")), 5)
    return top.select("course_id", "chunk_id", r(F.col("score")).alias("score"), "rank")


# --- text and structure ---
@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM lines")
def line_explode(spark, sf):
    return S.lines(_docs(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS n FROM lines) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM n WHERE n = 1")
def line_dedupe_keep_first(spark, sf):
    return R.keep_first(S.lines(_docs(spark, sf)), ["doc_id", "line"], ["line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {LINES_SQL}, n AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM lines) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM n WHERE b IS NULL OR b <> line")
def adjacent_collapse(spark, sf):
    return S.adjacent_collapsed(S.lines(_docs(spark, sf))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(
    f"WITH {LINES_SQL}, m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines), e AS (SELECT doc_id, line FROM m WHERE line_no < 2 UNION ALL SELECT doc_id, line FROM m WHERE line_no > last - 2) "
    "SELECT source, line, count(*) AS n FROM e JOIN documents USING (doc_id) WHERE length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '^[0-9 /—–-]+$') GROUP BY ALL HAVING count(*) >= 3"
)
def repeated_edge_lines(spark, sf):
    return S.edge_lines(_docs(spark, sf), "source")


@query(
    r"SELECT doc_id, " + R6.format(r"CASE WHEN length(text) = 0 THEN 0 ELSE 1.0 - CAST(length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}A-Za-z0-9=+\-*/^<>≤≥≈≠∫∑∏√∞]', '', 'g')) AS DOUBLE) / length(text) END") + " AS gibberish FROM documents"
)
def gibberish_ratio(spark, sf):
    return _docs(spark, sf).select("doc_id", r(T.gibberish_ratio(F.col("text"))).alias("gibberish"))


@query(
    rf"WITH {LINES_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(line) <= 2) AS short FROM lines GROUP BY 1), "
    r"g AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE 1.0 - CAST(length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}A-Za-z0-9=+\-*/^<>≤≥≈≠∫∑∏√∞]', '', 'g')) AS DOUBLE) / length(text) END AS g FROM documents) "
    "SELECT doc_id, coalesce(n, 0) AS line_count, " + R6.format("greatest(0, least(1, 1.0 - g * 0.75 - coalesce(CAST(short AS DOUBLE) / greatest(n, 1), 0) * 0.25))") + " AS quality FROM g LEFT JOIN s USING (doc_id)"
)
def text_quality(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_quality(F.col("text")).alias("q")).select("doc_id", F.col("q.line_count").alias("line_count"), r(F.col("q.quality")).alias("quality"))


@query(rf"WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\s*(?:第?\s*[0-9]+\s*页?|[-—–]?\s*[0-9]+\s*[-—–]?|[0-9]+\s*/\s*[0-9]+|page\s+[0-9]+(?:\s+of\s+[0-9]+)?)\s*$')) AS n FROM lines GROUP BY 1")
def page_number_lines(spark, sf):
    return S.lines(_docs(spark, sf)).groupBy("doc_id").agg(F.count_if(T.is_page_number(F.col("line"))).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def whitespace_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalise_whitespace(F.col("text"))).alias("h"))


@query(r"WITH " + LINES_SQL + r" SELECT CASE WHEN regexp_matches(line, '(?i)^\s*Definition([^\w]|$)') THEN 'definition' WHEN regexp_matches(line, '(?i)^\s*(Theorem|Lemma)([^\w]|$)') THEN 'theorem' WHEN regexp_matches(line, '(?i)^\s*Example([^\w]|$)') THEN 'example' WHEN regexp_matches(line, '(?i)^\s*Proof([^\w]|$)') THEN 'proof' WHEN regexp_matches(line, '(?i)^\s*Exercises?([^\w]|$)') THEN 'exercise' WHEN regexp_matches(line, '(?i)^\s*Summary([^\w]|$)') THEN 'summary' WHEN regexp_matches(line, '(\$.*?\$|\\frac|\\sum|\\int|[=<>≤≥≈≠]|∫|∑|√|lim)') THEN 'formula' ELSE 'explanation' END AS kind, count(*) AS n FROM lines GROUP BY 1")
def block_type(spark, sf):
    return S.lines(_docs(spark, sf)).groupBy(T.block_type(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


FORMULA_SQL = r"""(?i)(\$\$.*?\$\$|\$[^$]{1,200}\$|\\\[[\s\S]{1,500}?\\\]|\\\([\s\S]{1,300}?\\\)|(?:[A-Za-z0-9_{}\x{4e00}-\x{9fff}]+)\s*[=<>≤≥≈≠]\s*[^，。；;\n]{1,120}|(?:∫|∑|∏|√|lim|\\frac|\\sum|\\int)[^，。；;\n]{0,160})"""
FORMULAS_SQL = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{FORMULA_SQL}', 1), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: length(x) >= 2))"


@query(
    f"WITH f AS (SELECT doc_id, least(length(text) // 350, 3) + least(len({FORMULAS_SQL}), 3) + CASE WHEN regexp_matches(text, '证明|推导|综合|应用|最值|极限|积分|导数|矩阵|递推|概率密度|偏导') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(text, '选择|填空|判断|基础|概念') THEN 1 ELSE 0 END AS s FROM documents) "
    "SELECT doc_id, CASE WHEN s <= 1 THEN '基础' WHEN s <= 4 THEN '中等' ELSE '困难' END AS difficulty FROM f"
)
def difficulty(spark, sf):
    return _docs(spark, sf).select("doc_id", T.difficulty(F.col("text")).alias("difficulty"))


@query(f"SELECT doc_id, len({FORMULAS_SQL}) AS n, md5(array_to_string(list_sort({FORMULAS_SQL}), '|')) AS h FROM documents")
def formulas(spark, sf):
    f = _docs(spark, sf).select("doc_id", T.formulas(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("f"), "|")).alias("h"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-D][.、]|A[.、].*B[.、]') THEN '选择题' WHEN regexp_matches(text, '_{2,}|\(\s*\)') THEN '填空题' ELSE '综合题' END AS kind FROM documents")
def question_type(spark, sf):
    return _docs(spark, sf).select("doc_id", T.question_type(F.col("text")).alias("kind"))


@query(
    rf"WITH {LINES_SQL}, m AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM lines WHERE length(line) <= 20), z AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY 1) "
    "SELECT doc_id, line AS title, CAST(line_no AS BIGINT) AS line_start, CAST(coalesce(nx - 1, last) AS BIGINT) AS line_end FROM m JOIN z USING (doc_id)"
)
def heading_spans(spark, sf):
    s = S.spans(S.lines(_docs(spark, sf)), F.length("line") <= 20)
    return s.select("doc_id", "title", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(
    rf"WITH {LINES_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^Definition([^\w]|$)') THEN 'definition' WHEN regexp_matches(line, '(?i)^(Theorem|Lemma)([^\w]|$)') THEN 'theorem' WHEN regexp_matches(line, '(?i)^Example([^\w]|$)') THEN 'example' WHEN regexp_matches(line, '(?i)^Proof([^\w]|$)') THEN 'proof' WHEN regexp_matches(line, '(?i)^Exercises?([^\w]|$)') THEN 'exercise' WHEN regexp_matches(line, '(?i)^Summary([^\w]|$)') THEN 'summary' END AS opener, "
    r"regexp_matches(line, '(\$.*?\$|\\frac|\\sum|\\int|[=<>≤≥≈≠]|∫|∑|√|lim)') AS f FROM lines), "
    "b AS (SELECT *, sum(CASE WHEN opener IS NOT NULL OR line_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM k) "
    "SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, coalesce(max(opener), CASE WHEN bool_or(f) THEN 'formula' ELSE 'explanation' END) AS content_type, CAST(min(line_no) AS BIGINT) AS line_start, count(*) AS n_lines FROM b GROUP BY doc_id, block_no"
)
def typed_block_runs(spark, sf):
    return S.typed_blocks(S.lines(_docs(spark, sf)))


@query(
    "WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(text) - 900) / 780.0) AS BIGINT) END)) AS chunk_no FROM documents WHERE length(text) > 0) "
    r"SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, md5(substr(text, chunk_no * 780 + 1, 900)) AS h FROM w WHERE length(regexp_replace(substr(text, chunk_no * 780 + 1, 900), '^\s+|\s+$', '', 'g')) >= 10"
)
def chunk_fixed(spark, sf):
    return S.fixed_windows(_docs(spark, sf)).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("h"))


@query(
    "WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS chunk_no FROM documents WHERE length(text) > 0) "
    r"SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, length(substr(text, chunk_no * 800 + 1, 800)) AS n FROM w WHERE length(regexp_replace(substr(text, chunk_no * 800 + 1, 800), '^\s+|\s+$', '', 'g')) >= 1"
)
def chunk_800(spark, sf):
    return S.plain_windows(_docs(spark, sf)).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n"))


@query()
def chunk_structured(spark, sf):
    return S.structured_chunks(_docs(spark, sf))


@query("WITH m AS (SELECT CAST(ts AS DATE) AS d, min(event_id) AS marker FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id, m.marker FROM events e ASOF LEFT JOIN m ON CAST(e.ts AS DATE) >= m.d")
def chapter_asof(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "event_type")
    m = e.where("event_type = 'signup'").groupBy(F.col("day").alias("d")).agg(F.min("event_id").alias("marker"))  # one row a day
    return S.as_of(e, m, "day", "d", "marker").select("event_id", "marker")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS opened_by FROM events")
def forward_fill(spark, sf):
    e = _t(spark, sf, "events").withColumn("opened_by", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.carried_forward(e, "opened_by", ["user_id"], ["ts", "event_id"]).select("event_id", F.coalesce("opened_by", F.lit(-1)).alias("opened_by"))


@query("SELECT conv_id, turn, count(*) OVER w AS n, sum(length(text)) OVER w AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def neighbour_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 2)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"), F.sum(F.length("text")).over(w).cast("long").alias("chars"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role FROM s WHERE n <= 5")
def history_last5(spark, sf):
    return A.latest(_t(spark, sf, "conversations"), "conv_id", [F.col("turn").desc()], 5).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'assistant') AS answers, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_history(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn"))


# --- dashboards ---
ACC = "coalesce(CAST(round(CAST(100.0 * {c} / nullif({t}, 0) AS DECIMAL(20,6)), 1) AS DOUBLE), 0)"


@query(f"WITH {ANSWERS_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, {ACC.format(c='count(*) FILTER (is_correct)', t='count(*)')} AS accuracy FROM a GROUP BY 1")
def student_overview(spark, sf):
    return A.answer_overview(_answers(spark, sf), "user_id")


@query(f"WITH {ANSWERS_SQL} SELECT user_id, coalesce(nullif(error_type, ''), '未分类') AS error_type, count(*) AS n FROM a WHERE NOT is_correct AND NOT mastered GROUP BY ALL")
def error_distribution(spark, sf):
    return A.error_histogram(_answers(spark, sf).where("NOT is_correct AND NOT mastered"), ["user_id"])


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM a) SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(seconds) AS BIGINT) AS seconds FROM n WHERE n <= 30 GROUP BY ALL")
def daily_seconds(spark, sf):
    return A.daily_seconds(_answers(spark, sf), "user_id").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM a WHERE NOT is_correct AND NOT mastered) SELECT user_id, event_id FROM n WHERE n <= 10")
def recent_mistakes(spark, sf):
    return A.latest(_answers(spark, sf).where("NOT is_correct AND NOT mastered"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 10).select("user_id", "event_id")


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM a) SELECT user_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, {ACC.format(c='count(*) FILTER (is_correct)', t='count(*)')} AS accuracy FROM n WHERE n <= 200 GROUP BY 1")
def learner_record_latest200(spark, sf):
    return A.answer_overview(A.latest(_answers(spark, sf), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 200), "user_id")


@query(
    f"WITH {ANSWERS_SQL}, s AS (SELECT user_id, count(*) AS total, {ACC.format(c='count(*) FILTER (is_correct)', t='count(*)')} AS acc, count(*) FILTER (NOT is_correct AND NOT mastered) AS un, count(*) FILTER (NOT is_correct AND mastered) AS ma FROM a GROUP BY 1) "
    "SELECT user_id, greatest(0, least(100, acc)) AS accuracy_score, CAST(greatest(0, least(100, 100 - 8 * un)) AS DOUBLE) AS mistake_score, greatest(0, least(100, acc - 3 * un + 15)) AS stability_score, CAST(greatest(0, least(100, 20 * ma)) AS DOUBLE) AS review_score, CASE WHEN total > 0 THEN CAST(65 AS DOUBLE) ELSE CAST(30 AS DOUBLE) END AS activity_score FROM s"
)
def radar_scores(spark, sf):
    a = _answers(spark, sf)
    right = F.count_if("is_correct")
    s = a.groupBy("user_id").agg(F.count("*").alias("total"), A.rounded_share(right, F.count("*")).alias("accuracy"), F.count_if(~F.col("is_correct") & ~F.col("mastered")).alias("unmastered"), F.count_if(~F.col("is_correct") & F.col("mastered")).alias("mastered"))
    return A.radar(s)


@query(
    f"WITH {ANSWERS_SQL}, h AS (SELECT user_id, coalesce(nullif(error_type, ''), '未分类') AS error_type, count(*) AS n FROM a WHERE NOT is_correct GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, error_type) AS rank FROM h) "
    "SELECT user_id, error_type, n, CAST(rank AS INTEGER) AS rank, CAST(greatest(15, least(75, 70 - 12 * n)) AS BIGINT) AS mastery FROM k WHERE rank <= 5"
)
def weak_point_mastery(spark, sf):
    return A.weak_points(A.error_histogram(_answers(spark, sf).where("NOT is_correct"), ["user_id"]), "user_id")


@query(f"SELECT p_brand AS course, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS correct, {ACC.format(c=chr(99) + 'ount(*) FILTER (l_returnflag <> ' + chr(39) + 'R' + chr(39) + ')', t='count(*)')} AS accuracy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def teacher_overview(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_partkey", (F.col("l_returnflag") != "R").alias("is_correct"))
    per = li.groupBy("l_partkey").agg(F.count("*").alias("t"), F.count_if("is_correct").alias("c"))  # fewer rows reach the join
    p = per.join(_t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return p.groupBy(F.col("p_brand").alias("course")).agg(F.sum("t").alias("total"), F.sum("c").alias("correct"), A.rounded_share(F.sum("c"), F.sum("t")).alias("accuracy"))


@query("WITH w AS (SELECT l_partkey, count(*) AS wrong FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY wrong DESC, l_partkey LIMIT 10) SELECT l_partkey, wrong, substr(p_name, 1, 80) AS stem FROM w JOIN part ON l_partkey = p_partkey")
def hard_exercises(spark, sf):
    a = _t(spark, sf, "lineitem").select("l_partkey", (F.col("l_returnflag") != "R").alias("is_correct"))
    return A.hardest(a, _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_name", 1, 80).alias("stem")), "l_partkey")


@query(
    "WITH c AS (SELECT c_nationkey, count(*) AS chapters FROM customer GROUP BY 1), k AS (SELECT c_nationkey, count(*) AS kps, count(DISTINCT o_custkey) AS documents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) "
    "SELECT n_name AS course, coalesce(chapters, 0) AS chapters, coalesce(kps, 0) AS kps, coalesce(documents, 0) AS documents FROM nation LEFT JOIN c ON n_nationkey = c.c_nationkey LEFT JOIN k ON n_nationkey = k.c_nationkey"
)
def course_listing(spark, sf):
    cu = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(cu, F.col("o_custkey") == F.col("c_custkey"))
    k = per.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("n").alias("kps"), F.count("*").alias("documents"))
    c = cu.groupBy("c_nationkey").agg(F.count("*").alias("chapters"))
    out = _t(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(k, F.col("n_nationkey") == F.col("k"), "left")
    return out.select(F.col("n_name").alias("course"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("chapters", "kps", "documents")])


@query("SELECT o_orderkey AS mistake_id, coalesce(substr(c_name, 1, 100), '') AS stem FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def mistake_book(spark, sf):
    top = _t(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100)
    return top.join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("mistake_id"), F.coalesce(F.substring("c_name", 1, 100), F.lit("")).alias("stem"))


@query(
    "SELECT source AS document_id, count(*) AS fragments, count(*) FILTER (quality = 1) AS success, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality IS NULL) AS unrated, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(round(CAST(avg(n_chars) AS DECIMAL(30,12)), 6) AS DOUBLE) AS avg_chars, count(*) = count(quality) AS index_success FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"
)
def parse_report(spark, sf):
    d = _docs(spark, sf).select("doc_id", "source", "n_chars").join(_t(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.col("source").alias("document_id")).agg(
        F.count("*").alias("fragments"), F.count_if(F.col("quality") == 1).alias("success"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("quality").isNull()).alias("unrated"),
        F.sum("n_chars").alias("chars"), r(F.avg("n_chars")).alias("avg_chars"), (F.count("*") == F.count("quality")).alias("index_success"),
    )


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_documents_anti(spark, sf):
    return _docs(spark, sf).select("doc_id").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def upsert_latest(spark, sf):
    return A.upserted(_t(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


# --- review, grading, routing ---
DIFF = "CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size >= 40 THEN 'hard' ELSE 'medium' END"


@query(f"WITH q AS (SELECT p_brand, {DIFF} AS d FROM part) SELECT p_brand, count(*) AS n, count(*) FILTER (d = 'easy') AS easy, count(*) FILTER (d = 'hard') AS hard, count(*) >= 3 AND (count(*) FILTER (d = 'easy') > 0.8 * count(*) OR count(*) FILTER (d = 'hard') > 0.8 * count(*)) AS issue FROM q GROUP BY 1")
def difficulty_mix(spark, sf):
    d = F.when(F.col("p_size") <= 15, "easy").when(F.col("p_size") >= 40, "hard").otherwise("medium")
    return KN.difficulty_mix(_t(spark, sf, "part").select("p_brand", d.alias("difficulty")), "p_brand")


@query("WITH n AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part) SELECT p_brand, p_partkey, CAST(nth AS INTEGER) AS nth FROM n WHERE nth > 1")
def duplicate_stems(spark, sf):
    return KN.repeated_stems(_t(spark, sf, "part"), "p_brand", "p_type", "p_partkey").select("p_brand", "p_partkey", "nth")


@query("WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey, CAST(total AS DOUBLE) AS total, abs(total - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.1 AS ok FROM s JOIN orders ON l_orderkey = o_orderkey")
def exam_total_check(spark, sf):
    s = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    j = s.join(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_orderkey", F.col("total").cast("double").alias("total"), (F.abs(F.col("total") - F.col("o_totalprice").cast("decimal(18,2)")) <= F.lit(0.1).cast("decimal(18,2)")).alias("ok"))


@query("SELECT p_partkey, CAST(greatest(0, least(100, p_size * 2 + CASE WHEN p_partkey % 3 > 0 THEN 10 ELSE -15 END - 20 * (p_partkey % 2) - 5 * (p_partkey % 7))) AS BIGINT) AS credibility FROM part")
def credibility(spark, sf):
    k = F.col("p_partkey")
    return _t(spark, sf, "part").select("p_partkey", KN.credibility(F.col("p_size") * 2, k % 3, k % 2, k % 7).cast("long").alias("credibility"))


@query(
    r"WITH q AS (SELECT item_id, text AS answer, substr(text, 1, 40) AS given, CASE WHEN item_id % 2 = 0 THEN '选择题' ELSE '综合题' END AS kind FROM benchmark), n AS (SELECT item_id, kind, regexp_replace(lower(answer), '\s+', '', 'g') AS a, regexp_replace(lower(CASE WHEN item_id % 3 = 0 THEN answer ELSE given END), '\s+', '', 'g') AS s FROM q), "
    "g AS (SELECT item_id, CASE WHEN kind = '选择题' THEN s = a ELSE length(s) >= 8 AND (len(list_filter(string_split(a, ',')[1:4], lambda k: length(k) >= 2 AND contains(s, k))) > 0 OR length(s) >= 18) END AS is_correct FROM n) SELECT item_id, is_correct, CASE WHEN is_correct THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM g"
)
def grade_answers(spark, sf):
    b = _t(spark, sf, "benchmark")
    given = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, 40))
    q = b.select("item_id", F.col("text").alias("answer"), given.alias("student_answer"), F.when(F.col("item_id") % 2 == 0, "选择题").otherwise("综合题").alias("question_type"))
    return KN.graded(q).select("item_id", "is_correct", "score")


@query("SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'exam' WHEN 1 THEN 'ppt' WHEN 2 THEN 'homework_tutor' WHEN 3 THEN 'student_profile' ELSE 'learning_package' END AS intent FROM conversations")
def intent_route(spark, sf):
    """Questions that name their task in other ways: an exam by two of its words, slides in capitals, nothing at all."""
    said = F.get(F.array(*[F.lit(x) for x in ("帮我组卷，要考试用的习题", "请做 PPT 课件", "作业答疑", "看看学习情况和学习报告", "你好")]), F.pmod("conv_id", F.lit(5)).cast("int"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", KN.intent(said).alias("intent"))


@query("SELECT event_type AS action, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_actions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("WITH k AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_brand FROM part) SELECT p_partkey, p_brand, CAST(i % 5 AS INTEGER) AS slot FROM k")
def round_robin_assign(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return _t(spark, sf, "part").select("p_partkey", "p_brand", F.pmod(F.row_number().over(w) - 1, F.lit(5)).alias("slot"))


@query("SELECT p_partkey, greatest(1, p_size % 7) AS days, greatest(1, p_size % 7) * 30 AS total_minutes FROM part")
def study_plan_fallback(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.greatest(F.lit(1), F.col("p_size") % 7).cast("int").alias("days"), F.lit(30).alias("daily_minutes"), F.split("p_name", " ").alias("points"))
    return KN.plan_errors(KN.study_plan(p)).where(F.size("errors") == 0).select("p_partkey", "days", "total_minutes")


@query("SELECT p_partkey, greatest(p_size * 10 - 60, 30) AS core_seconds FROM part")
def micro_lesson_fallback(spark, sf):
    p = P.micro_lessons(_t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).alias("duration")))
    return p.select("p_partkey", F.col("sections")[1]["seconds"].alias("core_seconds"))


@query("SELECT p_partkey, CAST(p_size % 5 + 1 AS BIGINT) AS n, 'Q00' || CAST(p_size % 5 + 1 AS VARCHAR) AS last_id, CAST(round(CAST(100.0 / (p_size % 5 + 1) AS DECIMAL(20,6)), 2) AS DOUBLE) AS score FROM part")
def exam_paper_fallback(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.split("p_name", " ").alias("points"), (F.col("p_size") % 5 + 1).cast("int").alias("n"), F.lit(100.0).alias("total_score"))
    q = F.element_at("questions", -1)
    return P.exam_papers(p).select(F.col("paper_id").alias("p_partkey"), F.size("questions").cast("long").alias("n"), q["question_id"].alias("last_id"), q["score"].alias("score"))


@query(
    r"WITH p AS (SELECT source, doc_id, doc_id % 3 > 0 AS img, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE 1.0 - CAST(length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}A-Za-z0-9=+\-*/^<>≤≥≈≠∫∑∏√∞]', '', 'g')) AS DOUBLE) / length(text) END >= 0.35 AS bad FROM documents), "
    "q AS (SELECT *, (n = 0 AND img) OR (bad AND (img OR n >= 20)) OR n = 0 OR bad OR (img AND n < 20) AS need FROM p), r AS (SELECT *, sum(CASE WHEN need THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM q) "
    "SELECT source AS document_id, doc_id AS ord FROM r WHERE need AND nth <= 5"
)
def ocr_budget(spark, sf):
    d = _docs(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % 3).cast("int").alias("image_count"), F.lit(0.0).alias("image_coverage"))
    return P.ocr_budget(d, 5).where("do_ocr").select("document_id", "ord")


@query("SELECT item_id, trim(CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE trim(text) || '？' END) || CASE WHEN contains(text, 'the') THEN '' ELSE ' the' END || CASE WHEN contains(text, 'Xyz') THEN '' ELSE ' Xyz' END AS q FROM benchmark")
def query_rewrite(spark, sf):
    """An opening, a reference word and question marks go (one mark of two stays); the point and the chapter are added where they lack."""
    t = F.trim("text")
    asked = F.concat(F.lit("请问 "), t, F.lit("这个"), F.when(F.col("item_id") % 2 == 0, "吗").otherwise("？？"))
    return _t(spark, sf, "benchmark").select("item_id", P.rewritten(asked, F.lit("the"), F.lit("Xyz"), F.lit("")).alias("q"))


@query("SELECT event_type, count(*) AS n, CASE event_type WHEN 'error' THEN '解析失败' WHEN 'view' THEN 'OCR 识别中' WHEN 'click' THEN '索引完成' ELSE event_type END AS label FROM events GROUP BY 1")
def status_labels(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "ocr_processing").when(F.col("event_type") == "click", "indexed").otherwise(F.col("event_type"))
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.first(T.labelled(status, T.STATUS_LABELS)).alias("label"))


# --- a textbook made of the part table: headings, definitions, theorems, examples, exercises, sentences, remarks ---
def _book(spark, sf) -> DataFrame:
    """``course_id, document_id, page_no, text``: a document per brand, a page per 400 part keys."""
    k, name, kind, size = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    line = (
        F.when(k % 12 == 0, say("第", size, "章 ", name)).when(k % 12 == 1, say(size, ".", (k % 9 + 1).cast("string"), " ", kind, " ", name)).when(k % 12 == 2, say("定义：", kind, "是指", name, "部件"))
        .when(k % 12 == 3, say("定理 ", kind, name)).when(k % 12 == 4, say("例1 ", name, " = ", size)).when(k % 12 == 5, say("习题 计算 ", kind, name)).when(k % 12 == 6, say(kind, "是", name, "的一种"))
        .when(k % 12 == 7, say("注意 ", name)).otherwise(say(name, "，", kind, "。"))
    )
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.floor(k / 400).cast("int").alias("page_no"), F.struct(k.alias("k"), line.alias("line")).alias("l"))
    page = rows.groupBy("document_id", "page_no").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return page.select(F.col("document_id").alias("course_id"), "document_id", "page_no", F.array_join(F.col("l.line"), "\n").alias("text"))


BOOK_SQL = """bl AS (SELECT p_brand AS document_id, CAST(p_partkey // 400 AS INTEGER) AS page_no, p_partkey AS pk, p_partkey % 12 AS k, p_name, p_type, p_size,
  CASE p_partkey % 12 WHEN 0 THEN '第' || p_size || '章 ' || p_name WHEN 1 THEN p_size || '.' || (p_partkey % 9 + 1) || ' ' || p_type || ' ' || p_name WHEN 2 THEN '定义：' || p_type || '是指' || p_name || '部件'
    WHEN 3 THEN '定理 ' || p_type || p_name WHEN 4 THEN '例1 ' || p_name || ' = ' || p_size WHEN 5 THEN '习题 计算 ' || p_type || p_name WHEN 6 THEN p_type || '是' || p_name || '的一种' WHEN 7 THEN '注意 ' || p_name
    ELSE p_name || '，' || p_type || '。' END AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line_no FROM part),
o1 AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pk) AS c0, last_value(CASE WHEN k = 0 THEN line END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pk) AS cn FROM bl),
o2 AS (SELECT *, max(c0) OVER (PARTITION BY document_id) AS cm FROM o1),
o3 AS (SELECT * EXCLUDE (c0, cn, cm), greatest(c0, 1) AS chapter_no, coalesce(cn, '正文') AS chapter_name FROM o2 WHERE c0 > 0 OR cm = 0),
o4 AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, chapter_no ORDER BY pk) AS s0, last_value(CASE WHEN k = 1 THEN line END IGNORE NULLS) OVER (PARTITION BY document_id, chapter_no ORDER BY pk) AS sn,
  min(line_no) OVER (PARTITION BY document_id, chapter_no) AS first_line FROM o3),
ol AS (SELECT *, max(s0) OVER (PARTITION BY document_id, chapter_no) AS sm FROM o4),
ch AS (SELECT document_id, 'chapter_' || lpad(CAST(chapter_no AS VARCHAR), 3, '0') AS chapter_id, chapter_no, chapter_name, min(page_no) AS page_start, max(page_no) AS page_end, CAST(min(line_no) AS BIGINT) AS line_start, CAST(max(line_no) AS BIGINT) AS line_end,
  string_agg(line, chr(10) ORDER BY pk) AS text, CAST(greatest(max(sm), 1) AS BIGINT) AS section_count FROM ol GROUP BY document_id, chapter_no, chapter_name)"""


@query(f"WITH {BOOK_SQL} SELECT document_id, page_no, CAST(line_no AS BIGINT) AS line_no, line FROM bl")
def book_lines(spark, sf):
    return S.page_lines(_book(spark, sf))


def _outline(spark, sf) -> DataFrame:
    return S.outlined(S.page_lines(_book(spark, sf)))


@query(f"WITH {BOOK_SQL} SELECT document_id, chapter_id, chapter_name, page_start, page_end, line_start, line_end, md5(text) AS h, section_count FROM ch")
def detect_chapters(spark, sf):
    return S.chapters(_outline(spark, sf)).withColumn("h", F.md5("text")).drop("text", "chapter_no")


SECTIONS_SQL = """se AS (SELECT document_id, chapter_no, chapter_name, greatest(s0, 1) AS section_no, coalesce(sn, '正文') AS section_name, CAST(min(line_no) - min(first_line) AS BIGINT) AS line_start, CAST(max(line_no) - min(first_line) AS BIGINT) AS line_end,
  string_agg(line, chr(10) ORDER BY pk) AS text FROM ol WHERE s0 > 0 OR sm = 0 GROUP BY ALL)"""


@query(f"WITH {BOOK_SQL}, {SECTIONS_SQL} SELECT document_id, 'chapter_' || lpad(CAST(chapter_no AS VARCHAR), 3, '0') AS chapter_id, chapter_name, 'section_' || lpad(CAST(section_no AS VARCHAR), 3, '0') AS section_id, section_name, line_start, line_end, md5(text) AS h FROM se")
def detect_sections(spark, sf):
    return S.sections(_outline(spark, sf)).withColumn("h", F.md5("text")).drop("text")


@query(f"WITH {BOOK_SQL} SELECT document_id, count(*) AS chapter_count, CAST(sum(section_count) AS BIGINT) AS section_count, list(chapter_name ORDER BY chapter_id) AS names FROM ch GROUP BY 1")
def course_outline(spark, sf):
    return S.course_outline(_outline(spark, sf)).select("document_id", "chapter_count", "section_count", F.col("chapters.chapter_name").alias("names"))


CHUNK_SQL = """pg AS (SELECT document_id, page_no, arg_min(k, pk) AS k0, arg_min(line, pk) AS l0, arg_max(line, pk) FILTER (k = 0) AS own, arg_max(line, pk) FILTER (k < 2) AS head, count(*) FILTER (k = 0) AS heads, length(string_agg(line, chr(10) ORDER BY pk)) + 2 AS size FROM bl GROUP BY 1, 2),
ps AS (SELECT document_id, page_no, coalesce(last_value(CASE WHEN k0 = 0 THEN l0 ELSE own END IGNORE NULLS) OVER w, '正文') AS chapter_name, coalesce(last_value(CASE WHEN k0 < 2 THEN l0 ELSE head END IGNORE NULLS) OVER w, '正文') AS section_name,
  'chapter_' || lpad(CAST(sum(heads + CASE WHEN k0 = 0 AND l0 <> own THEN 1 ELSE 0 END) OVER w AS VARCHAR), 3, '0') AS chapter_id, sum(size) OVER w - size AS base FROM pg WINDOW w AS (PARTITION BY document_id ORDER BY page_no)),
b1 AS (SELECT *, sum(CASE WHEN k IN (2, 3, 4, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_no ORDER BY pk) AS b FROM bl),
ck AS (SELECT document_id, page_no, b, CASE WHEN b = 0 THEN 'explanation' ELSE ['definition', 'theorem', 'example', 'exercise'][CAST(arg_min(k, pk) - 1 AS INTEGER)] END AS content_type, string_agg(line, chr(10) ORDER BY pk) AS text FROM b1 GROUP BY 1, 2, 3),
chk AS (SELECT ck.*, chapter_id, chapter_name, section_name, CAST(base AS BIGINT) AS start_offset, CAST(base + length(text) AS BIGINT) AS end_offset, row_number() OVER (PARTITION BY document_id ORDER BY page_no, b) - 1 AS chunk_index FROM ck JOIN ps USING (document_id, page_no))"""


@query(
    f"WITH {BOOK_SQL}, {CHUNK_SQL} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, page_no, chapter_id, chapter_name, section_name, content_type, start_offset, end_offset, length(text) AS char_count, "
    "'chunk_' || substr(md5(document_id || ':' || document_id || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 16) AS chunk_id, content_type = 'example' AS has_example, content_type = 'exercise' AS has_exercise FROM chk"
)
def page_chunks(spark, sf):
    return S.page_chunks(_book(spark, sf)).select("document_id", "chunk_index", "page_no", "chapter_id", "chapter_name", "section_name", "content_type", "start_offset", "end_offset", "char_count", "chunk_id", "has_example", "has_exercise")


@query()
def section_chunks(spark, sf):
    return S.section_chunks(_outline(spark, sf), F.col("document_id")).select("document_id", "chunk_index", "chapter_id", "section_name", "content_type", "chunk_id", "char_count")


def _points(spark, sf) -> DataFrame:
    chapters = written(S.chapters(_outline(spark, sf)).select(F.concat_ws("/", "document_id", F.col("chapter_no").cast("string")).alias("key"), F.col("document_id").alias("course_id"), "chapter_id", "chapter_no", "chapter_name", "text"))
    p = KN.knowledge_points(chapters.select("key", "text"), "key").join(chapters.drop("text"), "key")
    order = F.struct("chapter_no", "place")
    return p.withColumn("ord", F.row_number().over(Window.partitionBy("course_id").orderBy(order)).cast("long"))


POINTS_SQL = """k1 AS (SELECT document_id, chapter_no, chapter_name, 0 AS pass, pk, p_type || ' ' || p_name AS name, 'section_heading' AS source, '' AS definition FROM ol WHERE k = 1),
k2 AS (SELECT document_id, chapter_no, chapter_name, 1 AS pass, pk, p_type AS name, 'definition' AS source, p_type || '是指' || p_name || '部件' AS definition FROM ol WHERE k = 2),
k3 AS (SELECT document_id, chapter_no, chapter_name, 2 AS pass, pk, p_type AS name, 'sentence' AS source, p_type || '是' || p_name || '的一种' AS definition FROM ol WHERE k = 6),
k4 AS (SELECT *, row_number() OVER (PARTITION BY document_id, chapter_no, name ORDER BY pass, pk) AS n FROM (FROM k2 UNION ALL FROM k3)),
kp AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chapter_no, pass, pk) AS ord, 'kp_' || substr(md5(CASE source WHEN 'section_heading' THEN name WHEN 'definition' THEN name || definition ELSE definition END), 1, 12) AS kp_id FROM (FROM k1 UNION ALL SELECT * EXCLUDE (n) FROM k4 WHERE n = 1))"""


@query(f"WITH {BOOK_SQL}, {POINTS_SQL} SELECT document_id AS course_id, chapter_name, CAST(ord AS BIGINT) AS ord, kp_id, name, source, definition FROM kp")
def kp_extract(spark, sf):
    return _points(spark, sf).select("course_id", "chapter_name", "ord", "kp_id", "name", "source", "definition")


def _graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = written(S.page_chunks(_book(spark, sf)).withColumn("ord", F.col("chunk_index")))
    p = written(_points(spark, sf))
    return KN.graph_nodes(f, p), f, p


GRAPH_SQL = BOOK_SQL + ", " + CHUNK_SQL + ", " + POINTS_SQL + r""",
fo AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY j) AS nth FROM (SELECT document_id, chunk_index, chapter_name, unnest(fl) AS f, generate_subscripts(fl, 1) AS j FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9_\x{4e00}-\x{9fff}]+ = [^，。；;\n]{1,120}') AS fl FROM chk))),
n0 AS (SELECT document_id AS course_id, 0 AS rd, chunk_index AS o, 0 AS kk, 'chapter' AS node_type, chapter_id AS node_id, chapter_name AS name, chapter_name AS chapter, '' AS summary, CAST(0.95 AS DOUBLE) AS confidence FROM chk
  UNION ALL SELECT document_id, 0, chunk_index, nth, 'formula', 'formula_' || substr(md5(f), 1, 12), substr(f, 1, 60), chapter_name, f, CAST(0.8 AS DOUBLE) FROM fo WHERE nth <= 3
  UNION ALL SELECT document_id, 0, chunk_index, 10 + i, t, t || '_' || substr(md5(cid || '|' || substr(text, 1, 80)), 1, 12), CASE WHEN length(sm) > 40 THEN substr(sm, 1, 40) || '...' ELSE sm END, chapter_name, CASE WHEN length(sm) > 120 THEN substr(sm, 1, 120) || '...' ELSE sm END, CASE WHEN t = 'mistake' THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END
    FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS sm, 'chunk_' || substr(md5(document_id || ':' || document_id || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 16) AS cid FROM chk), (VALUES (1, 'example'), (2, 'exercise'), (3, 'mistake')) AS v(i, t) WHERE content_type = t OR t = 'mistake' AND contains(text, '注意')
  UNION ALL SELECT document_id, 1, ord, 0, 'knowledge_point', kp_id, name, chapter_name, CASE WHEN definition = '' THEN name ELSE definition END, CAST(0.72 AS DOUBLE) FROM kp),
nd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, node_id ORDER BY rd, o, kk) AS w FROM n0) WHERE w = 1)"""


@query(f"WITH {GRAPH_SQL} SELECT course_id, node_id, node_type, name, chapter, summary, confidence FROM nd")
def graph_nodes(spark, sf):
    return _graph(spark, sf)[0].drop("place")


@query(
    f"WITH {GRAPH_SQL}, "
    "cn AS (SELECT course_id, name AS chapter_name, arg_max(node_id, (rd, o, kk)) AS node FROM nd WHERE node_type = 'chapter' GROUP BY 1, 2), "
    "e AS (SELECT document_id AS course_id, kp_id AS source, node AS target, 'belongs_to' AS relation, CAST(1 AS DOUBLE) AS weight FROM kp JOIN cn ON kp.document_id = cn.course_id AND kp.chapter_name = cn.chapter_name "
    "UNION ALL SELECT nd.course_id, node, node_id, CASE node_type WHEN 'formula' THEN 'formula_for' WHEN 'example' THEN 'example_of' WHEN 'exercise' THEN 'used_in' ELSE 'confusable_with' END, CAST(0.8 AS DOUBLE) FROM nd JOIN cn ON nd.course_id = cn.course_id AND nd.chapter = cn.chapter_name WHERE node_type IN ('formula', 'example', 'exercise', 'mistake') "
    "UNION ALL SELECT course_id, node_id, lead(node_id) OVER (PARTITION BY course_id ORDER BY rd, o, kk), 'prerequisite', CAST(0.45 AS DOUBLE) FROM nd WHERE node_type = 'chapter') "
    "SELECT DISTINCT course_id, source, target, relation, weight FROM e WHERE target IS NOT NULL AND source <> target"
)
def graph_edges(spark, sf):
    """Without the edges between similar names, which SQL can't score."""
    n, f, p = _graph(spark, sf)
    return KN.graph_edges(n, f, p).where("relation <> 'same_level'")


@query()
def similar_points(spark, sf):
    n = _graph(spark, sf)[0].where("node_type = 'knowledge_point'")
    return KN.similar_names(n.select(F.col("course_id").alias("per"), F.col("node_id").alias("id"), "name"))


@query(f"WITH {BOOK_SQL}, t AS (SELECT DISTINCT document_id, p_name AS term FROM bl WHERE k = 4), h AS (SELECT t.document_id, term, line_no, line FROM t JOIN bl USING (document_id) WHERE contains(line, term)) SELECT document_id, term, CAST(min(line_no) AS BIGINT) AS line_no, arg_min(line, line_no) AS line FROM h GROUP BY 1, 2")
def term_first_line(spark, sf):
    terms = _t(spark, sf, "part").where("p_partkey % 12 = 4").select(F.col("p_brand").alias("document_id"), F.col("p_name").alias("term")).distinct()
    rows = S.page_lines(_book(spark, sf)).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    found = S.first_occurrence(terms, rows.select("document_id", F.col("l.line").alias("lines")))
    return found.select("document_id", "term", F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    f"WITH {BOOK_SQL}, pg AS (SELECT document_id, page_no, string_agg(line, chr(10) ORDER BY pk) AS text FROM bl GROUP BY ALL), "
    "h AS (SELECT pg.document_id, page_no, strpos(pg.text, chapter_name) AS pos, CAST(chapter_no AS INTEGER) AS chapter, pg.text FROM pg JOIN ch ON ch.document_id = pg.document_id AND page_start = page_no WHERE strpos(pg.text, chapter_name) > 0), "
    "e AS (SELECT *, lead(pos) OVER w AS nxt, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY document_id, page_no ORDER BY pos, chapter)), "
    "sp AS (SELECT document_id, page_no, n, chapter, trim(substr(text, pos, coalesce(nxt, length(text) + 1) - pos), chr(10) || ' ') AS text FROM e "
    "UNION ALL SELECT document_id, page_no, 0, greatest(0, chapter - 1), trim(substr(text, 1, pos - 1), chr(10) || ' ') FROM e WHERE n = 1 AND length(trim(substr(text, 1, pos - 1), chr(10) || ' ')) >= 40), "
    "al AS (SELECT * FROM sp WHERE text <> '' UNION ALL SELECT document_id, page_no, 1, coalesce((SELECT max(CAST(chapter_no AS INTEGER)) FROM ch WHERE ch.document_id = pg.document_id AND page_start > 0 AND page_start <= page_no), 0), text FROM pg "
    "WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.document_id = pg.document_id AND h.page_no = pg.page_no)) "
    "SELECT document_id, page_no, CAST(row_number() OVER (PARTITION BY document_id, page_no ORDER BY n) - 1 AS INTEGER) AS span_no, chapter AS chapter_index, md5(text) AS h FROM al"
)
def page_spans(spark, sf):
    names = S.chapters(_outline(spark, sf)).select("document_id", F.col("chapter_no").cast("int").alias("chapter_index"), F.col("chapter_name").alias("name"), "page_start")
    return S.name_spans(_book(spark, sf), names).select("document_id", "page_no", "span_no", "chapter_index", F.md5("text").alias("h"))


def _book_fragments(spark, sf) -> DataFrame:
    c = S.page_chunks(_book(spark, sf))
    return c.select(F.lit("book").alias("course_id"), "document_id", F.concat_ws("/", "document_id", "chunk_id").alias("chunk_id"), "chapter_name", "section_name", F.col("content_type").alias("chunk_type"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "text", "tags", F.col("tags").alias("knowledge_points"), "has_formula", "has_example", "has_exercise", F.lit(False).alias("is_ocr"), F.lit(1.0).alias("source_quality_score"))


@query(f"WITH {BOOK_SQL}, {CHUNK_SQL} SELECT document_id, count(*) AS n FROM chk WHERE content_type = 'example' GROUP BY 1")
def post_filter_flags(spark, sf):
    f = R.post_filtered(_book_fragments(spark, sf), {"has_example": True, "has_exercise": False, "exclude_low_quality_ocr": True})
    return f.groupBy("document_id").agg(F.count("*").alias("n"))


@query()
def post_filter_point(spark, sf):
    return R.post_filtered(_book_fragments(spark, sf), {"knowledge_point": "ECONOMY"}).groupBy("document_id").agg(F.count("*").alias("n"))


KEYWORD_SQL = """ft AS (SELECT document_id || '/' || 'chunk_' || substr(md5(document_id || ':' || document_id || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 16) AS chunk_id, document_id, page_no, chapter_name, section_name, content_type, text,
  regexp_extract_all(lower(chapter_name || ' ' || section_name || ' ' || content_type || ' ' || text), '[a-z0-9_]+') || regexp_extract_all(chapter_name || ' ' || section_name || ' ' || content_type || ' ' || text, '[\\x{4e00}-\\x{9fff}]') AS t1 FROM chk),
fk AS (SELECT *, len(t1) + greatest(len(list_filter(t1, lambda t: regexp_matches(t, '[\\x{4e00}-\\x{9fff}]'))) - 1, 0) AS dl FROM ft),
fs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM fk),
fx AS (SELECT chunk_id, dl, q.t AS term, len(list_filter(t1, lambda t: t = q.t)) AS tf FROM fk, (VALUES ('small'), ('gear')) AS q(t)),
fd AS (SELECT term, count(*) AS df FROM fx WHERE tf > 0 GROUP BY 1),
fb AS (SELECT chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm FROM fx JOIN fd USING (term), fs WHERE tf > 0 GROUP BY 1)"""


@query(
    f"WITH {BOOK_SQL}, {CHUNK_SQL}, {KEYWORD_SQL}, top AS (SELECT chunk_id, text, bm FROM fb JOIN fk USING (chunk_id) ORDER BY bm DESC, chunk_id LIMIT 20) "
    "SELECT chunk_id, CAST(row_number() OVER (ORDER BY bm DESC, chunk_id) AS INTEGER) AS rank, " + R6.format("1 / (1 + bm) + CASE WHEN contains(text, 'small gear') THEN 1 ELSE 0 END + 0.2 * (CASE WHEN contains(text, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'gear') THEN 1 ELSE 0 END)") + " AS keyword_score FROM top"
)
def keyword_search(spark, sf):
    return R.keyword_search(_book_fragments(spark, sf), "book", "small gear").select("chunk_id", "rank", r(F.col("keyword_score")).alias("keyword_score"))


@query()
def retrieve_ladder(spark, sf):
    """A section that no fragment has: the hits of the wider filters, marked."""
    return R.retrieve(_book_fragments(spark, sf), "book", "small gear", section="none").select("rank", "chunk_id", r(F.col("rerank_score")).alias("rerank_score"), "why_matched", "citation")


@query()
def retrieve_context(spark, sf):
    return R.retrieve_for("plan", _book_fragments(spark, sf), "book", "small gear")


# --- reports, generated material and its review ---
@query(
    f"WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM a), u AS (SELECT user_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, {ACC.format(c='count(*) FILTER (is_correct)', t='count(*)')} AS accuracy FROM n WHERE n <= 200 GROUP BY 1), "
    "m AS (SELECT user_id, count(*) FILTER (NOT mastered) AS mistake_count, count(*) FILTER (mastered) AS mastered_count FROM a WHERE NOT is_correct GROUP BY 1), x AS (SELECT user_id, list(action ORDER BY n) AS recent_actions FROM n WHERE n <= 10 GROUP BY 1) "
    "SELECT user_id, total, correct, accuracy, coalesce(mistake_count, 0) AS mistake_count, coalesce(mastered_count, 0) AS mastered_count, recent_actions FROM u JOIN x USING (user_id) LEFT JOIN m USING (user_id)"
)
def learner_record(spark, sf):
    a = _answers(spark, sf)
    return A.learner_record(a, a.where("NOT is_correct"), a)


@query("SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'nation', count(*) FROM nation")
def table_counts(spark, sf):
    return A.table_counts({n: _t(spark, sf, n) for n in ("part", "events", "nation")})


@query(
    f"WITH {BOOK_SQL}, {CHUNK_SQL}, d AS (SELECT document_id, count(*) AS chunk_count, count(*) FILTER (content_type <> 'theorem') AS vector_count FROM chk GROUP BY 1), pt AS (SELECT document_id, page_no, string_agg(line, chr(10) ORDER BY pk) AS text, count(*) FILTER (k = 4) AS ex, count(*) FILTER (k = 5) AS xs FROM bl GROUP BY 1, 2), "
    "pp AS (SELECT document_id, count(*) AS p, count(*) FILTER (page_no % 3 > 0) AS good, count(*) FILTER (page_no % 3 = 0) AS failed, sum(CASE WHEN page_no % 3 > 0 THEN length(text) + 2 ELSE 0 END) - 2 AS chars, sum(CASE WHEN page_no % 3 > 0 THEN ex ELSE 0 END) AS ex FROM pt GROUP BY 1) "
    "SELECT document_id, p AS total_pages, good AS success_pages, failed AS failed_pages, CAST(greatest(chars, 0) AS BIGINT) AS total_chars, CAST(ex AS BIGINT) AS example_count, chunk_count, vector_count, chunk_count = vector_count AS index_success, (SELECT count(*) FROM ch WHERE ch.document_id = pp.document_id) AS chapter_count FROM pp JOIN d USING (document_id)"
)
def document_report(spark, sf):
    """Every third page failed; theorems have no vector."""
    bad = F.col("page_no") % 3 == 0
    pages = _book(spark, sf).select("document_id", "page_no", F.when(~bad, F.col("text")).otherwise("").alias("text"), F.lit("direct").alias("method"), F.lit(False).alias("is_ocr"), F.lit(False).alias("is_scanned"), F.lit(1.0).alias("quality"), F.when(bad, "lost").alias("error"), F.lit(None).cast("string").alias("failure_reason"))
    docs = pages.select("document_id", F.lit("book").alias("course_id"), F.lit(None).cast("long").alias("page_count")).distinct()
    frags = S.page_chunks(_book(spark, sf)).select("document_id", (F.col("content_type") != "theorem").alias("has_vector"))
    rep = A.parse_report(docs, pages, frags, docs.select("document_id").limit(0), S.course_outline(_outline(spark, sf)))
    return rep.select("document_id", "total_pages", "success_pages", "failed_pages", F.col("total_chars").cast("long").alias("total_chars"), "example_count", "chunk_count", "vector_count", "index_success", "chapter_count")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS i, ['multiple_choice', 'fill_in', 'short_answer'][(i - 1) % 3 + 1] AS question_type, string_split(p_name, ' ')[(i - 1) % len(string_split(p_name, ' ')) + 1] AS point, '请围绕“' || string_split(p_name, ' ')[(i - 1) % len(string_split(p_name, ' ')) + 1] || '”完成一道基础练习。' AS stem FROM part, unnest(range(1, p_size % 5 + 2)) AS u(i)")
def exercise_fallback(spark, sf):
    q = _t(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("points"), F.array().cast("array<string>").alias("question_types"), (F.col("p_size") % 5 + 1).alias("n"), F.lit("").alias("chapter"))
    e = G.exercises(q).select("p_partkey", F.posexplode("questions").alias("j", "q"))
    return e.select("p_partkey", (F.col("j") + 1).alias("i"), "q.question_type", F.col("q.knowledge_point").alias("point"), "q.stem")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS slide_number, ['学习目标', '核心概念', '方法步骤', '例题演示', '易错提醒', '课堂练习', '总结'][(i - 1) % 7 + 1] AS slide_title FROM part, unnest(range(1, p_size % 9 + 2)) AS u(i)")
def slide_fallback(spark, sf):
    s = G.slides(_t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 9 + 1).alias("total_slides")))
    return s.select("p_partkey", F.explode("slides").alias("s")).select("p_partkey", "s.slide_number", "s.slide_title")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 AND p_size % 5 > 0 THEN ['clarify'] ELSE list_filter([CASE WHEN p_size % 4 = 0 THEN 'review' WHEN p_size % 4 < 3 THEN 'preview' END, CASE WHEN p_size % 5 = 0 THEN 'practice' END], lambda x: x IS NOT NULL) END AS kinds FROM part")
def learning_actions(spark, sf):
    k, none = F.col("p_size"), F.array().cast("array<string>")
    q = _t(spark, sf, "part").select("p_partkey", F.when(k % 4 == 0, F.split("p_name", " ")).otherwise(none).alias("weak_points"), F.when(k % 4 < 3, F.split("p_name", " ")).otherwise(none).alias("points"), (k % 5 == 0).alias("has_exercises"), F.lit(False).alias("has_diagnosis"))
    return G.learning_actions(q).select("p_partkey", F.col("actions.type").alias("kinds"))


@query("WITH p AS (SELECT p_partkey, p_size % 6 AS s FROM part) SELECT p_partkey, CASE s WHEN 0 THEN ['title', 'daily_tasks', 'total_time_minutes'] WHEN 1 THEN ['_root'] WHEN 2 THEN ['questions'] ELSE [] END AS fields, CASE WHEN s = 1 THEN 1 ELSE 0 END AS critical FROM p")
def completeness_rules(spark, sf):
    k = F.col("p_size") % 6
    doc = F.when(k == 0, '{"references": ["a"]}').when(k == 1, "{broken").when(k == 2, '{"references": ["a"], "questions": []}').otherwise('{"references": ["a"], "questions": [1], "title": "t"}')
    q = _t(spark, sf, "part").select("p_partkey", doc.alias("result"), F.when(k == 0, "study_plan").otherwise("exercise").alias("task_type"))
    c = G.completeness(q).select("p_partkey", F.col("issues.field").alias("fields"), G.severity_counts(F.col("issues"))["critical"].alias("critical"))
    return c.select("p_partkey", "fields", F.col("critical").cast("int").alias("critical"))


@query("SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS total, l_orderkey % 3 = 0 OR l_orderkey % 3 = 1 AS is_valid FROM lineitem GROUP BY 1")
def exam_score_check(spark, sf):
    """A total of 0 stands for the sum; one order in three is off by one."""
    q = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("score"))).alias("questions"), F.sum("l_quantity").cast("double").alias("s"))
    k = F.col("l_orderkey") % 3
    return G.exam_check(q.withColumn("total_score", F.when(k == 0, 0.0).when(k == 1, F.col("s")).otherwise(F.col("s") + 1))).select("l_orderkey", "total", "is_valid")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')")
def course_answers(spark, sf):
    ex = _t(spark, sf, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("exercise_id"))
    return L.answers_of(_t(spark, sf, "lineitem").withColumn("exercise_id", F.col("l_partkey")), ex).select("l_orderkey", "l_linenumber")


@query(f"WITH {BOOK_SQL}, {POINTS_SQL} SELECT ch.document_id AS course_id, ch.chapter_id, ch.chapter_name, (SELECT count(*) FROM kp WHERE kp.document_id = ch.document_id AND kp.chapter_name = ch.chapter_name) AS kp_count FROM ch")
def chapter_point_counts(spark, sf):
    c = S.chapters(_outline(spark, sf)).select(F.col("document_id").alias("course_id"), "chapter_id", "chapter_name")
    return L.chapter_counts(c, _points(spark, sf)).select("course_id", "chapter_id", "chapter_name", "kp_count")


@query("WITH t AS (SELECT doc_id, CASE WHEN source = 'src5' AND lang = 'xx' THEN 0 WHEN source = 'src5' AND lang = 'de' THEN 1 WHEN source = 'src5' THEN 2 END AS tier, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS n FROM documents) SELECT doc_id AS chunk_id, CAST(tier AS INTEGER) AS tier FROM t WHERE n = 1 AND tier = (SELECT min(tier) FROM t)")
def filter_ladder(spark, sf):
    """No fragment is in the first tier; the German ones of the course make the second."""
    mine = F.col("course_id") == "src5"
    return L.laddered(_fragments(spark, sf), [mine & (F.col("lang") == "xx"), mine & (F.col("lang") == "de"), mine], ["course_id", "lang", "text"], ["chunk_id"]).select("chunk_id", "tier")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{}' ELSE '{}' END AS doc, CASE event_id % 3 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no k' END AS warning FROM events")
def required_key(spark, sf):
    e = _t(spark, sf, "events")
    doc = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), F.col("props"))).otherwise('{"other": 1}')
    return L.with_required(e.select("event_id", doc.alias("doc")), "doc", "k", "{}")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def packed_json(spark, sf):
    """The properties as JSON within a JSON string within another."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    packed = quoted(quoted(F.col("props")))
    return _t(spark, sf, "events").select("event_id", F.get_json_object(L.unpacked(packed), "$.k").cast("long").alias("k"))


@query("WITH s AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY text, turn) AS n FROM conversations WHERE conv_id = 3 AND contains(lower(text), 'the')) SELECT text AS concept FROM s WHERE n <= 3")
def session_concepts(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("concept"))
    return L.concepts(c, "3", "The").select("concept")


# --- batch functions: rows only ---
@query()
def nfkc_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(T.normalise_whitespace(batch.nfkc(batch.normalise_math(T.remove_control(F.col("text")))))).alias("n"))


@query()
def fuzzy_match(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", batch.token_set_ratio_udf("p_name", F.lit("red part steel")).alias("score")).where("score >= 40")


@query()
def json_repair(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", batch.repair_json(F.concat(F.lit("Answer: ```json\n"), F.col("props"), F.lit("\n```"))).alias("fixed"))


@query()
def render_markdown(spark, sf):
    return _t(spark, sf, "events").select("event_id", batch.render_markdown("props").alias("markdown"))


# --- analysis of pages ---
ANALYSIS_TERMS = ("STEEL", "BRASS", "red", "gear", "概率", "部件")
ANALYSIS_SQL = r"""n AS (SELECT document_id, page_no, pk, replace(replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '．', '.'), '：', ':') AS line FROM bl),
t AS (SELECT *, trim(regexp_replace(regexp_replace(line, '[.·•…．]{2,}\s*\d+\s*$', ''), '\s+\d{1,4}\s*$', ''), ' -—') AS title, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2, lag(line) OVER w AS l0 FROM n WINDOW w AS (PARTITION BY document_id, page_no ORDER BY pk)),
h AS (SELECT document_id, regexp_replace(title, '\s+', '', 'g') AS key, min(pk) AS pk, arg_min(title, pk) AS title, arg_min(page_no, pk) AS page_no FROM t WHERE length(title) <= 90 AND regexp_matches(title, '^(第[一二三四五六七八九十百零〇0-9]+[章节篇]\s*.+|[0-9]+(\.[0-9]+){1,3}\s+[\x{4e00}-\x{9fa5}A-Za-z].+)') GROUP BY ALL),
hn AS (SELECT *, row_number() OVER w - 1 AS idx, lead(page_no) OVER w AS later FROM h WINDOW w AS (PARTITION BY document_id ORDER BY pk)),
c AS (SELECT document_id, CAST(idx AS INTEGER) AS chapter_index, left(title, 120) AS name, regexp_extract(title, '^(第[0-9]+[章节篇]|[0-9]+(\.[0-9]+){0,3})', 1) AS number, page_no AS page_start,
  CASE WHEN idx = max(idx) OVER (PARTITION BY document_id) THEN 0 ELSE greatest(page_no, later - 1) END AS page_end FROM hn WHERE idx < 80)"""


@query(f"WITH {BOOK_SQL}, {ANALYSIS_SQL} SELECT * FROM c")
def analysed_chapters(spark, sf):
    return AN.chapters(AN.lines(_book(spark, sf)))


@query(
    f"WITH {BOOK_SQL}, {ANALYSIS_SQL}, "
    r"""m AS (SELECT t.*, coalesce(last_value(c.chapter_index IGNORE NULLS) OVER (PARTITION BY t.document_id ORDER BY t.pk), 0) AS chapter_index FROM t LEFT JOIN c ON c.document_id = t.document_id AND c.name = t.title),
    x AS (SELECT *, regexp_extract(line, '^(定义|定理|性质|引理|推论|命题|公式|法则|例题|例)\s*([0-9一二三四五六七八九十.．-]*)\s*[：:]?\s*(.+)?$', ['a', 'b', 'c']) AS e FROM m),
    e AS (SELECT 0 AS o, 0 AS no, pk, document_id, page_no, chapter_index, trim(e.a || e.b || ' ' || trim(e.c)) AS name, left(concat_ws(' ', line, l1, l2), 500) AS d, CASE WHEN e.a = '定理' THEN 'theorem' WHEN e.a = '例' THEN 'method' ELSE 'concept' END AS kp_type FROM x WHERE e.a <> ''
      UNION ALL SELECT 0, 0, pk, document_id, page_no, chapter_index, title, left(concat_ws(' ', line, l1), 500), 'concept' FROM x WHERE e.a = '' AND length(line) <= 90 AND regexp_matches(line, '^[0-9]+(\.[0-9]+){1,3}\s+[\x{4e00}-\x{9fa5}A-Za-z].+')
      UNION ALL SELECT 1, no, pk, document_id, page_no, chapter_index, term, left(concat_ws(' ', l0, line, l1, l2), 500), 'concept' FROM m JOIN (SELECT unnest(['STEEL', 'BRASS', 'red', 'gear', '概率', '部件']) AS term, unnest(range(6)) AS no) ON contains(line, term) QUALIFY row_number() OVER (PARTITION BY document_id, term ORDER BY pk) = 1
      UNION ALL SELECT 2, 0, pk, document_id, page_no, chapter_index, left(line, 80), line, 'formula' FROM (SELECT * FROM (SELECT * FROM m WHERE length(line) BETWEEN 4 AND 220 AND regexp_matches(line, '[=∫∑∏→∞]|lim|sin|cos|tan|log|ln|P[{(]|[ED]\(|Var|Cov') QUALIFY row_number() OVER (PARTITION BY document_id, line ORDER BY pk) = 1) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY pk) <= 80)),
    u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY document_id, regexp_replace(name, '\s+', '', 'g') ORDER BY o, no, pk) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY o, no, pk) AS place FROM u)
    SELECT document_id, CAST(place AS BIGINT) AS place, name, md5(d) AS h, kp_type, CASE WHEN name = '概率' THEN 'easy' ELSE 'medium' END AS difficulty, page_no, chapter_index FROM r WHERE place <= 300"""
)
def analysed_points(spark, sf):
    rows = AN.lines(_book(spark, sf))
    p = AN.points(rows, AN.chapters(rows), ANALYSIS_TERMS)
    return p.select("document_id", F.col("place").cast("long").alias("place"), "name", F.md5("definition").alias("h"), "kp_type", "difficulty", "page_no", "chapter_index")


# --- what is kept ---
@query(
    """SELECT source, lang, count(*) AS n, CAST(sum(CASE WHEN source = 'src5' THEN 1 ELSE length(text) END) AS BIGINT) AS chars, count(*) FILTER (source = 'src5') AS changed FROM documents WHERE lang <> 'de' GROUP BY source, lang"""
)
def bucket_table(spark, sf):
    """All documents kept, those of a source replaced (by rows with a new column), those of a language deleted."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("document_id"), "source", "lang", F.length("text").alias("chars"))
    kept = BucketTable(spark, f"{scratch(spark)}/rows-{uuid.uuid4().hex}", buckets=16)
    kept.replace(d)
    kept.replace(d.where("source = 'src5'").withColumns({"chars": F.lit(1), "changed": F.lit(True)}))
    kept.delete(d.where("lang = 'de'"))
    return kept.rows().groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"), F.count("changed").alias("changed"))


@query(
    r"""WITH d AS (SELECT lang, text, regexp_matches(lower(text), '[a-z0-9_]') AS said FROM documents)
    SELECT lang, count(*) AS n, count(*) FILTER (said) AS with_vector, (SELECT count(DISTINCT text) FROM d WHERE said) AS kept, CAST(0 AS BIGINT) AS kept_again FROM d GROUP BY lang"""
)
def embedding_cache(spark, sf):
    """All texts embedded through the cache, half of them first; a third batch finds nothing to do."""
    f = _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "lang", "text")
    cache = EmbeddingCache(spark, f"{scratch(spark)}/embeddings-{uuid.uuid4().hex}", "hash", 10_000_000)
    embed = lambda rows: R.dense_hash_embedding(rows.withColumnRenamed("digest", "chunk_id")).withColumnRenamed("chunk_id", "digest")
    cache.fill(f.where(F.length("text") % 2 == 0), embed, "first")
    cache.fill(f, embed, "second")
    cache.fill(f, embed, "third")
    kept = cache.stored().agg(F.count("*").alias("kept"))
    again = cache.stored().join(cache.stored(but="third"), "digest", "left_anti").agg(F.count("*").alias("kept_again"))
    return cache.embedded(f).groupBy("lang").agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector")).crossJoin(kept).crossJoin(again)


# --- results as text ---
def _papers(spark, sf) -> DataFrame:
    """``o_orderkey, doc``: every order as a plan of questions and days, packed twice: a fenced string under ``raw`` that holds another string."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_returnflag").alias("question_type"), F.concat(F.lit("ship "), F.col("l_partkey").cast("string")).alias("question_text"), F.col("l_linenumber").alias("score"), F.array("l_returnflag", "l_linestatus").alias("options"), F.col("l_linestatus").alias("answer")).alias("q"))
    q = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["q"]).alias("questions"))
    days = F.array(F.struct(F.lit(2).alias("day"), F.array("o_orderpriority", "o_orderstatus").alias("tasks")))
    inner = F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.lit("").alias("remark"), F.struct(F.to_json(F.struct(F.col("o_custkey").alias("cust_key"))).alias("raw")).alias("ship_notes"), "questions", days.alias("daily_tasks"), F.array("o_orderstatus").alias("answers")))
    fenced = F.concat(F.lit("```json\n"), inner, F.lit("\n```"))
    return _t(spark, sf, "orders").join(q, "o_orderkey").select("o_orderkey", F.to_json(F.struct(fenced.alias("raw"))).alias("doc"))


OUTLINE_SQL = """q AS (SELECT l_orderkey AS o_orderkey, string_agg('    第 ' || n || ' 题' || chr(10) || '        题型：' || l_returnflag || chr(10) || '        题干：ship ' || l_partkey || chr(10) || '        分值：' || l_linenumber || chr(10)
  || '        选项：' || chr(10) || '            • ' || l_returnflag || chr(10) || '            • ' || l_linestatus || chr(10) || '        答案：' || l_linestatus, chr(10) ORDER BY n) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR), l_linestatus) AS n FROM lineitem) GROUP BY l_orderkey)"""


@query(
    f"WITH {OUTLINE_SQL} SELECT o_orderkey, '标题：' || o_orderpriority || chr(10) || 'Ship notes：' || chr(10) || '    Cust key：' || o_custkey || chr(10) || '题目：' || chr(10) || q || chr(10) || '每日任务安排：' || chr(10) "
    "|| '    Day 2' || chr(10) || '        任务内容：' || chr(10) || '            • ' || o_orderpriority || chr(10) || '            • ' || o_orderstatus || chr(10) || '答案：' || chr(10) || '    • ' || o_orderstatus AS text FROM orders JOIN q USING (o_orderkey)"
)
def json_outline(spark, sf):
    return _papers(spark, sf).select("o_orderkey", RE.outline(F.col("doc")).alias("text"))


@query(
    """WITH q AS (SELECT l_orderkey AS o_orderkey, string_agg('#### 第 ' || n || ' 题  [' || l_returnflag || ']  (' || l_linenumber || ' 分)' || chr(10) || '  ship ' || l_partkey || chr(10) || '  A. ' || l_returnflag || chr(10) || '  B. ' || l_linestatus || chr(10), chr(10) ORDER BY n) AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR), l_linestatus) AS n FROM lineitem) GROUP BY l_orderkey)
    SELECT o_orderkey, '**标题**：' || o_orderpriority || chr(10) || chr(10) || '## Ship notes' || chr(10) || chr(10) || '**Cust key**：' || o_custkey || chr(10) || chr(10) || '## 题目' || chr(10) || chr(10) || q || chr(10)
    || '## 每日任务安排' || chr(10) || chr(10) || '**第 2 天**' || chr(10) || '### 任务内容' || chr(10) || chr(10) || '- ' || o_orderpriority || chr(10) || '- ' || o_orderstatus || chr(10) || chr(10) AS text FROM orders JOIN q USING (o_orderkey)"""
)
def markdown_for_students(spark, sf):
    return _papers(spark, sf).select("o_orderkey", RE.markdown(F.col("doc"), answers=False).alias("text"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'insufficient' WHEN 4 THEN 'insufficient' ELSE 'ok' END AS answer_status, CASE WHEN event_id % 5 = 0 THEN 'read ' || event_type ELSE event_type END AS question_recognition,
    CASE event_id % 5 WHEN 1 THEN '当前模型没有把题目代入求解，只返回了通用辅导模板。' WHEN 4 THEN '未获得有效解题内容。' WHEN 3 THEN 'try' ELSE '' END AS solving_approach,
    CASE event_id % 5 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN '缺少：可用于计算或推导的有效模型输出|请补充完整题干，或检查模型/OCR服务是否正常返回。' WHEN 4 THEN '缺少：可用于计算或推导的有效模型输出|请补充完整题干，或检查模型/OCR服务是否正常返回。' ELSE '' END AS steps,
    CASE WHEN event_id % 5 = 2 THEN CAST(user_id AS VARCHAR) ELSE '' END AS final_answer,
    CASE event_id % 5 WHEN 0 THEN 'one tip' WHEN 1 THEN '不要把通用解题模板当成真实答案。' WHEN 4 THEN '不要把通用解题模板当成真实答案。' WHEN 2 THEN 'a|b' ELSE '' END AS mistakes,
    CASE event_id % 5 WHEN 0 THEN 'look' WHEN 1 THEN '把题目文字粘贴出来后，我再按题目逐步求解。' WHEN 4 THEN '把题目文字粘贴出来后，我再按题目逐步求解。' ELSE '可以继续追问某一步为什么这样做，或让我生成同类题。' END AS hint FROM events"""
)
def homework_results(spark, sf):
    """Tutoring results in five shapes: wrapped with aliases, a template, an answer alone, an approach alone, not JSON."""
    e, kind, user = _t(spark, sf, "events"), F.col("event_type"), F.col("user_id").cast("string")
    obj = lambda **x: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in x.items()]))
    full = obj(steps=F.array(F.concat(F.lit(" "), kind), F.lit(" "), user), hints=F.array(F.lit("look"), F.lit("else")), mistake_tips="one tip", question_recognition=F.concat(F.lit("read "), kind))
    i = F.col("event_id") % 5
    doc = (
        F.when(i == 0, obj(final_package=obj(tutor_result=full))).when(i == 1, obj(solving_approach="先识别题目考查", complete_steps=F.array(F.lit("整理条件"), F.lit("检查答案"))))
        .when(i == 2, obj(tutoring=F.struct(user.alias("final_answer"), F.array(F.lit("a"), F.lit("b")).alias("mistake_tips")))).when(i == 3, obj(solving_approach=" try ", answer_status="")).otherwise("{broken")
    )
    out = RE.homework(e.select("event_id", kind.alias("question"), doc.alias("result")))
    return out.select("event_id", "answer_status", "question_recognition", "solving_approach", F.array_join("complete_steps", "|").alias("steps"), "final_answer", F.array_join("common_mistakes", "|").alias("mistakes"), F.col("next_step_hint").alias("hint"))


# --- templates ---
@query(
    """WITH p AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS n, bool_or(p_size > 49) AS f FROM part GROUP BY p_brand)
    SELECT p_brand, array_to_string(n[1:5], '|') AS focus, array_to_string(n[1:3], '|') AS difficulties, CASE WHEN f THEN '' ELSE '缺少教材片段，重点难点为保守估计。' END AS warning, p_brand || ' 是本节需要理解和应用的核心内容。' AS explained, CASE WHEN f THEN '' ELSE '缺少教材片段，讲解为通用版本。' END AS warning2 FROM p"""
)
def keypoint_templates(spark, sf):
    first = _t(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("n"), F.max(F.col("p_size") > 49).alias("f"))
    asked = first.select("p_brand", F.col("n.p_name").alias("points"), F.when(F.col("f"), F.array(F.lit("x"))).alias("fragments"), F.col("p_brand").alias("knowledge_point"))
    k = G.keypoints(asked).withColumn("warning", F.col("insufficient_data_warning")).drop("insufficient_data_warning")
    one = F.get("key_points", F.lit(0))
    return G.explanation(k).select("p_brand", F.array_join(one["core_focus"], "|").alias("focus"), F.array_join(one["learning_difficulties"], "|").alias("difficulties"), "warning", F.col("concept_explanation").alias("explained"), F.col("insufficient_data_warning").alias("warning2"))


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AS is_correct, CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END AS score, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'unknown' END AS error_type,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE '复习相关知识点|完成 2-3 道同类变式题' END AS remedies, o_orderpriority AS involved, '缺少教材片段，诊断为保守版本。' AS warning, o_orderpriority AS review, 'insufficient' AS status FROM orders"""
)
def diagnosis_templates(spark, sf):
    """Diagnosis and tutoring of every order as a question whose right answer is F."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.lit("F").alias("standard_answer"), F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("\n")).alias("student_answer"), F.col("o_orderpriority").alias("knowledge_point"), F.col("o_orderstatus").alias("question_text"), F.array().cast("array<string>").alias("fragments"))
    d = G.diagnosis(o).withColumn("warning", F.col("insufficient_data_warning")).drop("insufficient_data_warning")
    return G.tutor(d).select("o_orderkey", "is_correct", "score", "error_type", F.array_join("remediation_suggestions", "|").alias("remedies"), F.array_join("involved_knowledge", "|").alias("involved"), "warning", F.array_join("recommended_review", "|").alias("review"), F.col("answer_status").alias("status"))


@query(
    f"""WITH {ANSWERS_SQL}, m AS (SELECT user_id, error_type, min(event_id) AS f FROM a WHERE NOT is_correct AND error_type <> '' GROUP BY ALL), l AS (SELECT user_id, string_agg(error_type, '|' ORDER BY f) AS w, array_to_string((list(error_type ORDER BY f))[1:3], '|') AS t FROM m GROUP BY user_id)
    SELECT c_custkey AS user_id, coalesce(w, '') AS weak, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) THEN '' ELSE '学习数据较少，画像为保守版本。' END AS warning, coalesce(t, '') AS tomorrow FROM customer LEFT JOIN l ON user_id = c_custkey"""
)
def profile_templates(spark, sf):
    """A profile and path for every customer, by their events as learners."""
    a = _answers(spark, sf)
    m = a.where(~F.col("is_correct")).select("user_id", "event_id", F.col("error_type").alias("knowledge_point"), F.col("error_type").alias("error_reason"))
    p = G.profiles(_t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), m, a, "user_id", "event_id").withColumn("warning", F.col("insufficient_data_warning"))
    path = G.adaptive_path(p.withColumns({"daily_study_time": F.lit(60), "exam_date": F.lit("")}))
    return path.select("user_id", F.array_join("weak_knowledge_points", "|").alias("weak"), "warning", F.array_join(F.get("tomorrow_tasks", F.lit(0))["knowledge_points"], "|").alias("tomorrow"))


@query(
    """WITH s AS (SELECT doc_id, unnest(range(0, 6)) AS i FROM documents), r AS (SELECT *, ['uploaded', 'parsing', 'chunking', 'embedding', 'completed'] AS names FROM s WHERE i BETWEEN 1 AND doc_id % 6 OR i = 0 AND doc_id % 7 = 0)
    SELECT doc_id AS document_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, CASE WHEN i > 1 THEN names[i - 1] END AS old_status, CASE WHEN i = 0 THEN 'completed' ELSE names[i] END AS status, i > 0 AS valid, CAST(i >= 2 AS INTEGER) AS attempt, CAST(60 * greatest(0, i - 2) AS DOUBLE) AS work_seconds FROM r"""
)
def document_life(spark, sf):
    """Every document on its way, some with a report that can't be; state in RocksDB, as for a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = F.array(*[F.lit(x) for x in ("completed", "uploaded", "parsing", "chunking", "embedding", "completed")])
    told = _docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.posexplode(names).alias("i", "status")).where((F.col("i").between(1, F.col("document_id") % 6)) | ((F.col("i") == 0) & (F.col("document_id") % 7 == 0)))
    return activity.document_life(told.select("document_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("i"))).alias("ts"), "status"))


# --- extension ---
@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) "
    "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, s"
)
def session_activity(spark, sf):
    return activity.sessions(_answers(spark, sf))
