"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

Each participant in turn becomes the assistant: that speaker's messages carry
the training mask, every other speaker is a user with a name, and system
messages stay system messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    """Text can't hold a marker of its own: ``<|`` becomes ``< |``."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


#: Turn numbers of one piece. Pieces only spread the work: they are joined again, so the result does not depend on it.
PIECE = 64


def rotate(turns: DataFrame) -> DataFrame:
    """``conv_id, perspective, n_turns, text, mask``: every dialogue whole, once for every participant.

    ``turns`` is ``(conv_id, turn, role, text)``. ``text`` is the rendering of
    all turns, ``mask`` the character ranges ``start:end`` (end excluded, joined
    by a comma) of the perspective's own messages with their closing marker.

    Turns sort by number (null last), then role, then text; rows that repeat
    wholly are rendered as often as they come. A null role is the participant
    ``unknown``; a null text is empty; a null conv_id is a dialogue of its own.
    ``system`` is never a perspective; a dialogue with system rows alone gives
    no rows. Other columns are ignored. Pieces of a dialogue are rendered apart
    and put together in order; a rendering is one string, so it must fit a row.
    """
    t = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    order = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", "role", "body")
    pieces = t.groupBy("conv_id", F.floor(F.col("turn") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(order)).alias("turns"))
    speakers = t.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    each = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = lambda x: x["role"] == F.col("perspective")
    head = lambda x: F.concat(
        F.lit(OPEN),
        F.when(own(x), F.lit("assistant")).when(x["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), _safe(x["role"]))),
        F.lit("\n"),
    )
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(_safe(x["body"]), F.lit(CLOSE)).alias("body"), own(x).alias("own")))
    spans = "array<struct<lo:bigint,hi:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("mask"))

    def step(acc, p):
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        return F.struct((hi + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).otherwise(acc["mask"]).alias("mask"))

    rendered = each.withColumn("parts", parts).select(
        "conv_id",
        "perspective",
        F.struct(
            F.col("piece").isNull().alias("no_turn"),
            "piece",
            F.size("parts").cast("long").alias("n"),
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
            F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"),
        ).alias("p"),
    )
    whole = rendered.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    # where each piece begins: the running length of those before it
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("ps", none, lambda acc, p: F.struct((acc["at"] + F.length(p["text"])).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
    moved = F.flatten(F.zip_with(F.col("ps")["mask"], "starts", lambda m, at: F.transform(m, lambda x: F.concat_ws(":", x["lo"] + at, x["hi"] + at))))
    return whole.withColumn("starts", starts).select(
        "conv_id",
        "perspective",
        F.aggregate("ps", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n_turns"),
        F.array_join(F.col("ps")["text"], "").alias("text"),
        F.array_join(moved, ",").alias("mask"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
p AS (SELECT t.conv_id, perspective, turn, role, body, role = perspective AS own,
        '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                               ELSE 'user name=' || replace(role, '<|', '< |') END || chr(10) AS head,
        replace(body, '<|', '< |') || '<|im_end|>' AS tail
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, body ROWS UNBOUNDED PRECEDING) - length(tail) - 1 AS lo FROM p)
SELECT conv_id, perspective, count(*) AS n_turns,
       string_agg(head || tail || chr(10), '' ORDER BY turn NULLS LAST, role, body) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(lo AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(lo + length(tail) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS LAST, role, body, lo), '') AS mask
FROM q GROUP BY conv_id, perspective
"""
