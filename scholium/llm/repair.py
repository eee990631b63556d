"""Conversation structure repair by shortest paths with a bucket queue.

A conversation's rows are edges of a graph: a node is (rows consumed, where the
turn-taking stands), an edit is an arc with a small integer cost. Dial's bucket
queue gives every node its distance to the goal; from the start, the walk takes
the least edit whose arc is tight, which gives the cheapest edits and of these
the least string.

Long conversations are divided: rows are range-partitioned in order, so a
conversation lies in segments of bounded size. A segment is first a matrix of
distances from each state at its start to each at its end; matrices are combined
from the last segment to the first, and every segment is then walked by itself
from the distances at its end. Only the last step, a digest of the repaired
text, has to see a conversation in order; it streams it and holds one segment.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_parts

#: Rows of a segment, and characters of its texts.
ROWS, CHARS = 512, 1 << 20
DELETE, INSERT, REROLE = 3, 2, 2
INF = 1 << 60
#: States: nothing yet, after the system row, after a user's, after an assistant's; where a new user's or assistant's row leads, and whence one comes.
NEXT, BEFORE = (2, 2, 3, 2), ((), (), (0, 1, 3), (2,))
ROLE = {2: "user", 3: "assistant"}
#: Where a row kept with its initial leads, and whence.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
KEPT_BEFORE = {"s": ((), (0,), (), ()), "u": ((), (), (0, 1, 3), ()), "a": ((), (), (), (2,))}
GOAL = (0, INF, INF, 0)


def distances(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[int]]:
    """The distance to the goal of every node ``[row][state]``, given those behind the last row.

    ``rows`` are ``(initial, truncated)``. Nodes leave the bucket queue by distance.
    """
    n = len(rows)
    dist = [[INF] * 4 for _ in range(n + 1)]
    base = min(ends)
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(DELETE * n + 16)]

    def reach(i: int, s: int, d: int):
        if d < dist[i][s]:
            dist[i][s] = d
            while d - base >= len(buckets):
                buckets.append([])
            buckets[d - base].append((i, s))

    for s, d in enumerate(ends):
        if d < INF:
            reach(n, s, d)
    at = 0
    while at < len(buckets):
        for i, s in buckets[at]:  # arcs without cost append to the bucket that is read
            d = at + base
            if dist[i][s] != d:
                continue
            for p in BEFORE[s]:
                reach(i, p, d + INSERT)
            if i:
                initial, cut = rows[i - 1]
                reach(i - 1, s, d + DELETE)
                for p in BEFORE[s]:
                    reach(i - 1, p, d + REROLE + cut)
                for p in KEPT_BEFORE[initial][s] if initial in KEPT else ():
                    reach(i - 1, p, d + cut)
        at += 1
    return dist


def walk(rows: list[tuple[str, int]], dist: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least string of tight arcs from the first node in ``state``, and the state it ends in.

    Before the end of a conversation the walk stops behind the last row: what
    is inserted there comes behind the rows that the next segment deletes.
    """
    i, s, out = 0, state, []
    while i < len(rows) or last and dist[i][s]:
        d = dist[i][s]
        if i < len(rows) and d == dist[i + 1][s] + DELETE:
            out.append("D")
            i += 1
        elif d == dist[i][NEXT[s]] + INSERT:
            out.append("I")
            s = NEXT[s]
        else:
            initial, cut = rows[i]
            kept = KEPT.get(initial, {}).get(s)
            if kept is not None and d == dist[i + 1][kept] + cut:
                out.append("K")
                s = kept
            else:
                out.append("R")
                s = NEXT[s]
            i += 1
    return "".join(out), s


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the checksum of ``conv_id:turn`` names."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    out = t.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return out.withColumn("copies", F.col("copies").cast("long"))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, blank, again, cut``: equal rows as one, with their number.

    ``again`` says that the conversation had role and text at an earlier turn.
    """
    digest = F.md5("text")
    one = rows.groupBy("conv_id", "turn", "role", digest.alias("digest")).agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    seen = rows.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return one.join(seen, same, "left").select("conv_id", "turn", "role", "text", "copies", (~full).alias("blank"), F.coalesce(order > F.col("first"), F.lit(False)).alias("again"), (full & ~ends).alias("cut"))


_STATS = "conv_id {id}, part int, idx int, turn_first long, turn_last long, turn_min long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, gaps array<long>, roles array<string>, texts array<string>, cuts array<int>"
_SEGMENT = f"{_STATS}, matrix array<long>"


class Segment:
    """Consecutive rows of a conversation: those that may stay, and between them how many are to be deleted."""

    def __init__(self, conv, part: int, idx: int):
        self.conv, self.part, self.idx = conv, part, idx
        self.turns, self.first, self.last, self.least = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = None
        self.gaps, self.roles, self.texts, self.cuts, self.chars, self.rows = [0], [], [], [], 0, 0

    def add(self, turn, role: str, text: str, copies: int, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and (self.turns == 0 or turn != self.last):
            self.turns += 1
            self.least = turn if self.least is None else self.least
        if self.rows == 0:
            self.first, self.head = turn, role[:1]
        else:
            self.illegal += self.tail + role[:1] not in LEGAL
        self.illegal += copies - 1 if role[:1] * 2 not in LEGAL else 0
        self.last, self.tail = turn, role[:1]
        self.rows += 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not again)
            if not again:
                self.truncated += cut
                self.roles.append(role)
                self.texts.append(text)
                self.cuts.append(int(cut))
                self.gaps.append(0)
                self.chars += len(text)
                copies -= 1
        self.gaps[-1] += copies

    def row(self) -> tuple:
        rows = free(self.roles, self.cuts)
        matrix = [[0] * 4 for _ in range(4)]
        for t in range(4):
            for s, d in enumerate(distances(rows, tuple(0 if k == t else INF for k in range(4)))[0]):
                matrix[s][t] = d
        return (self.conv, self.part, self.idx, self.first, self.last, self.least, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.gaps, self.roles, self.texts, self.cuts, [d for m in matrix for d in m])


LEGAL = {"su", "ua", "au"}


def free(roles: list[str], cuts: list[int]) -> list[tuple[str, int]]:
    return [(r[:1], c) for r, c in zip(roles, cuts)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``turns (conv_id, turn, role, text)`` are damaged first (``damaged``); a null
    in any of them is one space there, and a null conv_id is a conversation of
    its own. Rows sort by turn (nulls first), role, text. A row's first fault
    counts: blank, duplicate (role and text came before), truncated. Blank and
    duplicate rows must go (3 each); any other row is kept (0), gets another
    role (2) or goes (3), rows without text are inserted (2), and a truncated
    row that stays adds 1, until the initials of the roles read
    ``(s?(ua)+)?``; a role without initial can't be kept. ``audit`` names the
    cheapest edits in order, the least string of several. ``gaps`` counts the
    numbers missing between the first and the last turn, ``illegal`` adjacent
    initials other than su, ua, au. A conversation without rows left has zeros,
    an empty audit and the digest of nothing. Repeated rows are duplicates;
    other columns are ignored; an empty table gives no rows. An audit is one
    string, so it must fit a row.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = faults(damaged(turns))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    name = turns.sparkSession.createDataFrame([], _SEGMENT.format(id=kind))
    segment_schema = _arrow(name)

    def divide(batches):
        part, now, held, idx = TaskContext.get().partitionId(), None, [], 0
        for b in batches:
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != conv or now.rows >= ROWS or now.chars >= CHARS:
                    if now is not None:
                        held.append(now.row())
                        if len(held) >= 256 or now.chars >= CHARS:
                            yield _batch(held, segment_schema)
                            held = []
                    now = Segment(conv, part, idx)
                    idx += 1
                now.add(*row)
        if now is not None:
            held.append(now.row())
        if held:
            yield _batch(held, segment_schema)

    segments = checkpoint(dealt.mapInArrow(divide, _SEGMENT.format(id=kind)))
    ends_schema = pa.schema([("part", pa.int32()), ("idx", pa.int32()), ("ends", pa.list_(pa.int64())), ("place", pa.int32())])

    def combine(batches):
        """Distances behind every segment of the conversations that have several; place 0 is a first, 2 a last segment."""
        now, held = None, []

        def out():
            if len(held) > 1:
                ends, got = GOAL, []
                for k in range(len(held) - 1, -1, -1):
                    part, idx, m = held[k]
                    got.append((part, idx, list(ends), 0 if k == 0 else 2 if k == len(held) - 1 else 1))
                    ends = tuple(min(m[4 * s + t] + ends[t] for t in range(4)) for s in range(4))
                    ends = tuple(min(d, INF) for d in ends)
                for lo in range(0, len(got), 10_000):
                    yield _batch(got[lo : lo + 10_000], ends_schema)

        for b in batches:
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and conv != now:
                    yield from out()
                    held = []
                now = conv
                held.append(row)
        yield from out()

    thin = segments.select("conv_id", "part", "idx", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")
    ends = thin.mapInArrow(combine, "part int, idx int, ends array<long>, place int")
    walked_type = _STATS.format(id=kind) + ", costs array<long>, edits array<string>, exits array<int>"
    walked_schema = _arrow(turns.sparkSession.createDataFrame([], walked_type))

    def walks(batches):
        """The edits of each segment from every state it can begin in."""
        for b in batches:
            out = []
            for *stats, end, place in zip(*(c.to_pylist() for c in b.columns)):
                rows = free(stats[-3], stats[-1])
                dist = distances(rows, tuple(end) if end else GOAL)
                costs, edits, exits = [0] * 4, [""] * 4, [0] * 4
                for s in range(4) if place else (0,):
                    if dist[0][s] < INF:
                        edits[s], exits[s] = walk(rows, dist, s, place is None or place == 2)
                        costs[s] = dist[0][s]
                out.append((*stats, costs, edits, exits))
            if out:
                yield _batch(out, walked_schema)

    walked = segments.drop("matrix").join(ends, ["part", "idx"], "left").select(*[c.split()[0] for c in _STATS.format(id=kind).split(", ")], "ends", "place").mapInArrow(walks, walked_type)
    result_type = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    result_schema = _arrow(turns.sparkSession.createDataFrame([], result_type))

    def assemble(batches):
        now, out = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != row[0]:
                    if now is not None:
                        out.append(now.result())
                        if len(out) >= 1_000:
                            yield _batch(out, result_schema)
                            out = []
                    now = Conversation(row[0])
                now.add(*row[3:])
        if now is not None:
            out.append(now.result())
        if out:
            yield _batch(out, result_schema)

    done = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx").mapInArrow(assemble, result_type)
    names = turns.select(F.col("conv_id").alias("id")).distinct()
    filled: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256().hexdigest()
    return names.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _arrow(empty: DataFrame) -> pa.Schema:
    return empty.toArrow().schema


class Conversation:
    """What the segments of one conversation come to, in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, 0, None
        self.least = self.greatest = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.forced = 0
        self.tail, self.audit, self.digest, self.empty = None, [], hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def add(self, first, last, least, turns, blank, duplicate, truncated, illegal, head, tail, gaps, roles, texts, cuts, costs, edits, exits) -> None:
        if self.tail is not None:
            self.illegal += self.tail + head not in LEGAL
            self.turns -= first is not None and first == self.greatest
        if least is not None:
            self.least = least if self.least is None else self.least
            self.greatest = last
        self.turns += turns
        self.blank, self.duplicate, self.truncated, self.illegal, self.tail = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.illegal + illegal, tail
        self.forced += sum(gaps)
        if self.cost is None:
            self.cost = costs[0]
        i, s = 0, self.state
        self.audit.append("D" * gaps[0])
        for e in edits[s]:
            self.audit.append(e)
            if e == "I":
                s = NEXT[s]
                self.write(ROLE[s], "")
                continue
            if e == "R":
                s = NEXT[s]
                self.write(ROLE[s], texts[i])
            elif e == "K":
                s = KEPT[roles[i][:1]][s]
                self.write(roles[i], texts[i])
            i += 1
            self.audit.append("D" * gaps[i])
        self.state = exits[self.state]

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + DELETE * self.forced, "".join(self.audit), self.digest.hexdigest())


def _arc(x: str, cost: str, letter: str, piece: str = "''") -> str:
    """SQL: a value (cost in nine digits, edits, chr(1), repaired rows) with one more edit."""
    return f"(lpad(CAST(CAST(left({x}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr(split_part({x}, chr(1), 1), 10) || '{letter}' || chr(1) || substr({x}, instr({x}, chr(1)) + 1) || {piece})"


def _inserted(source: str, extra: str) -> str:
    """SQL: the states after at most one inserted row."""
    two = ", ".join(_arc(x, "2", "I", "'user:' || chr(10)") for x in ("a0", "a1", "a3"))
    return f"SELECT {extra}, a0, a1, least(a2, {two}) AS a2, least(a3, {_arc('a2', '2', 'I', chr(39) + 'assistant:' + chr(39) + ' || chr(10)')}) AS a3 FROM ({source})"


def _oracle() -> str:
    row, keep, again = "role || ':' || text || chr(10)", "cut", "2 + cut"
    user, assistant = "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
    step = ", ".join(f"CASE WHEN gone THEN {_arc(f'a{k}', '3', 'D')} ELSE least({v}) END AS a{k}" for k, v in enumerate((
        _arc("a0", "3", "D"),
        f"{_arc('a1', '3', 'D')}, CASE WHEN initial = 's' THEN {_arc('a0', keep, 'K', row)} END",
        ", ".join([_arc("a2", "3", "D"), *(f"CASE WHEN initial = 'u' THEN {_arc(x, keep, 'K', row)} END" for x in ("a0", "a1", "a3")), *(_arc(x, again, "R", user) for x in ("a0", "a1", "a3"))]),
        f"{_arc('a3', '3', 'D')}, CASE WHEN initial = 'a' THEN {_arc('a2', keep, 'K', row)} END, {_arc('a2', again, 'R', assistant)}",
    )))
    more = "conv_id, i"
    now = "SELECT r.conv_id, r.i + 1 AS i, a0, a1, a2, a3, role, text, initial, cut, gone FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1"
    cols = "conv_id, i, role, text, initial, cut, gone"
    return rf"""
WITH RECURSIVE p AS (SELECT i, 0 AS k, CAST(i AS UBIGINT) AS c FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM p WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM p WHERE k = 8),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT o.*, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS UBIGINT))), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295) % 20 AS kind FROM o, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, left(role, 1) AS initial, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM n),
f AS (SELECT *, NOT blank AND nth > 1 AS duplicate, blank OR nth > 1 AS gone, CASE WHEN NOT blank AND nth = 1 AND open THEN 1 ELSE 0 END AS cut,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM g),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' || chr(1) AS a0, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT {more}, {step} FROM ({_inserted(_inserted(now, cols), cols)})),
z AS (SELECT conv_id, least(a0, a3) AS best FROM ({_inserted(_inserted("SELECT * FROM r QUALIFY i = max(i) OVER (PARTITION BY conv_id)", more), more)})),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(best, 9) AS BIGINT) AS cost, substr(split_part(best, chr(1), 1), 10) AS audit, sha256(CASE WHEN substr(best, instr(best, chr(1)) + 1) = '' THEN '' ELSE left(substr(best, instr(best, chr(1)) + 1), -1) END) AS repaired_sha256
FROM z LEFT JOIN s ON z.conv_id IS NOT DISTINCT FROM s.conv_id
"""


ORACLE = _oracle()
