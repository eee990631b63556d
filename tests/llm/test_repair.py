"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scholium.llm import repair


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = convs[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted((solve(conv, sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, mine in convs.items()), key=repr)


def solve(conv, rows):
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # cheapest first, then the least string: (cost, audit) leave the heap in order
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, done_roles, text = heapq.heappop(heap)
        state = (i, done_roles[:1] == "s", done_roles[-1:], len(done_roles) > 0)
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", done_roles):
            return conv, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256(text[:-1].encode()).hexdigest()

        def go(c, letter, j, role, body):
            roles = done_roles + role[:1]
            if not role or re.fullmatch("s?(ua)*u?", roles):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles, text + (f"{role}:{body}\n" if letter != "D" else "")))

        go(2, "I", i, "user", "")
        go(2, "I", i, "assistant", "")
        if i < len(rows):
            go(3, "D", i + 1, "", "")
            if kinds[i] not in ("b", "d"):
                cut = kinds[i] == "t"
                if rows[i][1]:
                    go(cut, "K", i + 1, rows[i][1], rows[i][2])
                go(2 + cut, "R", i + 1, "user", rows[i][2])
                go(2 + cut, "R", i + 1, "assistant", rows[i][2])


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit(1)).withColumn("copies", F.lit("x")).repartition(3)
    return sorted((tuple(r) for r in repair.repaired(df).collect()), key=repr)


def dialogues(rng, n, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "use", "a", None, "User"]
    texts = ["Yes.", "No", "What?\n", " \t", "", None, "é!", "q\x0b", "Sure . ", " "]
    out = []
    for conv in range(n):
        turns = rng.sample(range(40), rng.randint(1, longest)) if rng.random() < 0.7 else [rng.choice([None, 1, 2, 5]) for _ in range(rng.randint(1, longest))]
        for k, t in enumerate(turns):
            out.append((conv if conv else None, t, rng.choice(roles) if rng.random() < 0.5 else roles[k % 2], rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
    out += [r for r in out if rng.random() < 0.1]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows_of_a_segment", [512, 2, 1])
def test_equals_brute_force(spark, monkeypatch, rows_of_a_segment):
    monkeypatch.setattr(repair, "ROWS", rows_of_a_segment)
    rows = dialogues(random.Random(rows_of_a_segment), 150, 9)
    assert got(spark, rows) == brute(rows)


def test_one_long_conversation_lies_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 20)
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{k}.", f"{k}"])) for k in range(1500)]
    assert got(spark, rows) == brute(rows)


def test_bucket_queue_gives_shortest_distances():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.randint(0, 1)) for _ in range(rng.randint(0, 8))]
        dist = repair.distances(rows, repair.GOAL)
        want = [[repair.INF] * 4 for _ in dist]
        want[-1] = [0, repair.INF, repair.INF, 0]
        for _ in range(3 * len(dist) + 6):  # Bellman-Ford
            for i in range(len(dist)):
                for s in range(4):
                    arcs = [want[i][repair.NEXT[s]] + 2]
                    if i < len(rows):
                        r, c = rows[i]
                        arcs += [want[i + 1][s] + 3, want[i + 1][repair.NEXT[s]] + 2 + c]
                        if s in repair.KEPT.get(r, {}):
                            arcs.append(want[i + 1][repair.KEPT[r][s]] + c)
                    want[i][s] = min(want[i][s], *arcs)
        assert dist == want


def test_empty(spark):
    assert got(spark, []) == []
    gone = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert got(spark, [(7, gone, "user", "x")]) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
