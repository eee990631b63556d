"""The life of documents as stream state: transitions, what is stuck, late rows, and a restart."""

import datetime as dt
import random

import pytest

from scholium.streaming import activity

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "document_id long, ts timestamp, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def brute(rows):
    """The transitions of a document by plain rules."""
    old, since, attempt, spent, out = None, None, 0, {}, []
    for ts, new in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], str(r[1]))):
        ok = new in activity.NEXT_STATUS[old] or (new == "failed" and old in activity.WORKING)
        if ok:
            if new == "parsing" and old != new:
                attempt, spent = attempt + 1, {}
            elif new != old and old in activity.WORKING[1:]:
                spent[old] = (ts - since).total_seconds()
            since, was, old = since if new == old else ts, old, new
        else:
            was = old
        out.append((ts, was, new, ok, attempt, round(sum(spent.values()), 3)))
    return out


def plain(rows):
    return sorted(((r.document_id, r.ts, r.old_status, r.status, r.valid, r.attempt, r.work_seconds) for r in rows), key=repr)


def test_table_equals_plain_rules(rocks):
    rng = random.Random(5)
    rows = [(d, at(i * 10), rng.choice([*activity.WORKING, *activity.WORKING, "completed", "failed", "odd", None])) for d in range(30) for i in range(40)] + [(1, None, "uploaded")]
    got = activity.document_life(rocks.createDataFrame(rows, SCHEMA)).collect()
    want = [(d, *r) for d in range(30) for r in brute([(t, s) for e, t, s in rows if e == d])]
    assert plain(got) == sorted(want, key=repr)
    assert activity.document_life(rocks.createDataFrame([], SCHEMA)).count() == 0


def run(spark, tmp_path):
    """All rows so far: every trigger's rows are a folder that is overwritten when the trigger is run again."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    life = activity.document_life(stream, late="10 seconds", stuck=100, forget=1000)
    keep = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/trigger={n}"))
    q = life.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return plain(spark.read.parquet(str(tmp_path / "out")).collect())


def test_stream_stuck_late_and_restarted(rocks, tmp_path):
    rocks.conf.set("spark.sql.shuffle.partitions", "2")
    put = lambda rows: rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, at(0), "uploaded"), (1, at(5), "parsing"), (2, at(6), "uploaded"), (2, at(7), "completed")])
    first = run(rocks, tmp_path)
    assert first == sorted([(1, at(0), None, "uploaded", True, 0, 0.0), (1, at(5), "uploaded", "parsing", True, 1, 0.0), (2, at(6), None, "uploaded", True, 0, 0.0), (2, at(7), "uploaded", "completed", False, 0, 0.0)], key=repr)
    # after a restart the status is still known; time passes until document 1 is stuck, and a late row is dropped
    put([(1, at(25), "chunking"), (3, at(500), "uploaded")])
    run(rocks, tmp_path)
    put([(2, at(8), "parsing"), (3, at(501), "parsing")])
    later = run(rocks, tmp_path)
    assert (1, at(25), "parsing", "chunking", True, 1, 20.0) in later
    assert (1, at(125), "chunking", "failed", True, 1, 120.0) in later
    assert (2, at(106), "uploaded", "failed", True, 0, 0.0) in later
    assert not any(r[0] == 2 and r[3] == "parsing" for r in later)
    assert run(rocks, tmp_path) == later  # nothing new: the same rows
    rocks.conf.set("spark.sql.shuffle.partitions", "4")
