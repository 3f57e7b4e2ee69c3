"""G, H, I and the versioned tables behind them."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lumencat import schemas
from lumencat.operators import audit, cache, counts, work_queue
from tests.catalog_rows import BARE, rows
from tests.catalog_rows import catalog as make

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)


def _puts(spark, data):
    return spark.createDataFrame([(k, v, T0 + at * HOUR, n, ttl) for n, (k, v, at, ttl) in enumerate(data)], schemas.CACHE_PUTS)


PUTS = [
    ("gone", "1", 0, 3600), ("edge", "1", 0, 7200), ("kept", "1", 0, None),
    ("hidden", "old", 0, 36000), ("hidden", "new", 1, 1800), ("tie", "a", 1, None), ("tie", "b", 1, None), ("later", "1", 5, None),
]


def test_last_write_counts_before_expiry(spark):
    table = cache.entries(_puts(spark, PUTS))
    asked = spark.createDataFrame([(k,) for k in ("gone", "edge", "kept", "hidden", "tie", "later", "never", "edge")], "key string")
    assert rows(cache.get(table, asked, T0 + 2 * HOUR), "key", "value") == sorted([
        ("gone", None), ("edge", "1"), ("kept", "1"), ("hidden", None), ("tie", "b"), ("later", None), ("never", None),
    ], key=repr)


def test_put_and_purge(spark):
    puts = _puts(spark, PUTS)
    table = cache.put(cache.entries(puts.limit(0)), puts)
    assert table.count() == 6
    assert rows(cache.put(table, puts)) == rows(table)
    assert rows(cache.purge(table, T0 + 2 * HOUR), "key") == [("edge",), ("kept",), ("later",), ("tie",)]


def test_many_gets_equal_single_gets(spark):
    puts = _puts(spark, PUTS)
    asks = [(n, k, T0 + at * dt.timedelta(minutes=30)) for n, (k, at) in enumerate(
        (k, at) for k in ("gone", "edge", "kept", "hidden", "tie", "later", "never") for at in range(0, 12)
    )]
    got = cache.get_many(puts, spark.createDataFrame(asks, "get_id long, key string, as_of timestamp"))

    def single(key, as_of):
        seen = [(T0 + at * HOUR, n, v, ttl) for n, (k, v, at, ttl) in enumerate(PUTS) if k == key and T0 + at * HOUR <= as_of]
        if not seen:
            return None
        written, _, value, ttl = max(seen)
        return value if ttl is None or written + dt.timedelta(seconds=ttl) >= as_of else None

    assert rows(got, "get_id", "value") == sorted([(n, single(k, at)) for n, k, at in asks], key=repr)


def _queue(spark, n=1000):
    rng = random.Random(1)
    data = [(i, json.dumps({"n": i}), rng.choice(["pending", "pending", "processing"]), T0 + rng.randrange(40) * HOUR) for i in range(n)]
    return data, spark.createDataFrame(data, schemas.MESSAGE_QUEUE)


def test_claims_are_oldest_first_and_never_repeat(spark):
    data, queue = _queue(spark)
    order = [i for i, _, s, _ in sorted(data, key=lambda m: (m[3], m[0])) if s == "pending"]
    claims = spark.createDataFrame([], "id long, payload string, worker int, turn long, batch_id long")
    for batch in range(3):
        got = work_queue.claim(queue, claims, 100, 3, batch)
        taken = sorted(got.collect(), key=lambda r: (r.turn, r.worker))
        assert [r.id for r in taken] == order[batch * 300:(batch + 1) * 300]
        claims = spark.createDataFrame(taken, claims.schema).union(claims)
    marked = work_queue.mark_claimed(queue, claims)
    assert marked.where("status = 'pending'").count() == max(0, len(order) - 900)
    assert sum(r.messages for r in work_queue.backlog(marked).collect()) == len(data)


def test_enqueue_continues_ids(spark):
    _, queue = _queue(spark, 10)
    new = work_queue.enqueue(queue, spark.createDataFrame([("b",), ("a",)], "payload string"), T0, ["payload"])
    assert rows(new, "id", "payload", "status") == [(10, "a", "pending"), (11, "b", "pending")]


@pytest.fixture(scope="module")
def states(spark):
    old = make(spark, BARE).assets
    new = old.where("id <> 2").withColumn("file_size", F.when(F.col("id") == 3, 1).otherwise(F.col("file_size"))).withColumn(
        "lon", F.when(F.col("id") != 4, F.col("lon"))
    ).union(spark.createDataFrame([(7, "video", "n", "/n", 1, T0, T0, None, 3.5)], schemas.ASSETS))
    return old, new


def test_changes_and_replay(spark, states):
    old, new = states
    empty = spark.createDataFrame([], schemas.AUDIT_LOG)
    log = audit.append_log(empty, audit.snapshot_changes(old.limit(0), old, T0))
    log = log.union(audit.append_log(log, audit.snapshot_changes(old, new, T0 + HOUR)))
    later = [(r.action, r.record_id) for r in log.where(F.col("changed_at") > T0).orderBy("id").collect()]
    assert later == [("DELETE", 2), ("UPDATE", 3), ("UPDATE", 4), ("INSERT", 7)]
    assert [r.id for r in log.orderBy("id").collect()] == list(range(1, 11))
    gone = log.where("action = 'DELETE'").first()
    assert gone.new_data is None and json.loads(gone.old_data)["file_name"] == "mountain1.png"
    assert "lon" in json.loads(log.where("record_id = 6").first().new_data)
    for at, state in ((T0, old), (T0 + HOUR, new)):
        again = audit.replay(log, at, state.schema)
        assert again.exceptAll(state).isEmpty() and state.exceptAll(again).isEmpty()


def test_feed_keeps_updates_that_change_nothing(states):
    old, _ = states
    row = F.struct(*old.columns)
    inserted = old.select(F.lit(None).cast(old.select(row.alias("r")).schema["r"].dataType).alias("old"), row.alias("new"))
    feed = inserted.unionByName(old.select(row.alias("old"), row.alias("new")))
    assert rows(audit.feed_changes(feed, T0).groupBy("action").count()) == [("INSERT", 6), ("UPDATE", 6)]
    assert audit.snapshot_changes(old, old, T0).isEmpty()


def test_incremental_counts_equal_a_recount(states):
    old, new = states
    for before, after in ((old, new), (new, old), (old, old.limit(0)), (old.limit(0), new)):
        moved = counts.apply_count_changes(counts.count_by_type(before), audit.snapshot_changes(before, after, T0))
        assert rows(moved) == rows(counts.count_by_type(after))
