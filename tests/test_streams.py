"""Stream forms against their batch forms, over several micro-batches and restarts."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lumencat import schemas
from lumencat.operators import audit, cache, counts, work_queue
from lumencat.plans.streams import ROCKSDB
from lumencat.sources.storage import SnapshotTable, append, scan_stream
from lumencat.streaming import change_log, expiry, folds
from lumencat.streaming.age_parts import AgeParts
from tests.catalog_rows import rows
from tests.catalog_rows import catalog as make

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def test_counts_over_restarts(spark, tmp_path):
    assets = make(spark).assets
    states = [assets.limit(0), assets, assets.where("asset_type = 'image'"), assets.withColumn("asset_type", F.lit("video"))]
    feed, stored = str(tmp_path / "feed"), SnapshotTable(spark, str(tmp_path / "counts"), schemas.ASSET_COUNTS)
    for old, new in zip(states, states[1:]):
        append(audit.snapshot_changes(old, new, T0), feed)
        folds.maintain_counts(scan_stream(spark, feed, schema(spark, feed)), stored, str(tmp_path / "cp")).awaitTermination()
        assert rows(stored.read()) == rows(counts.count_by_type(new))


def schema(spark, path):
    return spark.read.parquet(path).schema


def test_a_repeated_batch_does_not_count_twice(spark, tmp_path):
    stored = SnapshotTable(spark, str(tmp_path / "counts"), schemas.ASSET_COUNTS)
    changes = audit.snapshot_changes(make(spark).assets.limit(0), make(spark).assets, T0)
    for batch in (0, 1, 1):
        before = stored.read(stored.current_version(before=batch))
        stored.commit(counts.apply_count_changes(before, changes), batch)
    assert rows(stored.read()) == [("image", 6), ("video", 4)]


def test_queue_over_restarts(spark, tmp_path):
    feed, claims = str(tmp_path / "feed"), str(tmp_path / "claims")
    pending = AgeParts(spark, str(tmp_path / "pending"))
    for batch in range(3):
        data = [(batch * 100 + i, "{}", "pending", T0 + (batch * 100 - i) * HOUR) for i in range(30)]
        append(spark.createDataFrame(data, schemas.MESSAGE_QUEUE).coalesce(1), feed)
        folds.hand_out(scan_stream(spark, feed, schemas.MESSAGE_QUEUE), pending, claims, str(tmp_path / "cp"), 5, 4).awaitTermination()
    taken = spark.read.parquet(claims)
    assert taken.count() == taken.select("id").distinct().count() == 60
    # Older messages go first: batch 1 hands out the ten left over from batch 0.
    assert rows(taken.where("batch = 1 AND id < 100"), "id") == [(i,) for i in range(10)]
    assert rows(pending.read(), "id") == [(i,) for i in range(200, 230)]


def test_change_log(spark, tmp_path):
    columns = ["id", "name"]
    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    batches = [
        [(1, "a", 0, False), (2, "b", 0, False), (1, "a2", 1, False)],
        [(1, "a3", 2, False), (3, "c", 2, False), (9, None, 2, True), (2, "b", 2, True)],
        [(2, "back", 3, False), (3, "c", 3, False)],
    ]
    for batch in batches:
        data = spark.createDataFrame(batch, "id long, name string, seq long, deleted boolean").withColumn("at", F.lit(T0) + F.make_dt_interval(hours=F.col("seq").cast("int")))
        append(data.coalesce(1), feed)
        writes = scan_stream(spark, feed, data.schema)
        change_log.log_changes(writes, columns, log, str(tmp_path / "cp")).awaitTermination()
    logged = change_log.read_changes(spark, log)

    def name(image):
        return image and json.loads(image)["name"]

    got = sorted((r.seq, r.record_id, r.action, name(r.old_data), name(r.new_data)) for r in logged.collect())
    assert got == [
        (0, 1, "INSERT", None, "a"), (0, 2, "INSERT", None, "b"), (1, 1, "UPDATE", "a", "a2"), (2, 1, "UPDATE", "a2", "a3"), (2, 2, "DELETE", "b", None),
        (2, 3, "INSERT", None, "c"), (3, 2, "INSERT", None, "back"), (3, 3, "UPDATE", "c", "c"),
    ]


def test_cache_purges_by_event_time(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    steps = [
        [("a", "1", 0, 3600), ("b", "1", 0, None), ("c", "1", 0, 36000)],
        [("c", "2", 1, 1800), ("d", "1", 2, None)],
        [("a", "late", 6, 3600), ("e", "1", 6, None)],
        # Far behind the clock: a key that never expires, one long expired, one older than what is stored.
        [("f", "1", -12, None), ("g", "1", -12, 3600), ("e", "old", -12, None)],
        [("h", "1", 6, None)],
    ]
    everything = []
    for n, step in enumerate(steps):
        everything += [(k, v, T0 + at * HOUR, n, ttl) for k, v, at, ttl in step]
        append(spark.createDataFrame([r for r in everything if r[3] == n], schemas.CACHE_PUTS).coalesce(1), feed)
        puts = scan_stream(spark, feed, schemas.CACHE_PUTS)
        expiry.maintain_cache(cache.entries(puts), out, str(tmp_path / "cp")).awaitTermination()
    live = expiry.live_entries(spark.read.schema(expiry.EVENTS).parquet(out))
    batch = cache.entries(spark.createDataFrame(everything, schemas.CACHE_PUTS))
    want = cache.purge(cache.put(batch.limit(0), spark.createDataFrame(everything, schemas.CACHE_PUTS)), T0 + 5 * HOUR)
    assert rows(live, "key", "value") == rows(want, "key", "value") == [
        ("a", "late"), ("b", "1"), ("d", "1"), ("e", "1"), ("f", "1"), ("h", "1")]


@pytest.mark.parametrize("files", [1, 10])
def test_every_write_of_a_busy_record_is_logged(spark, tmp_path, files):
    """Many writes of one record in one micro-batch, however the batch is filed."""
    n = 400
    data = [(1, f"v{k}", k, k % 7 == 3) for k in range(n)] + [(2, f"w{k}", k, False) for k in range(5)]
    rows_ = spark.createDataFrame(data, "id long, name string, seq long, deleted boolean").withColumn("at", F.lit(T0))
    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    append(rows_.repartition(files), feed)
    writes = scan_stream(spark, feed, rows_.schema)
    change_log.log_changes(writes, ["id", "name"], log, str(tmp_path / "cp")).awaitTermination()
    got = {(r.record_id, r.seq): (r.action, r.old_data and json.loads(r.old_data)["name"], r.new_data and json.loads(r.new_data)["name"])
           for r in change_log.read_changes(spark, log).collect()}
    want, image = {}, {}
    for record, name, seq, deleted in data:
        old, new = image.get(record), None if deleted else name
        if old or new:
            want[record, seq] = ("INSERT" if old is None else "DELETE" if new is None else "UPDATE", old, new)
        image[record] = new
    assert got == want


def test_images_survive_folding(spark, tmp_path):
    images = change_log.Images(spark, str(tmp_path / "images"), fold_after=2)
    for batch in range(6):
        rows_ = [(batch, f"i{batch}"), (100, f"h{batch}"), (batch - 1, None)]
        images.write(spark.createDataFrame(rows_, "record_id long, image string"), batch)
    got = {r.record_id: r.image for r in images.before(6).where("image IS NOT NULL").collect()}
    assert got == {100: "h5", 5: "i5"} and images.base.current_version() == 4
    assert {r.record_id: r.image for r in images.before(3).where("image IS NOT NULL").collect()} == {100: "h2", 2: "i2"}


def test_a_reader_outlives_a_repeated_commit(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), schemas.ASSET_COUNTS, keep=3)
    make_rows = lambda n: spark.createDataFrame([("image", n)], schemas.ASSET_COUNTS)
    table.commit(make_rows(1), 7)
    opened = table.read()
    table.commit(make_rows(2), 7)
    assert rows(opened) == [("image", 1)] and rows(table.read()) == [("image", 2)]
    for n in range(12):
        table.commit(make_rows(n))
    assert rows(table.read()) == [("image", 11)] and table.current_version() == 19
    assert len(list((tmp_path / "t" / "log").iterdir())) == 8
    with pytest.raises(ValueError):
        table.read(7)


def _step(pending, claims, spark, data, batch, per_worker, workers):
    """One micro-batch of ``hand_out`` on given messages; returns the ids handed out, oldest first."""
    queue = spark.createDataFrame(data, schemas.MESSAGE_QUEUE)
    open_parts = pending.add(queue, batch)
    oldest = pending.oldest(open_parts, per_worker * workers)
    given = work_queue.claim(oldest, oldest.select("id").limit(0), per_worker, workers, batch)
    given.write.mode("overwrite").parquet(f"{claims}/batch={batch}")
    given = spark.read.parquet(f"{claims}/batch={batch}")
    pending.taken(open_parts, oldest, given, batch)
    return [r.id for r in given.orderBy("turn", "worker").collect()], oldest


def test_queue_takes_the_oldest_at_every_step(spark, tmp_path):
    """Late and timeless messages, ties, parts that close and open again, and a repeated batch."""
    pending, claims = AgeParts(spark, str(tmp_path / "pending")), str(tmp_path / "claims")
    rng = random.Random(7)
    backlog: dict[int, tuple] = {}
    n = 0
    for batch in range(6):
        data = []
        for _ in range([40, 0, 15, 3, 30, 2][batch]):
            n += 1
            at = None if n % 11 == 0 else T0 + dt.timedelta(minutes=10 * rng.randrange(40 - 5 * batch))
            data.append((n, "{}", "done" if n % 13 == 0 else "pending", at))
        for message in data:
            if message[2] == "pending":
                backlog[message[0]] = (message[3] is None, message[3] or T0, message[0])
        want = sorted(backlog, key=backlog.get)[:12]
        for _ in range(2 if batch in (0, 3) else 1):
            assert _step(pending, claims, spark, data, batch, 4, 3)[0] == want
        for taken in want:
            del backlog[taken]
        assert sorted(rows(pending.read(), "id")) == sorted((k,) for k in backlog)


def test_queue_writes_no_more_than_arrives_and_goes(spark, tmp_path):
    pending, claims = AgeParts(spark, str(tmp_path / "pending")), str(tmp_path / "claims")
    load = lambda first, count: [(first + i, "{}", "pending", T0 + i * HOUR / 20) for i in range(count)]
    assert _step(pending, claims, spark, load(0, 4000), 0, 5, 2)[0] == list(range(10))
    for batch in range(1, 4):
        taken, read = _step(pending, claims, spark, load(4000 * batch, 20), batch, 5, 2)
        assert len(taken) == 10
        files = spark.read.parquet(f"{tmp_path}/pending/messages").where(f"batch = {batch}")
        assert files.count() == 20 and spark.read.parquet(f"{claims}/batch={batch}").count() == 10
        # 200 parts of 20 messages: the state is a row per part, and a claim sees one or two of them.
        assert pending.state.read().count() <= 201
        assert read.select("part").distinct().count() <= 2


def test_a_busy_part_is_read_behind_its_mark(spark, tmp_path):
    pending, claims = AgeParts(spark, str(tmp_path / "pending"), width=10**9), str(tmp_path / "claims")
    _step(pending, claims, spark, [(i, "{}", "pending", T0 + i * HOUR) for i in range(500)], 0, 100, 4)
    chosen = pending.state.read().collect()
    assert [r.pending for r in chosen] == [100]
    assert pending._unread(chosen).count() == 101
    plan = pending._unread(chosen)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(age" in plan
