"""Many (record, time) questions against a replay of the whole log for each."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumencat import schemas
from lumencat.operators.history import History

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)
QUESTIONS = "q long, record long, at timestamp"


def change(n, record, hour, image):
    at = None if hour is None else T0 + hour * HOUR
    return (n, "assets", record, "DELETE" if image is None else "UPDATE", None, image, at, "t")


def truth(log, record, at):
    seen = [c for c in log if c[2] == record and c[6] is not None and at is not None and c[6] <= at]
    return max(seen, key=lambda c: (c[6], c[0]))[5] if seen else None


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """A log of ten days with a busy record, ties, deletes, a late batch and a repeated one."""
    rng = random.Random(3)
    history = History(spark, str(tmp_path_factory.mktemp("history")), 24 * 3600)
    log = []
    for n in range(600):
        record = 1 if rng.random() < 0.4 else rng.randrange(2, 12)
        log.append(change(n, record, rng.randrange(200), None if rng.random() < 0.2 else f'{{"v": {n}}}'))
    log.append(change(600, 5, None, '{"v": "never"}'))
    history.append(spark.createDataFrame(log[:400], schemas.AUDIT_LOG), 0)
    day = history.period(F.lit(T0))
    first = spark.range(1).select(day.alias("d")).first().d
    history.seal(first + 3)
    history.seal(first + 6)
    for _ in range(2):  # late changes: the images after them are made again
        history.append(spark.createDataFrame(log[400:], schemas.AUDIT_LOG), 1)
    return history, log, first


def test_every_question_gets_its_image(spark, kept):
    history, log, first = kept
    rng = random.Random(4)
    asked = [(q, 1 if q % 3 == 0 else rng.randrange(0, 13), T0 + rng.randrange(-20, 260) * HOUR) for q in range(500)]
    # Borders of periods, repeated rows, and questions without a record or a time.
    asked += [(900 + d, 1, T0 + 24 * d * HOUR) for d in range(10)] + [(950, 2, T0), (950, 2, T0), (951, None, T0), (952, 3, None)]
    got = history.as_of(spark.createDataFrame(asked, QUESTIONS).repartition(5), "record", "at")
    assert got.columns == ["q", "record", "at", "image"]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(((r.q, r.image) for r in got.collect()), key=key) == sorted(((q, truth(log, r, at)) for q, r, at in asked), key=key)


def test_log_before_the_nearest_image_is_not_read(spark, kept):
    history, log, first = kept
    assert history.images() == [first + 3, first + 6]
    late = spark.createDataFrame([(1, 1, T0 + 150 * HOUR)], QUESTIONS)
    placed = late.select(history.period(F.col("at")).alias("period")).withColumn("base", F.lit(first + 6))
    images, scanned = history._sources(history._needed(placed))
    assert {r.period for r in scanned.select("period").distinct().collect()} == {first + 6}
    assert {r.base for r in images.select("base").distinct().collect()} == {first + 6}
    partition_filters = scanned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    assert f">= {first + 6}" in partition_filters


def test_no_log_no_questions(spark, tmp_path):
    history = History(spark, str(tmp_path), 3600)
    one = spark.createDataFrame([(1, 1, T0)], QUESTIONS)
    assert [r.image for r in history.as_of(one, "record", "at").collect()] == [None]
    assert history.as_of(one.limit(0), "record", "at").collect() == []
    # Names of the operator's own columns are the questions' to use.
    clash = one.select(F.col("q").alias("base"), F.col("record").alias("key"), F.col("at").alias("time"), F.lit(7).alias("period"))
    assert history.as_of(clash, "key", "time").columns == ["base", "key", "time", "period", "image"]
