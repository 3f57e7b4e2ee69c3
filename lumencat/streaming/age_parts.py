"""Pending messages in parts by age, each with the marks of what has been taken (H2 as a stream).

Claims always take the oldest messages, so what a claim leaves of a part are the messages behind a
mark, and messages that came later. The state is a row per part that holds a pending message; a
message is written once when it arrives and never again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from lumencat import schemas
from lumencat.sources.storage import SnapshotTable

# ``marks``: after batch ``batch``, all messages that had come up to (age, id) were taken. Newest last,
# and each lower than those before it, as a mark makes earlier ones up to itself needless.
_MARK = T.StructType([T.StructField(name, T.LongType()) for name in ("batch", "age", "id")])
_STATE = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("since", T.LongType()), T.StructField("pending", T.LongType()),
    T.StructField("marks", T.ArrayType(_MARK)),
])
_ROWS = T.StructType([*schemas.MESSAGE_QUEUE.fields, T.StructField("age", T.LongType())])
_STORED = T.StructType([*_ROWS.fields, T.StructField("part", T.LongType()), T.StructField("batch", T.LongType())])
_NO_TIME = (1 << 63) - 1


class AgeParts:
    """Pending messages under ``root``, in parts of ``width`` seconds of their creation times.

    Ids are unique; messages without a time are the youngest. A batch that runs again replaces what
    it wrote, as its number is the version of the state and a folder in each part.
    """

    def __init__(self, spark: SparkSession, root: str, width: int = 3600):
        self.spark, self.messages, self.width = spark, f"{root.rstrip('/')}/messages", width
        self.state = SnapshotTable(spark, f"{root.rstrip('/')}/state", _STATE)

    def _aged(self, messages: DataFrame) -> DataFrame:
        age = F.coalesce(F.unix_micros("created_at"), F.lit(_NO_TIME))
        aged = messages.where("status = 'pending'").select("id", "payload", "status", "created_at", age.alias("age"))
        return aged.withColumn("part", F.floor(F.col("age") / (self.width * 1_000_000)).cast("long"))

    def add(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """Write the pending ones of ``messages``; returns the open parts with them counted in."""
        aged = self._aged(messages)
        # Sorted files let a read skip what lies before a mark; a busy part is cut over several tasks.
        order = ["part", "age", "id"]
        aged.withColumn("batch", F.lit(batch_id)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(self.messages)
        version = self.state.current_version(before=batch_id)
        before = self.spark.createDataFrame([], _STATE) if version is None else self.state.read(version)
        came = aged.groupBy("part").agg(F.count(F.lit(1)).alias("came"))
        return before.join(came, "part", "full_outer").select(
            "part", F.coalesce("since", F.lit(batch_id)).cast("long").alias("since"),
            (F.coalesce("pending", F.lit(0)) + F.coalesce("came", F.lit(0))).alias("pending"), "marks",
        )

    def _stored(self, parts: list[int]) -> DataFrame:
        folders = [f"{self.messages}/part={part}" for part in parts]
        return self.spark.read.schema(_STORED).option("basePath", self.messages).parquet(*folders)

    def oldest(self, open_parts: DataFrame, total: int) -> DataFrame:
        """Pending messages of the oldest parts that together hold ``total``, if there are so many."""
        # Each open part holds a message, so that at most ``total`` of them are looked at.
        rows, chosen, found = open_parts.orderBy("part").limit(total).collect(), [], 0
        for row in rows:
            if found >= total:
                break
            chosen.append(row)
            found += row["pending"]
        if not chosen:
            return self.spark.createDataFrame([], _STORED)
        return self._alive(self._unread(chosen), self.spark.createDataFrame(chosen, _STATE))

    def _unread(self, chosen: list[Row]) -> DataFrame:
        """Stored messages of ``chosen``; of the oldest marked part only what its last mark leaves."""
        marked = next((row for row in chosen if row["marks"]), None)
        if marked is None:
            return self._stored([row["part"] for row in chosen])
        last, own = marked["marks"][-1], self._stored([marked["part"]])
        # Two plain conjuncts each: folders are pruned by batch, row groups by age.
        pieces = [
            own.where((F.col("batch") <= last["batch"]) & (F.col("age") >= last["age"])), own.where(F.col("batch") > last["batch"]),
        ]
        others = [row["part"] for row in chosen if row is not marked]
        return reduce(DataFrame.unionByName, pieces + ([self._stored(others)] if others else []))

    @staticmethod
    def _alive(stored: DataFrame, parts: DataFrame) -> DataFrame:
        return stored.join(parts.select("part", "since", "marks"), "part").where(
            (F.col("batch") >= F.col("since")) & ~_taken()
        ).select(*_STORED.names)

    def taken(self, open_parts: DataFrame, oldest: DataFrame, ids: DataFrame, batch_id: int) -> None:
        """Commit the state without the messages ``ids``, which must be the oldest ones of ``oldest``."""
        last = F.max(F.struct(F.lit(batch_id).cast("long").alias("batch"), "age", "id"))
        gone = oldest.join(ids.select("id"), "id", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("gone"), last.alias("mark"))
        marks = F.coalesce("marks", F.array().cast(_STATE["marks"].dataType))
        ahead = F.filter(marks, lambda m: F.struct(m["age"], m["id"]) > F.struct(F.col("mark.age"), F.col("mark.id")))
        after = open_parts.join(gone, "part", "left").select(
            "part", "since", (F.col("pending") - F.coalesce("gone", F.lit(0))).alias("pending"),
            F.when(F.col("mark").isNull(), marks).otherwise(F.concat(ahead, F.array("mark"))).alias("marks"),
        )
        self.state.commit(after.where("pending > 0"), batch_id)

    def read(self) -> DataFrame:
        """All pending messages."""
        if self.state.current_version() is None:
            return self.spark.createDataFrame([], schemas.MESSAGE_QUEUE)
        stored = self.spark.read.schema(_STORED).parquet(self.messages)
        return self._alive(stored, self.state.read()).select(*schemas.MESSAGE_QUEUE.names)


def _taken() -> Column:
    """Whether a mark set at or after the batch of a message reaches it."""
    own = F.struct(F.col("age"), F.col("id"))
    return F.coalesce(
        F.exists("marks", lambda m: (m["batch"] >= F.col("batch")) & (F.struct(m["age"], m["id"]) >= own)), F.lit(False)
    )
