"""The change log by periods with full images between them: many (record, time) questions at once.

An image holds every record as it stood when a period began, so a question needs the nearest image
before its time and the log of the periods from there on. Neither older images nor older log is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from lumencat import schemas
from lumencat.operators.ordered import carry_forward
from lumencat.sources.storage import children

_LOG = T.StructType([*schemas.AUDIT_LOG.fields, T.StructField("period", T.LongType()), T.StructField("batch", T.LongType())])
_IMAGE = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("image", T.StringType()), T.StructField("base", T.LongType()),
])
# The first base: no image, all log from the beginning.
_NEVER = -(1 << 62)


class History:
    """Change rows (I1) under ``root``, in periods of ``width`` seconds of ``changed_at``.

    Changes without a time are kept and never found, as in ``audit.replay``. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, width: int):
        self.spark, self.root, self.width = spark, root.rstrip("/"), width

    def period(self, at: Column) -> Column:
        return F.floor(F.unix_micros(at) / (self.width * 1_000_000)).cast("long")

    def _start(self, period: Column) -> Column:
        return F.timestamp_micros(period * F.lit(self.width * 1_000_000).cast("long"))

    def images(self) -> list[int]:
        """The periods that have an image of their beginning, oldest first."""
        names = [n for n in children(self.spark, f"{self.root}/images") if n.startswith("base=")]
        done = [n for n in names if "_SUCCESS" in children(self.spark, f"{self.root}/images/{n}")]
        return sorted(int(n.removeprefix("base=")) for n in done)

    def append(self, changes: DataFrame, batch: int) -> None:
        """Add change rows; a batch that runs again replaces its own rows.

        Images of periods after a late change are made anew from the first of them on.
        """
        order = ["period", "record_id", "changed_at", "id"]
        rows = changes.select(*schemas.AUDIT_LOG.names, self.period(F.col("changed_at")).alias("period"), F.lit(batch).cast("long").alias("batch"))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(f"{self.root}/log")
        images = self.images()
        if images:
            earliest = rows.agg(F.min("period")).first()[0]
            for base in images:
                if earliest is not None and base > earliest:
                    self.seal(base)

    def log(self) -> DataFrame:
        if not children(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def _image(self, bases: Sequence[int]) -> DataFrame:
        folders = [f"{self.root}/images/base={base}" for base in bases if base != _NEVER]
        if not folders:
            return self.spark.createDataFrame([], _IMAGE)
        return self.spark.read.schema(_IMAGE).option("basePath", f"{self.root}/images").parquet(*folders)

    def seal(self, period: int) -> None:
        """Write the image of all records as they stood when ``period`` began, from the image before it."""
        base = max((b for b in self.images() if b < period), default=_NEVER)
        between = self.log().where((F.col("period") >= base) & (F.col("period") < period))
        newest = between.groupBy("record_id").agg(
            F.max_by(F.struct(F.when(F.col("action") != "DELETE", F.col("new_data")).alias("image")), F.struct("changed_at", "id")).alias("last")
        ).select("record_id", "last.image")
        kept = self._image([base]).select("record_id", "image").join(newest, "record_id", "left_anti")
        sealed = kept.unionByName(newest.where("image IS NOT NULL"))
        sealed.repartitionByRange("record_id").sortWithinPartitions("record_id").write.mode("overwrite").parquet(f"{self.root}/images/base={period}")

    def _needed(self, questions: DataFrame) -> list[Row]:
        """(base, last period) of the images that questions start from; a row per image at most."""
        return questions.where("base IS NOT NULL").groupBy("base").agg(F.max("period").alias("until")).collect()

    def _sources(self, needed: Sequence[Row]) -> tuple[DataFrame, DataFrame]:
        """The images and the log that ``needed`` names: literal conditions on folders."""
        wanted = F.lit(False)
        for row in needed:
            wanted = wanted | F.col("period").between(row["base"], row["until"])
        return self._image([row["base"] for row in needed]), self.log().where(wanted)

    def as_of(self, questions: DataFrame, record: str, at: str, name: str = "image") -> DataFrame:
        """``questions`` with ``name``: the record ``record`` as it stood at the time ``at``.

        NULL where there was no such record, or where the question has no record or no time. A change
        at the very time counts; changes at one time count in the order of their ids.
        """
        bases = F.array(*[F.lit(b).cast("long") for b in [_NEVER, *self.images()]])
        base = lambda period: F.array_max(F.filter(bases, lambda b: b <= period))
        asked = questions.select(
            F.struct(*[F.col(f"`{c}`") for c in questions.columns]).alias("asked"),
            F.col(record).cast("long").alias("record_id"), F.col(at).cast("timestamp").alias("time"),
        ).withColumn("period", self.period(F.col("time")))
        asked = asked.withColumn("base", base(F.col("period")))
        images, log = self._sources(self._needed(asked))
        answer, no_answer = "struct<image:string>", F.lit(None).cast("struct<image:string>")
        no_question = F.lit(None).cast(asked.schema["asked"].dataType)
        key = F.struct("base", "record_id").alias("key")
        image = F.struct(F.when(F.col("action") != "DELETE", F.col("new_data")).alias("image")).cast(answer)
        wanted = asked.select("base", "record_id").distinct()
        known = images.join(wanted, ["base", "record_id"], "left_semi").select(
            key, self._start(F.col("base")).alias("time"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"),
            F.struct("image").cast(answer).alias("set"), no_question.alias("asked"),
        )
        changed = log.withColumn("base", base(F.col("period"))).join(wanted, ["base", "record_id"], "left_semi").select(
            key, F.col("changed_at").alias("time"), F.lit(1).alias("kind"), "id", image.alias("set"), no_question.alias("asked"),
        )
        put = asked.select(key, "time", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("id"), no_answer.alias("set"), "asked")
        found = carry_forward(known.unionByName(changed).unionByName(put), "key", ["time", "kind", "id"], "set", "found")
        image = F.when(F.col("key.record_id").isNotNull() & F.col("time").isNotNull(), F.col("found.image"))
        return found.where("kind = 2").select("asked.*", image.alias(name))
