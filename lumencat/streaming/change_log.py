"""Stream form of the change log (I1): every write of a record becomes a change row.

The writes of a micro-batch are put in order together with the images before it, and each write gets
the image before it from its neighbour, so a record of any number of writes spans many tasks. The
images are kept as one small table per micro-batch over a base that is renewed now and then.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lumencat import schemas
from lumencat.functions.documents import json_document
from lumencat.operators.ordered import carry_forward
from lumencat.sources.storage import SnapshotTable, materialize

# ``seq`` of the write orders the changes of one record.
CHANGES = T.StructType([*[f for f in schemas.AUDIT_LOG if f.name != "id"], T.StructField("seq", T.LongType())])
_IMAGE = "record_id long, image string, batch long"


class Images:
    """The newest image of every record: what each micro-batch wrote, over a base.

    A micro-batch writes the records that it touched and nothing else; every ``fold_after`` of them
    the base takes them in.
    """

    def __init__(self, spark: SparkSession, root: str, fold_after: int = 32):
        self.spark, self.root, self.fold_after = spark, root.rstrip("/"), fold_after
        self.base = SnapshotTable(spark, f"{self.root}/base", T._parse_datatype_string("record_id long, image string"))

    def _since(self, base: int | None, batch_id: int) -> DataFrame:
        try:
            written = self.spark.read.schema(_IMAGE).parquet(f"{self.root}/batches")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            written = self.spark.createDataFrame([], _IMAGE)
        written = written.where(F.col("batch") < batch_id)  # the folders of other batches are not read
        return written if base is None else written.where(F.col("batch") > base)

    def before(self, batch_id: int) -> DataFrame:
        """(record_id, image) as they stood before ``batch_id``; a NULL image is a deleted record."""
        base = self.base.current_version(before=batch_id)
        newest = self._since(base, batch_id).groupBy("record_id").agg(F.max_by(F.struct("image"), "batch").alias("last"))
        newest = newest.select("record_id", "last.image")
        if base is None:
            return newest
        return self.base.read(base).join(newest, "record_id", "left_anti").unionByName(newest)

    def write(self, images: DataFrame, batch_id: int) -> None:
        images.write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch_id}")
        if batch_id and batch_id % self.fold_after == 0:
            self.base.commit(self.before(batch_id + 1).where("image IS NOT NULL"), batch_id)


def _chained(writes: DataFrame, prior: DataFrame) -> DataFrame:
    """``writes`` (record_id, image, seq, at) with ``old``: the image before each write.

    Every write is a question and, right after it, an answer for the next one.
    """
    image = F.struct("image")
    no_image = F.lit(None).cast("struct<image:string>")
    tie = F.xxhash64("image")
    first = F.lit(-(1 << 63)).cast("long")
    asked = writes.select("record_id", "seq", tie.alias("tie"), F.lit(0).alias("kind"), no_image.alias("set"), image.alias("new"), "at")
    answers = writes.select("record_id", "seq", tie.alias("tie"), F.lit(1).alias("kind"), image.alias("set"), no_image.alias("new"), "at")
    known = prior.select(
        "record_id", first.alias("seq"), first.alias("tie"), F.lit(-1).alias("kind"), image.alias("set"), no_image.alias("new"),
        F.lit(None).cast("timestamp").alias("at"),
    )
    rows = asked.unionByName(answers).unionByName(known)
    return carry_forward(rows, "record_id", ["seq", "tie", "kind"], "set", "found")


def log_changes(
    writes: DataFrame, columns: list[str], path: str, checkpoint: str,
    key: str = "id", table: str = "assets", changed_by: str = "spark", trigger: dict | None = None,
) -> StreamingQuery:
    """Append a change row per write, under ``path``/changes; deleting an unknown record is none.

    ``writes`` holds whole rows (``columns``) with ``seq``, ``deleted`` and ``at``. A micro-batch that
    runs again replaces its own rows. ``trigger`` defaults to all that is there.
    """
    spark = writes.sparkSession
    images = Images(spark, f"{path}/images")
    image = F.when(~F.col("deleted"), json_document(F.struct(*columns)))
    numbered = writes.select(
        F.col(key).cast("long").alias("record_id"), image.alias("image"), F.col("seq").cast("long").alias("seq"), "at",
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "writes")
        touched = batch.select("record_id").distinct()
        chained = _chained(batch, images.before(batch_id).join(touched, "record_id", "left_semi"))
        old, new = F.col("found.image"), F.col("new.image")
        action = F.when(old.isNull(), "INSERT").when(new.isNull(), "DELETE").otherwise("UPDATE")
        changes = chained.where((F.col("kind") == 0) & (old.isNotNull() | new.isNotNull())).select(
            F.lit(table).alias("table_name"), "record_id", action.alias("action"), old.alias("old_data"), new.alias("new_data"),
            F.col("at").alias("changed_at"), F.lit(changed_by).alias("changed_by"), "seq",
        )
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        order = F.struct("seq", F.xxhash64("image"))
        last = batch.groupBy("record_id").agg(F.max_by(F.struct("image"), order).alias("last"))
        images.write(last.select("record_id", "last.image"), batch_id)

    return (
        numbered.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change rows under ``path``."""
    return spark.read.schema(CHANGES).parquet(f"{path}/changes")
