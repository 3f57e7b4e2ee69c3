"""Token totals by source, language and tokenizer version, kept up by signed changes (operator 8).

A batch of changes is added up before it is written, so a commit stores a row per group and not per
document. It becomes visible by one row in the log, which names its folder. A batch whose id is in
the log is not counted again, whether a caller repeats it or two writers race: readers take one
folder per id. ``compact`` folds what is committed into one folder; batches that land meanwhile,
and other compactions, neither get lost nor count twice.

Defined cases: null group columns form groups of their own; null counts are 0; unknown kinds of
change are an error; repeated rows of a batch count each (a batch is a bag of changes); an empty
batch commits; groups that fall back to nothing leave the totals; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

GROUP = ["source", "lang", "tokenizer"]
_LOG = "batch_id string, folder string, at timestamp, covers array<string>"
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """(group, docs, tokens) of ``changes`` (kind, group, n_tokens, old_tokens).

    insert adds a document and n_tokens, delete takes them away, revise replaces old_tokens.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("kind") == "insert", n).when(F.col("kind") == "delete", -n).otherwise(n - old)
    return changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """The totals under ``path``; writers may repeat a batch at any time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """One row per batch id: of several, the first that was logged."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)
        first = Window.partitionBy("batch_id").orderBy("at", "folder")
        return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def _publish(self, rows: DataFrame, batch_id: str, covers: list[str]) -> None:
        folder = f"{self.path}/deltas-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        entry = self.spark.createDataFrame([(batch_id, folder, covers)], "batch_id string, folder string, covers array<string>")
        entry.withColumn("at", F.current_timestamp()).select("batch_id", "folder", "at", "covers").coalesce(1).write.mode(
            "append").parquet(f"{self.path}/log")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Count ``changes`` in, once; False if the batch was there already."""
        if not self.log().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        self._publish(deltas(changes), batch_id, [])
        return True

    def _live(self) -> dict[str, str]:
        """batch_id -> folder of what counts. The log has a row per commit, and is read once.

        A compaction stands for what it covers if all of that counts so far, else it is passed over;
        so whatever compactions race or overlap, each batch counts through one folder.
        """
        log = sorted(self.log().collect(), key=lambda r: (r["at"], r["folder"]))
        live = {r["batch_id"]: r["folder"] for r in log if not r["covers"]}
        for r in log:
            if r["covers"] and all(b in live for b in r["covers"]):
                for b in r["covers"]:
                    del live[b]
                live[r["batch_id"]] = r["folder"]
        return live

    def _sum(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*folders)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all commits."""
        return self._sum(sorted(self._live().values()))

    def compact(self) -> None:
        """Fold what counts now into one folder, named after it; the batches stay known."""
        live = self._live()
        if len(live) > 1:
            covers = sorted(live)
            name = hashlib.sha256(json.dumps(covers).encode()).hexdigest()
            self._publish(self._sum([live[b] for b in covers]), f"compaction-{name}", covers)
