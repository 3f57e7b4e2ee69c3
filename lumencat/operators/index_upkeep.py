"""F1 kept up by changes: postings with the version that made them, the newest of a document's class counting.

A batch of changes names the (asset, class) pairs it touches; only their texts are made into postings
again, under the number of the batch. Postings of older versions of a touched pair no longer count,
which an anti-join with the touched pairs tells at reading; so a batch writes as much as it touches,
and what a deleted or emptied asset leaves is hidden by its pair alone. ``merge`` folds all into one
version, clustered by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumencat.operators.search import build_index, field_postings
from lumencat.sources.storage import children, intermediates, materialize, remove

PAIR = ["id", "weight"]


def touched(asset_changes: DataFrame, link_changes: DataFrame, tag_changes: DataFrame, links: DataFrame) -> DataFrame:
    """The (id, weight) pairs whose terms may have changed.

    ``asset_changes`` and ``tag_changes`` are change rows (I1), ``link_changes`` the links
    (asset_id, tag_id) that came or went, ``links`` all links after the batch. A new or renamed asset
    touches class A, a deleted one both classes; a renamed tag touches class B of every asset that has it.
    """
    named = lambda column: F.get_json_object(column, "$.file_name")
    changed = (F.col("action") != "UPDATE") | ~named("old_data").eqNullSafe(named("new_data"))
    # Both classes from one look at the changes, which a comparison of snapshots may stand behind.
    classes = F.array_compact(F.array(F.when(changed, "A"), F.when(F.col("action") == "DELETE", "B")))
    own = asset_changes.select(F.col("record_id").alias("id"), F.explode(classes).alias("weight"))
    label = lambda column: F.get_json_object(column, "$.name")
    renamed = tag_changes.where(~label("old_data").eqNullSafe(label("new_data"))).select(F.col("record_id").alias("tag_id"))
    of_tags = links.join(renamed, "tag_id", "left_semi").select(F.col("asset_id").alias("id"))
    tagged = link_changes.select(F.col("asset_id").alias("id")).union(of_tags)
    return own.union(tagged.withColumn("weight", F.lit("B"))).distinct()


def delta(
    pairs: DataFrame, assets: DataFrame, links: DataFrame, tags: DataFrame, config: str = "simple", keep_compound: bool = False,
) -> DataFrame:
    """Postings (id, weight, term, tf) of the touched ``pairs`` in the tables as they stand after the batch."""
    of = {c: pairs.where(F.col("weight") == c).select("id") for c in ("A", "B")}
    renamed = assets.join(of["A"], "id", "left_semi").select("id", F.lit("A").alias("weight"), F.col("file_name").alias("text"))
    known = of["B"].join(assets.select("id"), "id", "left_semi").select(F.col("id").alias("asset_id"))
    retagged = links.join(known, "asset_id", "left_semi")
    tagged = build_index(assets.select("id", "file_name").limit(0), retagged, tags, config, keep_compound)
    return field_postings(renamed, config, keep_compound).unionByName(tagged)


def current(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The postings that count: those of (id, weight) pairs that no later version touched.

    ``postings`` and ``pairs`` have a ``version``. A filter on terms reaches the postings' files.
    """
    later = pairs.groupBy(*PAIR).agg(F.max("version").alias("newest"))
    older = (F.col("p.id") == F.col("l.id")) & (F.col("p.weight") == F.col("l.weight")) & (F.col("p.version") < F.col("l.newest"))
    return postings.alias("p").join(later.alias("l"), older, "left_anti").select("id", "weight", "term", "tf")


class KeptIndex:
    """An index under ``root``: a folder of postings and one of touched pairs per version.

    A batch that comes again replaces its own version, so it counts once. One writer at a time.
    """

    _POSTINGS = "id long, weight string, term string, tf long, version long"
    _PAIRS = "id long, weight string, version long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, postings: DataFrame, pairs: DataFrame, version: int) -> None:
        """Store what version ``version`` makes of its touched ``pairs``, the pairs last: without them it doesn't hide anything.

        Ranges are cut after a look at all rows, so the postings are written first, lest they be made twice.
        """
        with intermediates() as made:
            rows = materialize(postings.select("id", "weight", "term", "tf"), "made-postings")
            ordered = rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
            ordered.write.mode("overwrite").parquet(f"{self.root}/postings/version={version}")
        remove(self.spark, made)
        pairs.select(*PAIR).write.mode("overwrite").parquet(f"{self.root}/pairs/version={version}")

    def start(self, assets: DataFrame, links: DataFrame, tags: DataFrame, config: str = "simple", keep_compound: bool = False) -> None:
        """Version 0: everything, and no pairs, as nothing is older."""
        built = build_index(assets, links, tags, config, keep_compound)
        self.write(built, self.spark.createDataFrame([], "id long, weight string"), 0)

    def apply(
        self, version: int, pairs: DataFrame, assets: DataFrame, links: DataFrame, tags: DataFrame,
        config: str = "simple", keep_compound: bool = False,
    ) -> None:
        """Count in a batch: ``pairs`` from ``touched``, and the tables as they stand after it."""
        self.write(delta(pairs, assets, links, tags, config, keep_compound), pairs, version)

    def read(self) -> DataFrame:
        """The postings that count; those of the newest version stand as they are, as no later one can hide them."""
        postings = self.spark.read.schema(self._POSTINGS).parquet(f"{self.root}/postings")
        pairs = self.spark.read.schema(self._PAIRS).parquet(f"{self.root}/pairs")
        versions = [int(n.removeprefix("version=")) for n in children(self.spark, f"{self.root}/pairs") if n.startswith("version=")]
        newest = max(versions, default=0)
        latest = postings.where(F.col("version") >= newest).select("id", "weight", "term", "tf")
        return latest.unionByName(current(postings.where(F.col("version") < newest), pairs))

    def merge(self, root: str) -> KeptIndex:
        """All that counts as version 0 of a new index under ``root``; this one stays for its readers."""
        merged = KeptIndex(self.spark, root)
        merged.write(self.read(), self.spark.createDataFrame([], "id long, weight string"), 0)
        return merged
