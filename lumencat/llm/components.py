"""Connected components of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumencat.sources.storage import materialize

ROWS_PER_FILE = 500_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Each round takes the smallest label of the neighbours and then the label of that label, so long
    chains shorten by jumps. Labels are written between rounds, in files by their number. Groups are summed before they
    shuffle, so a node with very many links is no burden.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).where("a != b")
    edges = materialize(edges.distinct(), "edges")
    files = 1 + edges.count() // ROWS_PER_FILE
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")).coalesce(files), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        nearer = labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = materialize(
            nearer.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")).coalesce(files), "labels")
        labels = moved.select("node", "label")
        if moved.where("label != was").isEmpty():
            return labels
