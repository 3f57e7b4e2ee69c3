"""Weighted full-text search (F1 to F4) on a table of postings (id, weight, term, tf).

Class A holds terms of the file name, class B terms of the tag names. The postings are an ordinary
table: written sorted by term, a query for a few terms reads only their row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.functions.text import asked_terms, counted_terms, query_terms
from lumencat.operators.catalog import tag_names
from lumencat.operators.ordered import rank_rows
from lumencat.sources.storage import materialize

# The documented default weights of the four classes.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
BM25_K1, BM25_B = 1.2, 0.75
# Sums in another order differ beyond these digits.
DIGITS = 6


def field_postings(
    texts: DataFrame, config: str = "simple", keep_compound: bool = False,
) -> DataFrame:
    """Postings of (id, weight, text) rows, one row per (id, weight); a narrow pass."""
    return counted_terms(texts.select("id", "weight", "text"), "text", config, keep_compound).select(
        "id", "weight", "term", "tf"
    )


def build_index(
    assets: DataFrame, links: DataFrame, tags: DataFrame, config: str = "simple", keep_compound: bool = False,
) -> DataFrame:
    """postings of all assets, file name as class A and tag names as class B.

    A tag name is split and stemmed once, not once per link. File names are counted in their rows;
    only the terms of the tags, which come from many links, meet in a shuffle.
    """
    names = field_postings(
        assets.select("id", F.lit("A").alias("weight"), F.col("file_name").alias("text")), config, keep_compound
    )
    words = counted_terms(tags.select(F.col("id").alias("tag_id"), "name"), "name", config, keep_compound)
    tagged = (
        links.select("asset_id", "tag_id").join(words, "tag_id")
        .groupBy(F.col("asset_id").alias("id"), F.lit("B").alias("weight"), "term")
        .agg(F.sum("tf").alias("tf"))
    )
    return names.unionByName(tagged)


def write_index(postings: DataFrame, path: str) -> None:
    """Store postings clustered by term, so that term filters skip row groups."""
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, documents, occurrences) of an index; combines before the shuffle."""
    return postings.groupBy("term").agg(
        F.count_distinct("id").alias("documents"), F.sum("tf").alias("occurrences")
    )


def _class_weight() -> Column:
    pairs = [x for c, w in CLASS_WEIGHTS.items() for x in (F.lit(c), F.lit(w))]
    return F.element_at(F.create_map(*pairs), F.col("weight"))


def weighted_tf() -> Column:
    """More hits count more, with saturation; class A counts above class B."""
    return F.sum(_class_weight() * F.col("tf") / (F.col("tf") + F.lit(1.0)))


def _holding_all(hits: DataFrame, keys: Sequence[str], needed: Column | int) -> DataFrame:
    """Documents with every term of the query, with their score; a group is one query's terms."""
    return (
        hits.groupBy(*keys)
        .agg(F.size(F.collect_set("term")).alias("found"), weighted_tf().alias("score"))
        .where(F.col("found") == needed)
    )


def match(
    postings: DataFrame, query: str, config: str = "simple", keep_compound: bool = False,
    scorer: str = "weighted_tf",
) -> DataFrame:
    """F2 + F3 for one query: (id, score) of assets that hold every term; no term, no match."""
    wanted = query_terms(postings.sparkSession, query, config, keep_compound)
    hits = postings.where(F.col("term").isin(wanted)) if wanted else postings.where(F.lit(False))
    if scorer == "bm25f":
        return _bm25f(postings, hits, len(wanted))
    return _holding_all(hits, ["id"], len(wanted)).select("id", "score")


def _bm25f(postings: DataFrame, hits: DataFrame, needed: int) -> DataFrame:
    """BM25F: field frequencies are normalised by field length and weighted, then saturated."""
    lengths = postings.groupBy("id", "weight").agg(F.sum("tf").alias("length"))
    documents = postings.agg(F.count_distinct("id")).first()[0]
    # One row per class and one row per query term.
    averages = lengths.groupBy("weight").agg(F.avg("length").alias("average"))
    holders = hits.groupBy("term").agg(F.count_distinct("id").alias("df"))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - BM25_B + BM25_B * F.col("length") / F.col("average")
    per_term = (
        hits.join(lengths, ["id", "weight"])
        .join(F.broadcast(averages), "weight")
        .groupBy("id", "term").agg(F.sum(_class_weight() * F.col("tf") / norm).alias("pseudo"))
        .join(F.broadcast(holders), "term")
    )
    return (
        per_term.groupBy("id")
        .agg(F.count(F.lit(1)).alias("found"),
             F.sum(idf * F.col("pseudo") / (F.lit(BM25_K1) + F.col("pseudo"))).alias("score"))
        .where(F.col("found") == needed)
        .select("id", "score")
    )


def match_batch(
    postings: DataFrame, queries: DataFrame, config: str = "simple", keep_compound: bool = False,
) -> DataFrame:
    """F2 + F3 for many queries (query_id, query): (query_id, id, score).

    Each query starts from its rarest term, so common terms are only looked up for documents that
    can still match, by (id, term).
    """
    words = materialize(asked_terms(queries, config, keep_compound), "query-terms")
    asked = words.select("term").distinct()
    sizes = materialize(
        postings.select("term").join(asked, "term", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "query-term-sizes",
    )
    counted = words.join(sizes, "term", "left")
    plans = materialize(
        counted.groupBy("query_id").agg(
            F.min_by("term", F.struct("df", "term")).alias("term"),
            F.count(F.lit(1)).alias("needed"),
            F.count("df").alias("known"),
            F.sort_array(F.collect_set("term")).alias("terms"),
        ).where("known = needed").drop("known"),
        "query-plans",
    )
    starts = postings.select("id", "term").join(plans.select("term", "query_id"), "term")
    candidates = starts.select("query_id", "id").distinct()
    probes = materialize(
        candidates.join(plans.select("query_id", "terms", "needed"), "query_id")
        .select("query_id", "id", "needed", F.explode("terms").alias("term")),
        "query-probes",
    )
    hits = postings.join(probes, ["id", "term"])
    found = _holding_all(hits, ["query_id", "needed", "id"], F.col("needed"))
    return found.select("query_id", "id", "score")


def rank(matches: DataFrame) -> DataFrame:
    """``matches`` with their ``rank`` from 1, best first; scores that agree to ``DIGITS`` digits tie, by id."""
    return rank_rows(matches, [F.round("score", DIGITS).desc(), "id"], "rank").orderBy("rank")


def search(
    assets: DataFrame, links: DataFrame, tags: DataFrame, postings: DataFrame, query: str,
    config: str = "simple", keep_compound: bool = False, scorer: str = "weighted_tf",
) -> DataFrame:
    """(id, file_name, asset_type, tags, score, rank) of matching assets, best first."""
    found = materialize(match(postings, query, config, keep_compound, scorer), "matches")
    named = tag_names(links.join(found.select(F.col("id").alias("asset_id")), "asset_id", "left_semi"), tags)
    rows = (
        assets.select("id", "file_name", "asset_type")
        .join(found, "id")
        .join(named.withColumnRenamed("asset_id", "id"), "id", "left")
        .select(
            "id", "file_name", "asset_type",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "score",
        )
    )
    return rank(rows)
