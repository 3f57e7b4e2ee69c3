"""The best k documents of each of many queries (F2, F3), with bounds that stop candidates early.

A document's score is the sum of what each term gives it, and no document gets more from a term than
the term's best. The most promising candidates of a query are scored first; of the others only those
are scored that could still reach the k-th best score found. A document's terms lie in one row, so that a
candidate is scored where it stands, without a lookup in the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumencat.operators.search import DIGITS, asked_terms, weighted_tf
from lumencat.sources.storage import materialize

# Scores that agree to ``DIGITS`` digits tie, so a bound this much below the k-th best may still count.
_MARGIN = 2 * 10.0 ** -DIGITS


def starts(impacts: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, id, terms, needed, bound) of the documents with a query's rarest term.

    ``impacts`` is (id, term, impact) and may have more columns, which are kept; ``words`` the distinct
    (query_id, term); a query with a term that no document holds has no row.
    """
    return _candidates(impacts, _plans(impacts, words))


def _candidates(impacts: DataFrame, plans: DataFrame) -> DataFrame:
    more = [c for c in impacts.columns if c not in ("id", "term", "impact")]
    return impacts.join(plans, "term").select("query_id", "id", "terms", "needed", (F.col("impact") + F.col("others")).alias("bound"), *more)


def _plans(impacts: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, term, others, needed, terms): each query's rarest term, and what its others give at best."""
    sizes = impacts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top"))
    plans = words.join(sizes, "term", "left").groupBy("query_id").agg(
        F.min_by(F.struct("term", "top"), F.struct("df", "term")).alias("rarest"), F.sum("top").alias("tops"),
        F.count(F.lit(1)).alias("needed"), F.count("df").alias("known"), F.collect_list("term").alias("terms"),
    ).where("known = needed")
    return plans.select("query_id", F.col("rarest.term").alias("term"), (F.col("tops") - F.col("rarest.top")).alias("others"), "needed", "terms")


def _best(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each query with their ``place``; Spark keeps k per task before it shuffles."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed.where(F.col("place") <= k)


def _scored(candidates: DataFrame, impacts: DataFrame) -> DataFrame:
    """(query_id, id, score) of the candidates that hold every term, looked up in ``impacts`` (id, term, impact)."""
    probes = candidates.select("query_id", "id", "needed", F.explode("terms").alias("term"))
    return probes.join(impacts, ["id", "term"]).groupBy("query_id", "id", "needed").agg(
        F.count(F.lit(1)).alias("found"), F.sum("impact").alias("score")
    ).where("found = needed").select("query_id", "id", "score")


def _scored_in_place(candidates: DataFrame) -> DataFrame:
    """(query_id, id, score) of the candidates that hold every term, by their own ``impacts`` (term to impact)."""
    score = F.aggregate("terms", F.lit(0.0), lambda total, term: total + F.try_element_at("impacts", term))
    return candidates.select("query_id", "id", score.alias("score")).where("score IS NOT NULL")


def _reached(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, reached): the k-th best score, of queries that have so many."""
    return _best(scored, [F.desc("score"), "id"], k).where(F.col("place") == k).select("query_id", F.col("score").alias("reached"))


def still_open(candidates: DataFrame, first: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Candidates outside ``first`` whose bound reaches the k-th best of ``scored``, all where there is none."""
    rest = candidates.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti").join(_reached(scored, k), "query_id", "left")
    return rest.where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - _MARGIN)).drop("reached")


def top_batch(
    postings: DataFrame, queries: DataFrame, k: int, config: str = "simple", keep_compound: bool = False, ahead: int = 4,
) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best documents of each query (query_id, query) by ``search.rank``.

    The same rows as ranking all of ``search.match_batch``. ``ahead`` times ``k`` candidates of a query are
    scored in the first round; it changes the work only.
    """
    words = materialize(asked_terms(queries, config, keep_compound), "query-terms")
    asked = postings.join(words.select("term").distinct(), "term", "left_semi")
    impacts = asked.where("id IS NOT NULL").repartition("id").groupBy("id", "term").agg(weighted_tf().alias("impact"))
    held = F.map_from_entries(F.collect_list(F.struct("term", "impact"))).alias("impacts")
    documents = materialize(impacts.groupBy("id").agg(held), "impacts")
    impacts = documents.select("id", "impacts", F.explode("impacts").alias("term", "impact"))
    plans = materialize(_plans(impacts, words), "query-plans")
    # All queries of one rarest term order its documents alike, so that order is made once for all.
    by_impact = Window.partitionBy("term").orderBy(F.desc("impact"), "id")
    rarest = impacts.select("id", "term", "impact").join(plans.select("term").distinct(), "term", "left_semi")
    ahead_of = rarest.withColumn("place", F.row_number().over(by_impact)).where(F.col("place") <= ahead * k).select("id", "term")
    first = materialize(_candidates(ahead_of.join(documents, "id").withColumn("impact", F.try_element_at("impacts", "term")), plans), "first")
    scored = materialize(_scored_in_place(first), "scored")
    # What is scored below the k-th best found is no result either.
    later = _scored_in_place(still_open(_candidates(impacts, plans), first, scored, k)).join(_reached(scored, k), "query_id", "left")
    later = later.where(F.col("reached").isNull() | (F.col("score") >= F.col("reached") - _MARGIN)).drop("reached")
    best = _best(scored.unionByName(later), [F.round("score", DIGITS).desc(), "id"], k)
    return best.select("query_id", "id", "score", F.col("place").alias("rank"))
