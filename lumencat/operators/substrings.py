"""D4 for many patterns at once: postings of grams over distinct texts, the rarest gram of a pattern first.

A pattern is compared only with texts that hold its rarest gram. What it hits are distinct texts; they
meet the assets by equality, so there is no join but equi-joins, and what they carry grows with hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
# Every text holds it; patterns of wildcards alone have no other.
_ANY = ""


def _cut(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters."""
    last = F.char_length(text) - (size - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(size)))


def text_grams(text: Column) -> Column:
    """The grams under which a text is posted: all of one to ``GRAM`` characters, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit(_ANY)), *[_cut(text, size) for size in range(1, GRAM + 1)]))


def pattern_grams(query: Column) -> Column:
    """Grams that every text with ``query`` in it holds: the longest pieces of each run between wildcards.

    A run is cut into pieces of ``GRAM`` characters, a shorter one is a gram itself.
    """
    runs = F.regexp_extract_all(query, F.lit(r"(?s)((?:\\.|[^%_\\])+)"), F.lit(1))
    plain = F.transform(runs, lambda run: F.regexp_replace(run, r"(?s)\\(.)", "$1"))
    pieces = F.flatten(F.transform(plain, lambda run: F.when(F.char_length(run) <= GRAM, F.array(run)).otherwise(_cut(run, GRAM))))
    return F.array_distinct(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit(_ANY))))


def _escaped(query: Column) -> Column:
    return F.regexp_replace(query, r"([\\%_])", r"\\$1")


def candidates(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, text) pairs to compare: texts with the rarest gram of the query.

    ``texts`` holds distinct lower-case ``text``, ``queries`` distinct lower-case ``query``. A query with a
    gram that no text holds has no pair.
    """
    grams = queries.select("query", F.explode(pattern_grams(F.col("query"))).alias("gram"))
    posted = texts.select("text", F.explode(text_grams(F.col("text"))).alias("gram"))
    # Only grams that some query has are counted and joined.
    used = posted.join(grams.select("gram").distinct(), "gram", "left_semi")
    known = used.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(known, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return rarest.where("best.n > 0").select("query", F.col("best.gram").alias("gram")).join(used, "gram").select("query", "text")


def substring_batch(
    assets: DataFrame, links: DataFrame, tags: DataFrame, patterns: DataFrame, column: str = "pattern", literal: bool = False,
) -> DataFrame:
    """(``column``, id) of every asset whose file name, type or any tag name contains the pattern.

    As ``catalog.substring_search``: case is ignored, and ``%``, ``_`` and ``\\`` are wildcards and escape
    unless ``literal``. A repeated pattern counts once, a NULL one finds nothing, an empty one or one of
    wildcards finds all texts that are long enough.
    """
    asked = patterns.select(F.col(column).alias("pattern")).where("pattern IS NOT NULL").distinct()
    query = F.lower(F.col("pattern"))
    asked = asked.select("pattern", (_escaped(query) if literal else query).alias("query"))
    parts = {
        "name": assets.select(F.col("id"), F.lower("file_name").alias("text")),
        "type": assets.select(F.col("id"), F.lower("asset_type").alias("text")),
        "tag": tags.select(F.col("id").alias("tag_id"), F.lower("name").alias("text")),
    }
    texts = parts["name"].select("text").union(parts["type"].select("text")).union(parts["tag"].select("text"))
    texts = texts.where("text IS NOT NULL").distinct()
    pairs = candidates(texts, asked.select("query").distinct())
    hits = pairs.where(F.like("text", F.concat(F.lit("%"), F.col("query"), F.lit("%")))).join(asked, "query").select("pattern", "text")
    # A link may outlive its asset. Links are met with the assets, as they are fewer than what patterns find by them.
    known = links.select("tag_id", F.col("asset_id").alias("id")).join(assets.select("id"), "id", "left_semi")
    tagged = hits.join(parts["tag"], "text").select("pattern", "tag_id").distinct()
    owners = tagged.join(known, "tag_id").select("pattern", "id")
    own = [hits.join(parts[part], "text").select("pattern", "id") for part in ("name", "type")]
    return own[0].union(own[1]).union(owners).distinct().select(F.col("pattern").alias(column), "id")
