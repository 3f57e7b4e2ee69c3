"""Text configurations: how a text becomes an array of index terms.

``simple``   lower case, split on everything that is not a letter or digit.
``english``  the same, then stop words out and every word stemmed, through a dictionary of distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumencat.functions.stemming import may_change, with_stems
from lumencat.sources.storage import materialize

_SEPARATORS = r"[^\p{L}\p{N}]+"
_COMPOUND = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"

# The published English stop words of the Snowball project.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now
""".split()


def terms(text: Column, config: str = "simple", keep_compound: bool = False) -> Column:
    """Words of a text, in order and with repeats, before they are stemmed; NULL counts as empty text.

    ``keep_compound`` keeps dotted names such as ``clip1.mp4`` in one piece.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if keep_compound:
        words = F.regexp_extract_all(lowered, F.lit(_COMPOUND), F.lit(0))
    else:
        words = F.array_remove(F.split(lowered, _SEPARATORS), "")
    if config == "simple":
        return words
    if config != "english":
        raise ValueError(f"unknown text configuration {config!r}")
    return F.filter(words, lambda w: ~w.isin(*ENGLISH_STOP_WORDS))


def counted_terms(
    rows: DataFrame, text: str, config: str = "simple", keep_compound: bool = False,
) -> DataFrame:
    """One row per row and distinct term of column ``text``, with its frequency ``tf``.

    The words of a text are sorted inside their row and counted run by run, so nothing is shuffled.
    With ``english`` those counts are written, each distinct word with an ending that a stem may lose is
    stemmed once, the dictionary is joined back to these words (broadcast where it is small) and words of
    one stem are added up: rows that agree in all other columns then count as one.
    """
    kept = [c for c in rows.columns if c != text]
    words, n = F.col("__words"), F.size("__words")
    # Sorted words and run starts are columns of their own: both are read more than once below.
    laid = rows.select(*kept, F.sort_array(terms(F.col(text), config, keep_compound)).alias("__words")).select(
        *kept, "__words",
        F.filter(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: (i < n) & ((i == 0) | (F.get(words, i) != F.get(words, i - 1))),
        ).alias("__starts"),
    )
    runs = F.transform(
        "__starts",
        lambda start, i: F.struct(
            F.get(words, start).alias("term"),
            (F.coalesce(F.get("__starts", i + 1), n) - start).cast("long").alias("tf"),
        ),
    )
    counted = laid.select(*kept, F.inline(runs))
    if config == "simple":
        return counted
    counted = materialize(counted, "words")
    changing = counted.where(may_change(F.col("term")))
    dictionary = with_stems(changing.select("term").distinct())
    stemmed = changing.join(dictionary, "term").select(*kept, F.col("stem").alias("term"), "tf")
    same = counted.where(~may_change(F.col("term"))).select(*kept, "term", "tf")
    return stemmed.union(same).groupBy(*kept, "term").agg(F.sum("tf").alias("tf"))


def asked_terms(queries: DataFrame, config: str = "simple", keep_compound: bool = False) -> DataFrame:
    """(query_id, term): the distinct terms of each query (query_id, query)."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query"), config, keep_compound))).alias("term"))
    if config == "simple":
        return words
    return with_stems(words).select("query_id", F.col("stem").alias("term")).distinct()


def query_terms(
    spark: SparkSession, query: str, config: str = "simple", keep_compound: bool = False,
) -> list[str]:
    """Distinct terms of one query text, by the very expressions that build the index."""
    one = spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))
    return sorted(r["term"] for r in asked_terms(one, config, keep_compound).select("term").collect())
