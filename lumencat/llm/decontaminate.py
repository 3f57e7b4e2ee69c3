"""Benchmark decontamination by a broadcast hash set of n-grams (operator 5).

The windows of all benchmark items are hashed once and sent to every task, where the windows of the
documents are looked up as they are made: no document is shuffled. A hit is checked word by word.

Defined cases: null, empty and wordless texts have no words and no hits; an item without words
matches nothing, an item of fewer words than a window is one window of its own length; items of one
text count each under its own id; rows that repeat stay rows; null ids of items are ignored; other
columns are ignored by ``hits`` and kept by the functions that remove.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.llm.columns import apart, together

WINDOW = 13
#: The benchmark's windows are broadcast up to this many; beyond, the join shuffles.
BROADCAST_WINDOWS = 1_000_000

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered: digits, letters and all that is not ASCII."""
    text = F.coalesce(text, F.lit(""))
    # ``lower`` does the same to plain ASCII, and faster.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, f"{_GAP}+"), "")


def _windows(texts: DataFrame, lengths: Column) -> DataFrame:
    """``texts`` with a row per window: its length, the number of its first word, its hash.

    Only built-in expressions without lambdas, so that all of it is one stage of compiled code and
    ``words`` is never copied.
    """
    rows = texts.select("*", F.posexplode("words").alias("first", "_word")).drop("_word")
    rows = rows.select("*", F.explode(lengths).alias("length"))
    return rows.where(F.col("first") + F.col("length") <= F.size("words")).withColumn(
        "hash", F.xxhash64(F.slice("words", F.col("first") + 1, F.col("length"))))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(hash, length, gram, item_ids) of the distinct windows, and the lengths that occur."""
    parsed = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    own = F.least(F.size("words"), F.lit(window))
    lengths = sorted(r[0] for r in parsed.select(own).distinct().collect())  # at most ``window`` of them
    gram = F.slice("words", F.col("first") + 1, F.col("length"))
    return _windows(parsed, F.array(own)).groupBy("hash", "length", gram.alias("gram")).agg(
        F.collect_set("item_id").alias("item_ids")), lengths


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, spans, item_ids) of the documents (doc_id, text) with a hit.

    ``spans`` are the hit windows, ordered and merged: structs (first, past) of word numbers from 0.
    """
    grams, lengths = benchmark_windows(items, window)
    small = grams.limit(broadcast_windows + 1).count() <= broadcast_windows
    parsed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    every = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    found = _windows(parsed, every).join(F.broadcast(grams) if small else grams, ["hash", "length"])
    placed = found.where(F.slice("words", F.col("first") + 1, F.col("length")) == F.col("gram"))
    by_doc = placed.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("length")).alias("past")))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    )
    return by_doc.select("doc_id", "text_hash", _merged("windows").alias("spans"), "item_ids")


def _merged(windows: str) -> Column:
    """Sorted windows as the runs of words that they cover together."""
    spans = "array<struct<first:int,past:int>>"
    run = F.named_struct(F.lit("first"), F.lit(-1), F.lit("past"), F.lit(-1), F.lit("done"), F.array().cast(spans))

    def step(acc: Column, x: Column) -> Column:
        closed = F.when(acc["past"] < 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["past"].alias("past")))))
        return F.when(
            x["first"] <= acc["past"],
            F.struct(acc["first"].alias("first"), F.greatest(acc["past"], x["past"]).alias("past"), acc["done"].alias("done")),
        ).otherwise(F.struct(x["first"].alias("first"), x["past"].alias("past"), closed.alias("done")))

    def last(acc: Column) -> Column:
        return F.when(acc["past"] < 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["past"].alias("past")))))

    return F.aggregate(windows, run, step, last)


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, spans, item_ids and contaminated, for columns so named.

    Contaminated: a word is hit, and hit words are at least ``share`` of all.
    """
    docs = docs.drop("n_words", "n_hit", "spans", "item_ids", "contaminated", "hit_id", "hit_hash")
    found = hits(docs, items, window)
    found = found.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
    counted = docs.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["past"] - s["first"]), F.lit(0)).cast("long")
    per = round(1 / share)
    return (
        counted.join(found, same, "left").drop("hit_id", "hit_hash")
        .withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words")))
    )


def remove_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return together(judge(apart(docs, ["doc_id", "text"]), items, window, share).where("not contaminated"), docs)


def remove_spans(judged: DataFrame) -> DataFrame:
    """The rows of ``judge`` with the hit words, and the gap before each, taken out of the text."""
    pieces = F.regexp_extract_all("text", F.lit(f"({_GAP}*{_WORD})"), F.lit(1))
    tail = F.regexp_extract("text", f"({_GAP}*)$", 1)
    hit = lambda i: F.exists("spans", lambda s: (s["first"] <= i) & (i < s["past"]))
    rest = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~hit(i)), ""), tail)
    return judged.withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))
