"""Quality rules with risk-controlled cutoffs (operator 6).

Each rule rejects a document whose measure lies beyond a cutoff. Cutoffs come from labelled
documents: for every stratum, rule and candidate cutoff, the good documents that the rule would
reject are counted, and the cutoff is certified if an exact binomial test says that the rule's rate
of false rejections is under its share of ``risk``, at ``error`` divided by the number of all tests
(Bonferroni). The strictest certified cutoff is used; a rule without one rejects nothing. So with
probability 1 - ``error`` over the labels, in no stratum more than ``risk`` of the good documents go.

Defined cases: null and empty texts have no words and fail the base rules; labels of unknown
documents, null labels and documents of a null doc_id teach nothing; a doc_id labelled twice is good
if every label says so; a null stratum is a stratum of its own; without labels only the base rules
hold; other columns are kept, but for those named as in ``OWN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.sources.storage import materialize

RISK, ERROR = 0.05, 0.05
REPEATED, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
#: What this operator adds, in place of columns so named.
OWN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rules", "kept", "measure", "limits")
_WHITE = r"[\x20\x09-\x0D]+"
#: rule -> candidate cutoffs, lenient to strict; a document is beyond if its measure is over the
#: cutoff ("under": below it).
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_lines": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeats": (0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02),
    "long_words": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "short_words_under": (1.0, 1.5, 2.0, 2.5, 3.0, 3.5),
}


def _adjacent(values: str, f) -> Column:
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), f)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    docs = docs.drop(*OWN)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, _WHITE, "") != "")
    df = docs.withColumn("_words", F.array_remove(F.split(text, _WHITE), "")).withColumn("_lines", lines)
    # Hashes of 8 words from those of 4, of 2, of 1; equal hashes of 64 bits count as equal windows.
    df = df.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        n = F.greatest(F.size("_words") - 2 * half + 1, F.lit(0))
        pair = F.zip_with(F.slice(f"_w{half}", 1, n), F.slice(f"_w{half}", half + 1, n), lambda x, y: F.xxhash64(x, y))
        df = df.withColumn(f"_w{2 * half}", pair)
    df = df.withColumn("_sorted", F.sort_array("_w8"))
    repeated = F.exists(_adjacent("_sorted", lambda a, b: a == b), lambda same: same)
    # Only a text that repeats a window is looked at place by place.
    df = df.withColumn("_placed", F.when(repeated, F.array_sort(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.array_sort(F.array_distinct(F.flatten(_adjacent(
        "_placed", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))
    df = df.withColumn("_places", places)
    covered = F.aggregate(
        _adjacent("_places", lambda a, b: F.least(F.lit(REPEATED), b - a)), F.lit(REPEATED), lambda n, x: n + x)
    return df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, _WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_places").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measures() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
        "short_words_under": share("word_chars", "n_words"),
    }


def _beyond(rule: Column, measure: Column, cutoff: Column) -> Column:
    return F.when(rule.endswith("_under"), measure < cutoff).otherwise(measure > cutoff)


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8."""
    z = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of Binomial(n, rate), exact to rounding where k <= n * rate; else 1.

    The largest term in logarithms, times the sum of the falling ratios of the terms below it, which
    is cut where they add less than rounding does.
    """
    top = (
        _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0)
        + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    )
    terms = F.least(k, (F.sqrt(n) * 12 + 60).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        j = (k - i + 1).cast("double")
        term = acc["term"] * j / (n - j + 1.0) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(top) * F.aggregate(steps, start, step, lambda acc: acc["sum"])
    return F.when(k <= n * rate, F.least(tail, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(metrics: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, p_value): the cutoff certified for each rule.

    One row per stratum and rule that has one; every labelled document counts.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = good.where("quality = 1").select("doc_id")
    held = metrics.where(~base_failed()).join(good, "doc_id", "left_semi")
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.lit(k).alias("strictness"), measure.alias("measure"))
        for rule, measure in _measures().items() for k, c in enumerate(CUTOFFS[rule])
    ])
    rate = risk / len(CUTOFFS)
    counted = (
        held.select(F.col(stratum).alias("stratum"), F.explode(tests).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff", "t.strictness")
        .agg(
            F.count(F.lit(1)).alias("n_good"),
            F.sum(_beyond(F.col("t.rule"), F.col("t.measure"), F.col("t.cutoff")).cast("long")).alias("n_rejected"),
        )
    )
    p_value = binomial_tail(F.col("n_rejected"), F.col("n_good").cast("double"), rate)
    # One row per stratum, rule and candidate: the tests share the error.
    counted = materialize(counted.withColumn("p_value", p_value), "tests")
    n_tests = counted.agg(F.count(F.lit(1)).alias("n_tests"))
    sure = counted.join(F.broadcast(n_tests)).where(F.col("p_value") * F.col("n_tests") <= error)
    best = F.max_by(F.struct("cutoff", "n_good", "n_rejected", "p_value"), "strictness").alias("best")
    return sure.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "best.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``docs`` with their measures, base_failed, the ``rules`` that reject each, and kept.

    Documents are measured once and written; thresholds and verdicts read the measures.
    """
    metrics = materialize(measured(docs).drop("text").withColumn("base_failed", base_failed()), "metrics")
    chosen = cutoffs(metrics, labels, stratum, risk, error)
    # At most one cutoff per rule and stratum.
    per_stratum = chosen.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cutoff")).alias("limits"))
    joined = metrics.join(per_stratum, F.col(stratum).eqNullSafe(F.col("stratum")), "left").drop("stratum")
    measure = F.create_map(*[x for rule, m in _measures().items() for x in (F.lit(rule), m)])
    broken = F.filter(
        F.coalesce("limits", F.array().cast("array<struct<rule:string,cutoff:double>>")),
        lambda t: _beyond(t["rule"], F.col("measure")[t["rule"]], t["cutoff"]),
    )
    rules = F.transform(broken, lambda t: t["rule"])
    return (
        joined.withColumn("measure", measure).withColumn("rules", rules).drop("measure", "limits")
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))
    )
