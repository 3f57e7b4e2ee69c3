from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from lumencat.llm import quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, odd_docs, no_docs):
    texts = [
        "a b c d e f g h " * 5, "a b c d e f g h a b c d e f g h i", "x\nx\n \ny\nx", "#*$ %&| <> ok", "one two",
        "a a a a a a a a a", "p q r s t u v w x y z " + "p q r s t u v w", None, "", " \t\n",
    ]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measured(docs).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    odd = [(r.text, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality_rules.measured(odd_docs).collect()]
    assert len(odd) == 11 and all(m == brute(t) for t, m in odd)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    assert quality_rules.judge(odd_docs, labels).count() == 11
    assert quality_rules.judge(no_docs, labels).count() == 0


@pytest.mark.parametrize("rate", [0.01, 0.05, 0.3])
def test_binomial_tail(spark, rate):
    cases = [(k, n) for n in (1, 5, 40, 300, 5000) for k in sorted({0, 1, int(n * rate / 2), int(n * rate), n})]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn(
        "p", quality_rules.binomial_tail(F.col("k"), F.col("n").cast("double"), rate)).collect()
    for r in rows:
        exact = math.fsum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(rate) + (r.n - j) * math.log1p(-rate))
            for j in range(r.k + 1))
        assert math.isclose(r.p, exact if r.k <= r.n * rate else 1.0, rel_tol=1e-9)


def test_cutoffs_keep_the_promise(spark):
    """Good texts have up to 4 % symbols: the strict cutoff would reject them, a looser one not."""
    rows = [(k, "en", 100, 500, k % 20, 10, 0, 0) for k in range(4000)] + [(5000 + k, "de", 100, 500, 400, 10, 0, 0) for k in range(50)]
    metrics = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = metrics.select("doc_id", F.lit(1).alias("quality"))
    got = {(r.stratum, r.rule): (r.cutoff, r.n_good, r.n_rejected) for r in quality_rules.cutoffs(metrics, labels, "lang").collect()}
    assert got["en", "symbols"] == (0.05, 4000, 0)
    assert not any(lang == "de" for lang, _ in got)  # 50 documents prove nothing
