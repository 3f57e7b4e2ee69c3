from __future__ import annotations

import random
import re

import pytest

from lumencat.llm import decontaminate

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = _words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids or ())), r.contaminated) for r in df.collect()), key=str)


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"ü{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 13, 14, 30])))) for k in range(12)]
    items += [(50, items[3][1]), (51, ""), (52, None), (None, "W1 W2"), (53, "--- ...")]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 200]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = (rng.choice(items)[1] or "").lower().split()
        docs.append((k, ", ".join(words)))
    return docs + [(None, None), (3, docs[5][1]), (3, docs[5][1])], items


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_equals_brute_force(spark, bound, monkeypatch):
    docs, items = _corpus(1)
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (13, bound))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert _got(decontaminate.judge(d, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Tied"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _got(decontaminate.judge(odd_docs, items)) == brute(rows, [(1, "Tied")])
    kept = decontaminate.remove_documents(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert decontaminate.judge(no_docs, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(odd_docs, none).count() == odd_docs.count()


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "(a) keep this, One two THREE! and four one two three."), (2, "clean text; stays")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = decontaminate.remove_spans(decontaminate.judge(docs, items))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "(a) keep this! and four.", 2: "clean text; stays"}
