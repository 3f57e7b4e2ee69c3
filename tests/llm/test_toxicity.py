from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lumencat.llm import toxicity


def _texts(n, seed=0):
    rng = random.Random(seed)
    neutral = [f"{a}{b}" for a in ("ra", "lo", "mi", "tes", "kan", "dor") for b in ("ne", "sto", "vil", "ger", "pim", "tal", "un")]
    bad = ["foulword", "vexing", "grumbl"]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(neutral) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(3, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "ed", "er"])
        texts.append(" ".join(words).capitalize() + ".")
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = _texts(700)
    return toxicity.train(pa.array(texts), np.array(labels), np.arange(700) % 4 == 1)


def test_held_out(model):
    texts, labels = _texts(400, seed=1)
    scores = model.score(pa.array(texts))
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.97
    assert ((scores >= 0) & (scores <= 1)).all()


def test_a_score_knows_only_its_text(model, monkeypatch):
    texts, _ = _texts(60, seed=2)
    texts += [None, "", "foulword", " ".join(["rane"] * 5000) + " foulwords " + "lone " * 5000]
    together = model.score(pa.array(texts, pa.string()))
    alone = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(together, alone, rtol=1e-5)
    monkeypatch.setattr(toxicity, "_ROWS", 256)  # a text in many stretches
    np.testing.assert_allclose(model.score(pa.array(texts, pa.string())), together, rtol=1e-5)
    assert together[-4] == together[-3] < 0.5 < together[-1]


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "FEWEST_DOCS", 1)
    labels = spark.createDataFrame(
        [(1, 0), (1, 0), (3, None), (5, 0), (7, 1), (6, 0), (None, 1), (77, 1), (2, 0)], "doc_id long, toxic int")
    kept = toxicity.remove_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, None}
    assert toxicity.remove_toxic(no_docs, labels).collect() == []
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.remove_toxic(odd_docs, no_labels).count() == odd_docs.count()


def test_thresholds_by_language(spark):
    """The clean documents of one language score high: its threshold rises, the others' do not."""
    rows = [(k, "a" if k % 2 else "b", 0.7 if k % 2 else 0.1) for k in range(4000)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(k, 0) for k in range(4000)], "doc_id long, toxic int")
    limits = {r.lang: r.threshold for r in toxicity.thresholds(scored, labels).collect()}
    assert limits == {"a": 0.7, "b": 0.5, None: 0.7}
    judged = toxicity.judge(scored, toxicity.thresholds(scored, labels))
    assert judged.where("toxic").count() == 0 and judged.count() == 4000
