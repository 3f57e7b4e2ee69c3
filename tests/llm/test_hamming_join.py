from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lumencat.llm import hamming_join as hj
from tests.llm.test_shingle_join import _corpus, _rows, _set


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows by comparing all pairs."""
    sets = [(d, _set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def test_equals_all_pairs(spark):
    rows = _corpus(3, 150)
    assert len({r[2] for r in brute(rows)}) < 120
    assert _rows(hj.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_group_of_near_copies_and_a_common_passage(spark):
    """Many members that only link through others, and many texts that share a passage but do not link."""
    rng = random.Random(5)
    base = [f"b{n}" for n in range(150)]
    texts = []
    for _ in range(80):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{n}" for n in range(60))
    texts += [passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(7 * n % 997, t) for n, t in enumerate(texts)]
    got = _rows(hj.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert 40 < len({r[2] for r in got}) < 100


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = hj.join(odd_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert _rows(got) == brute(rows)
    assert hj.join(no_docs).collect() == []
    clash = odd_docs.withColumnsRenamed({"slot": "key", "row": "doc", "source": "size", "lang": "component_id"})
    assert _rows(hj.join(clash)) == brute(rows)
    kept = hj.deduplicate(clash)
    assert kept.columns == clash.columns and kept.count() == odd_docs.count()


def test_rows_of_one_id_are_one_node(spark):
    """An id with two texts connects the groups of both, whichever of its classes is smaller."""
    one, other = (" ".join(f"{c}{n}" for n in range(60)) for c in "ab")
    rows = [(3, one), (7, one), (7, other), (9, other), (5, other + " more"), (8, ""), (9, "")]
    got = _rows(hj.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {r[2] for r in got if r[0] != 8} == {3}


def test_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 1 << 16, (300, hj.PARTS * hj.EACH)).astype(np.uint16)
    other = signs.copy()
    for row in other:
        places = rng.choice(len(row), hj.MOST, replace=False)
        row[places] ^= rng.integers(1, 1 << 16, hj.MOST).astype(np.uint16)
    assert (hj.keys(signs) == hj.keys(other)).any(axis=1).all()
    assert not (hj.keys(signs) == hj.keys(signs[::-1])).any()
    assert hj.miss(0.85) < 1e-6 < hj.miss(0.6)


def test_distance_counts_differing_hashes(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 16, (50, hj.PARTS * hj.EACH)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < 0.3, x ^ np.uint16(1 << 15), x)
    longs = np.concatenate([hj._whole(x), hj._whole(y)], axis=1).view(np.int64).tolist()
    names = [f"{m}_{c}" for m in "xy" for c in hj._SIGNS]
    got = spark.createDataFrame([(n, *row) for n, row in enumerate(longs)], ", ".join(f"{c} long" for c in ["n", *names]))
    assert [r[1] for r in sorted(got.select("n", hj._distance().alias("d")).collect())] == (x != y).sum(axis=1).tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    b = np.concatenate([a[:8100], rng.integers(0, 1 << 63, 900).astype(np.uint64)])
    near = (hj.signature(a) == hj.signature(b)).mean()
    assert abs(near - 8100 / 9900) < 0.15


def test_parities_never_rule_out_a_link(spark):
    rows = _corpus(11, 60)
    docs = spark.createDataFrame(rows, "doc long, text string")
    sets = hj._sets(docs, 5)
    pairs = hj._light(sets, "x").crossJoin(hj._light(sets, "y")).where("x_doc < y_doc")
    passed = {tuple(r) for r in pairs.where(hj._may_link(85, 100)).select("x_doc", "y_doc").collect()}
    own = [(d, _set(t)) for d, t in rows]
    linked = {(a, b) for (a, x), (b, y) in combinations(own, 2) if x and y and 100 * len(x & y) >= 85 * len(x | y)}
    assert linked <= passed and len(passed) < pairs.agg(F.count("*")).first()[0] / 2
