from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumencat.llm import shingle_join
from lumencat.llm.components import components
from lumencat.llm.textvec import WHITE, word_hashes

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows by comparing all pairs."""
    sets = [(d, _set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = "this line stands in very many of the texts"
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 25, 60, 150, 400]))]
            texts.append(" ".join(words) + (f"\n{line}" if rng.random() < 0.5 else ""))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rows = _corpus(seed)
    got = shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _rows(got) == brute(rows)


def test_a_bucket_of_many_pivots(spark, monkeypatch):
    """Later rounds find what the first pivots do not."""
    monkeypatch.setattr(shingle_join, "PIVOTS", 1)
    monkeypatch.setattr(shingle_join, "MORE", 2)
    rows = _corpus(9, 150)
    assert _rows(shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = shingle_join.join(odd_docs)
    assert _rows(got) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert shingle_join.join(no_docs).collect() == []
    kept = shingle_join.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 6, 7]
    assert shingle_join.deduplicate(no_docs).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 15, 16, 30, 63, 64, 100, 255, 300, 1000, 5000])
def test_similar_sets_always_share_a_shown_signature(size):
    """Whatever the order after the first cut: here, rarest last or first by chance."""
    rng = np.random.default_rng(size)
    for trial in range(40):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        common = rng.integers(int(np.ceil(0.75 * size)), size + 1)
        extra_room = int(common / 0.75 - size)  # |union| <= common / 0.75
        keep = rng.permutation(a)[:common]
        extra = rng.integers(0, 2**63, rng.integers(0, extra_room + 1) if extra_room > 0 else 0, dtype=np.int64).astype(np.uint64)
        b = np.unique(np.concatenate([keep, extra]))
        if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
            continue
        order = np.uint64(rng.integers(1, 2**62))
        shown = []
        for s in (a, b):
            own = set()
            for instance, slack, signatures in shingle_join.signatures(s):
                ranked = sorted(signatures.tolist(), key=lambda x: (x * int(order)) % 2**64)
                own |= {(instance, x) for x in ranked[: len(ranked) - slack]}
            shown.append(own)
        assert shown[0] & shown[1]


def test_words_do_not_depend_on_segments():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n\t 漢Z") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "x" * 500]
    column = pa.array(texts, pa.string())
    whole, begins = word_hashes(column)
    for segment in (1, 7, 64):
        hashes, cut = word_hashes(column, WHITE, segment)
        assert (hashes == whole).all() and (cut == begins).all()
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER)) for t in texts]
    assert np.diff(begins).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(whole.tolist())) == len(set(zip(flat, whole.tolist())))
    sliced, _ = word_hashes(column.slice(50, 20))
    assert (sliced == whole[begins[50] : begins[70]]).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_group_of_near_copies_costs_a_pair_or_two_per_member(spark, monkeypatch):
    """Members that meet many pivots are compared with one, and with others only across components."""
    rng = random.Random(3)
    first = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(150):
        words = list(first)
        for _ in range(4):
            words[rng.randrange(0, 300, 6)] = f"x{rng.randrange(3)}"
        rows.append((n, " ".join(words)))
    compared, similar = [], shingle_join._similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(shingle_join, "_similar", counted)
    got = shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _rows(got) == brute(rows)
    assert compared[0] < 150 and sum(compared) <= 300
