from __future__ import annotations

import math

import numpy as np
import pytest

from lumencat.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, x string, n int"


def _brute(rows, components=4):
    """vec_id, x -> per component (n, deviation, |whitened|, explained), by one eigendecomposition."""
    vectors = np.array(sorted({x for _, x in rows}), np.float64)
    n, sums = len(vectors), [sum(int(x[k]) for x in {x for _, x in rows}) for k in range(vectors.shape[1])]
    centred = vectors - vectors.mean(axis=0)
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    found = []
    for key, x in rows:
        deviation = sum((n * int(c) - s) ** 2 for c, s in zip(x, sums))
        white = (np.array(x) - vectors.mean(axis=0)) @ q / np.sqrt(values)
        found += [(key, k + 1, n, deviation, abs(white[k]), values[k] / (centred**2).sum() * n) for k in range(len(values))]
    return found


def _same(got, want, near=1e-9):
    order = lambda r: (str(r[0]), r[1], r[3], round(abs(r[4]), 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([(abs(r[4]), r[5]) for r in got], [r[4:] for r in want], atol=near, rtol=near)


def test_query_equals_an_eigendecomposition(spark):
    got = [tuple(r) for r in queries.op12_whitening(spark, SF_DIR).collect()]
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [(r.vec_id, tuple(math.floor(256 * c) for c in r.embedding)) for r in table]
    _same([r[:6] for r in got], _brute(rows))
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10


@pytest.mark.parametrize("size, scales", [(3, (9, 5, 1)), (60, (40, 40, 39, 1)), (80, (1,)), (50, (3000, 2, 1.5))])
def test_spectra(spark, size, scales):
    rng = np.random.default_rng(size)
    spread = np.resize(np.array(scales, float), size) if len(scales) > 1 else np.ones(size)
    spread[len(scales):] = 0.5
    vectors = (rng.normal(size=(400, size)) * spread).astype(np.float32)
    rows = spark.createDataFrame([(n, v.tolist(), None, n) for n, v in enumerate(vectors)], ROWS)
    model = whitening.fit(whitening.fixed_point(rows.select("vec_id", "embedding")))
    assert model.residual < (1e-12 if max(scales) < 100 else 1e-8) and model.identity_error < 1e-9
    exact = [(n, tuple(math.floor(256 * float(c)) for c in v)) for n, v in enumerate(vectors)]
    _same([tuple(r)[:6] for r in whitening.whiten(rows).collect()], _brute(exact, min(4, size)), 1e-7)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [0.5, 0.25], "a", 1), (1, [0.5, 0.25], "a", 1), (2, [-0.0, 0.0], "b", 2), (None, [-0.3, 1.0], None, None),
        (3, None, "c", 3), (4, [], "c", 3), (5, [0.1, None], "c", 3), (6, [nan, 0.0], "c", 3), (7, [0.0, inf], "c", 3),
        (8, [1.0, 2.0, 3.0], "c", 3), (9, [0.5, 0.25], "same vector", 1),
    ]
    got = [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()]
    kept = [(1, (128, 64)), (1, (128, 64)), (2, (0, 0)), (None, (-77, 256)), (9, (128, 64))]
    _same([r[:6] for r in got], _brute(kept))
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(rows[4:9], ROWS)).collect() == []
    alike = whitening.whiten(spark.createDataFrame(rows[:2], ROWS)).collect()
    assert [tuple(r) for r in alike] == [(1, c, 1, 0, None, None, None) for c in (1, 2, 1, 2)]
    line = whitening.whiten(spark.createDataFrame([(n, [n / 4, n / 2], "", 0) for n in range(5)], ROWS)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)


def test_large_entries_stay_exact(spark):
    rows = [(n, [float(2**40 * n), float(-(2**45) * n * n)], "", 0) for n in range(4)]
    model = whitening.fit(whitening.fixed_point(spark.createDataFrame(rows, ROWS)))
    assert model.sums == [256 * 2**40 * 6, -256 * 2**45 * 14]
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()} == {None}
