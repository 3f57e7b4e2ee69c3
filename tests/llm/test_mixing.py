from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencat.llm import mixing


@pytest.mark.parametrize("seed", range(3))
def test_segments_use_all_blocks_up(seed):
    rng = random.Random(seed)
    blocks = {f"s{k}": rng.randrange(0, 200) for k in range(8)}
    parts = {s: rng.randrange(1, 20) for s in blocks}
    used = dict.fromkeys(blocks, 0)
    for periods, shares in mixing.segments(blocks, parts):
        for s, n in shares.items():
            used[s] += periods * n
    assert used == blocks


def _edf(shares):
    """Slots of (source, j), one after the other, by earliest deadline."""
    length, done, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for slot in range(length):
        ready = [(-(-(done[s] + 1) * length // c), s) for s, c in shares.items() if done[s] < c and done[s] * length // c <= slot]
        _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_patterns_equal_a_simulation(spark):
    rng = random.Random(5)
    shares = [{s: rng.randrange(1, 40) for s in range(rng.randrange(1, 9))} for _ in range(12)]
    rows = [(k, s, c) for k, own in enumerate(shares) for s, c in own.items()]
    got = {}
    for r in mixing.patterns(spark.createDataFrame(rows, "segment int, source_no int, share long")).collect():
        got.setdefault(r.segment, {})[r.slot] = (r.source_no, r.j)
        assert r.release <= r.slot < r.due
    for k, own in enumerate(shares):
        order = [got[k][slot] for slot in range(sum(own.values()))]
        assert order == _edf(own)
        given = dict.fromkeys(own, 0)
        for slot, (s, _) in enumerate(order, 1):
            given[s] += 1
            assert all(abs(given[x] - slot * c / len(order)) < 1 for x, c in own.items())


def test_every_row_gets_a_place(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    weights = {"hot": 0.2, **{f"s{k}": 0.1 + 0.01 * k for k in range(7)}}
    rows = mixing.mix(docs, weights, block_rows=10, period=100).collect()
    assert sorted(r.key for r in rows) == list(range(5000)) and len({r.place for r in rows}) == 5000
    assert all(r.release <= r.slot < r.due for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    total = sum(weights.values())
    given = dict.fromkeys(weights, 0)
    for slot in range(100):  # all sources last through the first period
        given[next(iter(slots[slot]))[0]] += 1
    assert all(abs(n - 100 * weights[s] / total) < 1 for s, n in given.items())


def _fluid(blocks, weights, ends):
    """What each source has got when the output is ``ends`` blocks long; ends ascend."""
    n, w = np.array([blocks[s] for s in blocks], float), np.array([weights[s] for s in blocks], float)
    turns = np.concatenate([[0], np.sort(n / w)])
    reached = np.array([np.minimum(v * w, n).sum() for v in turns])
    return {end: np.minimum(np.interp(end, reached, turns) * w, n) for end in ends}


def _deviation(spark, blocks, weights, period=mixing.PERIOD, every=1):
    """The most that a source stands off its exact share, every so many slots up to the end."""
    total, names = sum(blocks.values()), list(blocks)
    parts = mixing.fine_parts([weights[s] for s in names], total)
    rows = mixing.schedule(mixing.windows(spark, [blocks[s] for s in names], parts), total, period).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(total)) and all(r.release <= r.slot < r.due for r in rows)
    shares = _fluid(blocks, weights, [*range(every, total, every), total])
    given, worst = np.zeros(len(names), int), 0
    for r in rows:
        assert r.j == given[r.source_no]
        given[r.source_no] += 1
        if r.slot + 1 in shares:
            worst = max(worst, np.abs(given - shares[r.slot + 1]).max())
    assert given.tolist() == list(blocks.values())
    return worst


def test_a_long_schedule_keeps_to_the_exact_weights(spark):
    # Rounded to thousandths, a source of 0.00449 would be given 40 of the first 10,000 blocks.
    weights = {"a": 0.48051, "b": 0.31337, "c": 0.20163, "d": 0.00449}
    assert _deviation(spark, {"a": 9610, "b": 6260, "c": 4030, "d": 100}, weights, every=23) < 1 + 1e-6


def test_thousands_of_sources_keep_their_weights(spark):
    weights = {"large": 0.3, **{f"s{k}": 0.7 / 2500 * (1 + k % 3 / 7) for k in range(2500)}}
    blocks = {s: 1 for s in weights} | {"large": 1100}
    assert _deviation(spark, blocks, weights, every=97) < 1 + 1e-6


@pytest.mark.parametrize("seed", range(2))
def test_stretches_make_no_difference(spark, seed):
    rng = random.Random(seed)
    blocks = {f"s{k}": rng.choice([0, 1, 7, rng.randrange(120)]) for k in range(9)}
    weights = {s: rng.choice([1 / 3, 0.2, rng.random() + 0.001]) for s in blocks}
    blocks["s0"] = 50
    assert _deviation(spark, blocks, weights, period=13) < 1 + 1e-6
    names, total = list(blocks), sum(blocks.values())
    rows = mixing.windows(spark, list(blocks.values()), mixing.fine_parts([weights[s] for s in names], total))
    whole, cut = (sorted(map(tuple, mixing.schedule(rows, total, p).collect())) for p in (total, 13))
    assert whole == cut


def test_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(odd_docs, block_rows=2)
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert mixing.mixed(no_docs).collect() == []
