"""MinHash near-duplicates by a multi-index Hamming join (operator 11).

The signature of a text is b bits of each of ``PARTS * EACH`` minimum hashes of its set of word
n-grams, and the distance of two signatures is the number of minimum hashes whose bits differ. Two
sets of similarity s differ in each with probability 1 - s at most, so a link at the threshold lies
beyond ``MOST`` differences with probability 1e-6 (``miss``). The signatures are split into ``PARTS``
parts: of two at a distance under ``PARTS * (ERRORS + 1)`` one part differs in ``ERRORS`` places at
most, so both show that part alike once those places are left out. A text shows every part with
every choice of ``ERRORS`` places left out; texts that show the same under one key are candidates,
and no pair under the distance threshold is missed. Links are confirmed on the whole sets.

Texts of equal sets are one class and go through all this once. The classes under a key are not
compared pair by pair: the pivot of a key is its most central class (the one that meets most
others), and each class is compared with the ``PIVOTS`` most central pivots that may link with it.
Only then the rest follows: the pairs of different components under one key, outside the component
that most of the key belongs to on one side. Before sets are compared, pairs must pass the distance
and a bound from the parities of the elements over ``BITS`` bits (every element that only one set
has flips one), which never rules out a link; the last join applies that bound to folded parities.

Defined cases: texts of 1 to n - 1 words are one n-gram; null, empty and blank texts have no set and
link with nothing; rows that share a doc_id are one node with the links of all of them; rows of a
null doc_id link with nothing, have no component and are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumencat.llm.components import components
from lumencat.llm.shingle_join import shingle_sets
from lumencat.llm.textvec import mix
from lumencat.sources.storage import materialize

WORDS, P, Q = 5, 85, 100
#: Parts of a signature, minimum hashes in each, places that may differ in one, and bits of a hash.
PARTS, EACH, ERRORS, HASH_BITS = 13, 5, 1, 16
#: The distance up to which every pair is found.
MOST = PARTS * (ERRORS + 1) - 1
BITS, FOLDS = 1024, 4
PIVOTS = 2
_U = np.uint64
_SIGNS = [f"g{k}" for k in range(-(-PARTS * EACH * HASH_BITS // 64))]
_PARITY = [f"s{k}" for k in range(BITS // 64)]
_FOLDED = [f"f{k}" for k in range(FOLDS)]
_LIGHT = ["doc", "size", *_SIGNS, *_PARITY]
_STEP = 1 << 12
_SEEDS = mix(np.arange(1, 2 * PARTS * EACH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FLIP, _TIMES = _SEEDS[::2], _SEEDS[1::2] | _U(1)


def miss(similarity: float) -> float:
    """The probability that two sets of this similarity lie beyond the distance threshold."""
    n, p = PARTS * EACH, 1 - similarity
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(MOST + 1, n + 1))


def signature(grams: np.ndarray) -> np.ndarray:
    """The minimum hashes of one set, ``HASH_BITS`` bits of each; long sets go in steps."""
    least = np.full(PARTS * EACH, ~_U(0))
    for at in range(0, len(grams), _STEP):
        np.minimum(least, ((grams[at : at + _STEP, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return (mix(least) >> _U(64 - HASH_BITS)).astype(np.uint16)


_LEFT_OUT = list(combinations(range(EACH), ERRORS))
_SHOWN = np.array([[part * EACH + k for k in range(EACH) if k not in out] for part in range(PARTS) for out in _LEFT_OUT])
_SALT = mix(np.arange(1, len(_SHOWN) + 1, dtype=_U) * _U(0xD1342543DE82EF95))


def keys(signatures: np.ndarray) -> np.ndarray:
    """A row of keys per signature: each part with each choice of places left out."""
    key = np.broadcast_to(_SALT, (len(signatures), len(_SALT)))
    for k in range(_SHOWN.shape[1]):
        key = mix(key * _U(0xD6E8FEB86659FD93) + signatures[:, _SHOWN[:, k]].astype(_U))
    return key


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _whole(signatures: np.ndarray) -> np.ndarray:
    """Signatures as rows of 64-bit numbers."""
    width = 64 // HASH_BITS
    return np.pad(signatures, ((0, 0), (0, -signatures.shape[1] % width))).view(_U)


def _rows(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, most) for batch in batches for at in range(0, batch.num_rows, most))


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, g0 ..): set size, 128 bits that tell sets apart, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            n = batch.num_rows
            size, d = np.zeros(n, np.int64), np.zeros((2, n), _U)
            signs = np.zeros((n, PARTS * EACH), np.uint16)
            for k, grams in enumerate(shingle_sets(batch.column(1), words)):
                size[k] = len(grams)
                d[0, k] = mix(grams ^ _U(0x8CB92BA72F3D8DD7)).sum(dtype=_U)
                d[1, k] = mix(grams + _U(0xABC98388FB8FAC03)).sum(dtype=_U)
                signs[k] = signature(grams)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), *map(_longs, d), *map(_longs, _whole(signs).T)], ["doc_id", "n_shingles", "d1", "d2", *_SIGNS])

    kind = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "d1", "d2", *_SIGNS))
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def key_rows(classes: DataFrame) -> DataFrame:
    """(key, doc): every key under which each class (doc, g0 ..) is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            signs = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint16)
            key = keys(signs)
            doc = np.repeat(batch.column(0).to_numpy(), key.shape[1])
            yield pa.RecordBatch.from_arrays([_longs(key.ravel()), pa.array(doc)], ["key", "doc"])

    return classes.select("doc", *_SIGNS).mapInArrow(run, "key long, doc long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc, size, g0 .., s0 .., grams): what is needed of the classes that have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches, 500):
            sets = list(shingle_sets(batch.column(1), words))
            signs = _whole(np.stack([signature(g) for g in sets]))
            parity = np.zeros((len(sets), BITS // 64), np.int64)
            for k, grams in enumerate(sets):
                odd = np.bincount((grams & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                parity[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(g) for g in sets], pa.int64()), *map(_longs, signs.T),
                *(pa.array(c) for c in parity.T.copy()), pa.array([g.tobytes() for g in sets], pa.binary()),
            ], [*_LIGHT, "grams"])

    return docs.select("doc", "text").mapInArrow(run, ", ".join(f"{c} long" for c in _LIGHT) + ", grams binary")


def _distance() -> Column:
    """In how many minimum hashes x and y differ."""
    total = F.lit(0)
    for c in _SIGNS:
        apart, fold = F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}")), HASH_BITS // 2
        while fold:
            apart = apart.bitwiseOR(F.shiftrightunsigned(apart, fold))
            fold //= 2
        ones = sum(1 << at for at in range(0, 64, HASH_BITS))
        total = total + F.bit_count(apart.bitwiseAND(F.lit(ones)))
    return total


def _room(parities: list[str], p: int, q: int) -> Column:
    """Whether sizes and parities of x and y leave room for a link."""
    unequal = reduce(lambda n, c: n + F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))), parities, F.lit(0))
    x, y = F.col("x_size"), F.col("y_size")
    return (q * F.least(x, y) >= p * F.greatest(x, y)) & ((q + p) * unequal <= (q - p) * (x + y))


def _may_link(p: int, q: int) -> Column:
    """Whether x and y are near by their signatures and leave room for a link."""
    return _room(_PARITY, p, q) & (_distance() <= MOST)


def _light(sets: DataFrame, mark: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{mark}_{c}") for c in _LIGHT])


def _folded(sets: DataFrame, mark: str) -> DataFrame:
    """Document, size and the parities over fewer bits: bits that meet are added."""
    parts = [reduce(Column.bitwiseXOR, [F.col(c) for c in _PARITY[k::FOLDS]]) for k in range(FOLDS)]
    return sets.select(*[c.alias(f"{mark}_{name}") for c, name in zip([F.col("doc"), F.col("size"), *parts], ["doc", "size", *_FOLDED])])


def _confirmed(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(q * both >= p * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, sets: DataFrame, p: int, q: int, *others: str) -> DataFrame:
    """The pairs (a, b, others ..) that may link."""
    x, y = _light(sets, "x"), _light(sets, "y")
    return pairs.join(y, F.col("b") == F.col("y_doc")).join(x, (F.col("a") == F.col("x_doc")) & _may_link(p, q)).select("a", "b", *others).distinct()


def links_of(classes: DataFrame, docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """Links (a, b) that connect every two classes of a component: ``classes`` (doc, size, g0 ..).

    ``docs`` (doc, text) has the text of every class under its ``doc``.
    """
    # Sets too small to be similar without being equal have no partner.
    shown = key_rows(classes.where(F.col("size") * (q - p) >= p))
    several = shown.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = materialize(shown.join(several, "key"), "meeting")
    weights = meeting.groupBy("doc").agg(F.sum("n").alias("weight"))
    sets = materialize(_sets(docs.join(weights.select("doc"), "doc", "left_semi"), words), "sets")
    pivots = meeting.join(weights, "doc").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("doc").alias("a"))).alias("pivot"))
    met = materialize(
        meeting.join(pivots, "key").where("doc != pivot.a").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("keys")), "pivots")

    near = _near(met.select("pivot.a", F.col("doc").alias("b"), "pivot.w"), sets, p, q, "w")
    best = near.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("w", "a"))), 1, PIVOTS).alias("best"))
    best = best.select("b", F.explode("best.a").alias("a"))
    links = materialize(_confirmed(best, sets, p, q), "links")

    labels = components(links).withColumnRenamed("node", "doc")
    named = meeting.join(labels, "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    open_ = materialize(named.join(mixed.select("key"), "key", "left_semi"), "open")
    main = open_.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("main"))
    rows = open_.join(_folded(sets, "y"), F.col("doc") == F.col("y_doc")).select("key", F.col("label").alias("y_label"), "y_doc", "y_size", *[f"y_{c}" for c in _FOLDED])
    others = rows.join(main.select(F.col("key").alias("x_key"), F.col("main.label").alias("main")), F.col("key") == F.col("x_key"))
    others = others.where("y_label != main").select("x_key", "main", *[F.col(f"y_{c}").alias(f"x_{c}") for c in ("label", "doc", "size", *_FOLDED)])
    rest = others.join(
        rows, (F.col("x_key") == F.col("key")) & (F.col("x_label") != F.col("y_label"))
        & ((F.col("y_label") == F.col("main")) | (F.col("x_doc") < F.col("y_doc"))) & _room(_FOLDED, p, q))
    rest = _near(rest.select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).distinct(), sets, p, q)
    return materialize(links.union(_confirmed(rest, sets, p, q)), "links")


def join(docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = materialize(describe(docs, words), "described")
    filled = each.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "d1", "d2"]
    classes = materialize(filled.groupBy(*same).agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in _SIGNS]), "classes")
    owned = materialize(filled.select("doc_id", *same).join(classes.select(*same, "doc"), same).select("doc_id", "doc"), "owned")
    links = links_of(classes.withColumnRenamed("n_shingles", "size"), docs.withColumnRenamed("doc_id", "doc"), words, p, q)
    twice = owned.groupBy("doc_id").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least != most")
    tied = owned.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct()
    labels = components(links.union(tied)).withColumnRenamed("node", "doc")
    named = owned.join(labels, "doc", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "doc")).alias("component_id"))
    return each.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id."""
    gone = materialize(join(docs, words, p, q).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
