"""N-gram Jaccard join by PartEnum signatures (operator 10).

Two texts link when their sets of distinct word n-grams have a Jaccard similarity of at least
``p / q``. Sets of like size differ in at most k elements then, so of the parts that a fixed
partition of the n-gram domain gives, at most k differ between them, and they share the content of
another. The partition depends on a band of sizes; a set also takes part in the band above when a
partner may lie there. A signature is a part and its content. Of its signatures a set needs to show
only k + 1 in any order that all sets keep to, and that order is rarest first: what nobody else has
costs no comparison, and a passage that many texts share counts only for texts that hold little
else. Sets with too few filled parts (``m <= k``; tiny ones) meet under a partition into single
elements instead.

Sets that share a signature are compared with the first few of their bucket, those with the fewest
signatures of their own, as the text that others were made from has: each set with the one of them that
it shares most signatures with, then with those that this left in another component. Buckets whose sets then lie in
one component are done, the others go on with more pivots until all their pairs of different
components were looked at. So no link is lost, and groups of copies cost a few comparisons per
member. Before two sets are fetched and compared, the parities of their elements over ``BITS`` bits
are: every element that only one set has flips one bit, so more unequal bits than a link allows rule
it out, and in the later rounds the join itself drops such pairs.

Defined cases: texts of 1 to n - 1 words are one n-gram; null, empty and blank texts have no set and
link with nothing; rows of a null doc_id link with nothing and have no component; rows that share a
doc_id are one node with the links of all of them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumencat.llm.components import components
from lumencat.llm.textvec import mix, stretches, word_hashes
from lumencat.sources.storage import materialize

WORDS, P, Q = 5, 75, 100
#: Sizes of one band differ by less than this factor.
BAND = 4
FEWEST_PARTS = 64
#: Pivots of the first round; each later round has so many times more.
PIVOTS, MORE = 2, 512
BITS = 1024
_PARITY = [f"s{k}" for k in range(BITS // 64)]
_U = np.uint64
_FIELD = 28
_SINGLE = 64  # instances from here on are partitions into single elements


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for part in stretches(column):
        yield from _sets_of(part, words)


def _sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    hashes, begins = word_hashes(column)
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        grams = grams * _U(0xD6E8FEB86659FD93) + hashes[k : k + len(grams)]
    grams = mix(grams + _U(words))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            one = _U(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    one = one * _U(0xD6E8FEB86659FD93) + h
                yield mix(np.array([one + _U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signatures(grams: np.ndarray, p: int = P, q: int = Q) -> Iterator[tuple[int, int, np.ndarray]]:
    """(instance, slack, signatures) of one set; all but ``slack`` of the signatures must be shown."""
    size = len(grams)
    band = 0
    while BAND ** (band + 1) <= size:
        band += 1
    for i in (band, band + 1):
        low, top = BAND**i, BAND ** (i + 1) - 1
        if size * q < p * low:
            continue
        partner = min(size * q // p, top)
        differ = (q - p) * (size + partner) // (q + p)
        most = (q - p) * 2 * top // (q + p)
        extra = most // 10 + 2  # the same for all sets of the instance
        parts = max(FEWEST_PARTS, most * 3 // 2)
        part = ((grams >> _U(32)) * _U(parts)) >> _U(32)
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(mix(grams ^ _U(0x5851F42D4C957F2D * (i + 1) % (1 << 64))), begins)
        filled = mix(content + part[begins] * _U(0x2545F4914F6CDD1D) + _U(i))
        shown = np.sort(filled)[: differ + 1 + extra]
        yield i, max(0, len(shown) - differ - 1) if len(filled) > differ else 0, shown
        if len(filled) <= differ:
            single = np.sort(mix(grams + _U(0x632BE59BD9B4E019 * (i + 1) % (1 << 64))))[: differ + 1 + extra]
            yield i + _SINGLE, max(0, len(single) - differ - 1), single


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): the size of each row's set and 128 bits that tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d1, d2 = [], [], []
            for grams in shingle_sets(batch.column(1), words):
                sizes.append(len(grams))
                d1.append(mix(grams ^ _U(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64))
                d2.append(mix(grams + _U(0xABC98388FB8FAC03)).sum(dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _as_long(np.array(d1, np.uint64)), _as_long(np.array(d2, np.uint64))],
                ["doc_id", "n_shingles", "d1", "d2"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def signature_rows(docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """(sig, doc, part): the signatures that each text shows; of equal sets, a task shows the first.

    ``part`` packs the instance, the number shown and the slack: these rows are most of what travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def batch_of(rows: list) -> pa.RecordBatch:
            sizes = [len(s) for _, _, _, s in rows]
            sigs = np.concatenate([s for _, _, _, s in rows]) if rows else np.zeros(0, np.uint64)
            part = [instance << 2 * _FIELD | len(s) << _FIELD | slack for _, instance, slack, s in rows]
            columns = [np.repeat(np.array(c, np.int64), sizes) for c in ([r[0] for r in rows], part)]
            return pa.RecordBatch.from_arrays([_as_long(sigs), *map(pa.array, columns)], ["sig", "doc", "part"])

        for batch in batches:
            rows: list = []
            held = 0
            for doc, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                same = (len(grams), int(mix(grams ^ _U(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)))
                if doc is None or not len(grams) or same in seen:
                    continue
                seen.add(same)
                for instance, slack, sigs in signatures(grams, p, q):
                    rows.append((doc, instance, slack, sigs))
                    held += len(sigs)
                if held > 200_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, doc long, part long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc, size, s0 .., grams): the set of each text, and the parities of its elements by their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            sets = list(shingle_sets(batch.column(1), words))
            parity = np.zeros((len(sets), BITS // 64), np.int64)
            for k, grams in enumerate(sets):
                odd = np.bincount((grams & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                parity[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in sets], pa.int64()), *(pa.array(c) for c in parity.T.copy()),
                 pa.array([g.tobytes() for g in sets], pa.binary())],
                ["doc", "size", *_PARITY, "grams"],
            )

    kind = f"doc long, size long, {', '.join(f'{c} long' for c in _PARITY)}, grams binary"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _sketch(sets: DataFrame, mark: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{mark}_{c}") for c in ("doc", "size", *_PARITY)])


def _may_link(p: int, q: int) -> Column:
    """Whether the parities of sets x and y leave room for a link: never wrong about one that is."""
    unequal = reduce(lambda n, c: n + F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))), _PARITY, F.lit(0))
    return (q + p) * unequal <= (q - p) * (F.col("x_size") + F.col("y_size"))


def _similar(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(q * both >= p * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The links among the distinct pairs (a, b): parities first, then whole sets."""
    pairs = pairs.join(_sketch(sets, "x"), F.col("a") == F.col("x_doc")).join(_sketch(sets, "y"), F.col("b") == F.col("y_doc"))
    return _similar(pairs.where(_may_link(p, q)).select("a", "b").distinct(), sets, p, q)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are in different components; a set without a label is its own."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        pairs = pairs.join(named, side, "left")
    return pairs.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def buckets(rows: DataFrame) -> DataFrame:
    """(sig, doc, place, n): who meets under a signature, after each set kept its rarest ones.

    ``place`` 1 has the fewest signatures that nobody else shows.
    """
    sharing = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("n > 1")
    own = Window.partitionBy("doc", "part")
    field = (1 << _FIELD) - 1
    slack, shown = F.col("part").bitwiseAND(field), F.shiftright("part", _FIELD).bitwiseAND(field)
    kept = (
        sharing.withColumn("place", F.row_number().over(own.orderBy("n", "sig")))
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .where(F.col("place") <= F.col("shared") - slack)
        .groupBy("sig", "doc").agg(F.min(shown - F.col("shared")).alias("alone"))
    )
    bucket = Window.partitionBy("sig")
    return (
        kept.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
        .select("sig", "doc", F.row_number().over(bucket.orderBy("alone", "doc")).alias("place"), "n")
    )


def join(docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = materialize(describe(docs, words), "described")
    same = ["n_shingles", "d1", "d2"]
    filled = each.where("n_shingles > 0 and doc_id is not null")
    first = filled.groupBy(*same).agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = filled.join(first, same).where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    meeting = materialize(buckets(signature_rows(docs, words, p, q)), "buckets")
    members = meeting.select(F.col("doc").alias("doc_id")).distinct()
    sets = materialize(_sets(docs.join(members, "doc_id", "left_semi"), words), "sets")

    x, y = _sketch(sets, "x"), _sketch(sets, "y")
    pivots = meeting.where(F.col("place") <= PIVOTS).select("sig", F.col("doc").alias("a"), F.col("place").alias("pivot"))
    met = meeting.join(pivots, "sig").where("place > pivot").groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    met = materialize(met, "met")
    # Each set first meets the one pivot that it shares most with; other pivots only where that left them apart.
    nearest = met.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = materialize(links.unionByName(_linked(nearest, sets, p, q)), "links")
    links = materialize(links.unionByName(_linked(_apart(met, components(links)), sets, p, q)), "links")
    low, high = PIVOTS, PIVOTS * MORE
    while True:
        labels = components(links)
        # Buckets beyond the pivots so far that still hold several components.
        named = meeting.where(F.col("n") > low).join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
            "label", F.coalesce("label", "doc"))
        mixed = named.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
        open_ = materialize(named.join(mixed.select("sig"), "sig", "left_semi"), "open")
        if open_.isEmpty():
            break
        pivots = open_.where(F.col("place").between(low + 1, high)).select(
            "sig", F.col("doc").alias("a"), F.col("place").alias("pivot"), F.col("label").alias("pivot_label"))
        pivots = pivots.join(x, F.col("a") == F.col("x_doc"))
        members = open_.join(y, F.col("doc") == F.col("y_doc"))
        pairs = members.join(pivots, (members["sig"] == pivots["sig"]) & _may_link(p, q) & F.expr("place > pivot and label != pivot_label"))
        pairs = pairs.select("a", F.col("doc").alias("b")).distinct()
        links = materialize(links.unionByName(_similar(pairs, sets, p, q)), "links")
        low, high = high, high * MORE
    return each.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, words: int = WORDS, p: int = P, q: int = Q) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id.

    Of rows that share a doc_id and have words, one stays. Rows without words or doc_id stay.
    """
    found = materialize(join(docs, words, p, q), "components")
    gone = found.where("component_id != doc_id").select("doc_id").distinct()
    twice = materialize(
        found.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(docs.columns)
    wordless = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    return (
        kept.join(twice, "doc_id", "left_anti").select(docs.columns)
        .union(again.where(~wordless).dropDuplicates(["doc_id"]))
        .union(again.where(wordless))
    )
