"""Mixing sources to target weights by Pfair scheduling (operator 3).

The rows of each source are cut into blocks. While sources last, each gets its exact share of the
output; one that runs out leaves, and the others go on in their proportions. So after v turns of
weight a source of n blocks and weight w has got min(v w, n), and T(v), the sum over all sources, is
the output's length. Block j is released at floor(T(j / w)) and due at ceil(T((j + 1) / w)); the
released block that is due first goes next. As the shares add up to one, every block meets its
window, so at any time each source has been given less than one block more or fewer than its share,
however long the output is. Every row is given a place, none is repeated or dropped.

Weights are whole numbers, as fine as 64 bits allow: over the whole output the rounding of a weight
moves a source by less than a thousandth of a block up to 10 million blocks.

Slots are given out in stretches of ``period``. Each stretch is scheduled alone, then one fold over
the stretches hands on what each leaves over (at most a block of each source), and each is scheduled
again with what it was handed. What is handed on is exact: of the blocks of a stretch and those
handed to it, the ones due first go, as a block from before may take any slot.

Defined cases: a null source is a source of its own; equal rows stay all and get places of their
own; an empty table gives an empty table; a source without a given weight gets the smallest one;
clashing names of other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumencat.llm.columns import apart, together
from lumencat.operators.ordered import rank_rows

BLOCK_ROWS, PERIOD, TEMPERATURE = 64, 1000, 0.7
# Schedules of up to this many blocks are broadcast; longer ones are joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000

Source = str | None


def tempered(rows: Mapping[Source, int], exponent: float = TEMPERATURE) -> dict[Source, float]:
    """Target weights that lift small sources: proportional to rows ** exponent."""
    total = sum(n**exponent for n in rows.values()) or 1.0
    return {s: n**exponent / total for s, n in rows.items()}


def whole_parts(weights: Mapping[Source, float], period: int = PERIOD) -> dict[Source, int]:
    """``weights`` as parts of ``period``, by the largest remainders; a source has one part at least."""
    total = sum(weights.values()) or 1.0
    exact = {s: period * w / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    rest = max(0, period - sum(parts.values()))
    for s in sorted(exact, key=lambda s: (parts[s] - exact[s], s is not None, s))[:rest]:
        parts[s] += 1
    return parts


def segments(blocks: Mapping[Source, int], parts: Mapping[Source, int]) -> list[tuple[int, dict[Source, int]]]:
    """(periods, blocks of each source in a period), in order; together they use all blocks up."""
    left, out = {s: n for s, n in blocks.items() if n > 0}, []
    while left:
        whole = min(left[s] // parts[s] for s in left)
        if whole:
            out.append((whole, {s: parts[s] for s in left}))
            left = {s: n - whole * parts[s] for s, n in left.items()}
        last = {s: min(n, parts[s]) for s, n in left.items() if n > 0}
        if last and any(left[s] < parts[s] for s in left):
            out.append((1, last))
            left = {s: n - last.get(s, 0) for s, n in left.items()}
        left = {s: n for s, n in left.items() if n > 0}
    return out


def patterns(shares: DataFrame) -> DataFrame:
    """(segment, slot, source_no, j, release, due) for ``shares`` (segment, source_no, share).

    Earliest deadline first, one slot after the other, as a fold over the slots of each segment.
    """
    own = shares.groupBy("segment").agg(
        F.array_sort(F.collect_list(F.struct("source_no", "share"))).alias("s"), F.sum("share").alias("length"))
    release = lambda j, share: F.floor(j * F.col("length") / share)
    due = lambda j, share: F.ceil((j + 1) * F.col("length") / share)

    def step(acc: Column, slot: Column) -> Column:
        # What the slot before was given to counts first; then the next is picked.
        done = F.zip_with(acc["done"], F.col("s"), lambda j, s: F.when(s["source_no"] == acc["next"]["source_no"], j + 1).otherwise(j))
        ready = F.zip_with(done, F.col("s"), lambda j, s: F.when(
            (j < s["share"]) & (release(j, s["share"]) <= slot),
            F.struct(
                due(j, s["share"]).alias("due"), s["source_no"].alias("source_no"), j.alias("j"),
                release(j, s["share"]).alias("release"),
            ),
        ))
        pick = F.array_min(ready)
        return F.struct(done.alias("done"), pick.alias("next"), F.concat(acc["taken"], F.array(pick)).alias("taken"))

    kind = "struct<due:bigint,source_no:int,j:bigint,release:bigint>"
    start = F.struct(
        F.transform("s", lambda s: F.lit(0).cast("long")).alias("done"),
        F.lit(None).cast(kind).alias("next"),
        F.array().cast(f"array<{kind}>").alias("taken"),
    )
    slots = F.sequence(F.lit(0).cast("long"), F.col("length") - 1)
    taken = own.select("segment", F.posexplode(F.aggregate(slots, start, step, lambda acc: acc["taken"])).alias("slot", "t"))
    return taken.select("segment", "slot", "t.source_no", "t.j", "t.release", "t.due")


def fine_parts(weights: Sequence[float], blocks: int) -> list[int]:
    """``weights`` as whole numbers, as large as products with ``blocks`` may be in 64 bits."""
    total = sum(map(Fraction, weights)) or Fraction(1)
    scale = 1 << (61 - max(blocks, 1).bit_length())
    return [max(1, round(Fraction(w) * scale / total)) for w in weights]


def windows(spark: SparkSession, blocks: Sequence[int], parts: Sequence[int]) -> DataFrame:
    """(source_no, j, release, due) of every block, for the blocks and the weight of each source.

    T is concave, so it is the least of the lines between the ends of sources.
    """
    gone, weight = 0, sum(parts)
    lines = [(gone, weight)]
    for s in sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], parts[s])):
        gone, weight = gone + blocks[s], weight - parts[s]
        lines.append((gone, weight))
    line = spark.createDataFrame([(lines,)], "lines array<struct<gone: long, weight: long>>")
    sources = spark.createDataFrame(list(zip(range(len(blocks)), blocks, parts)), "source_no int, n long, part long")
    some = 10_000  # blocks of a source are made in pieces, so that a large one spans tasks
    pieces = sources.where("n > 0").select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {some})")).alias("piece"))
    pieces = pieces.repartition("source_no", "piece").withColumn(
        "j", F.explode(F.expr(f"sequence(piece * {some}, least(n, (piece + 1) * {some}) - 1)")))
    return pieces.crossJoin(F.broadcast(line)).select(
        "source_no", "j",
        F.expr("array_min(transform(lines, x -> x.gone + (j * x.weight) div part))").alias("release"),
        F.expr("array_min(transform(lines, x -> x.gone + ((j + 1) * x.weight + part - 1) div part))").alias("due"),
    )


_BLOCK = "struct<due:bigint,source_no:int,j:bigint,release:bigint>"


def _first_due(begin: Column, end: Column, fresh: Column, handed: Column) -> Column:
    """(ready, taken): earliest deadline first over the slots from ``begin`` to before ``end``.

    ``taken`` has a block or null for each slot; ``ready`` is left over.
    """
    def rest(acc: Column) -> Column:
        return F.filter(acc["ready"], lambda x: F.coalesce(x != acc["next"], F.lit(True)))

    def step(acc: Column, slot: Column) -> Column:
        # What the slot before took goes first; an expression within a lambda would run per element.
        ready = F.concat(rest(acc), F.filter(fresh, lambda x: x["release"] == slot))
        pick = F.array_min(ready)
        return F.struct(ready.alias("ready"), pick.alias("next"), F.concat(acc["taken"], F.array(pick)).alias("taken"))

    start = F.struct(
        handed.alias("ready"), F.lit(None).cast(_BLOCK).alias("next"), F.array().cast(f"array<{_BLOCK}>").alias("taken"))
    return F.aggregate(
        F.sequence(begin, end - 1), start, step, lambda acc: F.struct(rest(acc).alias("ready"), acc["taken"].alias("taken")))


def schedule(blocks: DataFrame, total: int, period: int = PERIOD) -> DataFrame:
    """(source_no, j, release, due, slot): the ``total`` blocks of ``blocks``, earliest deadline first."""
    spark = blocks.sparkSession
    block = F.struct("due", "source_no", "j", "release").cast(_BLOCK)
    none = F.array().cast(f"array<{_BLOCK}>")
    begin, end = F.col("stretch") * period, F.least((F.col("stretch") + 1) * period, F.lit(total).cast("long"))
    own = blocks.groupBy(F.expr(f"release div {period}").alias("stretch")).agg(F.collect_list(block).alias("fresh"))
    stretches = spark.range(-(-total // period)).withColumnRenamed("id", "stretch").join(own, "stretch", "left")
    stretches = stretches.withColumn("fresh", F.coalesce("fresh", none))

    alone = stretches.select("stretch", (end - begin).alias("room"), _first_due(begin, end, F.col("fresh"), none).alias("run"))
    alone = alone.select(
        "stretch", "room", F.col("run.ready").alias("ready"),
        F.sort_array(F.filter("run.taken", lambda x: x.isNotNull()), asc=False).alias("taken"))
    # Only the last due of a stretch may be pushed out of it: one block of each source at most.
    most = blocks.select(F.count_distinct("source_no").alias("most"))
    alone = alone.crossJoin(F.broadcast(most)).select(F.struct(
        "stretch", "room", "ready", F.size("taken").alias("n"),
        F.slice("taken", F.lit(1), F.greatest("most", F.lit(1)).cast("int")).alias("last")).alias("s"))

    def hand(acc: Column, s: Column) -> Column:
        over = F.greatest(s["n"] + F.size(acc["handed"]) - s["room"], F.lit(0)).cast("int")
        pushed = F.slice(F.sort_array(F.concat(s["last"], acc["handed"]), asc=False), F.lit(1), over)
        return F.struct(
            F.concat(s["ready"], pushed).alias("handed"),
            F.concat(acc["all"], F.array(F.struct(s["stretch"].alias("stretch"), acc["handed"].alias("handed")))).alias("all"))

    start = F.struct(none.alias("handed"), F.array().cast(f"array<struct<stretch:bigint,handed:array<{_BLOCK}>>>").alias("all"))
    # One row per stretch, with a block of each source at most.
    folded = alone.agg(F.aggregate(F.sort_array(F.collect_list("s")), start, hand)["all"].alias("all"))
    handed = folded.select(F.inline("all"))

    run = stretches.join(handed, "stretch").select("stretch", _first_due(begin, end, F.col("fresh"), F.col("handed"))["taken"].alias("taken"))
    slots = run.select("stretch", F.posexplode("taken").alias("at", "t"))
    return slots.select("t.source_no", "t.j", "t.release", "t.due", (F.col("stretch") * period + F.col("at")).alias("slot"))


def mix(
    docs: DataFrame,
    weights: Mapping[Source, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """(row, source, key, block, release, due, slot, place): ``docs`` as the struct ``row``, placed.

    ``place`` orders the output. ``weights`` defaults to ``tempered`` row counts. ``period`` slots are
    given out together. What the driver holds is one count per source.
    """
    spark = docs.sparkSession
    rows = apart(docs, [source, key]).toDF("row", "source", "key")
    counted = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = weights or tempered(counted)
    least = min((weights[s] for s in counted if s in weights), default=1.0)
    names = sorted(counted, key=lambda s: (s is not None, s))
    blocks = [-(-counted[s] // block_rows) for s in names]
    total = sum(blocks)
    slots = schedule(windows(spark, blocks, fine_parts([weights.get(s, least) for s in names], total)), total, period)
    slots = slots.withColumnRenamed("j", "block")

    # Rows of a source are numbered along (source, key); a source of any size spans many tasks.
    ranked = rank_rows(rows.withColumn("tie", F.xxhash64("row")), ["source", "key", "tie"], "rank").drop("tie")
    before, starts = 0, []
    for no, s in enumerate(names):
        starts.append((no, s, before))
        before += counted[s]
    begun = F.broadcast(spark.createDataFrame(starts, "source_no int, start_source string, before long"))  # a row per source
    numbered = ranked.join(begun, F.col("source").eqNullSafe(F.col("start_source"))).withColumn(
        "nth", F.col("rank") - F.col("before") - 1)
    placed = numbered.withColumn("block", F.floor(F.col("nth") / block_rows))
    out = placed.join(F.broadcast(slots) if total <= BROADCAST_BLOCKS else slots, ["source_no", "block"])
    return out.select(
        "row", "source", "key", "block", "release", "due", "slot",
        (F.col("slot") * block_rows + F.col("nth") % block_rows).alias("place"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: written, its files follow each other in that order."""
    placed = mix(docs, **options)
    return together(placed.repartitionByRange("place").sortWithinPartitions("place"), docs)
