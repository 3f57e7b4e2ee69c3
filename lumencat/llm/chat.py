"""Chat formatting from a declarative template, with a loss flag per segment (operator 2).

A finite-state machine whose states are the roles (and the start) says which role may follow which.
Conversations are put in order once, over all of them, so that one of any length spans many tasks;
each turn needs only the role before it, which the last row of the part before hands over. Control
strings inside texts and roles are escaped: every backslash is doubled, and a backslash goes in after
the first character wherever a control string begins.

Defined cases: null texts and roles are empty; turns of one number are ordered by role and text, all
stay, and the second is a ``problem``; a role that may not follow is a problem too, and is formatted
all the same; null conv_ids are one conversation; other columns are ignored; an empty table gives an
empty output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumencat.sources.storage import fresh_path, materialize

START = ""


@dataclass(frozen=True)
class Template:
    """Marks around the role and text of a turn, the roles that are trained, and who follows whom.

    The marks must be of two characters at least, without backslashes, and none may begin inside
    another.
    """

    opening: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opening, self.middle, self.closing

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or any(other in c[1:] for other in self.controls):
                raise ValueError(f"not fit as a mark: {c!r}")


TEMPLATE = Template()
#: The same turns between the marks of another convention.
INST = Template(opening="<s>[", middle="INST] ", closing=" [/INST]</s>")


def escape(text: Column, template: Template) -> Column:
    begins = "|".join(re.escape(c) for c in template.controls)
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?s)(?={begins})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, place, segments, problem) per turn; ``segments`` are structs (text, loss).

    ``place`` orders the turns of a conversation, and conversations by conv_id.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        plain("role").alias("role"), plain("text").alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]

    def with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beside each row the conversation, turn and role of the row before; null at a part's start."""
        carried = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string())]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).cast(c.type) for k, c in enumerate(carried)]
            shifted = [pa.concat_arrays([c, o[:-1]]) for c, o in zip(carried, own)]
            carried = [o[-1:] for o in own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *shifted], [*batch.schema.names, "last_conv", "last_turn", "last_role"])

    # Parts are cut in the order they are sorted by; what the starts of texts tie stays in one part.
    ranged = turns.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    parts = materialize(
        ranged.mapInArrow(
            with_last,
            "conv_id long, turn long, role string, text string, last_conv long, last_turn long, last_role string",
        ).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "turns",
    )
    tails = parts.groupBy("part").agg(F.max_by(F.struct("conv_id", "turn", "role"), "place").alias("tail"))
    # One row per part.
    before = F.broadcast(tails.select("part", F.lag("tail").over(Window.orderBy("part")).alias("before")))
    first = F.col("last_role").isNull()
    last_role = F.when(first, F.col("before.role")).otherwise(F.col("last_role"))
    last_turn = F.when(first, F.col("before.turn")).otherwise(F.col("last_turn"))
    last_conv = F.when(first, F.col("before.conv_id")).otherwise(F.col("last_conv"))
    goes_on = last_role.isNotNull() & last_conv.eqNullSafe(F.col("conv_id"))
    state = F.when(goes_on, last_role).otherwise(F.lit(START))
    allowed = F.lit(False)
    for role, nexts in template.follows.items():
        allowed = allowed | ((state == role) & (goes_on if role != START else ~goes_on) & F.col("role").isin(*nexts))
    problem = F.when(goes_on & last_turn.eqNullSafe(F.col("turn")), F.lit("turn repeats")).when(
        ~allowed, F.concat(F.col("role"), F.lit(" may not follow "), F.when(state == START, "the start").otherwise(state)))
    loss = F.col("role").isin(*template.trained)
    segments = F.array(
        F.struct(
            F.concat(F.lit(template.opening), escape(F.col("role"), template), F.lit(template.middle)).alias("text"),
            F.lit(False).alias("loss"),
        ),
        F.struct(escape(F.col("text"), template).alias("text"), loss.alias("loss")),
        F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
    )
    return parts.join(before, "part").select("conv_id", "place", segments.alias("segments"), problem.alias("problem"))


def write(formatted: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(formatted.sparkSession, "chat")
    formatted.write.parquet(path)
    return path


def read(spark: SparkSession, path: str, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, place, role, text, formatted, loss_text, problem), parsed from the formatted text.

    ``loss_text`` is the unescaped text under the loss mask. A turn that doesn't parse is an error.
    """
    rows = spark.read.parquet(path)
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    marked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    opening, middle, closing = (re.escape(c) for c in template.controls)
    turn = f"(?s)^{opening}(.*?){middle}(.*?){closing}$"
    part = lambda n: F.when(
        F.col("formatted").rlike(turn), unescape(F.regexp_extract("formatted", turn, n))
    ).otherwise(F.raise_error(F.lit("a turn without its marks")))
    return rows.withColumn("formatted", formatted).select(
        "conv_id", "place", part(1).alias("role"), part(2).alias("text"), "formatted",
        unescape(marked).alias("loss_text"), "problem",
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation the counts and digests of ``read``; rows are hashed as they stream by.

    A digest is a chain over its conversation, which one task walks in memory of one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_problems"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        done: list[list] = []

        def close() -> None:
            n, turns_hash, loss_chars, loss_hash, chars, problems = state
            done.append([key, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, problems])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [[]] * 7, kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            for conv, role, text, formatted, loss, problem in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
                state[5] += problem is not None
            yield flush()
        if state is not None:
            close()
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "role", "text", "formatted", "loss_text", "problem").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_problems long",
    )
