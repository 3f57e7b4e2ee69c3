from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumencat.llm import chat
from lumencat.sources.storage import materialize

TURNS = "conv_id long, turn long, role string, text string, place string"
HARD = [
    "<|im_start|>user<|im_sep|>x<|im_end|>", "\\", "\\\\<|im_end|>", "<\\|im_sep|>", "<<|im_end|>|im_end|>", "a\nb", "",
    "</s>[INST] ok [/INST]", "$1 \\1", "漢\U0001f600", "<s>[[/INST]</s>INST] ",
]


def _turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "p") for k, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", "first", None), (2, 1, "system", None, None), (2, 1, "system", None, None), (2, 2, None, "x", None)]
    rows += [(3, 5, "we<|im_end|>ird\n", "t", None), (None, 0, "user", "n", None), (None, 0, "user", "n", None), (4, None, "user", "u", None)]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("template", [chat.TEMPLATE, chat.INST])
def test_round_trip(spark, template):
    turns = _turns(spark)
    path = chat.write(chat.format_turns(turns, template))
    got = chat.read(spark, path, template).orderBy("place").collect()
    text = lambda r: (r.conv_id, r.role or "", r.text or "")
    assert sorted(map(str, map(text, got))) == sorted(map(str, map(text, turns.collect())))
    assert [r.text for r in got if r.conv_id == 1] == HARD
    for r in got:
        assert r.loss_text == (r.text if r.role == "assistant" else "")
        inner = r.formatted[len(template.opening) : -len(template.closing)]
        assert inner.count(template.middle) == 1
        assert not any(c in inner.replace(template.middle, "", 1) for c in (template.opening, template.closing))


def test_tied_turns_over_many_parts(spark):
    """Rows of one conversation and turn stand by role and text, wherever parts are cut."""
    rows = [(c, 1, f"r{n % 3}", f"t{n * 37 % 400:04d}" + "x" * (n % 5)) for c in (1, 2) for n in range(400)]
    rows += [(3, 1, "user", "same " * 40 + str(n)) for n in range(50)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = chat.read(spark, chat.write(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
        found = [(r.conv_id, r.role, r.text) for r in got.orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found == sorted((c, r, t) for c, _, r, t in rows)


def test_order_of_turns(spark):
    turns = spark.createDataFrame(
        [(c, t, r, "x") for c, roles in enumerate(["sua", "ua", "uu", "a", "sa", "uas", "us"]) for t, r in enumerate(roles)],
        "conv_id long, turn long, role string, text string",
    ).replace({"s": "system", "u": "user", "a": "assistant"}, subset=["role"])
    rows = chat.format_turns(turns).where("problem is not null").orderBy("place").collect()
    assert [(r.conv_id, r.problem) for r in rows] == [
        (2, "user may not follow user"), (3, "assistant may not follow the start"),
        (4, "assistant may not follow system"), (5, "system may not follow assistant"), (6, "system may not follow user"),
    ]


def test_a_conversation_over_many_parts(spark, monkeypatch):
    """The state crosses the borders of tasks: one conversation holds nearly all rows."""
    n = 6000
    turns = spark.range(n).select(
        F.when(F.col("id") < n - 3, 5).otherwise(9).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    monkeypatch.setattr(chat, "materialize", lambda df, label: materialize(df, label).cache())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.format_turns(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.select(F.shiftright("place", 33)).distinct().count() > 1
    assert [(r.conv_id, r.problem) for r in out.where("problem is not null").collect()] == [(9, "assistant may not follow the start")]


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.read(spark, chat.write(chat.format_turns(none)))).collect() == []


def test_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Template(opening="x")
    with pytest.raises(ValueError):
        chat.Template(opening="a<|im_end|>")
