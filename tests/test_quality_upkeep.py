"""The kept report against a full check of the tables after every batch."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from lumencat.operators import quality
from lumencat.operators.quality_upkeep import KeptReport
from lumencat.schemas import TableRules

PARENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
CHILD = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("kind", T.StringType()),
])
RULES = {
    "parent": TableRules(PARENT, ("id",), unique=("name",), not_null=("name",), lengths={"name": 3}),
    "child": TableRules(CHILD, ("a", "b"), foreign={"a": ("parent", "id")}, domains={"kind": ("x", "y")}),
}


def report(df):
    return sorted(tuple(map(str, r)) for r in df.select("rule", "table_name", "columns", "value", "row_count").collect())


def frame(spark, name, counted):
    return spark.createDataFrame(list(counted.elements()), RULES[name].schema)


def signed(spark, name, before, after):
    rows = [(*row, 1) for row in (after - before).elements()] + [(*row, -1) for row in (before - after).elements()]
    return spark.createDataFrame(rows, T.StructType([*RULES[name].schema.fields, T.StructField("sign", T.IntegerType())]))


@pytest.mark.parametrize("fold", [False, True])
def test_every_batch_equals_a_full_check(spark, tmp_path, fold):
    rng = random.Random(11)
    kept = KeptReport(spark, str(tmp_path), RULES, buckets=4)
    state = {"parent": Counter(), "child": Counter()}

    def parent():
        return (rng.choice([None, *range(8)]), rng.choice([None, "", "p", "qq", "long name", "p,q"]))

    def child():
        return (rng.choice([None, *range(10)]), rng.choice([None, "", "1", "1,2"]), rng.choice([None, "x", "y", "z", ""]))

    for batch in range(4):
        after = {}
        for name, make in (("parent", parent), ("child", child)):
            rows = [row for row in state[name].elements() if rng.random() > 0.4]
            after[name] = Counter(rows + [make() for _ in range(0 if batch == 2 and name == "parent" else 12)])
        if batch == 3:
            after["parent"] = Counter()  # every child is an orphan now
        changes = {name: signed(spark, name, state[name], after[name]) for name in RULES}
        for _ in range(2 if batch == 1 else 1):
            kept.apply(changes, batch)
        if fold and batch in (0, 2):
            kept.fold(batch)
        state = after
        full = quality.check_tables({name: frame(spark, name, state[name]) for name in RULES}, RULES)
        assert report(kept.report()) == report(full)


def test_an_empty_start_and_a_batch_without_rows(spark, tmp_path):
    kept = KeptReport(spark, str(tmp_path), RULES)
    nothing = signed(spark, "parent", Counter(), Counter())
    kept.apply({"parent": nothing}, 0)
    assert kept.report().collect() == []
    kept.apply({"child": signed(spark, "child", Counter(), Counter([(1, "b", "x")]))}, 1)
    assert report(kept.report()) == [("foreign_key", "child", "a", "1", "1")]
    # The parent's side alone cures it; the child is not written again.
    kept.apply({"parent": signed(spark, "parent", Counter(), Counter([(1, "p")]))}, 2)
    assert kept.report().collect() == []
    written = spark.read.parquet(f"{tmp_path}/counts").where("batch = 2")
    assert {r.counter for r in written.collect()} == {"parent(id)", "parent(name)"}


def test_keys_are_counted_before_they_become_text(spark, tmp_path):
    """Text keys in the sum of every changed row made a batch cost several times its shuffle."""
    kept = KeptReport(spark, str(tmp_path), {"parent": RULES["parent"]})
    rows = signed(spark, "parent", Counter(), Counter([(1, "p"), (1, "q")]))
    plan = kept._signed({"parent": rows})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().index("json") < plan.index("Aggregate")
    found = {(r.counter, r.key, r.n) for r in kept._signed({"parent": rows}).collect()}
    assert found == {("parent(id)", '{"k0":1}', 2), ("parent(name)", '{"k0":"p"}', 1), ("parent(name)", '{"k0":"q"}', 1)}
