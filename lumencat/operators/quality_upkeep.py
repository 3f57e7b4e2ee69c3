"""C1 to C6 kept up by changes: signed counts of keys and of broken rules, and the report over them.

A batch of changed rows adds to the counts with their signs. Only keys that it touches are examined
again: a foreign key both where a child came or went and where a parent did.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lumencat.operators.quality import broken_rules, joined_value
from lumencat.schemas import TABLES, TableRules
from lumencat.sources.storage import SnapshotTable, children

# A counter is all rows of a table by the values of some columns, or by the rule that they break.
_COUNTS = "counter string, key string, value string, n long, bucket int, batch long"
_REPORT = T.StructType([
    T.StructField(name, T.StringType()) for name in ("rule", "table_name", "columns", "key", "value")
] + [T.StructField("row_count", T.LongType())])
_RULE = ["rule", "table_name", "columns"]
# Keys as text tell apart whatever their values as text tell apart.
_KEY_TEXT = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _counter(table: str, columns: tuple[str, ...]) -> str:
    return f"{table}({','.join(columns)})"


class KeptReport:
    """The report of ``quality.check_tables`` for tables with ``rules``, kept under ``root``.

    Rows of a batch have a ``sign``: 1 for a row that came, -1 for one that went; an updated row is
    both. Batches are numbered and applied in order; one that runs again replaces what it wrote. A
    key of which more rows went than came counts as none.
    """

    def __init__(self, spark: SparkSession, root: str, rules: Mapping[str, TableRules] = TABLES, buckets: int = 64):
        self.spark, self.root, self.rules, self.buckets = spark, root.rstrip("/"), rules, buckets
        self.kept = SnapshotTable(spark, f"{self.root}/report", _REPORT)

    def _keys(self, table: str) -> list[tuple[str, ...]]:
        """The column lists of ``table`` whose values are counted: own keys, and both ends of references."""
        rule = self.rules[table]
        lists = [tuple(rule.primary), *[(c,) for c in rule.unique], *[(c,) for c in rule.foreign]]
        for other in self.rules.values():
            lists += [(key,) for parent, key in other.foreign.values() if parent == table]
        return list(dict.fromkeys(lists))

    def _signed(self, changes: Mapping[str, DataFrame]) -> DataFrame:
        """(counter, key, value, n): what the changed rows add to the counters.

        Keys are counted as the columns they are, all lists of a table in one pass, and become text
        once per key.
        """
        parts = []
        for table, rows in changes.items():
            lists = self._keys(table)
            columns = list(dict.fromkeys(c for names in lists for c in names))
            added = F.sum("sign").cast("long").alias("n")
            # In grouping_id, the bit of a column is set where the grouping leaves the column out.
            group = {names: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in names) for names in lists}
            sets = [[F.col(c) for c in names] for names in lists]
            sums = rows.groupingSets(sets, *columns).agg(added, F.grouping_id().alias("__group")).where("n <> 0")
            chosen = F.lit(None)
            for names in lists:
                key = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]), _KEY_TEXT)
                item = F.struct(F.lit(_counter(table, names)).alias("counter"), key.alias("key"), joined_value(names).alias("value"))
                chosen = F.when(F.col("__group") == group[names], item).otherwise(chosen)
            parts.append(sums.select(chosen.alias("item"), "n").select("item.*", "n"))
            broken = broken_rules(self.rules[table])
            if broken:
                items = []
                for test, rule, column, value in broken:
                    text = value.cast("string")
                    items.append(F.when(test, F.struct(
                        F.lit(f"{rule}:{table}({column})").alias("counter"), F.coalesce(text, F.lit("")).alias("key"), text.alias("value"))))
                found = rows.where(reduce(Column.__or__, [test for test, *_ in broken])).select("sign", F.inline(F.array_compact(F.array(*items))))
                parts.append(found.groupBy("counter", "key", "value").agg(added).where("n <> 0"))
        return reduce(DataFrame.unionByName, parts)

    def _rules_table(self) -> DataFrame:
        """A row per rule: whose counter it looks at, and the parent's counter for references."""
        rows = []
        for table, rule in self.rules.items():
            rows.append(("primary_key", table, ",".join(rule.primary), _counter(table, tuple(rule.primary)), None))
            rows += [("unique", table, c, _counter(table, (c,)), None) for c in rule.unique]
            rows += [
                ("foreign_key", table, c, _counter(table, (c,)), _counter(parent, (key,)))
                for c, (parent, key) in rule.foreign.items() if parent in self.rules
            ]
            rows += [(name, table, c, f"{name}:{table}({c})", None) for _, name, c, _ in broken_rules(rule)]
        return self.spark.createDataFrame(rows, "rule string, table_name string, columns string, counter string, parent string")

    def _stored(self, batch: int) -> DataFrame:
        """All signed counts up to ``batch``: the newest base before it and what came since."""
        bases = [int(n.removeprefix("upto=")) for n in children(self.spark, f"{self.root}/base")]
        done = [b for b in bases if b < batch and "_SUCCESS" in children(self.spark, f"{self.root}/base/upto={b}")]
        base = max(done, default=-1)
        rows = self.spark.read.schema(_COUNTS).parquet(f"{self.root}/counts").where(F.col("batch").between(base + 1, batch))
        if base < 0:
            return rows
        folded = self.spark.read.schema(_COUNTS).parquet(f"{self.root}/base/upto={base}")
        return rows.unionByName(folded)

    def _bucketed(self, counts: DataFrame) -> DataFrame:
        # One key's counts share a bucket over all counters, so parents and children meet there.
        return counts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _dealt(self, counts: DataFrame, partitions: list[str]) -> DataFrame:
        return counts.withColumn("__part", F.pmod(F.xxhash64("key", "counter"), F.lit(4))).repartition(*partitions, "__part")

    def _write(self, dealt: DataFrame, path: str, partitions: list[str]) -> None:
        dealt.drop("__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)

    def apply(self, changes: Mapping[str, DataFrame], batch: int) -> None:
        """Take in the signed rows of ``changes`` and renew the report where they touch it.

        All counts of a key meet in one shuffle, its own and those of its parents, whichever counter
        they belong to.
        """
        signed = self._bucketed(self._signed(changes)).withColumn("batch", F.lit(batch).cast("long"))
        self._write(self._dealt(signed, ["bucket", "batch"]), f"{self.root}/counts", ["bucket", "batch"])
        delta = self.spark.read.schema(_COUNTS).parquet(f"{self.root}/counts").where(F.col("batch") == batch)
        rules = F.broadcast(self._rules_table())  # a row per declared rule
        # Buckets without a touched key are not read; there are at most ``buckets`` numbers.
        buckets = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
        stored = self._stored(batch).where(F.col("bucket").isin(buckets))
        version = self.kept.current_version(before=batch)
        if version is None:
            stored = stored.repartition("key")
        else:
            stored = stored.join(delta.select("key"), "key", "left_semi")
        sums = stored.groupBy("counter", "key", "value").agg(F.sum("n").alias("n"), F.max(F.col("batch") == batch).alias("moved"))
        of_key = Window.partitionBy("key")
        parents = sorted({
            _counter(parent, (key,)) for rule in self.rules.values() for parent, key in rule.foreign.values() if parent in self.rules
        })
        # A key that is neither a reference nor referred to matters only where it is repeated.
        alone = {_counter(table, names) for table in self.rules for names in self._keys(table)} - set(parents) - {
            _counter(table, (c,)) for table, rule in self.rules.items() for c in rule.foreign
        }
        seen = sums.where((F.col("n") > 1) | ~F.col("counter").isin(sorted(alone))).select("*", *[
            F.max(F.when(F.col("counter") == parent, test)).over(of_key).alias(f"__{name}_{i}")
            for i, parent in enumerate(parents) for name, test in (("found", F.col("n") > 0), ("moved", F.col("moved")))
        ])

        def of_parent(name: str) -> Column:
            value = F.lit(False)
            for i, parent in enumerate(parents):
                value = F.when(F.col("parent") == parent, F.coalesce(F.col(f"__{name}_{i}"), F.lit(False))).otherwise(value)
            return value

        # A changed counter touches the rules that look at it, and those whose parent it is.
        looked = seen.where("n > 0").join(rules, "counter").where(F.col("moved") | of_parent("moved"))
        rule = F.col("rule")
        real = ~F.col("key").rlike('^\\{"k0":null\\}$')  # a NULL is neither a repeated value nor a reference
        wrong = (
            F.when(rule == "primary_key", F.col("n") > 1)
            .when(rule == "unique", real & (F.col("n") > 1))
            .when(rule == "foreign_key", real & ~of_parent("found"))
            .otherwise(True)
        )
        now = looked.where(wrong).select(*_RULE, "key", "value", F.col("n").alias("row_count"))
        if version is not None:
            moved = delta.select("counter", "key")
            touched = moved.join(rules, "counter").select(*_RULE, "key").unionByName(
                moved.withColumnRenamed("counter", "parent").join(rules, "parent").select(*_RULE, "key"))
            now = self.kept.read(version).join(touched, [*_RULE, "key"], "left_anti").unionByName(now)
        self.kept.commit(now, batch)

    def fold(self, batch: int) -> None:
        """Sum all counts up to ``batch`` into one base; later batches read no older ones."""
        # Dealt out as they are written, the counts of a key are together already when they are summed.
        dealt = self._dealt(self._stored(batch), ["bucket"])
        sums = dealt.groupBy("bucket", "__part", "counter", "key", "value").agg(F.sum("n").alias("n"))
        kept = sums.where("n <> 0").withColumn("batch", F.lit(batch).cast("long"))
        self._write(kept, f"{self.root}/base/upto={batch}", ["bucket"])

    def report(self) -> DataFrame:
        return self.kept.read().drop("key")
