"""Merkle manifest of a dataset: a tree of hashes per group, and a proof for every row (operator 13).

A leaf is the hash of a row's fields, each with its byte count before it (``-`` if null). The leaves
of a group stand in key order; runs of ``arity`` consecutive nodes become the hash of the run, level
by level, until one node, the subroot, is left. The subroots, in group order, make the root in the
same way. The proof of a row is the siblings it meets on its way up; folding a leaf with its proof
gives the root again if, and only if, nothing of the row has changed.

The tree is cut into superblocks of ``arity ** LEVELS`` consecutive nodes. A first pass reduces each
superblock to its top, and the tops, so many times fewer, are reduced likewise until one node per
group is left. Then paths come down: the nodes of a superblock and the outer siblings of its top,
which hang above all of them alike, meet in one cogroup that redoes the reduction inside, joins the
siblings from inside and outside and folds. So a group of any size is shared out over tasks of
bounded memory, and what travels is a hash per row and a path per superblock.

Defined cases: a null field is ``-`` and an empty text ``0:``; a null key comes first; rows of one
key stand in the order of their leaves, so repeated rows are leaves of their own, side by side; a
null group is a group of its own, before the others; an empty table has no root and no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumencat.operators.ordered import rank_rows
from lumencat.sources.storage import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run; a superblock is so many levels high.
ARITY, LEVELS = 2, 10
_PATH = "lefts array<string>, rights array<string>"


def leaf(fields: Sequence[Column | str]) -> Column:
    """The hash of a row: each field as its UTF-8 byte count, a colon and itself, or as ``-``."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*marked), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _reduced(nodes: list[str], size: int, arity: int, levels: int) -> list[list[str]]:
    """The levels of one superblock, from its nodes to its top, in a tree of ``size`` nodes.

    A superblock that is all of its tree ends with the last node, others after ``levels`` levels.
    """
    made = [nodes]
    whole = size <= arity**levels
    while (len(made[-1]) > 1) if whole else (len(made) <= levels):
        last = made[-1]
        made.append([_hash("".join(last[at : at + arity])) for at in range(0, len(last), arity)])
    return made


def _siblings(made: list[list[str]], at: int, arity: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``at`` and its ancestors within their runs, level by level."""
    lefts, rights = [], []
    for level in made[:-1]:
        first = at - at % arity
        lefts.append("".join(level[first:at]))
        rights.append("".join(level[at + 1 : first + arity]))
        at //= arity
    return lefts, rights


def fold(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights):
        node = _hash(left + node + right)
    return node


def proof_digest(lefts: Sequence[str], rights: Sequence[str]) -> str:
    return _hash("".join(left + right for left, right in zip(lefts, rights)))


def _block(levels: int, arity: int) -> Column:
    return F.floor(F.col("pos") / F.lit(arity**levels)).cast("long").alias("block")


def _tops(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, size, pos, node): the top of each superblock, as the nodes of a tree so much smaller."""

    def reduce_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, size, block = key
        made = _reduced(rows.sort_values("pos")["node"].tolist(), size, arity, levels)
        return pd.DataFrame({"tree": [tree], "size": [-(-size // arity**levels)], "pos": [block], "node": [made[-1][0]]})

    return nodes.groupBy("tree", "size", _block(levels, arity)).applyInPandas(
        reduce_block, "tree long, size long, pos long, node string")


def _paths(nodes: DataFrame, most: int, arity: int, levels: int) -> DataFrame:
    """(tree, pos, lefts, rights, top): the siblings of each node up to the top of its tree.

    ``most`` is the size of the largest tree; each round leaves ``arity ** levels`` times fewer nodes.
    """
    if most <= 1:
        none = F.array().cast("array<string>")
        return nodes.select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.col("node").alias("top"))
    tops = materialize(_tops(nodes, arity, levels), "tops")
    outer = _paths(tops, -(-most // arity**levels), arity, levels)

    def join(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        up = above.iloc[0]
        made = _reduced(inner["node"].tolist(), int(inner["size"].iloc[0]), arity, levels)
        paths = [_siblings(made, at, arity) for at in range(len(inner))]
        return pd.DataFrame({
            "tree": inner["tree"], "pos": inner["pos"],
            "lefts": [[*left, *up["lefts"]] for left, _ in paths], "rights": [[*right, *up["rights"]] for _, right in paths],
            "top": up["top"],
        })

    found = nodes.groupBy("tree", _block(levels, arity)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(
        join, f"tree long, pos long, {_PATH}, top string")
    return materialize(found, "paths")


def prove(
    rows: DataFrame, key: str = "doc_id", group: str = "lang", arity: int = ARITY, levels: int = LEVELS, paths: bool = False,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``rows``.

    ``rows`` has key, group, ``leaf`` and ``claimed``: the leaf to fold with the proof, where it isn't
    null, in place of the one that the tree is built from. With ``paths`` the siblings are returned
    too (lefts, rights), as ``check`` takes them.
    """
    kind = rows.schema[key].dataType.simpleString()
    known = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), "leaf", "claimed")
    ranked = rank_rows(known, [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf"], "nth")
    sizes = ranked.groupBy("grp").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = materialize(rank_rows(sizes, [F.col("grp").asc_nulls_first()], "tree"), "groups")
    most, n_groups = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    # A row per group; Spark broadcasts them where they are few.
    leaves = materialize(
        ranked.join(groups.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).select(
            F.col("key").cast("string").alias("key"), "claimed", "tree", "size", (F.col("nth") - F.col("first")).alias("pos"), F.col("leaf").alias("node")),
        "leaves",
    )
    tops = materialize(_tops(leaves, arity, levels), "tops")
    outer = _paths(tops, -(-(most or 0) // arity**levels), arity, levels)
    subroots = outer.where("pos = 0").select(
        F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("size"), (F.col("tree") - 1).alias("pos"), F.col("top").alias("node"))
    above = _paths(materialize(subroots, "subroots"), n_groups, arity, levels)
    over = above.select((F.col("pos") + 1).alias("of"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), F.col("top").alias("root"))
    outer = outer.join(over, F.col("tree") == F.col("of")).select(
        "tree", "pos", F.concat("lefts", "up_lefts").alias("lefts"), F.concat("rights", "up_rights").alias("rights"),
        F.col("top").alias("subroot"), "root")

    def finish(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        up = above.iloc[0]
        made = _reduced(inner["node"].tolist(), int(inner["size"].iloc[0]), arity, levels)
        found = []
        for at, (node, claimed) in enumerate(zip(inner["node"], inner["claimed"])):
            lefts, rights = _siblings(made, at, arity)
            lefts, rights = [*lefts, *up["lefts"]], [*rights, *up["rights"]]
            folded = fold(node if pd.isna(claimed) else claimed, lefts, rights)
            found.append((proof_digest(lefts, rights), folded, *((lefts, rights) if paths else ())))
        out = pd.DataFrame(found, columns=["proof_sha256", "folded_root", *(["lefts", "rights"] if paths else [])])
        out.insert(0, "key", inner["key"].array)
        out.insert(1, "leaf", inner["node"].array)
        out.insert(2, "subroot", up["subroot"])
        out.insert(3, "root", up["root"])
        out["verified"] = out["folded_root"] == up["root"]
        return out

    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += f", {_PATH}, verified boolean" if paths else ", verified boolean"
    proved = leaves.groupBy("tree", _block(levels, arity)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(finish, schema)
    return proved.select(F.col("key").cast(kind).alias(key), *proved.columns[1:])


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang",
    arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """The manifest of ``docs``: per row its leaf, subroot, root and proof (lefts, rights), to be stored."""
    rows = materialize(docs.select(key, group, leaf(fields).alias("leaf"), F.lit(None).cast("string").alias("claimed")), "leaf")
    return prove(rows, key, group, arity, levels, paths=True).drop("folded_root", "verified")


def check(docs: DataFrame, stored: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id") -> DataFrame:
    """(key, status): whether each row of ``docs`` still folds to the root of the stored manifest.

    ``status`` is intact, changed, new (a key that the manifest lacks) or missing (one that ``docs``
    lacks). A row is folded with the proofs of its own key alone, so no tree is built again. Rows
    that are equal count as one.
    """
    kind = docs.schema[key].dataType.simpleString()
    now = docs.select(F.col(key).cast("string").alias("key"), leaf(fields).alias("leaf")).distinct()
    held = stored.select(F.col(key).cast("string").alias("of"), "root", "lefts", "rights")
    met = now.join(held, F.col("key").eqNullSafe(F.col("of")), "full")

    def folded(batches):
        for rows in batches:
            status = [
                "missing" if node is None else "new" if root is None else "changed" if fold(node, lefts, rights) != root else "intact"
                for node, root, lefts, rights in zip(rows["leaf"], rows["root"], rows["lefts"], rows["rights"])
            ]
            yield pd.DataFrame({"key": rows["key"], "leaf": rows["leaf"], "status": status})

    told = met.select(F.coalesce("key", "of").alias("key"), "leaf", "root", "lefts", "rights").mapInPandas(
        folded, "key string, leaf string, status string")
    best = F.when(F.max(F.col("status") == "intact"), "intact").otherwise(F.min("status"))
    return told.groupBy("key", "leaf").agg(best.alias("status")).select(F.col("key").cast(kind).alias(key), "status")
