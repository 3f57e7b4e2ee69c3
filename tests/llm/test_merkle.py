from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lumencat.llm import merkle

FIELDS = ("doc_id", "source", "lang", "text")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row) -> str:
    return _h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def _tree(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and per node what stands left and right on each level: the tree built in one piece."""
    paths: list[list] = [[] for _ in nodes]
    under = [[n] for n in range(len(nodes))]
    while len(nodes) > 1:
        above, covers = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for k in range(len(run)):
                for n in under[at + k]:
                    paths[n].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(_h("".join(run)))
            covers.append([n for k in range(len(run)) for n in under[at + k]])
        nodes, under = above, covers
    return nodes[0], paths


def _expected(rows, arity: int, claimed: dict[str, str]) -> list[tuple]:
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((r["doc_id"], _leaf(r)) for r in rows if r["lang"] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = own, *_tree([node for _, node in own], arity)
    root, tops = _tree([trees[lang][1] for lang in langs], arity)
    found = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for (key, node), path in zip(own, paths):
            folded = claimed.get(node, node)
            for left, right in path + top:
                folded = _h(left + folded + right)
            proof = _h("".join(left + right for left, right in path + top))
            found.append((key, node, subroot, root, proof, folded, folded == root))
    return sorted(found, key=str)


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 3), (3, 2), (2, 10), (5, 1)])
def test_equals_the_tree_in_one_piece(spark, odd_docs, arity, levels):
    many = spark.createDataFrame(
        [(100 + n, f"text {n % 5}", [None, "en", "fr", "zz", "é"][n * n % 5], "s" * (n % 3), "x", "y", n) for n in range(75)],
        odd_docs.schema)
    docs = odd_docs.where("length(text) < 1000 or text is null").union(many)
    tampered = F.when(F.col("label") % 3 == 0, merkle.leaf(["doc_id", "source", "lang", F.concat("text", F.lit("!"))]))
    rows = docs.select("doc_id", "lang", merkle.leaf(FIELDS).alias("leaf"), tampered.alias("claimed"))
    claimed = {r["leaf"]: r["claimed"] for r in rows.collect() if r["claimed"]}
    got = merkle.prove(rows, arity=arity, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == _expected(docs.collect(), arity, claimed)
    assert 10 < sum(not r[-1] for r in found) < len(found)


def test_long_texts_clashing_names_and_other_keys(spark, odd_docs, no_docs):
    odd = odd_docs.withColumnsRenamed({"slot": "leaf", "row": "pos", "label": "tree"})
    rows = odd.select("doc_id", "lang", merkle.leaf(FIELDS).alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    assert sorted(map(tuple, merkle.prove(rows, levels=2).collect()), key=str) == _expected(odd.collect(), 2, {})
    assert merkle.manifest(odd, FIELDS).count() == odd.count()
    assert merkle.manifest(no_docs, FIELDS).collect() == []
    by_text = merkle.prove(rows.select(F.col("leaf").alias("doc_id"), "lang", "leaf", "claimed"))
    assert by_text.schema["doc_id"].dataType.simpleString() == "string" and by_text.count() == odd.count()
    one = rows.where("doc_id = 5")
    assert [(r.leaf, r.subroot, r.root, r.verified) for r in merkle.prove(one).collect()] == [(r.leaf,) * 3 + (True,) for r in one.collect()]


def test_check_tells_what_changed(spark, odd_docs):
    docs = odd_docs.where("doc_id is null or doc_id not in (1, 7)")
    stored = merkle.manifest(docs, FIELDS, levels=1)
    assert {r.status for r in merkle.check(docs, stored, FIELDS).collect()} == {"intact"}
    later = docs.where("doc_id is null or doc_id != 4").withColumn("text", F.when(F.col("doc_id") == 3, "new text").otherwise(F.col("text")))
    later = later.union(spark.createDataFrame([(9, "more", "en", "a", "s", "r", 1)], docs.schema))
    status = {r.doc_id: r.status for r in merkle.check(later, stored, FIELDS).collect()}
    assert {k for k, v in status.items() if v == "intact"} == {None, 2, 5, 6}
    assert (status[3], status[4], status[9]) == ("changed", "missing", "new")
