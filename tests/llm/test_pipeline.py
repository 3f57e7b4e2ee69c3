"""Stage by stage against brute force, each on what the one before kept."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumencat.llm.queries import QUERIES
from tests.llm import test_decontaminate, test_shingle_join

SF_DIR = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def _written(spark, df, tmp_path, name):
    path = f"{tmp_path}/{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def _stages(spark, docs, tmp_path):
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(_written(spark, stage(spark, out[-1], SF_DIR), tmp_path, f"s{n}"))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # More copies, a copy with another id, rows of one id, and an item of the benchmark.
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    first = docs.orderBy("doc_id").first()
    extra = [(9000, first.text, "en", "src0", 1), (9001, first.text, None, None, None), (9001, first.text, None, None, None),
             (9002, item, "en", "src1", 1), (9003, None, None, "src1", None), (9004, "", "en", "src1", 0), (None, "no id at all", "en", "src2", 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCUMENTS))
    given, clean, single, free, mixed, ids = _stages(spark, docs, tmp_path)
    for df in (clean, single, free, mixed):
        assert df.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    stay = {r.doc_id for r in clean.collect()}
    quiet = [d for d, t in labels.items() if t == 0]
    assert len([d for d in quiet if d not in stay]) <= 0.05 * len(quiet)

    component = {(d, n): c for d, n, c in test_shingle_join.brute(_texts(clean))}
    want = {d for (d, _), c in component.items() if d == c or d is None}
    assert {r.doc_id for r in single.collect()} == want and single.where("doc_id = 9001").count() <= 1

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = test_decontaminate.brute(_texts(single), items)
    assert sorted(map(str, (r.doc_id for r in free.collect()))) == sorted(str(d) for d, *_, bad in judged if not bad)
    assert not free.where("doc_id = 9002").count()

    assert sorted(map(str, mixed.collect())) == sorted(map(str, free.collect()))
    order = [(r.doc_id, r.text) for r in mixed.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    got = ids.orderBy("start").collect()
    assert [r.doc_id for r in got] == [d for d, _ in order]
    start = 0
    for r, (_, text) in zip(got, order):
        own = _ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    out = _stages(spark, odd_docs, tmp_path / "odd")
    assert all(df.columns == odd_docs.columns for df in out[:-1]) and 0 < out[-1].count() <= 11
    assert all(df.count() == 0 for df in _stages(spark, no_docs, tmp_path / "none"))


def test_run_gives_the_last_stage(spark):
    docs = corpus_pipeline.run(spark, SF_DIR)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() > 100


def test_op1_over_a_whole_table(spark):
    got = QUERIES["op1_token_files"](spark, SF_DIR).orderBy("start").collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        own = _ids(d.text)
        assert tuple(r) == (d.doc_id, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_op3_over_a_whole_table(spark):
    rows = QUERIES["op3_mixing"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert sorted((r.doc_id, r.source) for r in rows) == sorted((d.doc_id, d.source) for d in docs)
    assert len({r.place for r in rows}) == len(rows) and all(r.release <= r.slot < r.due for r in rows)


def test_op4_over_a_whole_table(spark):
    rows = QUERIES["op4_shards"](spark, SF_DIR).collect()
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 8, zlib.crc32(t)) for d, t in docs.items()}
    sizes = [sorted(r.slot for r in rows if r.shard == k) for k in range(24)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_op10_over_a_whole_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op10_shingle_join"](spark, SF_DIR).collect()), key=str)
    assert got == test_shingle_join.brute(_texts(spark.read.parquet(f"{SF_DIR}/documents.parquet")))


def test_op7_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows.values())
    held = [(r.score, t) for r, t in labels if r.held_out]
    pairs = [(p, n) for p, t in held if t for n, u in held if not u]
    assert pairs and sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs) > 0.95


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_is_numbered_and_named(name):
    assert name.startswith("op") and name[2:].split("_")[0].isdigit()
