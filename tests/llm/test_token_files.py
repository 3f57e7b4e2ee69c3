from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lumencat.llm import bpe, token_files
from lumencat.llm.bpe import Encoder
from lumencat.llm.huffman import Code, code_lengths
from lumencat.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
ENCODER = Encoder(PATH)

#: What a cut at blanks could get wrong.
_PARTS = st.sampled_from([
    " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "don't", "I'll", "word", " the", "é", "Ǆ", "漢", "1", "½",
    "_", "-", "...", "<|endoftext|>", "​", "\U0001f600", "A", "\r\n",
])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(_PARTS, max_size=12).map("".join)))
def test_pieces_give_the_ids_of_the_whole_text(text):
    ids = np.frombuffer(ENCODER.encode(text), ENCODER.dtype).tolist()
    assert ids == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.lists(st.one_of(_PARTS, st.sampled_from([
    " aaaaaaaaab", " of.\nThe", " x***", " naïve×2", " 12,345", " señor.", "\nend\n", " ¿qué",
])), max_size=12).map("".join)), min_size=1, max_size=8), st.sampled_from([1, 40, bpe.RUN]))
def test_texts_together_give_the_ids_of_each_alone(texts, run):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "RUN", run)
        got = [np.frombuffer(ids, ENCODER.dtype).tolist() for ids in ENCODER.encode_all(pa.array(texts, pa.string()))]
    assert got == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def _huffman_bits(counts):
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=200))
def test_unlimited_codes_are_optimal(counts):
    counts = np.array(counts)
    lengths = code_lengths(counts, 30).astype(int)
    used = counts[counts > 0]
    if len(used) > 1:
        assert (counts * lengths).sum() == _huffman_bits(used.tolist())
        assert sum(2.0 ** -lengths[counts > 0]) == 1


def test_limited_codes():
    counts = 2 ** np.arange(40)
    lengths = code_lengths(counts, 6)
    assert lengths.max() == 6 and sum(2.0 ** -lengths.astype(int)) <= 1
    with pytest.raises(ValueError):
        code_lengths(np.ones(65, int), 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 40))
def test_blocks_decode(ids, step):
    ids = np.array(ids, np.int64)
    code = Code(code_lengths(np.bincount(ids, minlength=1) + (np.arange(max(ids.max(initial=0) + 1, 1)) % 7 == 0), 9))
    payload, checkpoints = code.encode(ids, step)
    assert code.decode(payload, checkpoints, len(ids), step).tolist() == ids.tolist()


def _expected(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc, text in rows:
        ids = np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def _read(spark, path):
    rows = token_files.read(spark, path).orderBy("start").collect()
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows]


@pytest.mark.parametrize("block_ids", [1, 500, 1 << 17])
def test_round_trip(spark, odd_docs, block_ids):
    got = _read(spark, token_files.write(odd_docs, PATH, block_ids=block_ids))
    want = _expected(odd_docs)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])  # noqa: E731 - ties of a doc_id in any order
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0], g[2], g[3]) for g in got if g[0]) == sorted((w[0], w[2], w[3]) for w in want if w[0])
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    assert sorted(map(key, got))[0][2] == sorted(map(key, want))[0][2]


def test_empty_table(spark, no_docs):
    assert _read(spark, token_files.write(no_docs, PATH)) == []


def test_files_are_in_order_and_blocks_alone(spark, odd_docs):
    path = token_files.write(odd_docs, PATH, block_ids=100)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    ids = [d for b in blocks for d in b.doc_ids]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert all(sum(b.doc_lengths) == b.n_ids for b in blocks) and len(blocks) > 1


LIBRARY = Tokenizer.from_file(PATH)  # unchanged
DEFAULT = Encoder(PATH, added_tokens=True)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(_PARTS, max_size=12).map("".join)))
def test_added_tokens_are_those_of_the_library(text):
    ids = np.frombuffer(DEFAULT.encode(text), DEFAULT.dtype).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_and_pipeline_give_the_ids_of_the_unchanged_library(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array(LIBRARY.encode("naïve <|endoftext|> 漢字 \x00 end", add_special_tokens=False).ids + [0], "<u4")
    assert 50256 in ids
    for got in (QUERIES["op1_token_files"](spark, str(tmp_path)), corpus_pipeline.encode(spark, odd_docs, str(tmp_path))):
        row = got.where("doc_id = 6").first()
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
