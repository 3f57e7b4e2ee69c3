"""Token ids of documents in Huffman-coded files (operator 1).

A folder of files holds ``codebook`` (id, length), ``blocks`` (whole documents in ascending doc_id
order, cut into blocks that decode alone) and ``parts`` (where the ids of each file begin).

Defined cases: null and empty texts are the end id alone; rows of one doc_id stay all and follow
each other; a null doc_id comes first; an empty table gives an empty codebook and no blocks; other
columns are ignored. Memory: one block, or the longest document where that is longer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumencat.llm.bpe import Encoder
from lumencat.llm.huffman import LONGEST, STEP, Code, code_lengths
from lumencat.sources.storage import fresh_path, materialize

BLOCK_IDS = 1 << 17


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str, added_tokens: bool = False) -> Encoder:
    """One per worker, so that its pieces serve all its tasks."""
    return Encoder(tokenizer, added_tokens=added_tokens)


def _id_bytes(spark: SparkSession, tokenizer: str) -> int:
    """Bytes of an id, as a task finds them: the driver need not load the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_encoder(tokenizer).dtype.itemsize])], ["n"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "n long").first()["n"]


def tokenize(
    docs: DataFrame, tokenizer: str, end_id: int = 0, order: Sequence[Column] | None = None, added_tokens: bool = False,
) -> DataFrame:
    """(key, doc_id, ids): the ids of each text with ``end_id`` after them, compressed.

    ``key`` is the struct that the files are ordered by, by default the doc_id.
    """
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(order or [F.col("doc_id")])]).alias("key")
    rows = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = rows.select("key", "doc_id", F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = _encoder(tokenizer, added_tokens), zstandard.ZstdCompressor(3)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = pa.array([squeeze.compress(ids + end) for ids in encoder.encode_all(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["key", "doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents; every task adds its own ids up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for batch in batches:
            held: list[bytes] = []
            for n, ids in enumerate(batch.column(0), 1):
                held.append(unpack.decompress(ids.as_py()))
                if n == len(batch) or n % 512 == 0:  # a count spans the vocabulary: many documents at once
                    seen = np.bincount(np.frombuffer(b"".join(held), f"<u{width}"))
                    if len(seen) > len(total):
                        total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                    total[: len(seen)] += seen
                    held.clear()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(tokens: DataFrame, lengths: bytes, width: int, block_ids: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, unpack = Code(np.frombuffer(lengths, np.uint8)), zstandard.ZstdDecompressor()
        names = ["block", "start", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        block = start = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            payload, checkpoints = code.encode(np.concatenate(parts))
            row = [block, start, held, docs[:], [len(p) for p in parts], checkpoints, payload]
            block, start, held = block + 1, start + held, 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0), batch.column(1)):
                docs.append(doc.as_py())
                parts.append(np.frombuffer(unpack.decompress(ids.as_py()), f"<u{width}"))
                held += len(parts[-1])
                if held >= block_ids:
                    yield flush()
        if parts:
            yield flush()

    ordered = tokens.repartitionByRange("key", F.xxhash64("ids")).sortWithinPartitions("key", F.xxhash64("ids"))
    return ordered.select("doc_id", "ids").mapInArrow(
        run,
        "block long, start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, checkpoints binary, payload binary",
    ).select(F.spark_partition_id().alias("part"), "*")


def write(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    end_id: int = 0,
    order: Sequence[Column] | None = None,
    longest: int = LONGEST,
    block_ids: int = BLOCK_IDS,
    added_tokens: bool = False,
) -> str:
    """Encode ``docs`` (doc_id, text) and write the files in ascending ``order``; returns their folder.

    ``order`` defaults to doc_id. With ``added_tokens`` the ids are those that the library gives by
    default; else a text that spells an added token out gets the ids of its letters. What the driver holds is the counts of the vocabulary, which its
    size bounds.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    width = _id_bytes(spark, tokenizer)
    tokens = materialize(tokenize(docs, tokenizer, end_id, order, added_tokens), "ids")
    counts = id_counts(tokens, width).toPandas()
    totals = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    totals[counts["id"].to_numpy(np.int64)] = counts["n"]
    lengths = code_lengths(totals, longest)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    # The bits are as short as they get: no second compression.
    _blocks(tokens, lengths.tobytes(), width, block_ids).write.option("compression", "none").parquet(f"{path}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("part_start"), "n_ids")
    parts.coalesce(1).write.parquet(f"{path}/parts")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``ids`` little-endian unsigned 32-bit, ``start`` the ids before."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"]
    packed = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for start, n_ids, docs, sizes, checkpoints, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = code.decode(payload, checkpoints, n_ids, STEP).astype("<u4")
                ends = np.cumsum(np.array(sizes, np.int64))
                texts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes)]
                columns = [
                    pa.array(docs, pa.int64()), pa.array(start + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    parts = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "part_start"))  # one row per file
    blocks = spark.read.parquet(f"{path}/blocks").join(parts, "part")
    return blocks.select(
        (F.col("part_start") + F.col("start")).alias("start"), "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload",
    ).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
