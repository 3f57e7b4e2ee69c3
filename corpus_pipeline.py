"""The corpus pipeline over ``documents``: what is toxic, repeated or contaminated goes, the rest is
mixed by source and written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next one. All but the last return the columns of ``documents``. What a stage wrote for
itself is deleted when the next begins, as its rows are written by then.

Nulls, empty texts, ties, repeated rows and empty tables: as each operator's docstring says. Rows of
a null doc_id pass every filter that their text passes.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumencat.llm import decontaminate, mixing, shingle_join, token_files, toxicity
from lumencat.llm.ship import ship
from lumencat.sources.storage import intermediates, materialize, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Training a classifier and linking texts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

_left_over: list[str] = []


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        remove(spark, _left_over)
        _left_over.clear()
        # Plans, broadcasts and shuffle files of the stages before are dropped once nothing refers to them.
        gc.collect()
        spark._jvm.System.gc()
        with intermediates() as made:
            out = work(spark, docs, sf_dir)
        _left_over.extend(made)
        return out

    return run_stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents over the threshold of their language go."""
    return toxicity.remove_toxic(docs, _table(spark, sf_dir, "labels"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the smallest doc_id of each group of linked texts stays."""
    return shingle_join.deduplicate(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents of which benchmark windows hit a twentieth or more go."""
    return decontaminate.remove_documents(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document once, in mixed order; the files hold the rows in that order."""
    return mixing.mixed(docs)


def _written_order(docs: DataFrame) -> list:
    """The order of the rows in the files that ``docs`` reads; doc_id where it reads no files."""
    # The number in a name is padded to five digits, beyond which names no longer sort by it.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    order = [F.length(number), number, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order).schema  # noqa: B018 - resolves the columns
    except AnalysisException:
        return [F.col("doc_id")]
    return order


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids in files, in mixed order; returns what is read back of each document."""
    path = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), order=_written_order(docs), added_tokens=True)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialize(docs, f"stage-{n}")
    return docs
