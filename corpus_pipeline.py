"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing, each stage written and reread."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import exact, langid, minhash, mixing, packing
from lexigraph.llm._common import BROADCAST_ROWS, checkpointed

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` but for the ids in `dropped`, which are broadcast only if they are few enough; else both sides shuffle."""
    dropped = checkpointed(dropped.distinct())
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told apart; null, letterless and narrowly decided texts go."""
    return langid.identify(docs, langid.train(docs)).where(~F.col("rejected")).select(*DOCUMENT_COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return without(docs, exact.exact_dedup(docs).where(~F.col("kept")).select("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id stays."""
    return without(docs, minhash.near_dedup(docs).where(~F.col("kept")).select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target shares."""
    return mixing.mix(docs).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows, as lists of doc_id and piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("minhash_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression, signatures and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each result lies as Parquet in the shared folder and is reread."""
    checkpointed(spark.range(1))  # names the shared folder where the session has none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
