"""Corpus pipeline: a chain of the operators of ``placewright.llm`` over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secret_scan
from placewright.llm.storage import hold_small_batches, stash, table
from placewright.session import share_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes."""
    path, pattern = byte_bpe.public_vocabulary()
    return byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).select("doc_id", "ids", *byte_bpe.digest_columns())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(stage: Stage) -> Stage:
    """The stage, run in a session whose Python workers can import the package.

    The session's Arrow batches stay small afterwards, as the stage's rows are only
    worked out when they are written.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_package(spark)
        hold_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _ready(quality)),
    ("near-duplicates", _ready(near_duplicates)),
    ("benchmark decontamination", _ready(decontamination)),
    ("secret scans", _ready(secrets)),
    ("byte-level BPE", _ready(tokens)),
]

#: The near-duplicate join, the edit-distance search, the forest and the tokenizer are
#: no SQL; the chain is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stash(docs, f"stage{number}")
    return docs
