"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but
the last return the columns they were given, so the stages can be run one by one over
written tables as well as in one go by ``run``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, line_dedup, minhash, mixing, quality
from marlstone.llm.storage import stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought in line with the text, where the column exists."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from ``labels`` outside the held-out fold."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, forest)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first that has them; documents of which no line is left go."""
    total, dropped = line_dedup.count_names(docs.columns)
    left = line_dedup.drop_recurring_lines(docs).where(f"{dropped} = 0 or {dropped} < {total}")
    return _recount(left.select(*docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays, also among rows without an id or of one id; documents without words stay."""
    return minhash.keep_one(docs, threshold=80).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 in turn, 150 percent of all words: a row for each copy the mix takes, in its order."""
    return _recount(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", deduplicate),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: Boosted trees, MinHash components and BPE are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor kept and wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
