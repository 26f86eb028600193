"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. The first four return
the columns of documents; the last one returns the token pieces and their places.

Null texts count as empty: they are not toxic, all empty texts are one group of copies, and what stays of them is one piece, the end token alone. Of
equal and of near copies the documents stay that the operators name (most code points, then smallest doc_id; smallest doc_id of the near
ones), and of rows that are identical in all columns one. Null doc_ids are kept and count as smallest. Further columns travel along, whatever their names. Empty tables,
also of labels or of the benchmark, give what is left by the other stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, exact_dedup, packing, scratch, simhash_dedup
from emberline.llm import toxicity as toxic

#: Bytes of a batch of rows that a Python worker gets at most (a longer row goes alone).
BATCH = 2 << 20


def _bounded(stage: Callable) -> Callable:
    """``stage`` with batches of at most BATCH bytes. What a stage returns runs later, so the setting stays until :func:`run` ends."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with probability 0.5 or more go."""
    return toxic.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_duplicates_of(docs)


@_bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies at 0.8 of their 5-word shingles the document with the smallest doc_id stays."""
    return simhash_dedup.drop_similar(docs)


@_bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: The stages hold trained weights and a tokenizer, which SQL cannot express; tests/llm compares the survivors with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written, and reread by the next. The session's batch size is as before at the end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    finally:
        spark.conf.set(key, before)
    return docs
