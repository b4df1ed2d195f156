"""From raw documents to encoded training text.

Each stage takes what its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm import bpe, decontaminate, quality, simhash, toxicity
from pairrank.llm.common import load, prepare
from pairrank.session import materialise


def _kept(docs: DataFrame, score, model, wanted: int) -> DataFrame:
    """Rows whose ``predicted`` is ``wanted``; the row travels as one value, so no name can clash."""
    marked = score(docs.select(F.struct("*").alias("row"), "text"), "text", model)
    return marked.where(F.col("predicted") == wanted).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; null and empty texts stay."""
    prepare(spark)
    return _kept(docs, toxicity.score, toxicity.fit(docs, load(spark, sf_dir, "labels")), 0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 at least."""
    prepare(spark)
    return _kept(docs, quality.score, quality.fit(docs, load(spark, sf_dir, "labels")), 1)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates.

    Groups are those of ``op10_simhash``: 3-word fingerprints within three bits. Near copies
    further apart stay; the README gives the recall.
    """
    prepare(spark)
    return simhash.keep_one(docs, "doc_id", "text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(prepare(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    prepare(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"), keep=())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The fitted stages and the tokenizer are beyond SQL; the tests hold each against brute force.
ORACLE_SQL = None


#: Python workers live on from stage to stage with what their largest batch took, so batches of whole texts are bounded in bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_BYTES[0])
    spark.conf.set(*BATCH_BYTES)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH_BYTES[0], before)
    return docs
