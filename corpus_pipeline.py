"""From documents to token ids: five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns what it keeps. Each result is
written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.llm import bpe, jaccard, mixing, quality, toxicity
from gridwell.llm.common import read, shared_dir


# Every stage takes an empty table, null ids, texts and sources, texts of any
# length, repeated rows and further columns, which pass through; what each does
# with them stands with the operator that it calls.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the likelihood ratio; null and empty texts fail the counts."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; null and empty texts stay."""
    return toxicity.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones; texts without words are like no other."""
    return jaccard.kept(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null is a source, and texts without words are taken as their neighbours are."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of their decoding; a null text has none."""
    rows = bpe.encoded(docs)
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

#: Two stages are learnt models and one a systematic sample of what they leave:
#: the tests hold the pipeline against a version stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    A table goes when the next one is written, and all go when a stage fails.
    The result is the last table, which stays in the shared folder for its readers.
    """
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    conf = spark._jsc.hadoopConfiguration()

    def drop(path: str) -> None:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(conf).delete(old, True)

    docs, path = read(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            before, path = path, f"{root}/{k}-{name}"
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if before:
                drop(before)
    except BaseException:
        drop(root)
        raise
    return docs
