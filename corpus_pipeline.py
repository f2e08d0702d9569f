"""A corpus through five operators: language, lines, near-duplicates, benchmark, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, language, lines, simhash, tiling
from strandline.llm.common import crc_remainder, shared_folder, spread, table, unused
from strandline.sources.folders import delete


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no word shows evidence for a learned language, go."""
    return language.recognised(docs, language.learn(docs, crc_remainder(docs["doc_id"], 4) != 2))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for their first occurrence; a document of nothing else goes with them."""
    counts = unused("n_lines", docs.columns), unused("n_removed", docs.columns)
    out = lines.drop_boilerplate(docs, counts=counts)
    changed = F.col(counts[1]) > 0
    return (
        out.filter(~(changed & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest id."""
    return simhash.one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: SQL has neither the hashes of the fingerprints nor the merges of the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again.

    What a stage has written is removed once the next one's result is there; the last such table stays, as
    the rows that are returned are made from it.
    """
    docs, folder = spread(table(spark, sf_dir, "documents")), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
