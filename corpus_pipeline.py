"""The corpus pipeline: stages that each apply one operator to the documents that the stage before kept.

Order: toxic documents go, repeated blocks of lines are cut from the later document, one document of each
near-duplicate class stays, documents that hold a benchmark passage go, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._shared import drop_spill, table
from bitquarry.llm.contamination import decontaminate
from bitquarry.llm.linededup import dedup_lines
from bitquarry.llm.minhash import keep_one_of_each
from bitquarry.llm.packing import best_fit_pack
from bitquarry.llm.toxicity import fit, without_toxic
from bitquarry.runtime import shared_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labels of these documents."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are cut; a document that loses all its words goes."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return best_fit_pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("decontamination", decontamination), ("packing", packing)]

#: Learned scores, alignments and token ids can't be expressed in SQL; each stage has a brute-force test instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a Parquet table that the next stage reads.

    Rows may repeat, lack an id or a text, and have other columns of any name: each stage does with them what its
    operator says. A stage's table is removed when the next one is written; the last one stays.
    """
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if done is not None:
            drop_spill(done)
        docs = done = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
