"""Corpus pipeline: five stages over ``documents``, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, line_dedup, mixing, near_duplicates, toxicity
from strandline.llm.tables import read, settled


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line are cut out of their documents; ``n_chars`` follows the text."""
    cut = line_dedup.without_repeated_lines(docs, share=0.8)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return near_duplicates.without_near_duplicates(docs, width=5, share=0.8)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return decontaminate.without_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the training mix takes: documents with the words taken of each, repeats counted."""
    return mixing.mixed(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_once),
    ("near_duplicates", one_of_each),
    ("decontamination", benchmark_out),
    ("mixing", mix),
]

#: The first stage learns its model; SQL can't express it. tests/llm compares each operator with a
#: brute-force version, each stage with its operator's report, and the whole run with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; intermediate tables go to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
