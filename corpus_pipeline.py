"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Every stage takes what the one before kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import bounded_packing, circulant_minhash, decontaminate, line_runs, pu_toxicity
from ticketlens.llm.common import table
from ticketlens.llm.queries import tokenizer_path
from ticketlens.session import scratch_path

MAX_TOXICITY = 0.5


def _recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, ``n_chars`` counted on the text as it is now."""
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.length("text").cast(kind))
    return docs.select(columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below MAX_TOXICITY, untouched."""
    model = pu_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = pu_toxicity.score(docs.withColumnRenamed("score", "__score"), model, keep=True)
    return scored.filter(F.col("score") < MAX_TOXICITY).drop("score").withColumnRenamed(
        "__score", "score"
    ).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of any length are cut out; documents of which nothing is left go."""
    cut = line_runs.drop_repeated_runs(docs, every_length=True)
    gone = (F.col("n_deleted") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return _recount(cut.filter(~gone), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    found = circulant_minhash.near_duplicates(docs)
    copies = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them mostly go."""
    clean = decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _recount(clean, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    return bounded_packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", packing),
]

ORACLE_SQL = None  # the toxicity model, the cuts of texts and the tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
