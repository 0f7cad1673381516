"""The corpus pipeline: documents that are good, without repeated lines, near copies and benchmark text, with the rate at which to use each.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. Null, empty and blank texts are documents without words: they stand or fall together in the classifier, are one line to line dedup, one
group to near-dedup, clean to decontamination, and without tokens in the mixture. Rows that repeat an id and text share every verdict; ties between copies
go to the smallest id; texts of any length are used whole; columns beyond those of documents pass through the first four stages
under any name (two leading underscores are reserved in line dedup). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from gridloom.llm.shared import forget, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below 0.3 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that stand in 10 documents or more go; n_chars follows the text, and a document of which nothing is left stays, empty."""
    from pyspark.sql import functions as F

    kept = line_dedup.dedup_lines(docs, min_docs=10).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id stays."""
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which a twentieth or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the rate of each document that is left."""
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.FILTERED_WEIGHTS)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmarks),
    ("mixing sources to target weights", mixture),
]

#: Training, similarity links and the fit are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(spark, before)  # what materialize() wrote, that is; not the input
    return STAGES[-1][1](spark, docs, sf_dir)
