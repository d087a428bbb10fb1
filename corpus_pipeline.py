"""A training corpus from ``documents``: toxic texts out, one text of each near-duplicate group, benchmark leaks out, personal data
masked, sources mixed to their target weights.

Every stage takes what the one before it kept and returns the columns of ``documents``; the last emits a row as often as the mix
takes it. Stages are written to the shared folder and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm import decontaminate, mixing, pii, resemblance, toxicity
from swathline.llm.common import short_batches, stored, table, words_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows of ``documents`` as they were; rows it rejects go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates by SimHash and MinHash, confirmed at Jaccard similarity 0.8 of five-word shingles: of each component the row
    with the smallest key stays."""
    short_batches(spark)
    return resemblance.first_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item's template go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    short_batches(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's rate says."""
    return mixing.mix(docs, words_of(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
]

#: A trained classifier and fingerprints have no SQL; ``tests/llm/test_pipeline.py`` replays the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
