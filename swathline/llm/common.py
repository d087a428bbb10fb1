"""Helpers shared by the text operators: table access, shared scratch tables and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.session import stored  # noqa: F401 - the operators take it from here

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of identifiers or small keys up to which a side is broadcast (8 to 40 bytes each, below 100 MB).
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch; texts of a few thousand characters make it a few megabytes.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts to ``BATCH_ROWS`` rows, which bounds what a Python worker and its executor hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it is counted at ``limit`` rows or fewer; unmarked, so shuffled, beyond."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``salt`` alone: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(salt), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
