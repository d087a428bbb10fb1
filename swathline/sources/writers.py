"""Sinks: manifests with their summary, mask tables, batch answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.validate import mask_conformance

#: Folders of the mask table.
MASK_PARTS = 64
#: Row groups of the pixel table: a few rows of a large scene each.
ROW_GROUP_BYTES = 16 << 20


def manifest_summary(rows: DataFrame) -> DataFrame:
    """Per task: rows, distinct answers, blind ceiling and the six most common answers.

    Answer counts are combined first; only that small table is ranked.
    """
    counts = rows.groupBy("task", F.col("answer").cast("string").alias("answer")).agg(F.count("*").alias("n"))
    per = counts.groupBy("task").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_answers"), F.max("n").alias("top_n"),
    )
    best = counts.withColumn("k", F.row_number().over(_by_count())).where("k <= 6").groupBy("task").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("=", "answer", "n").alias("t")))), lambda x: x["t"]), ", ").alias("top")
    )
    return per.join(best, "task").select("task", "rows", "distinct_answers", F.round(100 * F.col("top_n") / F.col("rows"), 2).alias("blind_ceiling"), "top")


def _by_count():
    from pyspark.sql import Window as W

    return W.partitionBy("task").orderBy(F.col("n").desc(), "answer")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by adapter and split, with the summary as JSON lines beside it."""
    rows.write.mode("overwrite").partitionBy("adapter", "split").parquet(f"{path}/rows")
    manifest_summary(rows).write.mode("overwrite").json(f"{path}/summary")


def write_json_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_mask_table(masks: DataFrame, headers: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Write only conforming full-scene masks; returns the acceptance record of every scene."""
    record = mask_conformance(masks, headers, keys)
    accepted = record.where("reject IS NULL").select(*keys)
    # Folders by hash, files sorted by scene: a folder per scene would be as many as there are scenes.
    kept = masks.join(accepted, list(keys), "left_semi").withColumn("part", F.pmod(F.xxhash64(keys[0]), F.lit(MASK_PARTS)))
    # A large scene is spread by blocks of rows.
    kept = kept.repartition("part", *keys, F.floor(F.col("r") / 512))
    kept.sortWithinPartitions("part", *keys, "r", "c").write.mode("overwrite").partitionBy("part").parquet(path)
    return record


def write_pixel_table(pixels: DataFrame, keys: Sequence[str], path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Pixels ranged and sorted by scene, row and column, in row groups of about ``row_group_bytes``.

    A row group then spans a few rows of one scene, so a window's bounds on ``r`` and ``c`` rule out
    most of them by their footers. Ranges are sampled, so a scene of any size is many files.
    """
    order = [*keys, "r", "c"]
    ranged = pixels.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def batch_answers(rows: DataFrame, answer: Column) -> DataFrame:
    """Every input row yields an answer or an error record; a bad row never loses the batch."""
    missing = (F.coalesce(F.size("images"), F.lit(0)) <= 0) | F.coalesce(F.col("question"), F.lit("")).eqNullSafe("")
    error = F.when(missing, "row needs both images and question")
    return rows.withColumn("error", error).withColumn("answer", F.when(error.isNull(), answer))


def write_batch(answered: DataFrame, path: str) -> None:
    """Two sinks from one frame."""
    answered.where("error IS NULL").write.mode("overwrite").json(f"{path}/answers")
    answered.where("error IS NOT NULL").write.mode("overwrite").json(f"{path}/errors")
