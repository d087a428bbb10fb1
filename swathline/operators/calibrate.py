"""Confidence features, heuristic confidence, calibration and reliability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.session import cut_lineage

# Fixed value: feature order.
FEATURES = (
    "tool_confidence_min", "tool_confidence_mean", "agreement_iou", "threshold_fallback_fraction",
    "router_is_rules", "warning_count", "answer_logprob", "deterministic_fallback_used",
)
MIN_SAMPLES = 10
# Distinct scores that are pooled in one place.
PART_POINTS = 200_000
BLOCK = ["lo", "hi", "total", "weight", "p0", "p1"]
BLOCK_SCHEMA = "lo double, hi double, total double, weight double, p0 long, p1 long"


def unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def heuristic_confidence() -> Column:
    """Weakest component first, then the named penalties."""
    value = F.least("tool_confidence_min", "tool_confidence_mean") * (0.6 + 0.4 * unit(F.col("agreement_iou")))
    value = value * (1.0 - 0.25 * unit(F.col("threshold_fallback_fraction")))
    value = value * F.when(F.col("router_is_rules") < 1, 0.95).otherwise(1.0)
    value = value * F.greatest(F.lit(0.6), 1.0 - 0.05 * F.col("warning_count"))
    return unit(F.when(F.col("deterministic_fallback_used") >= 1, F.least(value, F.lit(C.PROPOSAL_CEILING))).otherwise(value))


def confidence_features(steps: DataFrame, query: str) -> DataFrame:
    """Per query: minimum and mean of positive confidences (0.4 without any), fallback share, no-ops."""
    positive = F.when(F.col("confidence") > 0, F.col("confidence"))
    return steps.groupBy(query).agg(
        F.coalesce(F.min(positive), F.lit(0.4)).alias("tool_confidence_min"),
        F.coalesce(F.avg(positive), F.lit(0.4)).alias("tool_confidence_mean"),
        F.avg(F.col("threshold_method").endswith("fallback").cast("double")).alias("threshold_fallback_fraction"),
        F.sum(F.coalesce(F.col("confidence") == 0, F.lit(False)).cast("long")).alias("no_ops"),
        F.max((F.col("tool") == "object_box_fallback").cast("double")).alias("deterministic_fallback_used"),
    )


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators among ordered blocks ``(lo, hi, total, weight, p0, p1)``."""
    stack: list[list[float]] = []
    for lo, hi, total, weight, p0, p1 in blocks.sort_values("lo")[BLOCK].itertuples(index=False, name=None):
        block = [lo, hi, total, weight, p0, p1]
        while stack and stack[-1][2] * block[3] > block[2] * stack[-1][3]:
            last = stack.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3], last[4], block[5]]
        stack.append(block)
    return pd.DataFrame(stack, columns=BLOCK).astype({"p0": "int64", "p1": "int64"})


def isotonic_fit(rows: DataFrame, score: str, label: str, part_points: int = PART_POINTS) -> DataFrame:
    """Pool-adjacent-violators over distinct scores: ``score, weight, fitted``. Rows without a score are left out.

    Rows of one score collapse to their sum with a weight. Points are cut into ranges of about
    ``part_points``; each range is pooled by itself, which the whole fit never undoes. Two neighbouring
    ranges are pooled together only where the fit still falls from one to the next, pair by pair and
    round by round, so a task holds two ranges' blocks and the driver a mean per range end.
    """
    points = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
    points = cut_lineage(points.agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("weight")))
    parts = max(1, -(-points.count() // part_points))
    points = cut_lineage(points.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id().cast("long")))
    own = [F.col("score").alias("lo"), F.col("score").alias("hi"), "total", "weight", F.col("part").alias("p0"), F.col("part").alias("p1")]
    pool = lambda df: df.groupBy("part").applyInPandas(lambda part, pdf: pooled(pdf).assign(part=part[0]), f"{BLOCK_SCHEMA}, part long")
    blocks = cut_lineage(pool(points.select(*own, "part")))
    mean = F.col("total") / F.col("weight")
    while True:
        ends = blocks.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("part").collect()
        into, i = {}, 0
        while i + 1 < len(ends):
            if ends[i]["last"] > ends[i + 1]["first"]:
                into[ends[i + 1]["part"]] = ends[i]["part"]
                i += 1
            i += 1
        if not into:
            break
        pairs = blocks.sparkSession.createDataFrame([(k, v) for b, a in into.items() for k, v in ((a, a), (b, a))], "part long, _into long")
        both = blocks.join(F.broadcast(pairs), "part", "left")  # at most a row per range
        merged = pool(both.where("_into IS NOT NULL").drop("part").withColumnRenamed("_into", "part"))
        blocks = cut_lineage(merged.unionByName(both.where("_into IS NULL").drop("_into")))
    met = blocks.select("lo", mean.alias("fitted"), F.explode(F.sequence("p0", "p1")).alias("part"))

    def fit(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("lo")
        at = np.searchsorted(held["lo"].to_numpy(), pdf["score"].to_numpy(), side="right") - 1
        return pd.DataFrame({"score": pdf["score"], "weight": pdf["weight"], "fitted": held["fitted"].to_numpy()[at]})

    return points.groupBy("part").cogroup(met.groupBy("part")).applyInPandas(fit, "score double, weight double, fitted double")


def logistic_scores(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``score``, the logistic probability from the standardised features."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(rows.withColumn("label", F.col(label).cast("double")))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(assembled).transform(assembled)
    logistic = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=100, standardization=False, probabilityCol="p").fit(scaled)
    return logistic.transform(scaled).withColumn("score", vector_to_array("p")[1]).drop("raw", "scaled", "rawPrediction", "p", "prediction", "label")


def calibrated(scored: DataFrame, label: str) -> DataFrame:
    """``scored`` with ``calibrated``, the isotonic probability of its ``score``."""
    curve = isotonic_fit(scored, "score", label).select(F.col("score").alias("_s"), F.col("fitted").alias("calibrated"))
    return scored.join(curve, F.col("score").cast("double") == F.col("_s"), "left").drop("_s")


def fit_calibrator(rows: DataFrame, label: str, isotonic: bool = True) -> DataFrame:
    """Features -> logistic score -> isotonic probability, or the logistic score alone without ``isotonic``."""
    n = rows.count()
    if n < MIN_SAMPLES:
        raise ValueError(f"{n} samples are too few to fit a calibrator")
    # Checkpointed, as the fitted curve is joined back on the very scores it was fitted on.
    scored = cut_lineage(logistic_scores(rows, label))
    return calibrated(scored, label) if isotonic else scored.withColumn("calibrated", F.col("score"))


def reliability_table(rows: DataFrame, probability: str, correct: str, bins: int = 10, closed_right: bool = True) -> DataFrame:
    """Per bin count, mean confidence and accuracy; empty bins are zero rows.

    ``closed_right`` gives (low, high] with 0 in the first bin; otherwise [low, high) with the
    last bin closed.
    """
    p = F.col(probability)
    slot = F.ceil(F.round(p * bins, 9)) - 1 if closed_right else F.floor(F.round(p * bins, 9))
    slot = F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1))
    filled = rows.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mc"), F.avg(F.col(correct).cast("double")).alias("acc"))
    frame = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return frame.join(filled, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("mc", F.lit(0.0)).alias("mean_confidence"), F.coalesce("acc", F.lit(0.0)).alias("accuracy"),
    )


def expected_calibration_error(rows: DataFrame, probability: str, correct: str, bins: int = 10) -> DataFrame:
    table = reliability_table(rows, probability, correct, bins)
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("count")
    return table.agg(F.sum("count").alias("n"), F.round(F.coalesce(F.try_divide(F.sum(gap), F.sum("count")), F.lit(0.0)), 6).alias("ece"))
