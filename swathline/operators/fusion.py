"""Decision-level fusion of optical and radar masks, and reconciling two models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.frames import Planes, ragged_percentile, with_block_facts
from swathline.operators.joins import attach
from swathline.operators.stats import exact_percentiles


#: Facts of a scene that a pixel's hints are judged by.
CUTS = {"bright_cut": "double", "ndvi_median": "double"}


def disagreement_hints(pixels: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """Bare-soil pixel flag and arid-scene flag from NDVI and visible brightness, beside the columns ``carried``.

    A scene's brightness cut and median NDVI are taken where its pixels meet; scenes over several blocks have them joined.
    """
    keys = list(keys)
    ndvi = F.when(F.col("nir") + F.col("red") != 0, (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red")))
    base = pixels.select(*keys, "r", "c", ndvi.alias("ndvi"), ((F.col("red") + F.col("green")) / 2).alias("bright"), *carried)
    base = base.where(F.col("ndvi").isNotNull()).dropna(subset=keys)

    def work(values: Planes, of: np.ndarray) -> Planes:
        return {"bright_cut": ragged_percentile(values["bright"], of, C.SOIL_BRIGHTNESS_PERCENTILE), "ndvi_median": ragged_percentile(values["ndvi"], of, 0.5)}

    cut = with_block_facts(base, keys, ["bright", "ndvi"], CUTS, work, lambda some: attach(some, scene_cuts(some, keys), keys)).where("bright_cut IS NOT NULL")
    soil = (F.col("ndvi") < C.SOIL_NDVI_MAX) & (F.col("bright") > F.col("bright_cut"))
    return cut.select(*keys, "r", "c", "ndvi", soil.alias("soil"), (F.col("ndvi_median") < C.ARID_NDVI_MAX).alias("arid"), *carried)


def scene_cuts(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and :data:`CUTS` of scenes of any size."""
    cut = exact_percentiles(base, keys, "bright", {"bright_cut": C.SOIL_BRIGHTNESS_PERCENTILE}).drop("n")
    median = exact_percentiles(base, keys, "ndvi", {"ndvi_median": 0.5}).drop("n")
    return cut.join(median, list(keys))


def grid_mismatch(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose masks do not cover the same pixels; fusion refuses them."""
    cells = [*keys, "r", "c"]
    extra = first.join(second, cells, "left_anti").select(*keys).unionByName(second.join(first, cells, "left_anti").select(*keys))
    return extra.groupBy(*keys).agg(F.count("*").alias("unmatched_px"))


def mask_counts(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreement counts and evidence overlaps of (optical, sar, soil, slope) per pair."""
    o, s = F.coalesce("optical", F.lit(False)), F.coalesce("sar", F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    return masks.groupBy(*keys).agg(
        count(o & s).alias("agreement_px"),
        count(o & ~s).alias("optical_only_px"),
        count(s & ~o).alias("sar_only_px"),
        count(s & ~o & F.coalesce("soil", F.lit(False))).alias("soil_px"),
        count(s & ~o & F.coalesce("slope", F.lit(False))).alias("slope_px"),
        F.bool_or(F.col("optical").isNotNull()).alias("has_optical"),
        F.bool_or(F.col("sar").isNotNull()).alias("has_sar"),
    )


def disagreement_cause(target: Column, arid: Column) -> Column:
    """Physical cause in evaluation order: soil, slope, arid, cloud; else wind; else none."""
    sar_only, optical_only = F.col("sar_only_px"), F.col("optical_only_px")
    radar_side = sar_only > optical_only
    return F.when(
        target == "water",
        F.when(radar_side & (F.col("soil_px") > 0.5 * sar_only), "wet_smooth_soil")
        .when(radar_side & (F.col("slope_px") > 0.5 * sar_only), "radar_shadow")
        .when(radar_side & F.coalesce(arid, F.lit(False)), "dry_smooth_sand")
        .when(radar_side, "cloud_over_water")
        .when(optical_only > 0, "wind_roughened_surface"),
    )


def fusion_verdicts(
    counts: DataFrame, keys: Sequence[str], target: Column, arid: Column, optical_confidence: Column, sar_confidence: Column
) -> DataFrame:
    """IoU, verdict, cause, winner and confidence, one row per pair."""
    union = F.col("agreement_px") + F.col("optical_only_px") + F.col("sar_only_px")
    iou = F.when(union == 0, 1.0).otherwise(F.col("agreement_px") / union)
    single = ~(F.col("has_optical") & F.col("has_sar"))
    winners = F.create_map(*[F.lit(x) for pair in C.DISAGREEMENT_WINNERS.items() for x in pair])
    agreed = F.col("iou") >= C.IOU_CONSISTENT
    cause = F.when(~F.col("single") & ~agreed, disagreement_cause(target, arid))
    o, s = optical_confidence, sar_confidence
    only = F.when(F.col("has_optical"), o).otherwise(s)
    confidence = (
        F.when(F.col("single"), only * C.SINGLE_MODALITY_FACTOR)
        .when(agreed, F.least(F.lit(0.97), F.greatest(o, s) + 0.1 * F.col("iou")))
        .when(F.col("winner") == "optical", o * C.DISAGREEMENT_PENALTY)
        .when(F.col("winner") == "sar", s * C.DISAGREEMENT_PENALTY)
        .otherwise(F.least(o, s) * C.DISAGREEMENT_PENALTY)
    )
    verdict = (
        F.when(F.col("single"), "single_modality").when(agreed, "consistent")
        .when(F.col("iou") < C.IOU_CONFLICT, "conflict").otherwise("partial")
    )
    return (
        counts.withColumn("single", single)
        .withColumn("iou", F.when(F.col("single"), 1.0).otherwise(iou))
        .withColumn("cause", cause)
        .withColumn("winner", F.when(F.col("single"), F.when(F.col("has_optical"), "optical").otherwise("sar")).otherwise(winners[F.col("cause")]))
        .withColumn("verdict", verdict)
        .withColumn("confidence", F.round(confidence, 4))
        .select(
            *keys, "verdict", "cause", "winner", F.round("iou", 4).alias("iou"), "confidence",
            "agreement_px", "optical_only_px", "sar_only_px",
        )
    )


def fused_mask(masks: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The verdict picks the pixel: union, winner's mask, or the agreed extent."""
    o, s = F.coalesce("optical", F.lit(False)), F.coalesce("sar", F.lit(False))
    hit = F.when(F.col("verdict") == "consistent", o | s).when(F.col("winner") == "optical", o).when(F.col("winner") == "sar", s).otherwise(o & s)
    return attach(masks, verdicts.select(*keys, "verdict", "winner"), keys).select(*keys, "r", "c", hit.alias("hit"))


def simple_reconcile(counts: DataFrame, keys: Sequence[str], target: Column) -> DataFrame:
    """The older two-rule form: more radar-only pixels means cloud, otherwise wind; water only."""
    union = F.col("agreement_px") + F.col("optical_only_px") + F.col("sar_only_px")
    agreed = F.col("iou") >= C.IOU_CONSISTENT
    radar_side = F.col("sar_only_px") > F.col("optical_only_px")
    water = target == "water"
    return counts.withColumn("iou", F.when(union == 0, 1.0).otherwise(F.col("agreement_px") / union)).select(
        *keys,
        F.round("iou", 6).alias("iou"),
        F.when(agreed, "high_agreement").when(water, "disagreement_resolved").otherwise("unexplained_disagreement").alias("verdict"),
        F.when(~agreed & water, F.when(radar_side, "cloud_over_water").otherwise("wind_roughened_surface")).alias("cause"),
        F.when(agreed, "both").when(water, F.when(radar_side, "sar").otherwise("optical")).alias("winner"),
        F.when(agreed, 1.0).otherwise(C.DISAGREEMENT_PENALTY).alias("confidence_multiplier"),
    )


def landcover_score(question: Column, scores: Column) -> Column:
    """Score the question asks about: strongest forest class, else the first class it names."""
    text = F.lower(question)
    forest = F.greatest(*[F.element_at(scores, C.LANDCOVER_CLASSES.index(n) + 1) for n in C.FOREST_CLASSES])
    picked = F.when(text.contains("is there forest"), forest)
    for index, name in enumerate(C.LANDCOVER_CLASSES, start=1):
        picked = picked.when(text.contains(name.lower()), F.element_at(scores, index))
    return picked


def landcover_answer(question: Column, scores: Column, threshold: float = C.LANDCOVER_THRESHOLD) -> Column:
    score = landcover_score(question, scores)
    return F.when(score.isNotNull(), F.when(score >= threshold, "yes").otherwise("no"))


def two_model_agreement(rows: DataFrame, optical: str, radar: str, truth: str) -> DataFrame:
    """One pass over (optical, radar, truth): alone, agreeing, disagreeing and policy accuracy."""
    both = rows.where(F.col(optical).isNotNull() & F.col(radar).isNotNull())
    hit = lambda c: (F.col(c) == F.col(truth)).cast("long")
    agree = F.col(optical) == F.col(radar)
    sums = both.agg(
        F.count("*").alias("rows_scored"),
        F.sum(hit(optical)).alias("_o"), F.sum(hit(radar)).alias("_r"), F.sum(agree.cast("long")).alias("agree_n"),
        F.sum(F.when(agree, hit(optical)).otherwise(0)).alias("_ah"),
        F.sum(F.when(~agree, hit(optical)).otherwise(0)).alias("_do"),
        F.sum(F.when(~agree, hit(radar)).otherwise(0)).alias("_dr"),
    )
    rate = lambda a, b: F.round(a / F.when(b > 0, b), 4)
    n, agree_n = F.col("rows_scored"), F.col("agree_n")
    return sums.select(
        "rows_scored", rate(F.col("_o"), n).alias("optical_alone"), rate(F.col("_r"), n).alias("radar_alone"),
        rate(agree_n, n).alias("agreement_rate"), "agree_n", rate(F.col("_ah"), agree_n).alias("agree_accuracy"),
        (n - agree_n).alias("disagree_n"), rate(F.col("_do"), n - agree_n).alias("optical_right"),
        rate(F.col("_dr"), n - agree_n).alias("radar_right"), rate(F.col("_ah") + F.col("_do"), n).alias("policy_agree_else_optical"),
    )


def threshold_sweep(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Accuracy per threshold in one pass, the best threshold and the majority floor."""
    said = lambda t: F.when(F.col(score) >= t, "yes").otherwise("no") == F.col(truth)
    sums = rows.where(F.col(score).isNotNull()).agg(
        F.count("*").alias("n"), F.sum((F.col(truth) == "yes").cast("long")).alias("yes"),
        *[F.sum(said(t).cast("long")).alias(f"h{i}") for i, t in enumerate(C.SWEEP_THRESHOLDS)],
    )
    table = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"h{i}") / F.col("n")).alias("accuracy")) for i, t in enumerate(C.SWEEP_THRESHOLDS)])
    best = F.array_max(F.transform(table, lambda t: t["accuracy"]))
    first_best = F.element_at(F.filter(table, lambda t: t["accuracy"] == F.col("best")), 1)["threshold"]
    floor = F.greatest(F.col("yes"), F.col("n") - F.col("yes")) / F.col("n")
    return (
        sums.withColumn("table", table).withColumn("best", best).withColumn("best_threshold", first_best)
        .select("n", F.explode("table").alias("t"), "best_threshold", F.round(floor, 4).alias("majority_floor"))
        .select("t.threshold", "n", F.round("t.accuracy", 4).alias("accuracy"), "best_threshold", "majority_floor")
    )
