"""Targets, candidate boxes and grounding scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.functions.boxes import box_iou
from swathline.operators.joins import attach
from swathline.operators.ranking import dense_rank_rows, top_rows

SCORE_SLICES = 256


def superlative(targets: DataFrame, frame: Sequence[str], area: str, tie: str) -> DataFrame:
    """Largest object of a frame, only when at least 1.5 times the runner-up."""
    order = W.partitionBy(*frame).orderBy(F.col(area).desc(), tie)
    top = targets.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    first, second = (F.max(F.when(F.col("_k") == k, F.col(area))) for k in (1, 2))
    pairs = top.groupBy(*frame).agg(
        F.max(F.when(F.col("_k") == 1, F.col(tie))).alias(tie), first.alias(area), second.alias("runner_up")
    )
    return pairs.where(F.col("runner_up").isNotNull()).where(F.col(area) >= 1.5 * F.greatest("runner_up", F.lit(1e-6)))


def unique_targets(targets: DataFrame, frame: Sequence[str], label: str, target: str) -> DataFrame:
    """Targets whose label occurs exactly once in their frame.

    A count with map-side combine keeps one row per (frame, label); the single member is
    its maximum, so no window over a frame is needed.
    """
    return targets.groupBy(*frame, label).agg(F.count("*").alias("_n"), F.max(target).alias(target)).where("_n = 1").drop("_n")


def remap_boxes(crops: DataFrame, tiles: DataFrame, tile: str, width: Column, height: Column) -> DataFrame:
    """Crop pixels -> full frame -> normalised."""
    moved = crops.join(tiles, tile)
    return moved.select(
        "*",
        ((F.col("px1") + F.col("off_x")) / width).alias("xmin"), ((F.col("py1") + F.col("off_y")) / height).alias("ymin"),
        ((F.col("px2") + F.col("off_x")) / width).alias("xmax"), ((F.col("py2") + F.col("off_y")) / height).alias("ymax"),
    )


def rank_candidates(references: DataFrame, candidates: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Each reference with its candidates, ranked by score, and their IoU."""
    scored = candidates.withColumn("_d", -F.col(score))
    # Scores lie in [0, 1]: slices of the score keep a reference with countless candidates apart.
    ranked = dense_rank_rows(scored, [key], ["_d", tie], F.floor(F.col("_d") * SCORE_SLICES), "rank").drop("_d")
    return with_iou(ranked, references, key)


def with_iou(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    names = lambda p: [F.col(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")]
    return attach(candidates, references, [key]).withColumn("iou", box_iou(names("r"), names("p")))


def grounding_accuracy(rows: DataFrame, iou: str, slices: Mapping[str, Column]) -> DataFrame:
    """acc@0.5, acc@0.7, mean IoU and unparsable share, overall and per slice.

    A missing box is a miss. Rows first collapse to counts per slice combination; only
    those few sums are unpivoted into slices.
    """
    hit = lambda t: F.sum((F.coalesce(iou, F.lit(0.0)) >= t).cast("long"))
    combos = rows.groupBy(*[c.alias(n) for n, c in slices.items()]).agg(
        F.count("*").alias("n"), hit(0.5).alias("h50"), hit(0.7).alias("h70"),
        F.sum(F.coalesce(iou, F.lit(0.0))).alias("total"), F.sum(F.col(iou).isNull().cast("long")).alias("missing"),
    )
    labels = F.array(F.lit("all"), *[F.concat(F.lit(f"{n}:"), F.col(n)) for n in slices])
    n = F.sum("n")
    return combos.withColumn("slice", F.explode(labels)).groupBy("slice").agg(
        n.alias("n"),
        F.round(F.sum("h50") / n, 6).alias("acc_50"), F.round(F.sum("h70") / n, 6).alias("acc_70"),
        F.round(F.sum("total") / n, 6).alias("mean_iou"), F.round(F.sum("missing") / n, 6).alias("unparsable"),
    )


def recall_at_k(references: DataFrame, candidates: DataFrame, key: str, score: str, tie: str, ks: Sequence[int], threshold: float) -> DataFrame:
    """Share of references whose best IoU within the top k clears the threshold.

    Only the best max(k) candidates of a reference can matter, a literal bound that trims map-side.
    """
    counts = candidates.groupBy(key).agg(F.count("*").alias("candidates"))
    top = top_rows(candidates, [key], [F.col(score).desc(), tie], max(ks))
    best = with_iou(top, references, key).groupBy(key).agg(*[F.max(F.when(F.col("rank") <= k, F.col("iou"))).alias(f"k{k}") for k in ks]).join(counts, key)
    share = lambda k: F.round(F.avg((F.col(f"k{k}") >= threshold).cast("double")), 4).alias(f"recall_{k}")
    return best.agg(
        F.count("*").alias("n"), F.round(F.avg("candidates"), 1).alias("mean_candidates"), *[share(k) for k in ks],
        F.round(F.avg(f"k{max(ks)}"), 4).alias("mean_best_iou"),
    )
