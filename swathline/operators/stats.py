"""Per-scene statistics.

Scenes may be huge, so nothing here windows over a whole scene: every statistic is
a map-side-combined aggregate keyed by scene, and only bounded tables (histogram
bins, decisions) are windowed or joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions.pixel import area_km2, past_cut
from swathline.operators.frames import Planes, by_frames
from swathline.operators.joins import attach
from swathline.operators.ranking import null_safe_join

Keys = Sequence[str]
#: Frames whose histograms a task holds at once.
GATED_FRAMES = 1 << 10


def value_range(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")
    )


def counted(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``keys, _v, _w``: distinct values and how often each occurs, summed map-side. A value most pixels share, such as a
    floor or a fill, is one row from here on."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    return rows.groupBy(*keys, "_v").agg(F.count("*").alias("_w"))


def usual_value(value: str, draws: int = 7) -> Column:
    """Aggregate: the middle one of ``draws`` values drawn by hash from a key's distinct ones.

    Two evaluations of one plan must agree on it, as bins counted by one are looked up by the other. A merged sketch
    such as ``percentile_approx`` depends on the order in which shuffled parts arrive; the least hash does not.
    """
    drawn = [F.min_by(value, F.xxhash64(F.col(value), F.lit(i))) for i in range(draws)]
    return F.element_at(F.array_sort(F.array(*drawn)), draws // 2 + 1)


def stretched_bin(value: Column, lo: Column, hi: Column, middle: Column, bins: int) -> Column:
    """0-based bin, non-decreasing in ``value``, by the logarithm of the distance from ``lo`` in units of a 64th of the
    middle's: a few far values leave the others in many bins."""
    unit = F.when(middle > lo, (middle - lo) / 64).when(hi > lo, (hi - lo) / bins)
    position = F.floor(F.log1p((value - lo) / unit) / F.log1p((hi - lo) / unit) * F.lit(float(bins)))
    return F.coalesce(F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)), F.lit(0)).cast("int")


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of ``value``; the last bin is closed, a constant range is bin 0."""
    position = F.floor((value - lo) / F.when(hi > lo, hi - lo) * F.lit(float(bins)))
    return F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, keys: Keys, value: str, bins: int) -> DataFrame:
    """Non-empty equal-width bins per key: ``keys, lo, hi, n, bin, cnt``."""
    ranged = attach(counted(df, keys, value), value_range(df, keys, value), keys)
    return (
        ranged.withColumn("bin", equal_width_bin(F.col("_v"), F.col("lo"), F.col("hi"), bins))
        .groupBy(*keys, "lo", "hi", "n", "bin")
        .agg(F.sum("_w").alias("cnt"))
    )


def otsu_threshold(df: DataFrame, keys: Keys, value: str, bins: int = C.OTSU_BINS) -> DataFrame:
    """Otsu cut and between-class variance ratio: ``keys, n, threshold, ratio``.

    Moments are kept in integer bin units, so the criterion is the same whatever the
    order of partial sums. Between-class variance is flat over empty bins, hence the
    non-empty bins suffice and the lowest one wins a tie.
    """
    hist = histogram(df, keys, value, bins)
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    moments = hist.select(
        *keys, "lo", "hi", "n", "bin",
        F.sum("cnt").over(upto).cast("double").alias("below"),
        F.sum(F.col("cnt") * F.col("bin")).over(upto).cast("double").alias("below_sum"),
        F.sum("cnt").over(whole).cast("double").alias("total"),
        F.sum(F.col("cnt") * F.col("bin")).over(whole).cast("double").alias("total_sum"),
        F.sum(F.col("cnt") * F.col("bin") * F.col("bin")).over(whole).cast("double").alias("total_sq"),
    )
    rest = F.col("total") - F.col("below")
    gap = F.col("total") * F.col("below_sum") - F.col("below") * F.col("total_sum")
    spread = F.col("total") * F.col("total_sq") - F.col("total_sum") * F.col("total_sum")
    between = F.when(rest > 0, gap * gap / (F.col("below") * rest)).otherwise(0.0)
    ratio = F.when(
        F.col("spread") > 0, F.least(F.greatest(F.col("between") / F.col("spread"), F.lit(0.0)), F.lit(1.0))
    )
    best = (
        moments.withColumn("between", between)
        .withColumn("spread", spread)
        .groupBy(*keys)
        .agg(F.max(F.struct("between", (-F.col("bin")).alias("low_bin"), "lo", "hi", "n", "spread")).alias("b"))
        .select(*keys, "b.*")
    )
    centre = F.col("lo") + (F.lit(0.5) - F.col("low_bin")) * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return best.select(
        *keys,
        "n",
        F.when(F.col("hi") > F.col("lo"), centre).otherwise(F.col("lo")).alias("threshold"),
        F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
    )


def gated_threshold(
    df: DataFrame,
    keys: Keys,
    value: str,
    fixed: Column | float,
    above: bool = True,
    method: str = "otsu",
) -> DataFrame:
    """Decision row per key, with the hit counts of the chosen cut.

    Otsu is kept only if its ratio, both class shares and its distance past the
    physical cut pass the gate. The second pass counts hits of both candidate cuts at
    once, so the chosen coverage needs no third pass. Columns: ``keys, n_pixels,
    n_valid, value, method, passed, ratio, positive_fraction, hits``.
    """
    if method not in ("otsu", "fixed"):
        raise ValueError(f"unknown threshold method {method!r}")
    fixed = fixed if isinstance(fixed, Column) else F.lit(float(fixed))
    cuts = otsu_threshold(df, keys, value) if method == "otsu" else None
    base = df.select(*keys, F.col(value).alias("_v"), fixed.alias("_fixed")).groupBy(*keys, "_v", "_fixed").agg(F.count("*").alias("_w"))
    if cuts is not None:
        base = attach(base, cuts.drop("n"), keys, "left")
    else:
        base = base.withColumn("threshold", F.lit(None).cast("double")).withColumn("ratio", F.lit(None).cast("double"))
    summed = base.groupBy(*keys).agg(
        F.sum("_w").alias("n_pixels"),
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(0)).alias("n_valid"),
        F.sum(past_cut(F.col("_v"), F.col("threshold"), above).cast("long") * F.col("_w")).alias("_otsu_hits"),
        F.sum(past_cut(F.col("_v"), F.col("_fixed"), above).cast("long") * F.col("_w")).alias("_fixed_hits"),
        F.first("threshold").alias("_otsu"),
        F.first("ratio").alias("ratio"),
        F.first("_fixed").alias("_fixed"),
    )
    share = F.col("_otsu_hits") / F.when(F.col("n_valid") > 0, F.col("n_valid"))
    overshoot = F.col("_fixed") - F.col("_otsu") if above else F.col("_otsu") - F.col("_fixed")
    passed = (
        (F.col("ratio") >= C.OTSU_MIN_RATIO)
        & (F.least(F.col("positive_fraction"), 1 - F.col("positive_fraction")) >= C.OTSU_MIN_CLASS)
        & (overshoot <= C.OTSU_SLACK)
    )
    rejected = "fixed" if method == "fixed" else "fixed_fallback"
    return (
        summed.withColumn("positive_fraction", share)
        .withColumn("passed", F.coalesce(passed, F.lit(False)))
        .select(
            *keys,
            "n_pixels",
            "n_valid",
            F.when(F.col("passed"), F.col("_otsu")).otherwise(F.col("_fixed")).alias("value"),
            F.when(F.col("passed"), "otsu").otherwise(rejected).alias("method"),
            "passed",
            "ratio",
            "positive_fraction",
            F.when(F.col("passed"), F.col("_otsu_hits")).otherwise(F.col("_fixed_hits")).alias("hits"),
        )
    )


#: Columns of a decision row that :func:`gate_planes` makes; the method follows from ``passed``.
GATE = {"n_pixels": "long", "n_valid": "long", "value": "double", "passed": "boolean", "ratio": "double", "positive_fraction": "double", "hits": "long"}


def gate_planes(x: np.ndarray, fixed: np.ndarray | float, above: bool = True, bins: int = C.OTSU_BINS) -> Planes:
    """:func:`gated_threshold` of stacked frames by Otsu's cut, one value per frame; NaN is an invalid cell, or no value."""
    flat, fixed = x.reshape(len(x), -1), np.broadcast_to(fixed, x.shape).reshape(len(x), -1)
    parts = [gate_rows(flat[i : i + GATED_FRAMES], fixed[i : i + GATED_FRAMES], above, bins) for i in range(0, len(x), GATED_FRAMES)]
    return {name: np.concatenate([part[name] for part in parts]) for name in GATE}


def gate_rows(x: np.ndarray, fixed: np.ndarray, above: bool, bins: int) -> Planes:
    """:func:`gate_planes` of frames that are one line each."""
    valid = ~np.isnan(x)
    n_valid = valid.sum(axis=1)
    some = n_valid > 0
    lo, hi = np.where(valid, x, np.inf).min(axis=1), np.where(valid, x, -np.inf).max(axis=1)
    ranged = valid & (hi > lo)[:, None]
    with np.errstate(invalid="ignore"):
        position = np.divide(x - lo[:, None], (hi - lo)[:, None], out=np.zeros_like(x), where=ranged) * float(bins)
    place = np.minimum(np.nan_to_num(np.floor(position)), bins - 1).astype(np.int64) + np.arange(len(x))[:, None] * bins
    cnt = np.bincount(place[valid], minlength=len(x) * bins).reshape(-1, bins).astype(float)
    at = np.arange(bins, dtype=float)
    below, below_sum = cnt.cumsum(axis=1), (cnt * at).cumsum(axis=1)
    total, total_sum, total_sq = below[:, -1:], below_sum[:, -1:], (cnt * at * at).sum(axis=1)
    rest, gap = total - below, total * below_sum - below * total_sum
    between = np.divide(gap * gap, below * rest, out=np.zeros_like(gap), where=(rest > 0) & (below > 0))
    best = between.argmax(axis=1)
    spread = total[:, 0] * total_sq - total_sum[:, 0] * total_sum[:, 0]
    ratio = np.clip(np.divide(between.max(axis=1), spread, out=np.zeros(len(x)), where=spread > 0), 0.0, 1.0)
    cut = lo.copy()
    wide = hi > lo
    cut[wide] = lo[wide] + (0.5 + best[wide]) * (hi[wide] - lo[wide]) / float(bins)
    cut, ratio = np.where(some, cut, np.nan), np.where(some, ratio, np.nan)
    hits = lambda at: ((x >= at) if above else (x <= at)).sum(axis=1)
    own, plain = hits(cut[:, None]), hits(fixed)
    share = np.divide(own, n_valid, out=np.full(len(x), np.nan), where=some)
    overshoot = fixed[:, 0] - cut if above else cut - fixed[:, 0]
    passed = (ratio >= C.OTSU_MIN_RATIO) & (np.minimum(share, 1 - share) >= C.OTSU_MIN_CLASS) & (overshoot <= C.OTSU_SLACK)
    return {
        "n_pixels": np.full(len(x), x.shape[1]), "n_valid": n_valid, "value": np.where(passed, cut, fixed[:, 0]), "passed": passed,
        "ratio": ratio, "positive_fraction": share, "hits": np.where(passed, own, plain),
    }


def with_method(rows: DataFrame, keys: Keys) -> DataFrame:
    """Rows of :func:`gate_planes` in the columns of :func:`gated_threshold`."""
    method = F.when(F.col("passed"), "otsu").otherwise("fixed_fallback").alias("method")
    return rows.select(*keys, "n_pixels", "n_valid", "value", method, "passed", "ratio", "positive_fraction", "hits")


def gated_frames(frame: DataFrame, keys: Keys, value: str, fixed: Column | float, above: bool = True) -> DataFrame:
    """:func:`gated_threshold` by Otsu's cut for complete frames with ``r`` and ``c``: a small frame is decided on where its pixels meet.

    ``fixed`` is the same all over a frame.
    """
    keys = list(keys)
    fixed = fixed if isinstance(fixed, Column) else F.lit(float(fixed))
    cells = frame.select(*keys, "r", "c", F.col(value).alias("_x"), fixed.cast("double").alias("_fixed"))
    work = lambda planes: gate_planes(planes["_x"], planes["_fixed"], above)
    spread = lambda some: gated_threshold(some, keys, "_x", F.col("_fixed"), above)
    return with_method(by_frames(cells, keys, ["_x", "_fixed"], GATE, work, spread, per_frame=True), keys)


def multiplier(method: Column) -> Column:
    return F.when(method == "otsu", 1.0).otherwise(C.FALLBACK_MULTIPLIER)


def measurement(
    decisions: DataFrame,
    keys: Keys,
    target: str,
    base: float,
    weight: float,
    pixel_size: Column,
    penalty: Column | float = 1.0,
) -> DataFrame:
    """Coverage, valid share, area and confidence from decision rows."""
    penalty = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    ratio = F.least(F.coalesce("ratio", F.lit(0.0)), F.lit(1.0))
    confidence = (F.lit(base) + F.lit(weight) * ratio) * multiplier(F.col("method")) * penalty
    return decisions.select(
        *keys,
        F.lit(target).alias("target"),
        "method",
        F.round("value", 6).alias("threshold_value"),
        F.round(F.col("hits") / F.greatest(F.col("n_valid"), F.lit(1)), 6).alias("coverage_fraction"),
        F.round(F.col("n_valid") / F.col("n_pixels"), 6).alias("valid_fraction"),
        F.round(area_km2(F.col("hits"), pixel_size), 6).alias("area_km2"),
        F.round(confidence, 4).alias("confidence"),
    )


#: Polarisations in the order in which a scene's is chosen, and the side of the cut on which each radar target lies.
POLARISATIONS = ("vv", "hh", "vh", "hv")
RADAR_ABOVE = {"water": False, "builtup": True}


def sar_summary(pixels: DataFrame, keys: Keys, scenes: DataFrame, pixel_size: Column) -> DataFrame:
    """Radar water (low) or built-up area (high) per scene: ``keys, pol, refused`` and the columns of :func:`measurement`.

    ``pixels`` are complete frames. ``scenes`` has ``target`` and the declared ``band`` of every scene. The first polarisation with any pixel is used, with its
    own physical cut. A band that is not C, or not declared, inherits the C-band table and costs confidence. A scene
    whose values are never negative is not in decibels: it is refused, with NULL measures.
    """
    keys = list(keys)
    lowest = pixels.groupBy(*keys).agg(*[F.min(p).alias(f"_{p}") for p in POLARISATIONS])
    pol = F.coalesce(*[F.when(F.col(f"_{p}").isNotNull(), p) for p in POLARISATIONS])
    floor = F.coalesce(*[F.col(f"_{p}") for p in POLARISATIONS])
    cuts = F.create_map(*[F.lit(x) for p in POLARISATIONS for t, cut in C.SAR_CUTS_DB[p].items() for x in (f"{p}/{t}", cut)])
    facts = null_safe_join(lowest.select(*keys, pol.alias("pol"), (floor >= 0).alias("refused")), scenes, keys)
    facts = facts.withColumn("_cut", F.try_element_at(cuts, F.concat_ws("/", "pol", "target")))
    value = F.coalesce(*[F.when(F.col("pol") == p, F.col(p)) for p in POLARISATIONS])
    rows = attach(pixels.select(*keys, "r", "c", *POLARISATIONS), facts, keys).where(~F.col("refused"))
    rows = rows.select(*keys, "r", "c", "target", "band", "_cut", value.alias("_value"))
    penalty = F.when(F.col("band").eqNullSafe(F.lit("C")), 1.0).otherwise(C.INHERITED_BAND_PENALTY)
    made = []
    for target, above in RADAR_ABOVE.items():
        own = rows.where(F.col("target") == target)
        decisions = null_safe_join(gated_frames(own, keys, "_value", F.col("_cut"), above=above), scenes.select(*keys, "band"), keys)
        made.append(measurement(decisions, keys, target, 0.5, 0.35, pixel_size, penalty).drop("target"))
    every = reduce(lambda a, b: a.unionByName(b), made)
    return null_safe_join(facts.select(*keys, "target", "pol", "refused"), every, keys, "left")


def exact_percentiles(
    df: DataFrame, keys: Keys, value: str, shares: Mapping[str, float], bins: int = 1024, nearest_rank: bool = False
) -> DataFrame:
    """Exact percentiles, safe for a key of any size; linearly interpolated unless ``nearest_rank``.

    A histogram finds the bins that hold the wanted ranks; only the values of those bins
    are then ranked, as (value, count) pairs inside one bin. Bins are stretched around a usual value, so that
    no far value drives a whole key into one of them.
    """
    keys = list(keys)
    data = counted(df, keys, value)
    middle = usual_value("_v").cast("double")
    ends = data.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), middle.alias("_mid"), F.sum("_w").alias("n"))
    ranged = attach(data, ends, keys).withColumn("_bin", stretched_bin(F.col("_v"), F.col("lo"), F.col("hi"), F.col("_mid"), bins))
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    binned = (
        ranged.groupBy(*keys, "n", "_bin")
        .agg(F.sum("_w").alias("_cnt"))
        .withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    )

    def position(p: float) -> Column:
        if nearest_rank:
            return F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
        return F.lit(p) * (F.col("n") - 1)

    ends = [F.array(F.floor(position(p)), F.ceil(position(p))) for p in shares.values()]
    wanted = F.array_distinct(F.flatten(F.array(*ends)))
    holds = F.filter(
        wanted, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_cnt"))
    )
    targets = binned.withColumn("_ranks", holds).where(F.size("_ranks") > 0).select(*keys, "_bin", "_before", "_ranks")
    running = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    picked = (
        null_safe_join(ranged, targets, [*keys, "_bin"])
        .withColumnRenamed("_w", "_c")
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(running), F.lit(0)))
        .withColumn(
            "_hit",
            F.filter("_ranks", lambda k: (k >= F.col("_start")) & (k < F.col("_start") + F.col("_c"))),
        )
        .select(*keys, "n", "_v", F.explode("_hit").alias("_k"))
    )
    outputs = []
    for name, p in shares.items():
        low, high = F.floor(position(p)), F.ceil(position(p))
        below = F.max(F.when(F.col("_k") == low, F.col("_v")))
        above = F.max(F.when(F.col("_k") == high, F.col("_v")))
        fraction = F.max(position(p) - low)
        outputs.append((below + (above - below) * fraction).alias(name))
    return picked.groupBy(*keys).agg(F.max("n").alias("n"), *outputs)


def stretch_bounds(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    low, high = C.STRETCH_PERCENTILES
    return exact_percentiles(df, keys, value, {"p_low": low, "p_high": high})


def nodata_share(df: DataFrame, keys: Keys, valid: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.round(F.avg((~valid).cast("double")), 6).alias("nodata_fraction")
    ).withColumn("warn", F.col("nodata_fraction") > C.NODATA_WARN)


def decibel_check(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """A scene whose finite values are never negative is refused; an empty one passes."""
    return df.groupBy(*keys).agg(F.min(value).alias("min_db"), F.max(value).alias("max_db")).withColumn(
        "refused", F.coalesce(F.col("min_db") >= 0, F.lit(False))
    )


def class_changes(pairs: DataFrame, keys: Keys, before: str, after: str, pixel_size: float | None) -> DataFrame:
    """Per class: pixels and area before, after and delta; NULL ratio when absent before.

    Pixels collapse to (before, after) transition counts first, so the unpivot touches a
    class-by-class table instead of every pixel twice.
    """
    moved = pairs.groupBy(*keys, before, after).agg(F.count("*").alias("px"))
    sides = moved.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(before).alias("class_id"), F.col("px").alias("b"), F.lit(0).cast("long").alias("a")),
                F.struct(F.col(after).alias("class_id"), F.lit(0).cast("long").alias("b"), F.col("px").alias("a")),
            )
        ).alias("s"),
    )
    out = (
        sides.groupBy(*keys, "s.class_id")
        .agg(F.sum("s.b").alias("before_px"), F.sum("s.a").alias("after_px"))
        .withColumn("delta_px", F.col("after_px") - F.col("before_px"))
        .withColumn(
            "class_change_ratio",
            F.when(F.col("before_px") > 0, F.round(F.col("delta_px") / F.col("before_px"), 6)),
        )
    )
    if pixel_size:
        km2 = pixel_size * pixel_size / 1_000_000.0
        for side in ("before", "after", "delta"):
            out = out.withColumn(f"{side}_km2", F.round(F.col(f"{side}_px") * F.lit(km2), 6))
    return out


def change_summary(pairs: DataFrame, keys: Keys, before: str, after: str) -> DataFrame:
    """Changed share and the extreme classes; ties go to the lowest label."""
    moved = pairs.groupBy(*keys, before, after).agg(F.count("*").alias("px"))
    totals = moved.groupBy(*keys).agg(
        F.sum("px").alias("valid_px"),
        F.sum(F.when(F.col(before) != F.col(after), F.col("px")).otherwise(0)).alias("changed_px"),
    )
    per_class = class_changes(pairs, keys, before, after, None)
    low = (-F.col("class_id")).alias("low")
    extremes = per_class.groupBy(*keys).agg(
        F.max_by("class_id", F.struct(F.abs("delta_px").alias("d"), low)).alias("largest_change_class"),
        F.min_by("class_id", F.struct(F.abs("delta_px").alias("d"), F.col("class_id").alias("low"))).alias("smallest_change_class"),
        F.max_by("class_id", F.struct(F.col("delta_px").alias("d"), low)).alias("largest_increase_class"),
        F.min_by("class_id", F.struct(F.col("delta_px").alias("d"), F.col("class_id").alias("low"))).alias("largest_decrease_class"),
    )
    return totals.join(extremes, list(keys)).withColumn(
        "change_ratio", F.round(F.col("changed_px") / F.col("valid_px"), 6)
    )


def mask_iou(df: DataFrame, keys: Keys, first: Column, second: Column) -> DataFrame:
    """Pixel counts and IoU of two boolean masks; two empty masks agree."""
    both = F.sum((first & second).cast("long"))
    either = F.sum((first | second).cast("long"))
    return df.groupBy(*keys).agg(
        both.alias("both_px"),
        F.sum((first & ~second).cast("long")).alias("first_only_px"),
        F.sum((second & ~first).cast("long")).alias("second_only_px"),
        F.when(either == 0, 1.0).otherwise(both / either).alias("iou"),
    )
