"""Per-scene statistics over the pixel, class and step views."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions import pixel as P
from swathline.operators import stats as S
from swathline.plans.oracle_parts import gate_sql, index_sql, otsu_sql
from swathline.plans.registry import query
from swathline.plans.views import ctes

SCENE = ["scene_id", "date_idx"]
KEYS = "scene_id, date_idx"
# Every seventh scene has no metric pixel size.
def pixel_size():
    return F.when(F.col("scene_id") % 7 != 0, 10.0)


PIXEL_SIZE_SQL = "CASE WHEN scene_id % 7 <> 0 THEN 10.0 END"


def with_index(frame, name):
    return frame.select(*SCENE, "r", "c", P.spectral_index(name).alias("v"))


def index_cte(name, source="grid"):
    return f"ix AS (SELECT {KEYS}, r, c, {index_sql(name)} AS v FROM {source})"


@query(
    "AGG01_otsu_threshold",
    ctes("px", index_cte("NDVI", "px"), otsu_sql("ix", KEYS, "v"))
    + f"SELECT {KEYS}, n, round(threshold, 6) AS threshold, round(ratio, 6) AS ratio FROM otsu",
)
def agg01(v):
    cut = S.otsu_threshold(with_index(v.px, "NDVI"), SCENE, "v")
    return cut.select(*SCENE, "n", F.round("threshold", 6).alias("threshold"), F.round("ratio", 6).alias("ratio"))


@query(
    "AGG02_exact_percentiles",
    ctes("px", index_cte("NDVI", "px"))
    + f"""SELECT {KEYS}, count(v) AS n, round(quantile_cont(v, 0.02), 6) AS p02, round(quantile_cont(v, 0.6), 6) AS p60,
round(quantile_cont(v, 0.98), 6) AS p98, round(quantile_cont(v, 0.99), 6) AS p99 FROM ix GROUP BY {KEYS}""",
)
def agg02(v):
    shares = {"p02": 0.02, "p60": 0.6, "p98": 0.98, "p99": 0.99}
    out = S.exact_percentiles(with_index(v.px, "NDVI"), SCENE, "v", shares)
    return out.select(*SCENE, "n", *[F.round(n, 6).alias(n) for n in shares])


@query(
    "AGG03_threshold_with_gate",
    ctes("px", "grid", index_cte("NDBI"), gate_sql("ix", KEYS, "v", "0.0"))
    + f"""SELECT {KEYS}, n_pixels, n_valid, hits, method, passed, round(value, 6) AS value, round(ratio, 6) AS ratio,
round(positive_fraction, 6) AS positive_fraction FROM gate""",
)
def agg03(v):
    gate = S.gated_frames(with_index(v.grid, "NDBI"), SCENE, "v", C.INDEX_CUTS["NDBI"])
    return gate.select(
        *SCENE, "n_pixels", "n_valid", "hits", "method", "passed",
        *[F.round(n, 6).alias(n) for n in ("value", "ratio", "positive_fraction")],
    )


def measure_sql(target, base, weight, penalty="1.0"):
    return f"""SELECT {KEYS}, '{target}' AS target, method, round(value, 6) AS threshold_value,
round(hits / greatest(n_valid, 1), 6) AS coverage_fraction, round(n_valid / n_pixels, 6) AS valid_fraction,
round(hits * ({PIXEL_SIZE_SQL}) * ({PIXEL_SIZE_SQL}) / 1000000.0, 6) AS area_km2,
round(({base} + {weight} * least(coalesce(ratio, 0.0), 1.0)) * CASE WHEN method = 'otsu' THEN 1.0 ELSE 0.75 END * {penalty}, 4) AS confidence
FROM gate"""


@query(
    "AGG04_spectral_index_summary",
    ctes("px", "grid", index_cte("MNDWI"), gate_sql("ix", KEYS, "v", "0.0")) + measure_sql("water", 0.55, 0.35),
)
def agg04(v):
    gate = S.gated_frames(with_index(v.grid, "MNDWI"), SCENE, "v", C.INDEX_CUTS["MNDWI"])
    return S.measurement(gate, SCENE, C.INDEX_TARGETS["MNDWI"], 0.55, 0.35, pixel_size())


@query(
    "AGG05_sar_backscatter_summary",
    ctes("px", "grid", gate_sql("grid", KEYS, "vv", "-18.0", above=False)) + measure_sql("water", 0.5, 0.35, "0.8"),
)
def agg05(v):
    # An undeclared radar band inherits the C-band table, which costs confidence.
    gate = S.gated_frames(v.grid, SCENE, "vv", C.SAR_CUTS_DB["vv"]["water"], above=False)
    return S.measurement(gate, SCENE, "water", 0.5, 0.35, pixel_size(), C.INHERITED_BAND_PENALTY)


# Scenes with different polarisations, targets and declared bands; every ninth is in linear power.
POL_SQL = """sp AS (SELECT scene_id, date_idx, r, c, CASE WHEN scene_id % 9 = 4 THEN abs(vv) ELSE vv END AS base FROM grid),
sv AS (SELECT scene_id, date_idx, base - CASE scene_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 WHEN 2 THEN 6.0 ELSE 6.5 END AS v FROM sp WHERE scene_id % 9 <> 4),
lo AS (SELECT scene_id, date_idx, count(base) AS n FROM sp GROUP BY ALL),
low_rows AS (SELECT * FROM sv WHERE scene_id % 2 = 0), high_rows AS (SELECT * FROM sv WHERE scene_id % 2 = 1)"""
LOW_CUT = "CASE WHEN scene_id % 4 < 2 THEN -18.0 ELSE -24.0 END"
HIGH_CUT = "CASE WHEN scene_id % 4 < 2 THEN -3.0 ELSE -12.0 END"
BAND_PENALTY = "CASE WHEN scene_id % 3 = 0 THEN 1.0 ELSE 0.8 END"


def sar_option_sql():
    parts = [
        measure_sql(t, 0.5, 0.35, BAND_PENALTY).replace("FROM gate", f"FROM {p}gate").replace(f"'{t}' AS target, ", "")
        for t, p in (("water", "w"), ("builtup", "b"))
    ]
    return (
        ctes("px", "grid", POL_SQL, gate_sql("low_rows", KEYS, "v", LOW_CUT, above=False, prefix="w"), gate_sql("high_rows", KEYS, "v", HIGH_CUT, prefix="b"),
             f"ms AS ({parts[0]} UNION ALL {parts[1]})")
        + f"""SELECT {KEYS}, CASE WHEN scene_id % 2 = 0 THEN 'water' ELSE 'builtup' END AS target, ['vv', 'hh', 'vh', 'hv'][1 + scene_id % 4] AS pol,
scene_id % 9 = 4 AS refused, method, threshold_value, coverage_fraction, valid_fraction, area_km2, confidence FROM lo LEFT JOIN ms USING ({KEYS})"""
    )


@query("AGG05_sar_options", sar_option_sql())
def agg05_options(v):
    k = F.col("scene_id") % 4
    base = F.when(F.col("scene_id") % 9 == 4, F.abs("vv")).otherwise(F.col("vv"))
    shifted = {"vv": (k == 0, 0.0), "hh": (k == 1, -1.0), "vh": (k >= 2, 6.0), "hv": (k >= 2, 6.5)}
    pixels = v.grid.select(*SCENE, "r", "c", *[F.when(on & ((k == 2) if p == "vh" else F.lit(True)), base - by).alias(p) for p, (on, by) in shifted.items()])
    scenes = v.grid.select(*SCENE).distinct().select(
        *SCENE, F.when(F.col("scene_id") % 2 == 0, "water").otherwise("builtup").alias("target"),
        F.when(F.col("scene_id") % 3 == 0, "C").when(F.col("scene_id") % 3 == 1, "X").alias("band"),
    )
    return S.sar_summary(pixels, SCENE, scenes, pixel_size())


@query(
    "AGG08_sigma0_sanity",
    ctes("px")
    + f"""SELECT {KEYS}, round(quantile_cont(vv, 0.02), 6) AS p_low, round(quantile_cont(vv, 0.98), 6) AS p_high,
quantile_cont(vv, 0.02) < -25.0 - 10.0 OR quantile_cont(vv, 0.98) > 5.0 + 10.0 AS warn
FROM px GROUP BY {KEYS}""",
)
def agg08(v):
    low = min(lo for lo, _ in C.SURFACE_RANGES_DB.values()) - C.SURFACE_MARGIN_DB
    high = max(hi for _, hi in C.SURFACE_RANGES_DB.values()) + C.SURFACE_MARGIN_DB
    bounds = S.stretch_bounds(v.px, SCENE, "vv")
    return bounds.select(
        *SCENE, F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"),
        ((F.col("p_low") < low) | (F.col("p_high") > high)).alias("warn"),
    )


def class_pairs(v):
    """The two dates of each scene, joined pixel by pixel."""
    side = lambda d, n: v.classes.where(F.col("date_idx") == d).select("scene_id", "r", "c", F.col("class_id").alias(n))
    return side(0, "before").join(side(1, "after"), ["scene_id", "r", "c"])


PAIRS = """pairs AS (SELECT a.scene_id, a.class_id AS before, b.class_id AS after FROM classes a JOIN classes b
ON a.scene_id = b.scene_id AND a.r = b.r AND a.c = b.c WHERE a.date_idx = 0 AND b.date_idx = 1)"""
PER_CLASS = """per_class AS (SELECT scene_id, k AS class_id, count(*) FILTER (before = k) AS before_px, count(*) FILTER (after = k) AS after_px
FROM pairs, (SELECT unnest([0, 1, 2, 3]) AS k) u GROUP BY scene_id, k HAVING count(*) FILTER (before = k OR after = k) > 0)"""


@query(
    "AGG10_change_statistics",
    ctes("classes", PAIRS, PER_CLASS)
    + """SELECT scene_id, class_id, before_px, after_px, after_px - before_px AS delta_px,
CASE WHEN before_px > 0 THEN round((after_px - before_px) / before_px, 6) END AS class_change_ratio,
round(before_px * 0.0001, 6) AS before_km2, round(after_px * 0.0001, 6) AS after_km2, round((after_px - before_px) * 0.0001, 6) AS delta_km2
FROM per_class""",
)
def agg10(v):
    return S.class_changes(class_pairs(v), ["scene_id"], "before", "after", 10.0)


@query(
    "AGG10_change_summary",
    ctes("classes", PAIRS, PER_CLASS, "d AS (SELECT scene_id, class_id, after_px - before_px AS dp FROM per_class)")
    + """SELECT scene_id, valid_px, changed_px, round(changed_px / valid_px, 6) AS change_ratio,
(SELECT class_id FROM d WHERE d.scene_id = t.scene_id ORDER BY abs(dp) DESC, class_id LIMIT 1) AS largest_change_class,
(SELECT class_id FROM d WHERE d.scene_id = t.scene_id ORDER BY abs(dp), class_id LIMIT 1) AS smallest_change_class,
(SELECT class_id FROM d WHERE d.scene_id = t.scene_id ORDER BY dp DESC, class_id LIMIT 1) AS largest_increase_class,
(SELECT class_id FROM d WHERE d.scene_id = t.scene_id ORDER BY dp, class_id LIMIT 1) AS largest_decrease_class
FROM (SELECT scene_id, count(*) AS valid_px, count(*) FILTER (before <> after) AS changed_px FROM pairs GROUP BY scene_id) t""",
)
def agg10_summary(v):
    return S.change_summary(class_pairs(v), ["scene_id"], "before", "after")


@query(
    "AGG11_change_stats_target",
    ctes("classes", PAIRS)
    + """SELECT scene_id, t1 * 100.0 AS area_t1_m2, t2 * 100.0 AS area_t2_m2, (t2 - t1) * 100.0 AS delta_m2,
CASE WHEN t1 > 0 THEN round(t2 / t1, 6) END AS growth, CASE WHEN t1 > 0 THEN round((t2 - t1) / t1, 6) END AS class_change_ratio
FROM (SELECT scene_id, count(*) FILTER (before = 2) AS t1, count(*) FILTER (after = 2) AS t2 FROM pairs GROUP BY scene_id) x""",
)
def agg11(v):
    t1, t2 = (F.sum((F.col(s) == 2).cast("long")).alias(n) for s, n in (("before", "t1"), ("after", "t2")))
    areas = class_pairs(v).groupBy("scene_id").agg(t1, t2)
    safe = F.when(F.col("t1") > 0, F.col("t1"))
    return areas.select(
        "scene_id",
        (F.col("t1") * 100.0).alias("area_t1_m2"),
        (F.col("t2") * 100.0).alias("area_t2_m2"),
        ((F.col("t2") - F.col("t1")) * 100.0).alias("delta_m2"),
        F.round(F.col("t2") / safe, 6).alias("growth"),
        F.round((F.col("t2") - F.col("t1")) / safe, 6).alias("class_change_ratio"),
    )


@query(
    "AGG12_class_fractions",
    ctes("classes")
    + f"""SELECT {KEYS}, class_id, count(*) AS px, round(count(*) / sum(count(*)) OVER (PARTITION BY {KEYS}), 6) AS fraction
FROM classes GROUP BY {KEYS}, class_id""",
)
def agg12(v):
    from pyspark.sql import Window as W

    counts = v.classes.groupBy(*SCENE, "class_id").agg(F.count("*").alias("px"))
    total = F.sum("px").over(W.partitionBy(*SCENE))
    return counts.withColumn("fraction", F.round(F.col("px") / total, 6))


OPTICAL_WATER = "(green - swir) / (green + swir) >= 0.0"
SAR_WATER = "vv <= -18.0"


@query(
    "AGG13_mask_iou",
    ctes("px")
    + f"""SELECT {KEYS}, count(*) FILTER (o AND s) AS both_px, count(*) FILTER (o AND NOT s) AS first_only_px,
count(*) FILTER (s AND NOT o) AS second_only_px,
round(CASE WHEN count(*) FILTER (o OR s) = 0 THEN 1.0 ELSE count(*) FILTER (o AND s) / count(*) FILTER (o OR s) END, 6) AS iou
FROM (SELECT {KEYS}, {OPTICAL_WATER} AS o, {SAR_WATER} AS s FROM px) t GROUP BY {KEYS}""",
)
def agg13(v):
    out = S.mask_iou(v.px, SCENE, F.expr(OPTICAL_WATER), F.expr(SAR_WATER))
    return out.withColumn("iou", F.round("iou", 6))


@query(
    "AGG14_changed_area_m2",
    ctes("classes", PAIRS)
    + "SELECT scene_id, count(*) FILTER (before <> after) AS changed_px, count(*) FILTER (before <> after) * 16.0 AS area_m2 FROM pairs GROUP BY scene_id",
)
def agg14(v):
    changed = F.sum((F.col("before") != F.col("after")).cast("long")).alias("changed_px")
    return class_pairs(v).groupBy("scene_id").agg(changed).withColumn("area_m2", F.col("changed_px") * F.lit(4.0 * 4.0))


@query(
    "AGG15_tile_index_delta",
    ctes("px")
    + """SELECT scene_id, round(t0, 4) AS ndvi_t0, round(t1, 4) AS ndvi_t1, round(t1 - t0, 4) AS ndvi_delta FROM (
SELECT scene_id, avg(i) FILTER (date_idx = 0) AS t0, avg(i) FILTER (date_idx = 1) AS t1
FROM (SELECT scene_id, date_idx, (nir - red) / (nir + red + 1e-6) AS i FROM px) p GROUP BY scene_id) t""",
)
def agg15(v):
    index = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red") + F.lit(1e-6))
    means = v.px.select("scene_id", "date_idx", index.alias("i")).groupBy("scene_id").agg(
        F.avg(F.when(F.col("date_idx") == 0, F.col("i"))).alias("t0"),
        F.avg(F.when(F.col("date_idx") == 1, F.col("i"))).alias("t1"),
    )
    return means.select(
        "scene_id", F.round("t0", 4).alias("ndvi_t0"), F.round("t1", 4).alias("ndvi_t1"),
        F.round(F.col("t1") - F.col("t0"), 4).alias("ndvi_delta"),
    )


@query(
    "AGG16_change_mask_f1",
    ctes("px")
    + f"""SELECT {KEYS}, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END, 6) AS iou, round((tp + fn) / n, 6) AS positive_share, round((tp + fp) / n, 6) AS predicted_share
FROM (SELECT {KEYS}, count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn
FROM (SELECT {KEYS}, {OPTICAL_WATER} AS t, {SAR_WATER} AS p FROM px) q GROUP BY {KEYS}) x""",
)
def agg16(v):
    truth, guess = F.expr(OPTICAL_WATER), F.expr(SAR_WATER)
    total = lambda c: F.sum(c.cast("long"))
    x = v.px.groupBy(*SCENE).agg(
        F.count("*").alias("n"), total(truth & guess).alias("tp"),
        total(guess & ~truth).alias("fp"), total(truth & ~guess).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return x.select(
        *SCENE, "tp", "fp", "fn", ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("iou"),
        F.round((tp + fn) / F.col("n"), 6).alias("positive_share"), F.round((tp + fp) / F.col("n"), 6).alias("predicted_share"),
    )


@query(
    "AGG18_trace_tool_stats",
    ctes("trace_steps")
    + """SELECT tool, count(*) AS steps, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(confidence), 6) AS mean_confidence,
round(avg(CASE WHEN threshold_method = 'fixed_fallback' THEN 1.0 ELSE 0.0 END), 6) AS fallback_share FROM trace_steps GROUP BY tool""",
)
def agg18(v):
    return v.trace_steps.groupBy("tool").agg(
        F.count("*").alias("steps"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg((F.col("threshold_method") == "fixed_fallback").cast("double")), 6).alias("fallback_share"),
    )


def variant_sql(conf):
    return f"""SELECT {KEYS}, method, round(value, 6) AS threshold_value, passed, round(hits / n_pixels, 6) AS area_fraction,
round({conf} * CASE WHEN method = 'otsu' THEN 1.0 ELSE 0.75 END, 4) AS confidence FROM gate"""


def variant(gate, conf):
    return gate.select(
        *SCENE, "method", F.round("value", 6).alias("threshold_value"), "passed",
        F.round(F.col("hits") / F.col("n_pixels"), 6).alias("area_fraction"),
        F.round(F.lit(conf) * S.multiplier(F.col("method")), 4).alias("confidence"),
    )


@query(
    "AGG19_measure_variant_index",
    ctes("px", "grid", index_cte("NDVI"), gate_sql("ix", KEYS, "v", "0.3")) + variant_sql(0.75),
)
def agg19_index(v):
    return variant(S.gated_frames(with_index(v.grid, "NDVI"), SCENE, "v", C.INDEX_CUTS["NDVI"]), 0.75)


@query(
    "AGG19_measure_variant_sar",
    ctes("px", "grid", gate_sql("grid", KEYS, "vv", "-18.0", above=False)) + variant_sql(0.7),
)
def agg19_sar(v):
    return variant(S.gated_frames(v.grid, SCENE, "vv", C.SAR_CUTS_DB["vv"]["water"], above=False), 0.7)
