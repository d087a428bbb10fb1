"""Change between dates, sensor fusion and model agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators import change as CH
from swathline.operators import fusion as FU
from swathline.operators import stats as S
from swathline.plans.registry import query
from swathline.plans.stats_queries import KEYS, OPTICAL_WATER, SAR_WATER, SCENE
from swathline.plans.views import ctes, folded

PIXEL = [*SCENE, "r", "c"]


@query(
    "JN03_id_set_diff",
    ctes(
        "obj",
        "span AS (SELECT aoi, min(period) AS lo, max(period) AS hi FROM obj GROUP BY aoi)",
        "b AS (SELECT DISTINCT aoi, period + 1 AS period, obj_id FROM obj JOIN span USING (aoi) WHERE period < hi)",
        "a AS (SELECT DISTINCT aoi, period, obj_id FROM obj JOIN span USING (aoi) WHERE period > lo)",
    )
    + """SELECT coalesce(b.aoi, a.aoi) AS aoi, coalesce(b.period, a.period) AS period, coalesce(b.obj_id, a.obj_id) AS obj_id,
CASE WHEN b.obj_id IS NULL THEN 'appeared' WHEN a.obj_id IS NULL THEN 'demolished' ELSE 'persisted' END AS status
FROM b FULL OUTER JOIN a ON a.aoi = b.aoi AND a.period = b.period AND a.obj_id = b.obj_id""",
)
def jn03(v):
    # Consecutive dates: each object meets the next date of its own area.
    span = v.obj.groupBy("aoi").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    dated = v.obj.join(span, "aoi")
    before = dated.where("period < hi").select("aoi", (F.col("period") + 1).alias("period"), "obj_id")
    after = dated.where("period > lo").select("aoi", "period", "obj_id")
    return CH.id_set_diff(before, after, ["aoi", "period", "obj_id"])


@query(
    "JN04_date_pair_join",
    ctes("obj", "d AS (SELECT DISTINCT aoi, period FROM obj)")
    + "SELECT a.aoi, a.period AS first, b.period AS second FROM d a JOIN d b ON a.aoi = b.aoi AND a.period < b.period AND b.period - a.period <= 8",
)
def jn04(v):
    return CH.date_pairs(v.obj, "aoi", "period", max_gap=8)


PAIR_STATS = """dates AS (SELECT aoi, period, count(*) AS total, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM obj GROUP BY aoi, period),
od AS (SELECT f.aoi, f.period AS first, s.period AS second, f.total AS total_first, s.total AS total_second, s.mx, s.my FROM dates f JOIN dates s ON f.aoi = s.aoi AND f.period <> s.period),
ap AS (SELECT od.aoi, od.first, od.second, count(*) AS appeared, count(*) FILTER (o.y >= od.my) AS north, count(*) FILTER (o.x >= od.mx) AS east
  FROM od JOIN obj o ON o.aoi = od.aoi AND o.period = od.second
  WHERE NOT EXISTS (SELECT 1 FROM obj p WHERE p.aoi = o.aoi AND p.period = od.first AND p.obj_id = o.obj_id) GROUP BY ALL),
ps AS (SELECT od.aoi, od.first, od.second, total_first, total_second, coalesce(a.appeared, 0) AS appeared, coalesce(g.appeared, 0) AS demolished,
  coalesce(a.north, 0) AS north, coalesce(a.east, 0) AS east FROM od
  LEFT JOIN ap a ON a.aoi = od.aoi AND a.first = od.first AND a.second = od.second
  LEFT JOIN ap g ON g.aoi = od.aoi AND g.first = od.second AND g.second = od.first)"""
WHERE_SQL = """CASE WHEN appeared >= 6 AND total_second >= 6 THEN CASE
WHEN greatest(north, appeared - north) / appeared >= 0.65 AND (greatest(east, appeared - east) / appeared < 0.65 OR greatest(north, appeared - north) >= greatest(east, appeared - east)) THEN CASE WHEN north >= appeared - north THEN 'north' ELSE 'south' END
WHEN greatest(east, appeared - east) / appeared >= 0.65 THEN CASE WHEN east >= appeared - east THEN 'east' ELSE 'west' END END END"""
BAND_SQL = "CASE WHEN appeared = 0 THEN 'none' WHEN appeared <= 10 THEN 'a few' WHEN appeared <= 50 THEN 'dozens' ELSE 'many' END"


@query(
    "FU10_change_answer",
    ctes("obj", PAIR_STATS)
    + f"""SELECT aoi, first, second, CASE WHEN appeared > 0 THEN 'yes' ELSE 'no' END AS presence_appeared, CASE WHEN demolished > 0 THEN 'yes' ELSE 'no' END AS presence_demolished,
CAST(appeared AS VARCHAR) AS count_appeared, CAST(demolished AS VARCHAR) AS count_demolished,
CASE WHEN total_second > total_first THEN 'second' WHEN total_second < total_first THEN 'first' END AS compare,
CASE WHEN total_second > total_first THEN 'increased' WHEN total_second < total_first THEN 'decreased' ELSE 'unchanged' END AS direction,
{BAND_SQL} AS magnitude, {WHERE_SQL} AS "where" FROM ps""",
)
def fu10(v):
    stats = CH.pair_statistics(v.obj, "aoi", "period", "obj_id")
    return stats.select("aoi", "first", "second", *[c.alias(n) for n, c in CH.change_answers(stats).items()])


@query(
    "FU11_magnitude_band",
    ctes("obj") + "SELECT aoi, period, count(*) AS objects, CASE WHEN count(*) <= 10 THEN 'a few' WHEN count(*) <= 50 THEN 'dozens' ELSE 'many' END AS band FROM obj GROUP BY aoi, period",
)
def fu11(v):
    counts = v.obj.groupBy("aoi", "period").agg(F.count("*").alias("objects"))
    return counts.withColumn("band", CH.magnitude_band(F.col("objects")))


@query("RG11_compass_cluster", ctes("obj", PAIR_STATS) + f"SELECT aoi, first, second, appeared, north, east, {WHERE_SQL} AS side FROM ps")
def rg11(v):
    stats = CH.pair_statistics(v.obj, "aoi", "period", "obj_id")
    side = CH.compass_side(F.col("appeared"), F.col("total_second"), F.col("north"), F.col("east"))
    return stats.select("aoi", "first", "second", "appeared", "north", "east", side.alias("side"))


HINTS = f"""nd AS (SELECT {KEYS}, r, c, (nir - red) / (nir + red) AS ndvi, (red + green) / 2 AS bright FROM px),
hc AS (SELECT {KEYS}, quantile_cont(bright, 0.6) AS cut, quantile_cont(ndvi, 0.5) < 0.1 AS arid FROM nd GROUP BY {KEYS}),
hints AS (SELECT {KEYS}, r, c, ndvi < 0.15 AND bright > cut AS soil, arid FROM nd JOIN hc USING ({KEYS}))"""


@query("FU06_disagreement_hints", ctes("px", HINTS) + f"SELECT {KEYS}, r, c, soil, arid FROM hints")
def fu06(v):
    return FU.disagreement_hints(v.px, SCENE).drop("ndvi")


# Scenes ending in 9 lack radar; a slope mask stands in for terrain evidence.
MASKS = f"""masks AS (SELECT p.scene_id, p.date_idx, p.r, p.c, {OPTICAL_WATER} AS optical, CASE WHEN p.scene_id % 10 <> 9 THEN vv <= -16.0 - p.scene_id % 7 END AS sar,
soil, p.scene_id % 6 = 1 AND p.r < 9 AS slope, arid FROM px p JOIN hints h ON h.scene_id = p.scene_id AND h.date_idx = p.date_idx AND h.r = p.r AND h.c = p.c)"""
COUNTS = f"""cn AS (SELECT {KEYS}, count(*) FILTER (optical AND coalesce(sar, false)) AS b, count(*) FILTER (optical AND NOT coalesce(sar, false)) AS oo, count(*) FILTER (NOT optical AND coalesce(sar, false)) AS so,
count(*) FILTER (NOT optical AND coalesce(sar, false) AND soil) AS soil_px, count(*) FILTER (NOT optical AND coalesce(sar, false) AND slope) AS slope_px, bool_or(arid) AS arid, count(sar) > 0 AS has_sar FROM masks GROUP BY {KEYS}),
tg AS (SELECT *, CASE WHEN scene_id % 11 = 10 THEN 'builtup' ELSE 'water' END AS target, 0.6 + scene_id % 4 * 0.1 AS oc, 0.5 + scene_id % 3 * 0.15 AS sc, CASE WHEN NOT has_sar OR b + oo + so = 0 THEN 1.0 ELSE b / (b + oo + so) END AS iou FROM cn)"""
CAUSE_SQL = """CASE WHEN NOT has_sar OR iou >= 0.6 OR target <> 'water' THEN NULL WHEN so > oo THEN CASE WHEN soil_px > 0.5 * so THEN 'wet_smooth_soil' WHEN slope_px > 0.5 * so THEN 'radar_shadow' WHEN arid THEN 'dry_smooth_sand' ELSE 'cloud_over_water' END
WHEN oo > 0 THEN 'wind_roughened_surface' END"""
VERDICTS = f"""cs AS (SELECT *, {CAUSE_SQL} AS cause FROM tg),
wn AS (SELECT *, CASE WHEN NOT has_sar THEN 'optical' WHEN cause = 'cloud_over_water' THEN 'sar' WHEN cause IS NOT NULL THEN 'optical' END AS winner,
CASE WHEN NOT has_sar THEN 'single_modality' WHEN iou >= 0.6 THEN 'consistent' WHEN iou < 0.3 THEN 'conflict' ELSE 'partial' END AS verdict FROM cs)"""


def sensor_masks(v):
    """Masks and hints side by side; pixels without a place count for their scene's cuts only."""
    sar = F.when(F.col("scene_id") % 10 != 9, F.col("vv") <= F.lit(-16.0) - F.col("scene_id") % 7)
    masks = v.px.select("*", F.expr(OPTICAL_WATER).alias("optical"), sar.alias("sar"), ((F.col("scene_id") % 6 == 1) & (F.col("r") < 9)).alias("slope"))
    hints = FU.disagreement_hints(masks, SCENE, ["optical", "sar", "slope"]).dropna(subset=PIXEL)
    return hints.select(*PIXEL, "optical", "sar", "soil", "slope", "arid")


def water_or_builtup():
    return F.when(F.col("scene_id") % 11 == 10, "builtup").otherwise("water")


def verdicts(v):
    masks = sensor_masks(v)
    counts = FU.mask_counts(masks, SCENE).join(masks.groupBy(*SCENE).agg(F.bool_or("arid").alias("arid")), SCENE)
    optical = F.lit(0.6) + F.col("scene_id") % 4 * F.lit(0.1)
    radar = F.lit(0.5) + F.col("scene_id") % 3 * F.lit(0.15)
    return masks, FU.fusion_verdicts(counts, SCENE, water_or_builtup(), F.col("arid"), optical, radar)


@query(
    "FU07_classify_disagreement",
    ctes("px", HINTS, MASKS, COUNTS)
    + f"SELECT {KEYS}, so AS sar_only_px, oo AS optical_only_px, soil_px, slope_px, CASE WHEN target = 'water' THEN CASE WHEN so > oo THEN CASE WHEN soil_px > 0.5 * so THEN 'wet_smooth_soil' WHEN slope_px > 0.5 * so THEN 'radar_shadow' WHEN arid THEN 'dry_smooth_sand' ELSE 'cloud_over_water' END WHEN oo > 0 THEN 'wind_roughened_surface' END END AS cause FROM tg",
)
def fu07(v):
    masks = sensor_masks(v)
    counts = FU.mask_counts(masks, SCENE).join(masks.groupBy(*SCENE).agg(F.bool_or("arid").alias("arid")), SCENE)
    cause = FU.disagreement_cause(water_or_builtup(), F.col("arid"))
    return counts.select(*SCENE, "sar_only_px", "optical_only_px", "soil_px", "slope_px", cause.alias("cause"))


@query(
    "FU08_fuse_masks",
    ctes("px", HINTS, MASKS, COUNTS, VERDICTS)
    + f"""SELECT {KEYS}, verdict, cause, winner, round(iou, 4) AS iou, round(CASE WHEN NOT has_sar THEN oc * 0.9 WHEN iou >= 0.6 THEN least(0.97, greatest(oc, sc) + 0.1 * iou)
WHEN winner = 'optical' THEN oc * 0.6 WHEN winner = 'sar' THEN sc * 0.6 ELSE least(oc, sc) * 0.6 END, 4) AS confidence, b AS agreement_px, oo AS optical_only_px, so AS sar_only_px FROM wn""",
)
def fu08(v):
    return verdicts(v)[1]


@query(
    "FU08_fused_mask",
    ctes("px", HINTS, MASKS, COUNTS, VERDICTS)
    + f"""SELECT {KEYS}, r, c, CASE WHEN verdict = 'consistent' THEN optical OR sar WHEN winner = 'optical' THEN optical WHEN winner = 'sar' THEN sar ELSE optical AND sar END AS hit
FROM masks JOIN wn USING ({KEYS})""",
)
def fu08_mask(v):
    masks, verdict = verdicts(v)
    return FU.fused_mask(masks, verdict, SCENE)


@query(
    "FU09_fuse_masks_simple",
    ctes(
        "px",
        f"m AS (SELECT {KEYS}, {OPTICAL_WATER} AS o, vv <= -16.0 - scene_id % 7 AS s FROM px)",
        f"k AS (SELECT {KEYS}, count(*) FILTER (o AND NOT s) AS oo, count(*) FILTER (s AND NOT o) AS so, CASE WHEN count(*) FILTER (o OR s) = 0 THEN 1.0 ELSE count(*) FILTER (o AND s) / count(*) FILTER (o OR s) END AS iou, CASE WHEN scene_id % 11 = 10 THEN 'builtup' ELSE 'water' END AS target FROM m GROUP BY {KEYS})",
    )
    + f"""SELECT {KEYS}, round(iou, 6) AS iou, CASE WHEN iou >= 0.6 THEN 'high_agreement' WHEN target = 'water' THEN 'disagreement_resolved' ELSE 'unexplained_disagreement' END AS verdict,
CASE WHEN iou < 0.6 AND target = 'water' THEN CASE WHEN so > oo THEN 'cloud_over_water' ELSE 'wind_roughened_surface' END END AS cause,
CASE WHEN iou >= 0.6 THEN 'both' WHEN target = 'water' THEN CASE WHEN so > oo THEN 'sar' ELSE 'optical' END END AS winner, CASE WHEN iou >= 0.6 THEN 1.0 ELSE 0.6 END AS confidence_multiplier FROM k""",
)
def fu09(v):
    masks = v.px.select(
        *SCENE, F.expr(OPTICAL_WATER).alias("optical"), (F.col("vv") <= F.lit(-16.0) - F.col("scene_id") % 7).alias("sar"),
        F.lit(False).alias("soil"), F.lit(False).alias("slope"),
    )
    return FU.simple_reconcile(FU.mask_counts(masks, SCENE), SCENE, water_or_builtup())


@query(
    "JN05_mask_align",
    ctes("px", "o AS (SELECT scene_id, date_idx, r, c FROM px WHERE scene_id % 3 <> 0 OR r < 15)")
    + f"SELECT {KEYS}, count(*) AS unmatched_px FROM px WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scene_id = px.scene_id AND o.date_idx = px.date_idx AND o.r = px.r AND o.c = px.c) GROUP BY {KEYS}",
)
def jn05(v):
    cells = v.px.select(*PIXEL)
    return FU.grid_mismatch(cells.where("scene_id % 3 <> 0 OR r < 15"), cells, SCENE)


QUESTION_SQL = """CASE WHEN vec_id % 21 < 19 THEN concat('Is there any ', ({names})[1 + vec_id % 21], ' here?') WHEN vec_id % 21 = 19 THEN 'Is there forest in the scene?' ELSE 'What time is it?' END"""
SCORED = (
    "cls AS (SELECT [" + ", ".join(f"'{n}'" for n in C.LANDCOVER_CLASSES) + "] AS names),\n"
    "q AS (SELECT vec_id, label, CASE WHEN vec_id % 21 < 19 THEN concat('Is there any ', names[1 + vec_id % 21], ' here?') WHEN vec_id % 21 = 19 THEN 'Is there forest in the scene?' ELSE 'What time is it?' END AS question, names,\n"
    " list_transform(range(1, 20), lambda i: 0.5 + 2 * list_sum([CAST(embedding[j] AS DOUBLE) for j in range(i, 33, 19)])) AS so, list_transform(range(33, 52), lambda i: 0.5 + 2 * list_sum([CAST(embedding[j] AS DOUBLE) for j in range(i, 65, 19)])) AS sr FROM embeddings, cls),\n"
    "sc AS (SELECT vec_id, label, question, CASE WHEN lower(question) LIKE '%is there forest%' THEN greatest(so[4], so[7], so[13]) ELSE so[list_position(list_transform(names, lambda n: contains(lower(question), lower(n))), true)] END AS o,\n"
    " CASE WHEN lower(question) LIKE '%is there forest%' THEN greatest(sr[4], sr[7], sr[13]) ELSE sr[list_position(list_transform(names, lambda n: contains(lower(question), lower(n))), true)] END AS r FROM q),\n"
    "ans AS (SELECT vec_id, question, CASE WHEN label % 2 = 0 THEN 'yes' ELSE 'no' END AS truth, o, r, CASE WHEN o IS NULL THEN NULL WHEN o >= 0.5 THEN 'yes' ELSE 'no' END AS optical, CASE WHEN r IS NULL THEN NULL WHEN r >= 0.5 THEN 'yes' ELSE 'no' END AS radar FROM sc)"
)


def scored_questions(v):
    """The halves of an embedding, folded to the number of classes, stand for the scores of two sensors."""
    names = F.array(*[F.lit(n) for n in C.LANDCOVER_CLASSES])
    slot = (F.col("vec_id") % 21).cast("int")
    question = (
        F.when(slot < 19, F.concat(F.lit("Is there any "), F.get(names, slot), F.lit(" here?")))
        .when(slot == 19, "Is there forest in the scene?")
        .otherwise("What time is it?")
    )
    scores = lambda first, last: F.transform(folded("embedding", first, last, 19), lambda e: F.lit(0.5) + 2 * e)
    return v.embeddings.select(
        "vec_id", question.alias("question"), scores(1, 32).alias("optical_scores"), scores(33, 64).alias("radar_scores"),
        F.when(F.col("label") % 2 == 0, "yes").otherwise("no").alias("truth"),
    )


@query("FU12_landcover_answer", "WITH " + SCORED + " SELECT vec_id, question, optical AS answer FROM ans")
def fu12(v):
    return scored_questions(v).select("vec_id", "question", FU.landcover_answer(F.col("question"), F.col("optical_scores")).alias("answer"))


def model_answers(v, column, name):
    return scored_questions(v).select("vec_id", FU.landcover_answer(F.col("question"), F.col(column)).alias(name), "truth")


@query("JN12_two_model_join", "WITH " + SCORED + " SELECT vec_id, optical, radar, truth FROM ans")
def jn12(v):
    return model_answers(v, "optical_scores", "optical").join(model_answers(v, "radar_scores", "radar").drop("truth"), "vec_id")


@query(
    "FU13_two_model_agreement",
    "WITH " + SCORED
    + """, s AS (SELECT count(*) AS n, count(*) FILTER (optical = truth) AS o, count(*) FILTER (radar = truth) AS r, count(*) FILTER (optical = radar) AS a, count(*) FILTER (optical = radar AND optical = truth) AS ah,
count(*) FILTER (optical <> radar AND optical = truth) AS d_o, count(*) FILTER (optical <> radar AND radar = truth) AS d_r FROM ans WHERE optical IS NOT NULL AND radar IS NOT NULL)
SELECT n AS rows_scored, round(o / n, 4) AS optical_alone, round(r / n, 4) AS radar_alone, round(a / n, 4) AS agreement_rate, a AS agree_n, round(ah / a, 4) AS agree_accuracy, n - a AS disagree_n,
round(d_o / (n - a), 4) AS optical_right, round(d_r / (n - a), 4) AS radar_right, round((ah + d_o) / n, 4) AS policy_agree_else_optical FROM s""",
)
def fu13(v):
    return FU.two_model_agreement(jn12(v), "optical", "radar", "truth")


@query(
    "FU14_threshold_sweep",
    "WITH " + SCORED
    + """, t AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold), a AS (SELECT threshold, count(*) AS n, count(*) FILTER (truth = 'yes') AS y, avg(CASE WHEN (o >= threshold) = (truth = 'yes') THEN 1.0 ELSE 0.0 END) AS acc FROM ans, t WHERE o IS NOT NULL GROUP BY threshold)
SELECT threshold, n, round(acc, 4) AS accuracy, (SELECT threshold FROM a ORDER BY acc DESC, threshold LIMIT 1) AS best_threshold, round(greatest(y, n - y) / n, 4) AS majority_floor FROM a""",
)
def fu14(v):
    rows = scored_questions(v).select(FU.landcover_score(F.col("question"), F.col("optical_scores")).alias("score"), "truth")
    return FU.threshold_sweep(rows, "score", "truth")
