"""Labelling, routing scores, confidence and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions import headers as H
from swathline.functions import labelling as L
from swathline.operators import calibrate as CF
from swathline.operators import change as CH
from swathline.plans.pixel_queries import inventory_sql
from swathline.plans.registry import query
from swathline.plans.sample_queries import change_rows, change_sql
from swathline.plans.views import VIEWS, ctes

col = F.col

TEXTS = (
    "Where is the harbor?",
    "Describe the scene.",
    "What does this image show, and how many buildings?",
    "How many buildings are there?",
    "Has the forest changed since 2019?",
    "The ship positioned near the right edge of the image can be found between the two small harbors.",
    "Is there a ship on the left side?",
    "Extract the water footprint.",
    "Is the vegetation healthy?",
    "What colour is the roof?",
    "What is the moisture of the crop fields?",
    "Locate the storage tanks in the port",
    "Give the polarimetric signature of the city",
    "What percentage of the area is urban?",
    "A large soccer ball field located in the bottom left corner of the view",
    "Is there flooding?",
    "Find the red thing",
)
VIEWS["asked"] = (
    "SELECT o_orderkey AS sample_id, CASE o_orderkey % " + str(len(TEXTS)) + "".join(f" WHEN {i} THEN '{t}'" for i, t in enumerate(TEXTS))
    + " END AS question, o_custkey % 5 < 4 AS optical, o_custkey % 3 = 0 AS sar, CASE WHEN o_custkey % 4 = 1 THEN 2 ELSE 1 END AS images, o_custkey % 7 < 3 AS blind, o_custkey % 11 = 3 AS single_pol,"
    " o_custkey % 6 AS crs_kind, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS nodata FROM orders"
)
Q = "lower(question)"


def any_sql(terms, t=Q):
    return f"regexp_matches({t}, '" + "|".join(terms) + "')"


WORDS = "[" + ", ".join(f"'{w}'" for w in L.OBJECT_WORDS) + "]"
REFERS = f"(NOT ends_with({Q}, '?') AND len(string_split({Q}, ' ')) >= 6 AND (list_has_any(regexp_extract_all({Q}, '[a-z\\-]+'), {WORDS}) OR {any_sql(L.OBJECT_PHRASES)}) AND {any_sql(L.SPATIAL_TERMS)})"
TASK_SQL = f"""CASE WHEN optical AND sar THEN CASE WHEN {any_sql(L.MASK_TERMS)} OR {any_sql(L.QUANTITATIVE_TERMS)} THEN 'crossmodal_extraction' ELSE 'crossmodal_vqa' END
WHEN images >= 2 THEN CASE WHEN {any_sql(L.MASK_TERMS)} THEN 'change_map' WHEN {any_sql(L.QUANTITATIVE_TERMS)} THEN 'change_vqa' WHEN {any_sql(L.CAPTION_TERMS)} THEN 'change_description' ELSE 'change_vqa' END
WHEN {any_sql(L.CHANGE_TERMS)} AND NOT {REFERS} THEN 'change_vqa' WHEN {any_sql(L.GROUNDING_TERMS)} OR {any_sql(L.MASK_TERMS)} OR {REFERS} THEN 'single_grounding'
WHEN {any_sql(L.CAPTION_TERMS)} AND NOT ends_with({Q}, '?') THEN 'single_caption' ELSE 'single_vqa' END"""
PATH_SQL = f"CASE WHEN NOT (optical AND sar) AND images < 2 AND NOT ({any_sql(L.CHANGE_TERMS)} AND NOT {REFERS}) AND NOT ({any_sql(L.GROUNDING_TERMS)} OR {any_sql(L.MASK_TERMS)} OR {REFERS}) AND {any_sql(L.CAPTION_TERMS)} AND ends_with({Q}, '?') THEN 'llm' ELSE 'rules' END"
LABELLED = f"lq AS (SELECT *, {TASK_SQL} AS task, {PATH_SQL} AS path FROM asked)"


def labelled(v):
    task, path = L.label_task(col("question"), col("optical"), col("sar"), col("images"))
    return v.asked.withColumn("task", task).withColumn("path", path)


@query("RT01_label_task", ctes("asked", LABELLED) + "SELECT sample_id, task, path FROM lq")
def rt01(v):
    return labelled(v).select("sample_id", "task", "path")


@query("RT02_is_referring_expression", ctes("asked") + f"SELECT sample_id, {REFERS} AS refers FROM asked")
def rt02(v):
    return v.asked.select("sample_id", L.is_referring_expression(col("question")).alias("refers"))


@query(
    "RT03_extract_targets",
    ctes("asked", f"n AS (SELECT sample_id, question, list_filter(regexp_extract_all({Q}, '[a-z\\-]+'), lambda w: list_contains({WORDS}, w))[1] AS known, list_filter(string_split(regexp_extract({Q}, '{L.LOCATE_PHRASE}', 1), ' '), lambda w: w NOT IN ('in', 'on', 'at', 'of', 'from', '')) AS kept FROM asked)")
    + f"SELECT sample_id, concat_ws(',', CASE WHEN {any_sql(L.WATER_TERMS)} THEN 'water' END, CASE WHEN {any_sql(L.BUILTUP_TERMS)} THEN 'builtup' END, CASE WHEN {any_sql(L.VEGETATION_TERMS)} THEN 'vegetation' END) AS targets, coalesce(known, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') END) AS noun FROM n",
)
def rt03(v):
    return v.asked.select("sample_id", F.array_join(L.targets(col("question")), ",").alias("targets"), L.grounding_noun(col("question")).alias("noun"))


TARGET_SQL = "CASE scene_id % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'vegetation' WHEN 2 THEN 'builtup' ELSE 'roads' END"


@query(
    "RT04_choose_measurement",
    inventory_sql()
    + f""", m AS (SELECT scene_id, {TARGET_SQL} AS target, modality = 'optical' AND cnt = 1 AS pan, CASE WHEN modality = 'sar' THEN 'C' END AS sb, nir > 0 AND red > 0 AS ndvi, green > 0 AND nir > 0 AS ndwi, green > 0 AND swir > 0 AS mndwi, swir > 0 AND nir > 0 AS ndbi FROM inv)
SELECT scene_id, target, CASE target WHEN 'water' THEN CASE WHEN mndwi THEN 'spectral_index:MNDWI' WHEN ndwi THEN 'spectral_index:NDWI' WHEN NOT pan THEN 'texture_seg' ELSE 'refusal' END WHEN 'vegetation' THEN CASE WHEN ndvi THEN 'spectral_index:NDVI' WHEN NOT pan THEN 'texture_seg' ELSE 'refusal' END
WHEN 'builtup' THEN CASE WHEN ndbi THEN 'spectral_index:NDBI' WHEN sb IS NOT NULL THEN 'sar_backscatter' WHEN NOT pan THEN 'texture_seg' ELSE 'refusal' END ELSE 'refusal' END AS tool FROM m""",
)
def rt04(v):
    bands = H.band_inventory(v.headers.withColumn("d", F.split("described", ",")), "d", "modality")
    indices = H.computable_indices({b: col(b) > 0 for b in C.BAND_NAMES})
    pan = (col("modality") == "optical") & (F.size("d") == 1)
    base = bands.select("scene_id", F.expr(TARGET_SQL).alias("target"), indices.alias("i"), pan.alias("pan"), F.when(col("modality") == "sar", "C").alias("sb"))
    return base.select("scene_id", "target", L.choose_measurement(col("target"), col("i"), col("pan"), col("sb")).alias("tool"))


REASON_SQL = f"""CASE WHEN starts_with(task, 'change_') AND images < 2 THEN 'change_needs_two_images' WHEN sar AND NOT optical AND {any_sql(L.COLOUR_TERMS)} THEN 'radar_has_no_colour'
WHEN blind AND {any_sql(L.SPECTRAL_TERMS)} AND {any_sql(L.IRREDUCIBLE_TERMS)} AND NOT sar THEN 'no_infrared_band' WHEN blind AND {any_sql(L.SPECTRAL_TERMS)} AND NOT sar AND NOT {any_sql(L.VEGETATION_TERMS)} THEN 'no_spectral_band' END"""
REFUSED = f"rq AS (SELECT *, {REASON_SQL} AS reason FROM lq)"


def refused(v):
    texture = F.array_contains(L.targets(col("question")), "vegetation")
    reason, category = L.refusal(col("question"), col("task"), col("optical"), col("sar"), col("images"), col("blind"), texture)
    return labelled(v).withColumn("reason", reason).withColumn("category", category)


@query(
    "RT05_flag_unanswerable",
    ctes("asked", LABELLED, REFUSED)
    + f"""SELECT sample_id, reason, CASE WHEN reason = 'change_needs_two_images' THEN 'missing_input' WHEN reason IS NOT NULL THEN 'modality_limitation' END AS category,
concat_ws(',', CASE WHEN crs_kind > 3 THEN 'crs_mismatch' END, CASE WHEN crs_kind = 1 THEN 'crs_missing' END, CASE WHEN sar AND NOT optical AND {any_sql(L.SPECTRAL_TERMS)} THEN 'spectral_on_radar' END, CASE WHEN single_pol AND {any_sql(L.POLARIMETRIC_TERMS)} THEN 'single_polarisation' END, CASE WHEN nodata > 0.5 THEN 'mostly_nodata' END) AS warnings FROM rq""",
)
def rt05(v):
    distinct = F.when(col("crs_kind") > 3, 2).otherwise(1)
    missing = F.when(col("crs_kind") == 1, 1).otherwise(0)
    warned = L.warnings(col("question"), col("optical"), col("sar"), distinct, missing, col("nodata"), col("single_pol"))
    return refused(v).select("sample_id", "reason", "category", F.array_join(warned, ",").alias("warnings"))


OP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(question, '{p}', 'i') THEN '{n}'" for n, p in L.OPERATION_RULES) + " END"


@query("RT06_label_change_operation", ctes("obj", change_sql()) + f"SELECT sample_id, {OP_SQL} AS operation FROM cr")
def rt06(v):
    return change_rows(v).select("sample_id", L.change_operation(col("question")).alias("operation"))


EXPECTED = "CASE WHEN optical AND sar THEN 'crossmodal_vqa' WHEN images >= 2 THEN 'change_vqa' WHEN sample_id % 17 IN (0, 5, 7, 11, 14) THEN 'single_grounding' WHEN sample_id % 17 IN (1, 2) THEN 'single_caption' WHEN sample_id % 17 = 4 THEN 'change_vqa' ELSE 'single_vqa' END"


@query(
    "RT07_routing_score",
    ctes("asked", LABELLED, REFUSED, f"x AS (SELECT *, {EXPECTED} = task AS hit, sample_id % 17 <> 2 AS clear, sample_id % 17 IN (4, 8, 9, 10) AS want_refusal, CASE sample_id % 17 WHEN 4 THEN 'missing_input' ELSE 'modality_limitation' END AS want_category, CASE WHEN reason = 'change_needs_two_images' THEN 'missing_input' WHEN reason IS NOT NULL THEN 'modality_limitation' END AS category FROM rq)")
    + """SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS task_accuracy, round(count(*) FILTER (hit AND clear) / count(*) FILTER (clear), 4) AS unambiguous_accuracy, count(*) FILTER (clear) AS unambiguous_n,
round(avg(CASE WHEN path = 'rules' THEN 1.0 ELSE 0.0 END), 4) AS rules_share, round(count(*) FILTER (hit AND path = 'rules') / count(*) FILTER (path = 'rules'), 4) AS rules_accuracy, round(count(*) FILTER (want_refusal AND reason IS NOT NULL) / count(*) FILTER (want_refusal), 4) AS refusal_catch_rate,
round(count(*) FILTER (want_refusal AND category = want_category) / count(*) FILTER (want_refusal), 4) AS refusal_category_accuracy FROM x""",
)
def rt07(v):
    scored = refused(v).select(
        (F.expr(EXPECTED) == col("task")).alias("hit"), (col("sample_id") % 17 != 2).alias("clear"), (col("path") == "rules").alias("rules"),
        (col("sample_id") % 17).isin(4, 8, 9, 10).alias("want"), F.when(col("sample_id") % 17 == 4, "missing_input").otherwise("modality_limitation").alias("want_category"),
        col("reason").isNotNull().alias("caught"), "category",
    )
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    share = lambda a, b: F.round(n(a) / n(b), 4)
    every = F.lit(True)
    return scored.agg(
        F.count("*").alias("n"), share(col("hit"), every).alias("task_accuracy"), share(col("hit") & col("clear"), col("clear")).alias("unambiguous_accuracy"),
        n(col("clear")).alias("unambiguous_n"), share(col("rules"), every).alias("rules_share"), share(col("hit") & col("rules"), col("rules")).alias("rules_accuracy"),
        share(col("want") & col("caught"), col("want")).alias("refusal_catch_rate"),
        share(col("want") & (col("category") == col("want_category")), col("want")).alias("refusal_category_accuracy"),
    )


@query("RT07_confusion", ctes("asked", LABELLED) + f"SELECT {EXPECTED} AS expected, task, count(*) AS n FROM lq GROUP BY ALL")
def rt07_confusion(v):
    return labelled(v).groupBy(F.expr(EXPECTED).alias("expected"), "task").agg(F.count("*").alias("n"))


BUNDLE = "CASE WHEN optical AND sar THEN 'crossmodal' WHEN images >= 2 THEN 'bitemporal' ELSE 'single' END"


@query(
    "RT08_task_support",
    ctes("asked", "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', [{', '.join(repr(r) for r in req)}])" for t, req in L.TASK_REQUIRES.items()) + ") x(task, req))")
    + f"SELECT sample_id, task, list_contains(req, {BUNDLE}) AS supported, CASE WHEN list_contains(req, {BUNDLE}) THEN NULL WHEN list_contains(req, 'bitemporal') THEN 'needs two scenes of the same modality at different dates' ELSE 'needs a co-registered optical and SAR pair' END AS reason FROM asked, t",
)
def rt08(v):
    table = F.array(*[F.struct(F.lit(t).alias("task"), F.array(*[F.lit(r) for r in req]).alias("req")) for t, req in L.TASK_REQUIRES.items()])
    rows = v.asked.select("sample_id", F.expr(BUNDLE).alias("bundle"), F.explode(table).alias("t"))
    ok = F.array_contains("t.req", col("bundle"))
    reason = F.when(~ok, F.when(F.array_contains("t.req", "bitemporal"), "needs two scenes of the same modality at different dates").otherwise("needs a co-registered optical and SAR pair"))
    return rows.select("sample_id", "t.task", ok.alias("supported"), reason.alias("reason"))


@query(
    "SC10_abstention_score",
    ctes("obj", change_sql(), f"q AS (SELECT aoi, first, second, task, CASE WHEN aoi % 8 = 5 THEN 'What colour is it?' ELSE question END AS question, CASE WHEN gap_months % 13 = 2 AND task = 'change_presence' THEN 'maybe' ELSE answer END AS answer, question AS q0 FROM cr)",
         f"o AS (SELECT q.*, {OP_SQL} AS op, CASE WHEN {OP_SQL} IS NOT NULL AND NOT (aoi % 6 = 4 AND task = 'change_compare') THEN (SELECT max(c.answer) FROM cr c WHERE c.aoi = q.aoi AND c.first = q.first AND c.second = q.second AND c.question = q.q0) END AS said FROM q)")
    + """SELECT task, count(*) AS rows, count(*) FILTER (op IS NOT NULL AND said IS NOT NULL) AS answered, count(*) FILTER (op IS NOT NULL AND said IS NULL) AS abstained, count(*) FILTER (op IS NULL) AS unrouted,
round(coalesce(count(*) FILTER (said = answer) / nullif(count(*) FILTER (said IS NOT NULL), 0), 0), 4) AS accuracy_answered, round(count(*) FILTER (said = answer) / count(*), 4) AS accuracy_all_rows FROM o GROUP BY task""",
)
def sc10(v):
    rows = change_rows(v)
    asked = rows.select(
        "aoi", "first", "second", "task", F.when(col("aoi") % 8 == 5, "What colour is it?").otherwise(col("question")).alias("question"),
        F.when((col("gap_months") % 13 == 2) & (col("task") == "change_presence"), "maybe").otherwise(col("answer")).alias("answer"),
    ).withColumn("operation", L.change_operation(col("question")))
    stats = CH.pair_statistics(v.obj, "aoi", "period", "obj_id")
    from swathline.plans.sample_queries import month

    answers = CH.change_answers(stats)
    said = stats.select("aoi", month(col("first")).alias("first"), month(col("second")).alias("second"), *[a.alias(n) for n, a in answers.items()])
    joined = asked.join(said, ["aoi", "first", "second"], "left")
    picked = F.coalesce(*[F.when(col("operation") == n, col(n)) for n in answers])
    # One area abstains on comparisons, as a tie would.
    return CH.abstention_score(joined.withColumn("said", F.when(~((col("aoi") % 6 == 4) & (col("task") == "change_compare")), picked)), "task")


FEATURE_SQL = "fs AS (SELECT query_id, coalesce(min(confidence) FILTER (confidence > 0), 0.4) AS mn, coalesce(avg(confidence) FILTER (confidence > 0), 0.4) AS av, avg(CASE WHEN threshold_method LIKE '%fallback' THEN 1.0 ELSE 0.0 END) AS fb, count(*) FILTER (confidence = 0) AS no_ops FROM trace_steps GROUP BY query_id)"


@query("CF02_confidence_features", ctes("trace_steps", FEATURE_SQL) + "SELECT query_id, mn AS tool_confidence_min, round(av, 6) AS tool_confidence_mean, round(fb, 6) AS threshold_fallback_fraction, no_ops, 0.0 AS deterministic_fallback_used FROM fs")
def cf02(v):
    out = CF.confidence_features(v.trace_steps, "query_id")
    return out.withColumn("tool_confidence_mean", F.round("tool_confidence_mean", 6)).withColumn("threshold_fallback_fraction", F.round("threshold_fallback_fraction", 6))


@query(
    "CF01_heuristic_confidence",
    ctes("trace_steps", FEATURE_SQL, "x AS (SELECT query_id, least(mn, av) * (0.6 + 0.4 * (query_id % 10 / 10.0)) * (1 - 0.25 * fb) * CASE WHEN query_id % 4 = 0 THEN 0.95 ELSE 1.0 END * greatest(0.6, 1 - 0.05 * (query_id % 12)) AS c, no_ops FROM fs)")
    + "SELECT query_id, round(least(greatest(CASE WHEN query_id % 9 = 0 THEN least(c, 0.35) ELSE c END, 0.0), 1.0), 9) AS heuristic, round(least(greatest(CASE WHEN query_id % 9 = 0 THEN least(c, 0.35) ELSE c END, 0.0), 1.0) * power(0.6, no_ops), 9) AS confidence FROM x",
)
def cf01(v):
    q = col("query_id")
    f = CF.confidence_features(v.trace_steps, "query_id").withColumn("agreement_iou", q % 10 / 10).withColumn("router_is_rules", F.when(q % 4 == 0, 0.0).otherwise(1.0))
    f = f.withColumn("warning_count", q % 12).withColumn("deterministic_fallback_used", F.when(q % 9 == 0, 1.0).otherwise(0.0))
    value = CF.heuristic_confidence()
    return f.select("query_id", F.round(value, 9).alias("heuristic"), F.round(value * F.pow(F.lit(0.6), "no_ops"), 9).alias("confidence"))


# The logistic fit has no SQL form; tests check that it is monotone and calibrated.
@query("CF03_fit_calibrator")
def cf03(v):
    p = col("p")
    rows = v.calib.select(
        "l_orderkey", "l_linenumber", "correct", p.alias("tool_confidence_min"), ((p + col("l_partkey") % 7 / 7) / 2).alias("tool_confidence_mean"),
        (col("l_suppkey") % 10 / 10).alias("agreement_iou"), (col("l_partkey") % 4 / 4).alias("threshold_fallback_fraction"),
        (col("l_orderkey") % 2).cast("double").alias("router_is_rules"), (col("l_partkey") % 5).cast("double").alias("warning_count"),
        (-(col("l_suppkey") % 3)).cast("double").alias("answer_logprob"), F.when(col("l_orderkey") % 9 == 0, 1.0).otherwise(0.0).alias("deterministic_fallback_used"),
    )
    out = CF.fit_calibrator(rows, "correct")
    return out.select("l_orderkey", "l_linenumber", "correct", F.round("score", 4).alias("score"), F.round("calibrated", 4).alias("calibrated"))


# Pool adjacent violators one step at a time: the last two blocks are merged while they fall, else the next point is pushed.
SCORES = "cs AS (SELECT l_orderkey, l_linenumber, correct, round(1 / (1 + exp(-(3.0 * p - 1.5 + 0.25 * (l_partkey % 7) - 0.5 * (l_orderkey % 2)))), 3) AS score FROM calib)"


@query(
    "CF03_calibrate_scores",
    "WITH RECURSIVE " + ctes(
        "calib", SCORES,
        "pt AS (SELECT score, CAST(sum(correct) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY score) AS k FROM cs GROUP BY score)",
        """st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(lo DOUBLE, t DOUBLE, w DOUBLE)[]) AS b, false AS done
 UNION ALL SELECT CASE WHEN falls THEN k ELSE k + 1 END, CASE WHEN falls THEN list_append(b[:-3], {'lo': b[-2].lo, 't': b[-2].t + b[-1].t, 'w': b[-2].w + b[-1].w}) WHEN score IS NOT NULL THEN list_append(b, {'lo': score, 't': t, 'w': w}) ELSE b END, NOT falls AND score IS NULL
 FROM (SELECT st.*, pt.score, pt.t, pt.w, coalesce(len(b) > 1 AND b[-2].t * b[-1].w > b[-1].t * b[-2].w, false) AS falls FROM st LEFT JOIN pt ON pt.k = st.k + 1 WHERE NOT st.done) z)""",
        "bl AS (SELECT unnest(b) AS x FROM st WHERE done)",
    )[len("WITH "):]
    + "SELECT l_orderkey, l_linenumber, score, round(x.t / x.w, 6) AS calibrated FROM cs ASOF JOIN (SELECT x, x.lo AS lo FROM bl) y ON cs.score >= y.lo",
)
def cf03_scores(v):
    """The isotonic half on scores of a stated logistic model."""
    z = 3.0 * col("p") - 1.5 + 0.25 * (col("l_partkey") % 7) - 0.5 * (col("l_orderkey") % 2)
    scored = v.calib.select("l_orderkey", "l_linenumber", "correct", F.round(1 / (1 + F.exp(-z)), 3).alias("score"))
    return CF.calibrated(scored, "correct").select("l_orderkey", "l_linenumber", "score", F.round("calibrated", 6).alias("calibrated"))


# Pooled values by the max-min formula: the largest over starts of the least mean up to any end.
ISOTONIC_SQL = ctes(
    "calib",
    "g AS (SELECT p AS score, avg(correct) AS y, CAST(count(*) AS DOUBLE) AS w FROM calib GROUP BY p)",
    "seg AS (SELECT a.score AS s, b.score AS e, sum(c.y * c.w) / sum(c.w) AS m FROM g a JOIN g b ON a.score <= b.score JOIN g c ON c.score BETWEEN a.score AND b.score GROUP BY a.score, b.score)",
    "low AS (SELECT g.score, g.w, seg.s, min(seg.m) AS m FROM g JOIN seg ON seg.s <= g.score AND seg.e >= g.score GROUP BY g.score, g.w, seg.s)",
) + "SELECT score, w AS weight, round(max(m), 6) AS fitted FROM low GROUP BY score, w"


@query("CF04_isotonic_pav", ISOTONIC_SQL)
def cf04(v):
    return CF.isotonic_fit(v.calib, "p", "correct").select("score", "weight", F.round("fitted", 6).alias("fitted"))


def table_sql(slot):
    return ctes("calib", f"b AS (SELECT CAST(least(greatest({slot}, 0), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mc, avg(correct) AS acc FROM calib GROUP BY 1)", "g AS (SELECT CAST(unnest(range(10)) AS BIGINT) AS bin)") + "SELECT bin, bin / 10 AS bin_low, (bin + 1) / 10 AS bin_high, coalesce(n, 0) AS count, round(coalesce(mc, 0), 6) AS mean_confidence, round(coalesce(acc, 0), 6) AS accuracy FROM g LEFT JOIN b USING (bin)"


def rounded_table(v, closed_right):
    out = CF.reliability_table(v.calib, "p", "correct", closed_right=closed_right)
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("CF05_reliability_table", table_sql("ceil(round(p * 10, 9)) - 1"))
def cf05(v):
    return rounded_table(v, True)


@query("CF05_reliability_left_closed", table_sql("floor(round(p * 10, 9))"))
def cf05_left(v):
    return rounded_table(v, False)


@query("CF06_expected_calibration_error", ctes("calib", "b AS (SELECT least(greatest(ceil(round(p * 10, 9)) - 1, 0), 9) AS bin, count(*) AS n, avg(p) AS mc, avg(correct) AS acc FROM calib GROUP BY 1)") + "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM b")
def cf06(v):
    return CF.expected_calibration_error(v.calib, "p", "correct")
