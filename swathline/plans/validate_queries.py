"""Corpus and trace checks over manifests derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.operators import questions as Q
from swathline.operators import validate as V
from swathline.plans.pixel_queries import PIXEL
from swathline.plans.registry import query
from swathline.plans.sample_queries import change_rows, change_sql
from swathline.plans.stats_queries import KEYS, SCENE
from swathline.plans.views import VIEWS, ctes

col = F.col

# A manifest with defects: repeats, blanks, straddling twins. Images are comma joined.
VIEWS["manifest"] = """
SELECT CASE WHEN o_orderkey % 101 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS sample_id, 'rs_vqa' AS adapter,
  CASE WHEN o_orderkey % 53 = 4 THEN '' ELSE 'single_vqa' END AS task,
  CASE WHEN o_custkey % 3 = 0 THEN concat('img', CAST(o_custkey % 90 AS STRING), ',img', CAST(o_custkey % 70 AS STRING)) ELSE concat('img', CAST(o_custkey % 90 AS STRING)) END AS image_list,
  concat('Q', CAST(o_orderkey % 400 AS STRING), ' about ', o_orderpriority) AS question,
  CASE WHEN o_orderkey % 211 = 9 THEN '' WHEN o_orderpriority = '5-LOW' THEN 'Yes' WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 10 > 0 THEN 'no' WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS answer,
  CASE WHEN o_orderkey % 53 = 4 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS question_type,
  CASE WHEN o_orderkey % 97 = 5 THEN '' WHEN o_custkey % 50 < 8 THEN 'val' ELSE 'train' END AS split,
  CASE o_custkey % 5 WHEN 0 THEN 'VRSBench' WHEN 1 THEN 'RSVQA-LR' WHEN 2 THEN 'reBEN' WHEN 3 THEN 'DOTA v2' ELSE 'own' END AS source,
  CASE WHEN o_orderkey % 301 = 2 THEN NULL ELSE 'CC BY 4.0' END AS licence,
  CASE WHEN o_orderkey % 4 < 3 THEN concat('t', CAST(o_custkey AS STRING), '_', CAST(o_orderkey % 2 AS STRING)) END AS twin_id
FROM orders"""


def manifest(v):
    return v.manifest.withColumn("images", F.split("image_list", ","))


@query(
    "VA01_check_schema",
    ctes("manifest")
    + "SELECT count(*) AS rows, count(*) FILTER (task = '' OR answer = '') AS missing_required, count(*) FILTER (coalesce(question_type, '') = '' AND task = '') AS untyped, count(*) FILTER (licence IS NULL) AS unlicensed FROM manifest",
)
def va01(v):
    return V.check_schema(manifest(v))


@query(
    "VA02_check_duplicates",
    ctes("manifest", "a AS (SELECT count(*) AS n FROM manifest GROUP BY image_list, question HAVING count(*) > 1)", "b AS (SELECT count(*) AS n FROM manifest GROUP BY sample_id HAVING count(*) > 1)")
    + "SELECT count(*) AS repeated_questions, coalesce(max(n), 0) AS worst, (SELECT count(*) FROM b) AS duplicate_ids FROM a",
)
def va02(v):
    return V.check_duplicates(manifest(v))


@query(
    "VA03_check_twins",
    ctes("manifest", "t AS (SELECT twin_id, count(*) AS n, count(DISTINCT split) > 1 AS s, count(DISTINCT answer) > 1 AS f FROM manifest WHERE twin_id IS NOT NULL GROUP BY twin_id)")
    + "SELECT count(*) AS twins, count(*) FILTER (n > 1) AS complete, count(*) FILTER (n > 1 AND f) AS opposing, count(*) FILTER (n = 1) AS single, count(*) FILTER (s) AS straddling, count(*) FILTER (n > 1 AND f) / count(*) FILTER (n > 1) < 0.5 AS warn FROM t",
)
def va03(v):
    return V.check_twins(manifest(v))


BALANCE = "c AS (SELECT coalesce(question_type, nullif(task, ''), '?') AS question_type, lower(answer) AS answer, count(*) AS n FROM manifest GROUP BY ALL)"


@query(
    "VA04_check_balance",
    ctes("manifest", BALANCE, "b AS (SELECT question_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS d, max(n) AS m, arg_max(answer, n) AS a FROM c GROUP BY question_type)")
    + "SELECT question_type, n, d AS distinct_answers, a AS most_common, round(m / n, 3) AS share, CASE WHEN d = 1 AND n > 1 THEN 'error' WHEN m / n > 0.8 AND n >= 20 THEN 'warning' ELSE 'ok' END AS level FROM b",
)
def va04(v):
    rows = manifest(v).withColumn("question_type", F.coalesce("question_type", F.nullif(col("task"), F.lit("")), F.lit("?")))
    return V.check_balance(rows, "question_type")


@query(
    "VA04_label_balance",
    "WITH c AS (SELECT d.lang, CAST(l.quality AS VARCHAR) AS a, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL), b AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS d, max(n) AS m, max({'n': n, 'a': a}).a AS a FROM c GROUP BY lang) SELECT lang, n, d AS distinct_answers, a AS most_common, round(m / n, 3) AS share, CASE WHEN d = 1 AND n > 1 THEN 'error' WHEN m / n > 0.8 AND n >= 20 THEN 'warning' ELSE 'ok' END AS level FROM b",
)
def va04_labels(v):
    rows = v.labels.join(v.documents.select("doc_id", "lang"), "doc_id").withColumn("answer", col("quality").cast("string"))
    return V.check_balance(rows, "lang")


@query(
    "VA05_check_image_load",
    ctes("manifest", "i AS (SELECT x, count(*) AS n FROM (SELECT unnest(string_split(image_list, ',')) AS x FROM manifest) u GROUP BY x)", "s AS (SELECT list_sort(list_distinct(string_split(image_list, ','))) AS k, count(*) AS n FROM manifest GROUP BY k)")
    + "SELECT (SELECT count(*) FROM i) AS distinct_images, (SELECT max(n) FROM i) AS rows_per_image_max, count(*) AS distinct_image_sets, max(n) AS rows_per_set_max, count(*) FILTER (n > 16) AS overloaded_sets, max(n) > 16 AS warn FROM s",
)
def va05(v):
    return V.check_image_load(manifest(v))


@query(
    "VA06_check_pixels",
    ctes("px", "it AS (SELECT s_suppkey AS scene_id, d AS date_idx FROM supplier, (SELECT unnest([0, 1, 2]) AS d) u)", f"sp AS (SELECT {KEYS}, stddev_pop(CASE WHEN scene_id % 9 = 4 THEN 5.0 ELSE red END) AS std FROM px GROUP BY {KEYS})")
    + f"SELECT it.scene_id, it.date_idx, CASE WHEN std IS NULL THEN 'missing' WHEN std < 1 THEN 'blank' ELSE 'ok' END AS state FROM it LEFT JOIN sp ON sp.scene_id = it.scene_id AND sp.date_idx = it.date_idx",
)
def va06(v):
    items = v.supplier.select(col("s_suppkey").alias("scene_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("date_idx"))
    pixels = v.px.withColumn("red", F.when(col("scene_id") % 9 == 4, 5.0).otherwise(col("red")))
    return V.check_pixels(items, pixels, SCENE, "red")


@query("VA07_check_splits", ctes("manifest") + "SELECT split, count(*) AS n, split = '' AS error FROM manifest GROUP BY split")
def va07(v):
    return V.check_splits(manifest(v))


@query(
    "VA08_balance_report",
    ctes("manifest", "i AS (SELECT image_list, count(*) AS n FROM manifest GROUP BY image_list)")
    + "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS images, max(n) AS rows_per_image_max, round(sum(n) / count(*), 2) AS rows_per_image_mean, (SELECT round(count(*) FILTER (lower(answer) = 'yes') / count(*), 3) FROM manifest WHERE lower(answer) IN ('yes', 'no')) AS yes_share, (SELECT count(DISTINCT coalesce(question_type, '?')) FROM manifest) AS types FROM i",
)
def va08(v):
    return V.balance_report(manifest(v).withColumn("question_type", F.coalesce("question_type", F.lit("?"))), "question_type")


STORED = "st AS (SELECT aoi, first, second, task, CASE WHEN aoi % 7 = 3 THEN concat(question, '?') ELSE question END AS question, CASE WHEN gap_months % 11 = 1 AND answer = 'yes' THEN 'no' ELSE answer END AS answer, aoi % 9 = 5 AS order_error FROM cr)"


@query(
    "VA09_verify_rows",
    ctes("obj", change_sql(), STORED)
    + "SELECT st.task, CASE WHEN order_error THEN 'order_error' WHEN cr.answer IS NULL THEN 'not_produced' WHEN cr.answer = st.answer THEN 'verified' ELSE 'mismatch' END AS state, count(*) AS n FROM st LEFT JOIN cr USING (aoi, first, second, question) GROUP BY ALL",
)
def va09(v):
    rows = change_rows(v)
    stored = rows.select(
        "aoi", "first", "second", "task", F.when(col("aoi") % 7 == 3, F.concat("question", F.lit("?"))).otherwise(col("question")).alias("question"),
        F.when((col("gap_months") % 11 == 1) & (col("answer") == "yes"), "no").otherwise(col("answer")).alias("answer"), (col("aoi") % 9 == 5).alias("order_error"),
    )
    return V.verify_rows(stored, rows, ["aoi", "first", "second", "question"])


@query("VA10_blind_ceiling", ctes("manifest", "c AS (SELECT source, question_type, lower(answer) AS answer, count(*) AS n FROM manifest GROUP BY ALL)") + "SELECT source, question_type, CAST(sum(n) AS BIGINT) AS n, round(100 * max(n) / sum(n), 2) AS blind_ceiling FROM c GROUP BY source, question_type")
def va10(v):
    return V.blind_ceiling(manifest(v), ["source", "question_type"])


@query(
    "VA11_caption_diversity",
    """WITH b AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w, len(text) - len(replace(text, '.', '')) AS stops FROM documents),
o AS (SELECT array_to_string(w[1:4], ' ') AS o, count(*) AS n FROM b GROUP BY 1), g AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - 3, 0) + 1), lambda i: lower(array_to_string(w[i:i + 3], ' ')))) AS g FROM b) u GROUP BY g),
mw AS (SELECT len(w) AS v, row_number() OVER (ORDER BY len(w)) - 1 AS k, count(*) OVER () AS c FROM b), ms AS (SELECT stops AS v, row_number() OVER (ORDER BY stops) - 1 AS k, count(*) OVER () AS c FROM b)
SELECT CAST(sum(n) AS BIGINT) AS captions, round(max(n) / sum(n), 4) AS top_opening_share, count(*) AS distinct_openings, (SELECT round(count(*) / sum(n), 4) FROM g) AS distinct_4gram_ratio, (SELECT CAST(v AS BIGINT) FROM mw WHERE k = c // 2) AS median_words, (SELECT CAST(v AS BIGINT) FROM ms WHERE k = c // 2) AS median_sentences FROM o""",
)
def va11(v):
    return V.caption_diversity(v.documents, "text")


RULES = {"vrsbench": "evaluation_only", r"^dota\b": "blocked", "unstaged": "not_staged"}


@query(
    "VA12_licence_gate",
    ctes("manifest") + "SELECT source, CASE WHEN regexp_matches(source, 'vrsbench', 'i') THEN 'evaluation_only' ELSE 'blocked' END AS reason, count(*) AS n FROM manifest WHERE split = 'train' AND (regexp_matches(source, 'vrsbench', 'i') OR regexp_matches(source, '^dota\\b', 'i')) GROUP BY ALL",
)
def va12(v):
    return V.licence_gate(manifest(v), RULES)


PERMITTED = {
    "click": {"index": {"enum": ("NDVI", "NDWI")}, "threshold": {"range": (-1.0, 1.0)}},
    "view": {"window": {"range": (3, 31), "int": True}},
    "purchase": {"threshold": {"range": (0.0, 0.5)}},
}
CALLS = """calls AS (SELECT event_id, event_type AS tool, CASE event_id % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'threshold' WHEN 2 THEN 'window' ELSE 'mode' END AS param,
CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'NDVI' ELSE 'EVI' END WHEN 1 THEN CAST(event_id % 30 / 10.0 - 1 AS VARCHAR) WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN '4.5' ELSE CAST(event_id % 50 AS VARCHAR) END ELSE 'x' END AS value, user_id % 6 = 0 AS no_nir FROM events)"""


@query(
    "VA13_parameter_audit",
    "WITH " + CALLS
    + """, n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM calls) SELECT event_id, tool, param, CASE tool WHEN 'click' THEN CASE WHEN no_nir THEN 'missing_band' WHEN param = 'index' THEN CASE WHEN value NOT IN ('NDVI', 'NDWI') THEN 'not_in_enum' END WHEN param = 'threshold' THEN CASE WHEN x IS NULL THEN 'not_a_number' WHEN x < -1 OR x > 1 THEN 'out_of_range' END ELSE 'unknown_parameter' END
WHEN 'view' THEN CASE WHEN param = 'window' THEN CASE WHEN x IS NULL OR x <> floor(x) THEN 'not_an_integer' WHEN x < 3 OR x > 31 THEN 'out_of_range' END ELSE 'unknown_parameter' END
WHEN 'purchase' THEN CASE WHEN param = 'threshold' THEN CASE WHEN x IS NULL THEN 'not_a_number' WHEN x < 0 OR x > 0.5 THEN 'out_of_range' END ELSE 'unknown_parameter' END ELSE 'unknown_tool' END AS reason FROM n""",
)
def va13(v):
    k = col("event_id")
    param = F.when(k % 4 == 0, "index").when(k % 4 == 1, "threshold").when(k % 4 == 2, "window").otherwise("mode")
    value = (
        F.when(k % 4 == 0, F.when(k % 3 == 0, "NDVI").otherwise("EVI")).when(k % 4 == 1, (k % 30 / 10 - 1).cast("string"))
        .when(k % 4 == 2, F.when(k % 5 == 0, "4.5").otherwise((k % 50).cast("string"))).otherwise("x")
    )
    bands = F.when(col("user_id") % 6 == 0, F.array(F.lit("red"))).otherwise(F.array(F.lit("red"), F.lit("nir")))
    calls = v.events.select("event_id", col("event_type").alias("tool"), param.alias("param"), value.alias("value"), bands.alias("bands"))
    return V.parameter_audit(calls, PERMITTED, {"click": ("nir",)}).select("event_id", "tool", "param", "reason")


MASKED = f"mk AS (SELECT scene_id, date_idx, r, c, coalesce(vv <= -18, false) AS hit, CASE WHEN scene_id % 7 = 2 THEN 'EPSG:4326' ELSE 'EPSG:32644' END AS crs FROM grid WHERE scene_id % 11 <> 3 AND (scene_id % 5 <> 1 OR r < 15))"


@query(
    "VA14_mask_conformance",
    ctes("px", "grid", MASKED, f"h AS (SELECT DISTINCT scene_id, date_idx FROM px)", f"f AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (hit) AS p, max(crs) AS crs FROM mk GROUP BY {KEYS})")
    + "SELECT h.scene_id, h.date_idx, CASE WHEN n IS NULL THEN 'no_mask' WHEN n <> 256 THEN 'shape' WHEN crs <> 'EPSG:32644' THEN 'crs' END AS reject, p AS positive_px, round(p * 100.0, 3) AS area_m2 FROM h LEFT JOIN f ON f.scene_id = h.scene_id AND f.date_idx = h.date_idx",
)
def va14(v):
    return V.mask_conformance(scene_masks(v), scene_headers(v), SCENE)


def scene_masks(v):
    crs = F.when(col("scene_id") % 7 == 2, "EPSG:4326").otherwise("EPSG:32644")
    return v.grid.where("scene_id % 11 <> 3 AND (scene_id % 5 <> 1 OR r < 15)").select(*PIXEL, F.coalesce(col("vv") <= -18, F.lit(False)).alias("hit"), crs.alias("crs"))


def scene_headers(v):
    return v.px.select(*SCENE).distinct().select(*SCENE, F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit("EPSG:32644").alias("crs"), F.lit(10.0).alias("pixel_size"))


TRACE = """tr AS (SELECT event_id, CASE WHEN event_id % 31 = 3 THEN '{"tool": ' WHEN event_id % 29 = 4 THEN '{"confidence": 0.5}' ELSE concat('{"tool": "', event_type, '", "confidence": ', CAST(event_id % 97 AS STRING), ', "basis": "', CASE WHEN event_id % 13 = 1 THEN 'guess' ELSE 'heuristic' END, '"}') END AS body FROM events)"""


@query(
    "VA15_trace_shape",
    "WITH " + TRACE
    + """, f AS (SELECT event_id, body, nullif(regexp_extract(body, '"tool": "([^"]*)"', 1), '') AS tool, nullif(regexp_extract(body, '"basis": "([^"]*)"', 1), '') AS basis FROM tr)
SELECT event_id, CASE WHEN NOT json_valid(body) THEN 'malformed' WHEN tool IS NULL THEN 'missing_tool' WHEN tool NOT IN ('click', 'view', 'purchase', 'signup', 'logout') THEN 'bad_tool' WHEN basis IS NULL THEN 'missing_basis' WHEN basis NOT IN ('heuristic', 'threshold_statistics') THEN 'bad_basis' END AS fault FROM f""",
)
def va15(v):
    raw = v.sql(TRACE[len("tr AS ("):-1])
    enums = {"tool": ("click", "view", "purchase", "signup", "logout"), "basis": ("heuristic", "threshold_statistics")}
    return V.trace_shape(raw, "body", "tool string, confidence double, basis string", enums).select("event_id", "fault")
