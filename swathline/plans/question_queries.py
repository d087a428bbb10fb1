"""Question rows generated from labels, boxes, masks and index deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions import boxes as B
from swathline.operators import change as CH
from swathline.operators import joins as JO
from swathline.operators import questions as Q
from swathline.operators import ranking as RK
from swathline.operators import sampling as SM
from swathline.plans.box_queries import AREA_SQL, RINGS, WKT, rings
from swathline.plans.registry import query
from swathline.plans.sample_queries import grid_patches
from swathline.plans.stats_queries import KEYS, SCENE
from swathline.plans.views import ctes

col = F.col
CLASS_SQL = "[" + ", ".join(f"'{c}'" for c in C.LANDCOVER_CLASSES) + "]"
LABELS = f"lb AS (SELECT o_custkey AS patch, list_sort(list(DISTINCT ({CLASS_SQL})[1 + (o_orderkey + o_custkey) % 19])) AS labels FROM orders GROUP BY o_custkey)"


def labels(v):
    names = F.array(*[F.lit(c) for c in C.LANDCOVER_CLASSES])
    name = F.get(names, ((col("o_orderkey") + col("o_custkey")) % 19).cast("int"))
    return v.orders.groupBy(col("o_custkey").alias("patch")).agg(F.array_sort(F.collect_set(name)).alias("labels"))


def order_sql(items, seed, key):
    return f"list_transform(list_sort(list_transform({items}, lambda x: sha256(concat_ws('|', '{seed}', {key}, x)) || x)), lambda t: substr(t, 65))"


@query(
    "QG01_qa_multilabel",
    ctes(
        LABELS,
        f"p AS (SELECT patch, labels, {order_sql('labels', 'pos', 'patch')} AS pos, {order_sql(f'list_filter({CLASS_SQL}, lambda y: NOT list_contains(labels, y))', 'neg', 'patch')} AS n0 FROM lb)",
        "q AS (SELECT *, n0[1:len(pos)] AS neg FROM p)",
        """r AS (SELECT patch, [""" + ", ".join(f"CASE WHEN pos[{i}] IS NOT NULL THEN 'presence~Is ' || lower(pos[{i}]) || ' present in this image?~yes' END" for i in range(1, 20)) + ", "
        + ", ".join(f"CASE WHEN neg[{i}] IS NOT NULL THEN 'presence~Is ' || lower(neg[{i}]) || ' present in this image?~no' END" for i in range(1, 20))
        + """, CASE WHEN len(pos) >= 2 THEN 'co_occurrence~Do both ' || lower(pos[1]) || ' and ' || lower(pos[2]) || ' appear in this image?~yes' END,
CASE WHEN len(neg) >= 1 THEN 'co_occurrence~Do both ' || lower(labels[1]) || ' and ' || lower(neg[1]) || ' appear in this image?~no' END,
'class_count~How many distinct land-cover classes are present in this image?~' || len(labels)] AS rows FROM q)""",
        "u AS (SELECT patch, unnest(list_filter(rows, lambda x: x IS NOT NULL)) AS row FROM r)",
    )
    + "SELECT patch, split_part(row, '~', 1) AS task, split_part(row, '~', 2) AS question, split_part(row, '~', 3) AS answer FROM u",
)
def qg01(v):
    return Q.multilabel_rows(labels(v), "patch", "labels", C.LANDCOVER_CLASSES).select("patch", "task", "question", "answer")


OBJ = "ob AS (SELECT ref_id, line_no, CASE (ref_id + line_no) % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'tank' ELSE 'aircraft' END AS kind, px1, py1, px1 + (ref_id * line_no) % 23 AS qx2, py1 + (ref_id + line_no * 5) % 19 AS qy2 FROM boxes)"


@query(
    "QG02_qa_boxes",
    ctes(
        "boxes", OBJ,
        "t AS (SELECT *, greatest(qx2 - px1, qy2 - py1) >= 12 AS legible, sha256(concat_ws('|', 'refer', ref_id, line_no)) AS o FROM ob)",
        "n AS (SELECT ref_id, count(*) FILTER (legible) AS n FROM t GROUP BY ref_id)",
        "b AS (SELECT * FROM t WHERE legible QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY o, line_no) = 1)",
        "s AS (SELECT *, concat('[', concat_ws(', ', CAST(round_even(least(px1 / 140, 1.0) * 1000, 0) AS INT), CAST(round_even(least(py1 / 120, 1.0) * 1000, 0) AS INT), CAST(round_even(least(qx2 / 140, 1.0) * 1000, 0) AS INT), CAST(round_even(least(qy2 / 120, 1.0) * 1000, 0) AS INT)), ']') AS box FROM b)",
    )
    + """SELECT ref_id, 'refer_box' AS task, 'Find the ' || kind || ' in this image and provide its bounding box.' AS question, 'There is an ' || kind || ' located at ' || box || '.' AS answer, 'refer_box|' || kind AS balance_key FROM s
UNION ALL SELECT n.ref_id, 'count', 'How many ' || coalesce(kind, 'aircraft') || 's are visible in the image?', CAST(n AS VARCHAR), concat_ws('|', 'count', coalesce(kind, 'aircraft'), CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '11-30' END) FROM n LEFT JOIN s USING (ref_id)""",
)
def qg02(v):
    kind = F.expr("CASE (ref_id + line_no) % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'tank' ELSE 'aircraft' END")
    boxes = v.boxes.select(
        "ref_id", col("line_no").alias("obj"), kind.alias("kind"), col("px1").alias("xmin"), col("py1").alias("ymin"),
        (col("px1") + (col("ref_id") * col("line_no")) % 23).alias("xmax"), (col("py1") + (col("ref_id") + col("line_no") * 5) % 19).alias("ymax"),
    )
    return Q.box_rows(boxes, "ref_id", 140, 120, "refer").select("ref_id", "task", "question", "answer", "balance_key")


@query(
    "QG03_qa_polygons",
    ctes("boxes", WKT, RINGS, f"s AS (SELECT ref_id, count(*) FILTER (len(ring) >= 3) AS n, coalesce(sum(CASE WHEN len(ring) >= 3 THEN {AREA_SQL} END), 0.0) * 4.0 AS a FROM rings GROUP BY ref_id)")
    + """SELECT ref_id, 'count' AS task, 'How many buildings are visible in this image?' AS question, CAST(n AS VARCHAR) AS answer FROM s
UNION ALL SELECT ref_id, 'presence', 'Are there any buildings in this image?', CASE WHEN n > 0 THEN 'yes' ELSE 'no' END FROM s
UNION ALL SELECT ref_id, 'area', 'What is the total building footprint area in this image, in square metres?', CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', round_even(a, 1)) END || ' m2' FROM s WHERE n > 0""",
)
def qg03(v):
    shapes = rings(v).select("ref_id", F.size("ring").alias("points"), B.ring_area(col("ring")).alias("area_px"))
    return Q.polygon_rows(shapes, "ref_id", 2.0).select("ref_id", "task", "question", "answer")


NAMES = ("Other", "Vegetation", "Water", "Builtup", "Snow")


@query(
    "QG04_qa_segmask",
    ctes(
        "classes",
        f"f AS (SELECT {KEYS}, (['Other', 'Vegetation', 'Water', 'Builtup'])[1 + class_id] AS name, count(*) / sum(count(*)) OVER (PARTITION BY {KEYS}) AS share FROM classes GROUP BY {KEYS}, class_id)",
        f"k AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY share DESC, name) AS k FROM f)",
        f"s AS (SELECT {KEYS}, max(CASE WHEN k = 1 THEN name END) AS n1, max(CASE WHEN k = 2 AND share >= 0.01 THEN name END) AS n2, max(CASE WHEN k = 1 THEN share END) AS s1, max(CASE WHEN k = 2 THEN share END) AS s2, count(*) FILTER (share >= 0.01) AS c, list(name) FILTER (share >= 0.01) AS names FROM k GROUP BY {KEYS})",
        f"a AS (SELECT *, {order_sql('list_filter([' + ', '.join(repr(n) for n in NAMES) + '], lambda y: NOT list_contains(names, y))', 'p4', 'scene_id, date_idx')}[1] AS absent FROM s)",
    )
    + " UNION ALL ".join([
        f"SELECT {KEYS}, 'dominant_class' AS task, 'Which land-cover class covers the largest area in this image?' AS question, n1 AS answer FROM a",
        *[f"SELECT {KEYS}, 'coverage', 'How much of this image is covered by ' || lower(n{i}) || '?', CASE WHEN s{i} < 0.01 THEN 'none' WHEN s{i} < 0.1 THEN 'a small part' WHEN s{i} < 0.35 THEN 'some' WHEN s{i} < 0.65 THEN 'about half' WHEN s{i} < 0.9 THEN 'most' ELSE 'nearly all' END FROM a WHERE n{i} IS NOT NULL" for i in (1, 2)],
        f"SELECT {KEYS}, 'presence', 'Is ' || lower(absent) || ' present in this image?', 'no' FROM a WHERE absent IS NOT NULL",
        f"SELECT {KEYS}, 'presence', 'Is ' || lower(n1) || ' present in this image?', 'yes' FROM a",
        f"SELECT {KEYS}, 'class_count', 'How many distinct land-cover classes are present in this image?', CAST(c AS VARCHAR) FROM a",
    ]),
)
def qg04(v):
    from pyspark.sql import Window as W

    counts = v.classes.groupBy(*SCENE, "class_id").agg(F.count("*").alias("n"))
    share = col("n") / F.sum("n").over(W.partitionBy(*SCENE))
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), col("class_id"))
    fractions = counts.select(*SCENE, name.alias("name"), share.alias("fraction"))
    return Q.segmask_rows(fractions, SCENE, NAMES).select(*SCENE, "task", "question", "answer")


DELTAS = """dl AS (SELECT aoi, period, count(*) FILTER (status = 'a') AS added, count(*) FILTER (status = 'd') AS removed, count(*) FILTER (status = 'p') AS persisted FROM (
SELECT coalesce(b.aoi, a.aoi) AS aoi, coalesce(b.period + 1, a.period) AS period, CASE WHEN b.obj_id IS NULL THEN 'a' WHEN a.obj_id IS NULL THEN 'd' ELSE 'p' END AS status FROM obj b FULL OUTER JOIN obj a ON a.aoi = b.aoi AND a.period = b.period + 1 AND a.obj_id = b.obj_id) t GROUP BY aoi, period),
dx AS (SELECT aoi, period, CASE WHEN period % 5 <> 4 THEN added END AS added, CASE WHEN period % 5 <> 4 THEN removed END AS removed, CASE WHEN period % 2 = 0 THEN persisted END AS persisted, CASE WHEN period % 3 = 0 THEN (added - removed % 2) * 12.5 END AS area_m2 FROM dl)"""


@query(
    "QG05_qa_change_delta",
    ctes("obj", DELTAS)
    + " UNION ALL ".join([
        "SELECT aoi, period, 'change_presence' AS task, 'Did the number of buildings change between the first and second image?' AS question, CASE WHEN added + removed > 0 THEN 'yes' ELSE 'no' END AS answer FROM dx WHERE added IS NOT NULL",
        "SELECT aoi, period, 'change_count', 'How many buildings were added between the first and second image?', CAST(added AS VARCHAR) FROM dx WHERE added IS NOT NULL",
        "SELECT aoi, period, 'change_count', 'How many buildings were removed between the first and second image?', CAST(removed AS VARCHAR) FROM dx WHERE added IS NOT NULL",
        "SELECT aoi, period, 'change_direction', 'Were more buildings built or demolished between the two images?', CASE WHEN added > removed THEN 'built' WHEN removed > added THEN 'demolished' ELSE 'neither' END FROM dx WHERE added IS NOT NULL",
        "SELECT aoi, period, 'change_count', 'How many buildings are present in both images?', CAST(persisted AS VARCHAR) FROM dx WHERE added IS NOT NULL AND persisted IS NOT NULL",
        "SELECT aoi, period, 'change_presence', 'Did any part of this area change between the two images?', CASE WHEN area_m2 > 0 THEN 'yes' ELSE 'no' END FROM dx WHERE area_m2 IS NOT NULL",
        "SELECT aoi, period, 'change_area', 'What area changed between the two images, in square metres?', CASE WHEN area_m2 = floor(area_m2) THEN CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', round_even(area_m2, 1)) END || ' m2' FROM dx WHERE area_m2 > 0",
    ]),
)
def qg05(v):
    before = v.obj.select("aoi", (col("period") + 1).alias("period"), "obj_id")
    status = CH.id_set_diff(before, v.obj.select("aoi", "period", "obj_id"), ["aoi", "period", "obj_id"])
    n = lambda s: F.sum((col("status") == s).cast("long"))
    d = status.groupBy("aoi", "period").agg(n("appeared").alias("added"), n("demolished").alias("removed"), n("persisted").alias("persisted"))
    area = F.when(col("period") % 3 == 0, (col("added") - col("removed") % 2) * 12.5)
    some = col("period") % 5 != 4
    d = d.select("aoi", "period", F.when(some, col("added")).alias("added"), F.when(some, col("removed")).alias("removed"), F.when(col("period") % 2 == 0, col("persisted")).alias("persisted"), area.alias("area_m2"))
    return Q.delta_rows(d, ["aoi", "period"]).select("aoi", "period", "task", "question", "answer")


@query(
    "QG06_qa_crossmodal_arms",
    ctes("qa", "a AS (SELECT unnest(['optical', 'sar', 'fused']) AS arm)")
    + "SELECT sample_id, arm, concat(question_type, '_', arm) AS question_type, CASE WHEN arm = 'fused' THEN 'crossmodal_vqa' ELSE 'single_vqa' END AS task, CASE arm WHEN 'optical' THEN concat('s2_', image_id) WHEN 'sar' THEN concat('s1_', image_id) ELSE concat('s2_', image_id, ',s1_', image_id) END AS images, answer FROM qa, a",
)
def qg06(v):
    rows = v.qa.withColumn("optical", F.concat(F.lit("s2_"), "image_id")).withColumn("sar", F.concat(F.lit("s1_"), "image_id"))
    return Q.crossmodal_arms(rows).select("sample_id", "arm", "question_type", "task", F.array_join("images", ",").alias("images"), "answer")


@query(
    "QG07_qa_passthrough",
    "SELECT concat(u.conv_id, '_qa_', CAST(u.turn AS VARCHAR)) AS sample_id, u.text AS question, a.text AS answer, 'vqa' AS task FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'",
)
def qg07(v):
    # Turn and reply meet by key, so a long conversation is never gathered into one row.
    asked = v.conversations.where("role = 'user'").select("conv_id", "turn", col("text").alias("question"))
    told = v.conversations.where("role = 'assistant'").select("conv_id", (col("turn") - 1).alias("turn"), col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"]).select(
        F.concat(col("conv_id"), F.lit("_qa_"), col("turn").cast("string")).alias("sample_id"), "question", "answer", F.lit("vqa").alias("task")
    )


ND = lambda a, b: f"({a} - {b}) / ({a} + {b} + 1e-6)"
TILE_DELTA = "td AS (SELECT scene_id, " + ", ".join(
    f"round(avg({ND(a, b)}) FILTER (date_idx = 1) - avg({ND(a, b)}) FILTER (date_idx = 0), 4) AS {n}" for n, a, b in (("ndvi", "nir", "red"), ("ndwi", "green", "nir"), ("ndbi", "swir", "nir"))
) + " FROM px GROUP BY scene_id)"


@query(
    "QG09_qa_index_delta",
    ctes(
        "px", TILE_DELTA,
        "l AS (SELECT scene_id, 'ndvi' AS index, 'vegetation cover' AS noun, ndvi AS raw FROM td UNION ALL SELECT scene_id, 'ndwi', 'surface water', ndwi FROM td UNION ALL SELECT scene_id, 'ndbi', 'built-up surface', ndbi FROM td)",
        "o AS (SELECT *, 't0t1' AS ordering, raw AS delta FROM l UNION ALL SELECT *, 't1t0', -raw FROM l)",
    )
    + """SELECT scene_id, index, ordering, 'index_direction' AS task, 'Between the first and second image, did ' || noun || ' increase, decrease, or stay unchanged?' AS question, CASE WHEN abs(delta) <= 0.05 THEN 'unchanged' WHEN delta > 0 THEN 'increased' ELSE 'decreased' END AS answer FROM o WHERE abs(delta) >= 0.1 OR abs(delta) <= 0.05
UNION ALL SELECT scene_id, index, ordering, 'index_presence', 'Is there a noticeable change in ' || noun || ' between the first and second image?', CASE WHEN abs(delta) <= 0.05 THEN 'no' ELSE 'yes' END FROM o WHERE abs(delta) >= 0.1 OR abs(delta) <= 0.05
UNION ALL SELECT scene_id, index, ordering, 'index_compare', 'Which image shows more ' || noun || ', the first or the second?', CASE WHEN delta > 0 THEN 'second' ELSE 'first' END FROM o WHERE abs(delta) >= 0.1""",
)
def qg09(v):
    index = {"ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "ndbi": ("swir", "nir")}
    nd = lambda a, b: (col(a) - col(b)) / (col(a) + col(b) + F.lit(1e-6))
    at = lambda d, n: F.avg(F.when(col("date_idx") == d, nd(*index[n])))
    tiles = v.px.groupBy("scene_id").agg(*[F.round(at(1, n) - at(0, n), 4).alias(f"{n}_delta") for n in index])
    return Q.index_delta_rows(tiles, "scene_id").select("scene_id", "index", "ordering", "task", "question", "answer")


GB = "gb AS (SELECT ref_id, line_no AS obj, px1 AS x, py1 AS y, 6.0 + ref_id * line_no % 20 AS w, 5.0 + (ref_id + line_no) % 17 AS h, (['civil', 'military', 'cargo', 'light'])[1 + (ref_id + line_no * 3) % 4] AS role, (ref_id * line_no) % 11 = 5 AS truncated FROM boxes)"
W_, H_ = 97, 89


def ground_boxes(v):
    role = F.get(F.array(*[F.lit(r) for r in ("civil", "military", "cargo", "light")]), ((col("ref_id") + col("line_no") * 3) % 4).cast("int"))
    return v.boxes.select(
        "ref_id", col("line_no").alias("obj"), col("px1").alias("x"), col("py1").alias("y"), (6.0 + col("ref_id") * col("line_no") % 20).alias("w"),
        (5.0 + (col("ref_id") + col("line_no")) % 17).alias("h"), role.alias("role"), ((col("ref_id") * col("line_no")) % 11 == 5).alias("truncated"),
    )


FORMS_SQL = "[" + ", ".join("'" + f + "'" for f in Q.REFERENCE_FORMS) + "]"
FORM = lambda phrase: f"replace(({FORMS_SQL})[1 + CAST('0x' || substr(sha256(concat_ws('|', 'ground', concat_ws('|', CAST(ref_id AS VARCHAR), detail))), 1, 8) AS BIGINT) % 6], '{{p}}', {phrase})"


def box_sql(x1, y1, x2, y2):
    from swathline.plans.box_queries import widen_sql

    cl = lambda e: f"least(greatest({e}, 0.0), 1.0)"
    a, c = widen_sql(cl(x1), cl(x2))
    b, d = widen_sql(cl(y1), cl(y2))
    return f"format('[{{:.2f}} {{:.2f}}, {{:.2f}} {{:.2f}}]', {a}, {b}, {c}, {d})"


@query(
    "QG10_qa_grounding",
    ctes(
        "boxes", GB,
        f"us AS (SELECT *, concat(CASE WHEN (y + h / 2) / {H_} < 0.5 THEN 'top' ELSE 'bottom' END, ' ', CASE WHEN (x + w / 2) / {W_} < 0.5 THEN 'left' ELSE 'right' END) AS quadrant, {box_sql(f'x / {W_}', f'y / {H_}', f'(x + w) / {W_}', f'(y + h) / {H_}')} AS box FROM gb WHERE NOT truncated AND NOT (x <= 1 OR y <= 1 OR x + w >= {W_ - 1} OR y + h >= {H_ - 1}))",
        "ur AS (SELECT ref_id, role AS detail, max(box) AS answer FROM us GROUP BY ref_id, role HAVING count(*) = 1)",
        "uq AS (SELECT ref_id, quadrant AS detail, max(box) AS answer FROM us GROUP BY ref_id, quadrant HAVING count(*) = 1)",
        "pt AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY sha256(concat_ws('|', 'ground', ref_id, obj))) = 1)",
    )
    + f"SELECT ref_id, 'ground_reference' AS task, {FORM('detail || ' + chr(39) + ' aircraft' + chr(39))} AS question, answer, detail FROM ur UNION ALL SELECT ref_id, 'ground_reference', {FORM(chr(39) + 'aircraft at the ' + chr(39) + ' || detail || ' + chr(39) + ' of the image' + chr(39))}, answer, detail FROM uq "
    + f"UNION ALL SELECT ref_id, 'ground_point', format('Create a bounding box enclosing the object located at <point>({{:.2f}}, {{:.2f}})</point> in the image.', round_even((x + w / 2) / {W_}, 2), round_even((y + h / 2) / {H_}, 2)), box, role FROM pt",
)
def qg10(v):
    return Q.grounding_rows(ground_boxes(v), "ref_id", W_, H_, "ground")


ROLES = ("civil", "military", "cargo", "light", "drone")


@query(
    "QG10_presence_pairs",
    ctes(
        "boxes", GB, "fr AS (SELECT ref_id, list_sort(list(DISTINCT role)) AS present FROM gb GROUP BY ref_id)",
        f"pk AS (SELECT ref_id, {order_sql('present', 'pres:yes', 'ref_id')}[1] AS y, {order_sql('list_filter([' + ', '.join(repr(r) for r in ROLES) + '], lambda q: NOT list_contains(present, q))', 'pres:no', 'ref_id')}[1] AS n FROM fr)",
    )
    + "SELECT ref_id, 'Is there a ' || y || ' in this image?' AS question, 'yes' AS answer FROM pk WHERE y IS NOT NULL UNION ALL SELECT ref_id, 'Is there a ' || n || ' in this image?', 'no' FROM pk WHERE n IS NOT NULL",
)
def qg10_presence(v):
    return Q.presence_pairs(ground_boxes(v), "ref_id", ROLES, "pres").select("ref_id", "question", "answer")


RADAR_SQL = "['Inland waters', 'Marine waters', 'Urban fabric', 'Industrial or commercial units']"
FOREST_SQL = "['Broad-leaved forest', 'Coniferous forest', 'Mixed forest']"


@query(
    "QG11_qa_optsar",
    ctes(
        LABELS,
        f"fo AS (SELECT patch, list_has_any(labels, {FOREST_SQL}) AS forest FROM lb)",
        "fk AS (SELECT patch, forest, row_number() OVER (PARTITION BY forest ORDER BY sha256(concat_ws('|', 'forest', patch)), patch) AS k FROM fo)",
        "pool AS (SELECT patch FROM fk WHERE NOT forest OR k <= (SELECT count(*) FROM fo WHERE NOT forest))",
        f"pk AS (SELECT patch, labels, {order_sql(f'list_filter(labels, lambda q: NOT list_contains({RADAR_SQL}, q))', 'present', 'patch')}[1] AS y, {order_sql(f'list_filter({CLASS_SQL}, lambda q: NOT list_contains(labels, q) AND NOT list_contains({RADAR_SQL}, q))', 'absent', 'patch')}[1] AS n, {order_sql(f'list_filter(labels, lambda q: list_contains({RADAR_SQL}, q))', 'radar_yes', 'patch')}[1] AS ry, {order_sql(f'list_filter({RADAR_SQL}, lambda q: NOT list_contains(labels, q))', 'radar_no', 'patch')}[1] AS rn FROM lb)",
        "arms AS (SELECT unnest(['optical', 'sar', 'fused']) AS arm)",
    )
    + " UNION ALL ".join([
        "SELECT patch, 'Is there ' || lower(y) || ' in this image?' AS question, 'yes' AS answer, 'optical' AS arm, 'landcover_presence_optical' AS question_type FROM pk WHERE y IS NOT NULL",
        "SELECT patch, 'Is there ' || lower(n) || ' in this image?', 'no', 'optical', 'landcover_presence_optical' FROM pk WHERE n IS NOT NULL",
        "SELECT patch, 'Is there ' || lower(ry) || ' in this image?', 'yes', arm, 'landcover_presence_' || arm FROM pk, arms WHERE ry IS NOT NULL AND rn IS NOT NULL",
        "SELECT patch, 'Is there ' || lower(rn) || ' in this image?', 'no', arm, 'landcover_presence_' || arm FROM pk, arms WHERE ry IS NOT NULL AND rn IS NOT NULL",
        "SELECT patch, 'Is there forest in this image?', CASE WHEN forest THEN 'yes' ELSE 'no' END, arm, 'landcover_forest_' || arm FROM fo JOIN pool USING (patch), arms",
    ]),
)
def qg11(v):
    patches = labels(v)
    forest = F.arrays_overlap("labels", F.array(*[F.lit(c) for c in C.FOREST_CLASSES]))
    flagged = patches.select("patch", forest.alias("forest"))
    # Every forest-free patch, and as many forest-bearing ones.
    pool = SM.positive_negative_ratio(flagged, ~col("forest"), 1.0, "forest", "patch")
    return Q.optsar_rows(patches, "patch", "labels", C.LANDCOVER_CLASSES, pool).select("patch", "question", "answer", "arm", "question_type")


INV = f"""iv AS (SELECT ref_id, role AS phrase, concat(CASE WHEN (y + h / 2) / {H_} < 0.5 THEN 'top' ELSE 'bottom' END, ' ', CASE WHEN (x + w / 2) / {W_} < 0.5 THEN 'left' ELSE 'right' END) AS cell, count(*) AS n, sum(w * h) AS area FROM gb GROUP BY ALL),
inv AS (SELECT ref_id, phrase, CAST(sum(n) AS BIGINT) AS count, CASE WHEN sum(area) / {W_ * H_}.0 / sum(n) >= 0.02 THEN 'large' ELSE 'small' END AS size, first(cell ORDER BY n DESC, cell) AS cell, string_agg(concat(cell, '=', n), ';' ORDER BY concat(cell, '=', n)) AS cells FROM iv GROUP BY ref_id, phrase)"""


def inventory(v):
    return Q.caption_inventory(ground_boxes(v).withColumnRenamed("role", "phrase"), "ref_id", W_, H_)


@query("QG12_caption_inventory", ctes("boxes", GB, INV) + "SELECT ref_id, phrase, count, size, cell, cells FROM inv")
def qg12(v):
    return inventory(v)


@query(
    "QG13_caption_render",
    ctes(
        "boxes", GB, INV,
        "cl AS (SELECT ref_id, phrase, count, CASE WHEN count > 1 THEN concat((['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'])[1 + count], ' ', size, ' ', phrase, 's') ELSE concat('a ', size, ' ', phrase) END || ' at the ' || cell AS clause FROM inv)",
    )
    + "SELECT ref_id, concat((['This aerial image shows', 'The satellite scene contains', 'In this overhead view there is'])[1 + CAST('0x' || substr(sha256(concat_ws('|', 'caption', ref_id)), 1, 8) AS BIGINT) % 3], ' ', string_agg(clause, ', ' ORDER BY count DESC, phrase), '.') AS caption FROM cl GROUP BY ref_id",
)
def qg13(v):
    return Q.caption_render(inventory(v), "ref_id", "caption")


NOUNS = ("commercial buildings", "buildings", "roads", "water")
FACT_ROWS = "fr AS (SELECT o_custkey AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'count' WHEN o_orderkey % 3 = 1 THEN 'presence' ELSE 'area' END AS question_type, CASE o_orderkey % 5 WHEN 0 THEN 'How many buildings are there?' WHEN 1 THEN 'Are there commercial buildings?' WHEN 2 THEN 'Is a Water area present?' WHEN 3 THEN 'roads visible?' ELSE 'What time is it?' END AS question, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 17 AS STRING) WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS answer FROM orders)"


@query(
    "QG14_facts_from_qa",
    "WITH " + FACT_ROWS
    + ", n AS (SELECT image, question_type, lower(trim(answer)) AS a, CASE WHEN contains(lower(question), 'commercial buildings') THEN 'commercial building' WHEN contains(lower(question), 'buildings') THEN 'building' WHEN contains(lower(question), 'roads') THEN 'road' WHEN contains(lower(question), 'water') THEN 'water' END AS noun FROM fr), g AS (SELECT image, noun, bool_or(question_type = 'presence' AND a = 'yes') AS present, max(CASE WHEN question_type = 'count' AND TRY_CAST(a AS BIGINT) > 0 THEN TRY_CAST(a AS BIGINT) END) AS count FROM n WHERE noun IS NOT NULL GROUP BY image, noun) SELECT * FROM g WHERE present OR count IS NOT NULL",
)
def qg14(v):
    return Q.facts_from_qa(v.sql(FACT_ROWS[len("fr AS ("):-1]), "image", NOUNS)


@query("QG15_attribute_list", ctes("boxes", GB) + "SELECT ref_id, array_to_string(list_sort(list(DISTINCT role)), ', ') AS answer FROM gb GROUP BY ref_id HAVING count(DISTINCT role) >= 2")
def qg15(v):
    return Q.attribute_list(ground_boxes(v), "ref_id", "role")


ASKED = """ask AS (SELECT o_orderkey AS sample_id, o_custkey, CASE o_orderkey % 9 WHEN 0 THEN 'Create a bounding box enclosing it' WHEN 1 THEN 'Where can the <ref>lake</ref> be found?' WHEN 2 THEN 'Is there water?' WHEN 3 THEN 'Describe the image.' WHEN 4 THEN 'Which country? a) x b) y' WHEN 5 THEN 'Which season? a) x b) y'
WHEN 6 THEN 'Which class? a) x b) y' WHEN 7 THEN 'What climate zone? a) x' ELSE 'How large?' END AS question, CASE o_orderkey % 9 WHEN 2 THEN 'Yes ' WHEN 3 THEN 'one two three four five six seven eight nine ten eleven twelve thirteen' WHEN 4 THEN 'b' WHEN 5 THEN 'A' WHEN 6 THEN ' c ' WHEN 7 THEN 'd' ELSE 'about ten' END AS answer FROM orders)"""


@query(
    "QG16_classify_question",
    "WITH " + ASKED
    + """ SELECT sample_id, CASE WHEN sample_id % 9 IN (0, 1, 3) THEN 'rs_ground_caption' ELSE 'rs_vqa' END AS adapter, CASE WHEN sample_id % 9 IN (0, 1) THEN 'single_grounding' WHEN sample_id % 9 = 3 THEN 'single_caption' ELSE 'single_vqa' END AS task,
CASE WHEN contains(lower(question), 'bounding box') THEN 'bbox' WHEN contains(question, '<ref>') THEN 'referring' WHEN lower(trim(answer)) IN ('yes', 'no') THEN 'presence' WHEN len(string_split(answer, ' ')) > 12 THEN 'caption' WHEN regexp_matches(trim(answer), '^[a-dA-D]$') THEN CASE WHEN contains(lower(question), 'country') THEN 'mcq_country' WHEN contains(lower(question), 'season') THEN 'mcq_season' WHEN contains(lower(question), 'climate') THEN 'mcq_climate' ELSE 'mcq' END ELSE 'other' END AS question_type FROM ask""",
)
def qg16(v):
    adapter, task, kind = Q.classify_question(col("question"), col("answer"))
    return v.sql(ASKED[len("ask AS ("):-1]).select("sample_id", adapter.alias("adapter"), task.alias("task"), kind.alias("question_type"))


@query(
    "QG17_group_qa_by_patch",
    ctes("patch", ASKED, "g AS (SELECT p.c_custkey, string_split(patch_id, '_') AS s, patch_id, count(sample_id) AS n, sum(sample_id) AS ids FROM patch p LEFT JOIN ask ON o_custkey = c_custkey GROUP BY ALL)")
    + "SELECT c_custkey, patch_id, s[6] AS tile, s[3] AS sensing, s[5] AS orbit, n AS questions, CAST(coalesce(ids, 0) AS BIGINT) AS id_sum FROM g",
)
def qg17(v):
    from swathline.functions.headers import parse_patch_id

    asked = v.sql(ASKED[len("ask AS ("):-1]).select(col("o_custkey").alias("c_custkey"), F.struct("sample_id", "question", "answer").alias("qa"))
    nested = JO.nest_in_parts(asked.withColumn("sid", col("qa.sample_id")), ["c_custkey"], RK.seeded("nest", "sid"), "sid", col("qa"))
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["sample_id"])
    sums = nested.groupBy("c_custkey").agg(F.sum(F.size("items").cast("long")).alias("n"), F.sum(ids).alias("s"))
    p = parse_patch_id(col("patch_id"))
    return v.patch.join(sums, "c_custkey", "left").select(
        "c_custkey", "patch_id", p["tile"].alias("tile"), p["sensing"].alias("sensing"), p["orbit"].alias("orbit"),
        F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce("s", F.lit(0)).alias("id_sum"),
    )


@query(
    "QG18_routing_cases",
    """WITH t AS (SELECT unnest(['What {slot} covers this image?', 'Locate the {slot}.', 'How did the {slot} change?']) AS template, unnest(['vqa', 'grounding', 'temporal']) AS task),
s AS (SELECT p_partkey, p_type AS slot FROM part), c AS (SELECT p_partkey, task, replace(template, '{slot}', lower(slot)) AS query_text, CASE WHEN task = 'temporal' THEN 2 ELSE 1 END AS images FROM s, t),
k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256(concat_ws('|', 'route', task, p_partkey)), p_partkey) AS k FROM c)
SELECT p_partkey, task, query_text, images FROM k WHERE k <= 100""",
)
def qg18(v):
    templates = F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("task"), F.lit(n).alias("images")) for a, b, n in (
        ("What {slot} covers this image?", "vqa", 1), ("Locate the {slot}.", "grounding", 1), ("How did the {slot} change?", "temporal", 2))])
    cases = v.part.select("p_partkey", F.explode(templates).alias("t"), F.lower("p_type").alias("slot")).select(
        "p_partkey", "t.task", F.replace(col("t.template"), F.lit("{slot}"), col("slot")).alias("query_text"), "t.images"
    )
    return SM.take_n(cases, ["task"], 100, "route", "p_partkey").select("p_partkey", "task", "query_text", "images")


@query(
    "QG19_scale_prefix",
    "WITH g AS (SELECT o_orderkey AS sample_id, CASE o_orderkey % 4 WHEN 0 THEN [10.0, 10.0] WHEN 1 THEN [0.5, 10.0] WHEN 2 THEN [0.0] ELSE [2.5] END AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'RSVQA-HR x' WHEN o_orderkey % 3 = 1 THEN 'RSVQA-LR' ELSE 'BEN' END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'Is a SMALL house there?' ELSE 'largest region?' END AS question, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 200 + o_custkey % 300 END AS w FROM orders),"
    + " f AS (SELECT sample_id, source, question, w, list_filter(v, lambda x: x > 0) AS v FROM g)"
    + """ SELECT sample_id, CASE WHEN len(v) = 0 THEN '' ELSE concat('[', concat_ws('; ', CASE WHEN len(list_distinct(v)) = 1 THEN concat('ground sample distance: ', regexp_replace(CAST(v[1] AS VARCHAR), '\\.0$', ''), ' m') ELSE concat('ground sample distance per view: ', array_to_string(list_transform(v, lambda x: concat(regexp_replace(CAST(x AS VARCHAR), '\\.0$', ''), ' m')), ', ')) END,
CASE WHEN w > 0 THEN concat('scene ', regexp_replace(CAST(w * v[1] AS VARCHAR), '\\.0$', ''), ' x ', regexp_replace(CAST(256 * v[1] AS VARCHAR), '\\.0$', ''), ' m, ', format('{:,}', CAST(round_even(w * v[1] * (256 * v[1]), 0) AS BIGINT)), ' m2') END,
CASE WHEN regexp_matches(question, '\\b(small|medium|large)\\b', 'i') THEN CASE WHEN starts_with(source, 'RSVQA-HR') THEN 'small <100 m2, medium <500 m2, large >=500 m2' WHEN starts_with(source, 'RSVQA-LR') THEN 'small <3000 m2, medium <10000 m2, large >=10000 m2' END END), '] ') END AS prefix FROM f""",
)
def qg19(v):
    k = col("o_orderkey")
    gsds = F.when(k % 4 == 0, F.array(F.lit(10.0), F.lit(10.0))).when(k % 4 == 1, F.array(F.lit(0.5), F.lit(10.0))).when(k % 4 == 2, F.array(F.lit(0.0))).otherwise(F.array(F.lit(2.5)))
    source = F.when(k % 3 == 0, "RSVQA-HR x").when(k % 3 == 1, "RSVQA-LR").otherwise("BEN")
    question = F.when(k % 5 == 0, "Is a SMALL house there?").otherwise("largest region?")
    width = F.when(k % 7 == 0, 0).otherwise(200 + col("o_custkey") % 300)
    rows = v.orders.select(k.alias("sample_id"), gsds.alias("g"), source.alias("s"), question.alias("q"), width.alias("w"))
    return rows.select("sample_id", Q.scale_prefix(col("g"), col("q"), col("s"), col("w"), F.lit(256)).alias("prefix"))
