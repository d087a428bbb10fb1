"""Boxes, rings and grounding scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import boxes as B
from swathline.operators import grounding as G
from swathline.plans.registry import query
from swathline.plans.views import ctes

col = F.col
# Boxes as pixel yxyx in a 110 x 90 frame; some corners are inverted on purpose.
PIX = "pix AS (SELECT ref_id, line_no, py1 AS y1, px1 AS x1, CASE WHEN ref_id % 13 = 4 THEN py1 - 5 ELSE py2 END AS y2, px2 AS x2 FROM boxes)"


def pixel_boxes(v):
    y2 = F.when(col("ref_id") % 13 == 4, col("py1") - 5).otherwise(col("py2"))
    return v.boxes.select("ref_id", "line_no", col("py1").alias("y1"), col("px1").alias("x1"), y2.alias("y2"), col("px2").alias("x2"))


@query(
    "RG04_box_convert",
    ctes("boxes", PIX)
    + """SELECT ref_id, line_no, CASE WHEN y1 <= y2 AND x1 <= x2 THEN least(x1 / 110, 1.0) END AS xmin, CASE WHEN y1 <= y2 AND x1 <= x2 THEN least(y2 / 90, 1.0) END AS ymax,
CASE WHEN y1 <= y2 AND x1 <= x2 THEN concat_ws(',', CAST(round_even(least(x1 / 110, 1.0) * 1000, 0) AS INT), CAST(round_even(least(y1 / 90, 1.0) * 1000, 0) AS INT), CAST(round_even(least(x2 / 110, 1.0) * 1000, 0) AS INT), CAST(round_even(least(y2 / 90, 1.0) * 1000, 0) AS INT)) END AS prompt,
y1 > y2 OR x1 > x2 AS rejected FROM pix""",
)
def rg04(v):
    made = B.from_pixels([col("y1"), col("x1"), col("y2"), col("x2")], F.lit(110), F.lit(90))
    out = pixel_boxes(v).withColumn("b", made)
    return out.select(
        "ref_id", "line_no", col("b.xmin").alias("xmin"), col("b.ymax").alias("ymax"),
        F.when(col("b").isNotNull(), F.array_join(B.to_prompt(col("b")).cast("array<string>"), ",")).alias("prompt"),
        col("b").isNull().alias("rejected"),
    )


TEXTS = """texts AS (SELECT ref_id, line_no, CASE ref_id % 4 WHEN 0 THEN concat('[', px1 / 100, ' ', py1 / 100, ', ', px2 / 100, ' ', py2 / 100, ']')
WHEN 1 THEN concat('[', px1 * 10, ' ', py1 * 10, ', ', px2 * 10, ' ', py2 * 10, ']') WHEN 2 THEN 'A caption without a box.' ELSE concat('two numbers ', px1 / 100, ' ', py1 / 100) END AS answer FROM boxes)"""


@query(
    "RG04_rescale_text",
    ctes("boxes", TEXTS, "n AS (SELECT *, list_transform(regexp_extract_all(answer, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS v FROM texts)")
    + """SELECT ref_id, line_no, CASE WHEN len(v) < 4 OR list_max(v[1:4]) > 1.0 THEN answer ELSE concat('[', CAST(round_even(v[1] * 1000, 0) AS INT), ' ', CAST(round_even(v[2] * 1000, 0) AS INT), ', ', CAST(round_even(v[3] * 1000, 0) AS INT), ' ', CAST(round_even(v[4] * 1000, 0) AS INT), ']') END AS answer FROM n""",
)
def rg04_text(v):
    texts = v.sql(TEXTS[len("texts AS ("):-1], boxes=v.boxes)
    return texts.select("ref_id", "line_no", B.rescale_text(col("answer")).alias("answer"))


def widen_sql(lo, hi):
    low, high = f"(({lo} + {hi}) / 2 - 0.01 / 2)", f"(({lo} + {hi}) / 2 + 0.01 / 2)"
    enough = f"round_even({hi}, 2) - round_even({lo}, 2) >= 0.01"
    return (
        f"CASE WHEN {enough} THEN {lo} WHEN {low} < 0 THEN 0.0 WHEN {high} > 1 THEN 1.0 - 0.01 ELSE {low} END",
        f"CASE WHEN {enough} THEN {hi} WHEN {low} < 0 THEN 0.01 WHEN {high} > 1 THEN 1.0 ELSE {high} END",
    )


THIN = "thin AS (SELECT ref_id, line_no, least(greatest(px1 / 97 - 0.02, 0.0), 1.0) AS x1, least(greatest(py1 / 89, 0.0), 1.0) AS y1, least(greatest(CASE WHEN line_no % 3 = 0 THEN px1 / 97 - 0.0163 ELSE px2 / 97 END, 0.0), 1.0) AS x2, least(greatest(py2 / 89, 0.0), 1.0) AS y2 FROM boxes)"


@query(
    "RG05_box_string",
    ctes("boxes", THIN, f"w AS (SELECT ref_id, line_no, {widen_sql('x1', 'x2')[0]} AS a, {widen_sql('y1', 'y2')[0]} AS b, {widen_sql('x1', 'x2')[1]} AS c, {widen_sql('y1', 'y2')[1]} AS d FROM thin)")
    + "SELECT ref_id, line_no, format('[{:.2f} {:.2f}, {:.2f} {:.2f}]', a, b, c, d) AS box FROM w",
)
def rg05(v):
    x1, x2 = col("px1") / 97 - 0.02, F.when(col("line_no") % 3 == 0, col("px1") / 97 - 0.0163).otherwise(col("px2") / 97)
    return v.boxes.select("ref_id", "line_no", B.box_string(x1, col("py1") / 89, x2, col("py2") / 89).alias("box"))


@query(
    "RG06_touches_edge_quadrant",
    ctes("boxes")
    + """SELECT ref_id, line_no, px1 <= 1 OR py1 <= 1 OR px2 >= 96 OR py2 >= 88 AS edge,
concat(CASE WHEN (py1 + (py2 - py1) / 2) / 89 < 0.5 THEN 'top' ELSE 'bottom' END, ' ', CASE WHEN (px1 + (px2 - px1) / 2) / 97 < 0.5 THEN 'left' ELSE 'right' END) AS quadrant FROM boxes""",
)
def rg06(v):
    args = (col("px1"), col("py1"), col("px2") - col("px1"), col("py2") - col("py1"), F.lit(97), F.lit(89))
    return v.boxes.select("ref_id", "line_no", B.touches_edge(*args).alias("edge"), B.quadrant(*args).alias("quadrant"))


IOU_SQL = """CASE WHEN (rx2 - rx1) * (ry2 - ry1) + (px2 - px1) * (py2 - py1) - greatest(least(rx2, px2) - greatest(rx1, px1), 0.0) * greatest(least(ry2, py2) - greatest(ry1, py1), 0.0) > 0
THEN greatest(least(rx2, px2) - greatest(rx1, px1), 0.0) * greatest(least(ry2, py2) - greatest(ry1, py1), 0.0) / ((rx2 - rx1) * (ry2 - ry1) + (px2 - px1) * (py2 - py1) - greatest(least(rx2, px2) - greatest(rx1, px1), 0.0) * greatest(least(ry2, py2) - greatest(ry1, py1), 0.0)) ELSE 0.0 END"""


def iou(v):
    names = lambda p: [col(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")]
    return v.boxes.withColumn("iou", B.box_iou(names("r"), names("p")))


@query("RG07_box_iou", ctes("boxes") + f"SELECT ref_id, line_no, {IOU_SQL} AS iou FROM boxes")
def rg07(v):
    return iou(v).select("ref_id", "line_no", "iou")


# Irregular pentagons; every eleventh scene is empty and some rings are degenerate.
WKT = """wkt AS (SELECT ref_id, line_no, CASE WHEN ref_id % 11 = 3 THEN 'POLYGON EMPTY' WHEN ref_id % 17 = 5 THEN concat('POLYGON ((', px1, ' ', py1, ', ', px2, ' ', py2, '))')
ELSE concat('POLYGON ((', px1, ' ', py1, ', ', px2, ' ', py1 + 3, ', ', px2 + 4, ' ', py2, ', ', px1 + 6, ' ', py2 + 7, ', ', px1 - 2, ' ', py1 + 9, '))') END AS geometry FROM boxes)"""
RINGS = "rings AS (SELECT ref_id, line_no, CASE WHEN geometry LIKE '%EMPTY%' THEN [] ELSE list_transform(string_split(replace(replace(geometry, 'POLYGON ((', ''), '))', ''), ', '), lambda s: {'x': CAST(string_split(s, ' ')[1] AS DOUBLE), 'y': CAST(string_split(s, ' ')[2] AS DOUBLE)}) END AS ring FROM wkt)"


def rings(v):
    wkt = v.sql(WKT[len("wkt AS ("):-1], boxes=v.boxes)
    return wkt.select("ref_id", "line_no", B.wkt_ring(col("geometry")).alias("ring"))


AREA_SQL = "CASE WHEN len(ring) >= 3 THEN abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y))) / 2 ELSE 0.0 END"


@query("RG08_polygon_area", ctes("boxes", WKT, RINGS) + f"SELECT ref_id, line_no, len(ring) AS points, {AREA_SQL} AS area_px FROM rings")
def rg08(v):
    return rings(v).select("ref_id", "line_no", F.size("ring").cast("long").alias("points"), B.ring_area(col("ring")).alias("area_px"))


@query(
    "RG09_polygon_to_box",
    ctes(
        "boxes", WKT, RINGS,
        "e AS (SELECT ref_id, line_no, list_min(list_transform(ring, lambda p: p.x)) AS x0, list_max(list_transform(ring, lambda p: p.x)) AS x1, list_min(list_transform(ring, lambda p: p.y)) AS y0, list_max(list_transform(ring, lambda p: p.y)) AS y1 FROM rings)",
        "p AS (SELECT ref_id, line_no, least(greatest(floor((x0 - 5.0) / 2.0), 0), 40) AS l, least(greatest(floor((x1 - 5.0) / 2.0), 0), 40) AS r, least(greatest(floor((y1 - 100.0) / -2.0), 0), 45) AS t, least(greatest(floor((y0 - 100.0) / -2.0), 0), 45) AS b FROM e)",
    )
    + "SELECT ref_id, line_no, CAST(l AS BIGINT) AS xmin, CAST(t AS BIGINT) AS ymin, CAST(r AS BIGINT) AS xmax, CAST(b AS BIGINT) AS ymax FROM p WHERE r > l AND b > t",
)
def rg09(v):
    made = B.ring_box(col("ring"), F.lit(2.0), F.lit(5.0), F.lit(-2.0), F.lit(100.0), F.lit(40), F.lit(45))
    # Boxes are generated, as a filter on a plain column would be pushed below the grouping with the text and its parsing in every term.
    out = rings(v).select("ref_id", "line_no", F.inline_outer(F.array(made))).where("xmin IS NOT NULL")
    return out.select("ref_id", "line_no", *[col(k).cast("long").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


TARGETS = "tg AS (SELECT ref_id, line_no, (px2 - px1) * (py2 - py1) * (1 + line_no * ref_id % 5 * 0.3) AS area, (ref_id + line_no * 7) % 4 AS role FROM boxes)"


def targets(v):
    area = (col("px2") - col("px1")) * (col("py2") - col("py1")) * (1 + col("line_no") * col("ref_id") % 5 * 0.3)
    return v.boxes.select("ref_id", "line_no", area.alias("area"), ((col("ref_id") + col("line_no") * 7) % 4).alias("role"))


@query(
    "RG12_superlative_target",
    ctes("boxes", TARGETS, "k AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY area DESC, line_no) AS k FROM tg)")
    + "SELECT a.ref_id, a.line_no, a.area, b.area AS runner_up FROM k a JOIN k b ON a.ref_id = b.ref_id AND a.k = 1 AND b.k = 2 AND a.area >= 1.5 * greatest(b.area, 1e-6)",
)
def rg12(v):
    return G.superlative(targets(v), ["ref_id"], "area", "line_no")


@query("RG13_unique_targets", ctes("boxes", TARGETS) + "SELECT ref_id, max(line_no) AS line_no, role FROM tg GROUP BY ref_id, role HAVING count(*) = 1")
def rg13(v):
    return G.unique_targets(targets(v), ["ref_id"], "role", "line_no").select("ref_id", "line_no", "role")


@query(
    "RG14_remap_boxes",
    ctes("boxes", "tl AS (SELECT *, ref_id % 2 * 48 AS off_x, line_no % 2 * 44 AS off_y FROM boxes)")
    + "SELECT ref_id, line_no, (px1 + off_x) / 145 AS xmin, (py1 + off_y) / 133 AS ymin, (px2 + off_x) / 145 AS xmax, (py2 + off_y) / 133 AS ymax FROM tl",
)
def rg14(v):
    crops = v.boxes.select("ref_id", "line_no", "px1", "py1", "px2", "py2", (col("ref_id") % 2 * 2 + col("line_no") % 2).alias("tile"))
    tiles = v.boxes.select(
        (col("ref_id") % 2 * 2 + col("line_no") % 2).alias("tile"), (col("ref_id") % 2 * 48).alias("off_x"), (col("line_no") % 2 * 44).alias("off_y")
    ).distinct()
    return G.remap_boxes(crops, tiles, "tile", F.lit(145), F.lit(133)).select("ref_id", "line_no", "xmin", "ymin", "xmax", "ymax")


@query(
    "TX14_reference_box",
    ctes(
        "boxes",
        "t AS (SELECT ref_id, line_no, CASE WHEN ref_id % 7 = 2 THEN '{<1><2><3>}' WHEN ref_id % 7 = 3 THEN concat('{<', CAST(px1 AS INT), '><', CAST(py1 AS INT), '><', CAST(px1 AS INT), '><', CAST(py2 AS INT), '>}') ELSE concat('{<', CAST(px2 AS INT), '><', CAST(py1 AS INT), '><', CAST(px1 AS INT), '><', CAST(py2 AS INT), '>}') END AS s FROM boxes)",
        "n AS (SELECT ref_id, line_no, s, list_transform(regexp_extract_all(s, '<(\\d+)>', 1), lambda x: CAST(x AS DOUBLE) / 100) AS v FROM t)",
        "o AS (SELECT ref_id, line_no, s, CASE WHEN len(v) = 4 AND v[1] <> v[3] AND v[2] <> v[4] THEN v END AS v FROM n)",
    )
    + "SELECT ref_id, line_no, s AS reference, least(v[1], v[3]) AS xmin, least(v[2], v[4]) AS ymin, greatest(v[1], v[3]) AS xmax, greatest(v[2], v[4]) AS ymax FROM o",
)
def tx14(v):
    i = lambda c: col(c).cast("int").cast("string")
    wrap = lambda *names: F.concat(F.lit("{<"), F.concat_ws("><", *[i(n) for n in names]), F.lit(">}"))
    text = F.when(col("ref_id") % 7 == 2, "{<1><2><3>}").when(col("ref_id") % 7 == 3, wrap("px1", "py1", "px1", "py2")).otherwise(wrap("px2", "py1", "px1", "py2"))
    out = v.boxes.select("ref_id", "line_no", text.alias("reference")).withColumn("b", B.reference_box(col("reference")))
    return out.select("ref_id", "line_no", "reference", *[col(f"b.{k}").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@query(
    "JN11_candidate_box_join",
    ctes("boxes", "r AS (SELECT DISTINCT ref_id, rx1, ry1, rx2, ry2 FROM boxes)", "p AS (SELECT ref_id, line_no, px1, py1, px2, py2, (line_no * 37 + ref_id) % 101 / 100.0 AS score FROM boxes)")
    + f"SELECT ref_id, line_no, score, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, line_no) AS rank, {IOU_SQL} AS iou FROM r JOIN p USING (ref_id)",
)
def jn11(v):
    out = G.rank_candidates(*candidates(v), "ref_id", "score", "line_no")
    return out.select("ref_id", "line_no", "score", col("rank").cast("long").alias("rank"), "iou")


def candidates(v):
    references = v.boxes.groupBy("ref_id").agg(*[F.first(c).alias(c) for c in ("rx1", "ry1", "rx2", "ry2")])
    score = ((col("line_no") * 37 + col("ref_id")) % 101) / 100
    return references, v.boxes.select("ref_id", "line_no", "px1", "py1", "px2", "py2", score.alias("score"))


@query(
    "SC03_grounding_accuracy",
    ctes(
        "boxes",
        f"x AS (SELECT ref_id, line_no, CASE WHEN (ref_id + line_no) % 9 = 0 THEN NULL ELSE {IOU_SQL} END AS iou, ref_id % 3 = 0 AS is_unique, CASE WHEN line_no <= 2 THEN 'small' ELSE 'large' END AS size_group FROM boxes)",
        "s AS (SELECT 'all' AS slice, * FROM x UNION ALL SELECT concat('unique:', CAST(is_unique AS VARCHAR)), * FROM x UNION ALL SELECT concat('size:', size_group), * FROM x)",
    )
    + """SELECT slice, count(*) AS n, round(avg(CASE WHEN coalesce(iou, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS acc_50, round(avg(CASE WHEN coalesce(iou, 0) >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS acc_70,
round(avg(coalesce(iou, 0)), 6) AS mean_iou, round(avg(CASE WHEN iou IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unparsable FROM s GROUP BY slice""",
)
def sc03(v):
    rows = iou(v).select(
        F.when((col("ref_id") + col("line_no")) % 9 != 0, col("iou")).alias("iou"),
        (col("ref_id") % 3 == 0).alias("is_unique"), F.when(col("line_no") <= 2, "small").otherwise("large").alias("size_group"),
    )
    slices = {"unique": col("is_unique").cast("string"), "size": col("size_group")}
    return G.grounding_accuracy(rows, "iou", slices)


@query(
    "SC04_recall_at_k",
    ctes(
        "boxes",
        f"k AS (SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY (line_no * 37 + ref_id) % 101 DESC, line_no) AS rank, {IOU_SQL} AS iou FROM boxes)",
        "b AS (SELECT ref_id, max(iou) FILTER (rank <= 1) AS k1, max(iou) FILTER (rank <= 3) AS k3, max(iou) FILTER (rank <= 5) AS k5, max(iou) FILTER (rank <= 10) AS k10, count(*) AS c FROM k GROUP BY ref_id)",
    )
    + """SELECT count(*) AS n, round(avg(c), 1) AS mean_candidates, round(avg(CASE WHEN k1 >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN k3 >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS recall_3,
round(avg(CASE WHEN k5 >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(avg(CASE WHEN k10 >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS recall_10, round(avg(k10), 4) AS mean_best_iou FROM b""",
)
def sc04(v):
    return G.recall_at_k(*candidates(v), "ref_id", "score", "line_no", (1, 3, 5, 10), 0.5)
