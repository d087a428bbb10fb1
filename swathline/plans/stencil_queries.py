"""Neighbourhood, region and tile operators over the pixel frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions import pixel as P
from swathline.operators import rasters as R
from swathline.operators import regions as RG
from swathline.operators import stats as S
from swathline.operators import stencil as ST
from swathline.operators import tiles as TK
from swathline.plans.box_queries import WKT, RINGS, rings
from swathline.plans.oracle_parts import gate_sql
from swathline.plans.registry import query
from swathline.plans.stats_queries import KEYS, SCENE, measure_sql, pixel_size, variant, variant_sql
from swathline.plans.views import ctes, folded

col = F.col
PKEYS = f"{KEYS}, r, c"
PIXEL = [*SCENE, "r", "c"]
FILL = f"fl AS (SELECT {PKEYS}, coalesce(nir, avg(nir) OVER (PARTITION BY {KEYS})) AS x, nir IS NOT NULL AS valid FROM grid)"


def off(k):
    return f"(SELECT CAST(unnest(range(-{k}, {k + 1})) AS BIGINT) AS dr)"


def stencil_sql(name, source, expressions, k, edge=15):
    """CTE joining every cell to its clamped neighbourhood and aggregating."""
    return f"""{name} AS (SELECT g.scene_id, g.date_idx, g.r, g.c, any_value(g.valid) AS valid, {expressions} FROM {source} g CROSS JOIN {off(k)} a CROSS JOIN (SELECT dr AS dc FROM {off(k)} q) b
JOIN {source} n ON n.scene_id = g.scene_id AND n.date_idx = g.date_idx AND n.r = least(greatest(g.r + dr, 0), {edge}) AND n.c = least(greatest(g.c + dc, 0), {edge}) GROUP BY g.scene_id, g.date_idx, g.r, g.c)"""


def frame(v, band="nir"):
    return v.grid.select(*PIXEL, band)


@query("NB01_box_mean", ctes("px", "grid", FILL, stencil_sql("bm", "fl", "avg(n.x) AS m", 4)) + f"SELECT {PKEYS}, round(m, 6) AS mean FROM bm")
def nb01(v):
    return ST.box_mean(frame(v), SCENE, "nir", 9).withColumn("mean", F.round("mean", 6))


VARIANCE = [
    stencil_sql("vr", "fl", "greatest(var_pop(n.x), 0) AS v", 4),
    f"vm AS (SELECT {KEYS}, max(v) AS peak FROM vr WHERE valid GROUP BY {KEYS})",
    f"lv AS (SELECT {PKEYS}, valid, CASE WHEN valid AND peak > 0 THEN least(v / peak, 1.0) ELSE 0.0 END AS variance FROM vr JOIN vm USING ({KEYS}))",
]


@query("NB02_local_variance", ctes("px", "grid", FILL, *VARIANCE) + f"SELECT {PKEYS}, round(variance, 6) AS variance FROM lv")
def nb02(v):
    return ST.local_variance(frame(v), SCENE, "nir", 9).select(*PIXEL, F.round("variance", 6).alias("variance"))


EDGES = [
    stencil_sql("sb", "fl", "sum(n.x * dc * (2 - abs(dr))) AS gx, sum(n.x * dr * (2 - abs(dc))) AS gy", 1),
    f"mg AS (SELECT {PKEYS}, valid, sqrt(gx * gx + gy * gy) AS x FROM sb)",
    stencil_sql("ed", "mg", "avg(n.x) AS d", 4),
    f"ep AS (SELECT {KEYS}, quantile_cont(d, 0.99) AS peak FROM ed WHERE valid GROUP BY {KEYS})",
    f"de AS (SELECT {PKEYS}, valid, CASE WHEN valid AND peak > 0 THEN least(d / peak, 1.0) ELSE 0.0 END AS edges FROM ed JOIN ep USING ({KEYS}))",
]


@query("NB03_edge_density", ctes("px", "grid", FILL, *EDGES) + f"SELECT {PKEYS}, round(edges, 6) AS edges FROM de")
def nb03(v):
    return ST.edge_density(frame(v), SCENE, "nir", 9).select(*PIXEL, F.round("edges", 6).alias("edges"))


RESPONSE = f"tx AS (SELECT {PKEYS}, CASE WHEN de.valid THEN least(0.6 * edges + 0.4 * variance, 1.0) END AS response FROM de JOIN lv USING ({PKEYS}))"


@query("NB04_texture_response", ctes("px", "grid", FILL, *VARIANCE, *EDGES, RESPONSE) + f"SELECT {PKEYS}, round(response, 6) AS response FROM tx")
def nb04(v):
    return ST.texture_response(frame(v), SCENE, "nir").withColumn("response", F.round("response", 6))


@query("AGG06_texture_seg_summary", ctes("px", "grid", FILL, *VARIANCE, *EDGES, RESPONSE, "tr AS (SELECT scene_id, date_idx, r, c, round(response, 9) AS response FROM tx)", gate_sql("tr", KEYS, "response", "0.35")) + measure_sql("builtup", 0.45, 0.0))
def agg06(v):
    gate = ST.texture_gate(frame(v), SCENE, "nir", C.TEXTURE_CUT)
    return S.measurement(gate, SCENE, "builtup", 0.45, 0.0, pixel_size())


@query("AGG19_measure_variant_texture", ctes("px", "grid", FILL, *VARIANCE, *EDGES, RESPONSE, "tr AS (SELECT scene_id, date_idx, r, c, round(response, 9) AS response FROM tx)", gate_sql("tr", KEYS, "response", "0.35")) + variant_sql(0.45))
def agg19_texture(v):
    return variant(ST.texture_gate(frame(v), SCENE, "nir", C.TEXTURE_CUT), 0.45)


POWER = f"pw AS (SELECT {PKEYS}, power(10.0, vv / 10) AS x, vv IS NOT NULL AS valid FROM grid)"
_DIRS = ("dr <= 0", "dr >= 0", "dc <= 0", "dc >= 0", "dr - dc <= 0", "dr - dc >= 0", "dr + dc <= 0", "dr + dc >= 0")
LEE = [
    POWER,
    stencil_sql(
        "ls", "pw",
        "any_value(g.x) AS x, avg(n.x) FILTER (abs(dr) <= 1 AND abs(dc) <= 1) AS m3, [" + ", ".join(f"{{'m': coalesce(avg(n.x) FILTER ({d}), 0), 'q': coalesce(avg(n.x * n.x) FILTER ({d}), 0)}}" for d in _DIRS) + "] AS d", 3,
    ),
    f"lr AS (SELECT {PKEYS}, valid, x, d, coalesce(m3, coalesce(x, 0)) AS ref FROM ls)",
    f"lc AS (SELECT *, list_transform(d, lambda s: round(abs(s.m - ref), 12)) AS gaps FROM lr)",
    f"lb AS (SELECT {PKEYS}, valid, x, d[list_position(gaps, list_min(gaps))] AS b FROM lc)",
    f"lg AS (SELECT {PKEYS}, valid, x, b.m AS m, greatest(b.q - b.m * b.m, 0) AS v FROM lb)",
    f"lee AS (SELECT {PKEYS}, CASE WHEN valid THEN m + (CASE WHEN v > 0 THEN least(greatest((v - m * m) / (v * 2), 0), 1) ELSE 0 END) * (x - m) END AS filtered FROM lg)",
]


def lee(v):
    power = v.grid.select(*PIXEL, F.pow(F.lit(10.0), col("vv") / 10).alias("p"))
    return ST.refined_lee(power, SCENE, "p")


@query("NB05_refined_lee", ctes("px", "grid", *LEE) + f"SELECT {PKEYS}, round(filtered, 8) AS filtered FROM lee")
def nb05(v):
    return lee(v).withColumn("filtered", F.round("filtered", 8))


GLCM = [
    f"gb AS (SELECT {KEYS}, quantile_cont(vv, 0.02) AS lo, quantile_cont(vv, 0.98) AS hi, avg(vv) AS m FROM grid GROUP BY {KEYS})",
    f"gq AS (SELECT {PKEYS}, vv IS NOT NULL AS valid, CAST(least(greatest(floor((coalesce(vv, m) - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1e-6 END) * 16), 0), 15) AS INT) AS lv FROM grid JOIN gb USING ({KEYS}))",
    "gs AS (SELECT a.scene_id, a.date_idx, a.r, a.c, a.valid, a.lv * 16 + b.lv AS x FROM gq a JOIN gq b ON b.scene_id = a.scene_id AND b.date_idx = a.date_idx AND b.r = a.r AND b.c = (a.c + 1) % 16)",
    f"""gn AS (SELECT g.scene_id, g.date_idx, g.r, g.c, g.valid, n.x, count(*) AS k FROM gs g CROSS JOIN {off(4)} a CROSS JOIN (SELECT dr AS dc FROM {off(4)} q) b
JOIN gs n ON n.scene_id = g.scene_id AND n.date_idx = g.date_idx AND n.r = least(greatest(g.r + dr, 0), 15) AND n.c = least(greatest(g.c + dc, 0), 15) GROUP BY ALL)""",
    f"ge AS (SELECT {PKEYS}, CASE WHEN bool_and(valid) THEN least(greatest(sum(-(k / 81.0) * log2(k / 81.0)) / 8.0, 0), 1) ELSE 0 END AS entropy FROM gn GROUP BY {PKEYS})",
]


@query("NB06_glcm_entropy", ctes("px", "grid", *GLCM) + f"SELECT {PKEYS}, round(entropy, 6) AS entropy FROM ge")
def nb06(v):
    return ST.glcm_entropy(v.grid, SCENE, "vv").withColumn("entropy", F.round("entropy", 6))


def opened_sql(mask):
    return [
        mask,
        "er AS (SELECT g.scene_id, g.date_idx, g.r, g.c, count(*) FILTER (n.hit) = 5 AS hit FROM mk g JOIN mk n ON n.scene_id = g.scene_id AND n.date_idx = g.date_idx AND abs(n.r - g.r) + abs(n.c - g.c) <= 1 GROUP BY g.scene_id, g.date_idx, g.r, g.c)",
        "op AS (SELECT g.scene_id, g.date_idx, g.r, g.c, bool_or(n.hit) AS hit FROM er g JOIN er n ON n.scene_id = g.scene_id AND n.date_idx = g.date_idx AND abs(n.r - g.r) + abs(n.c - g.c) <= 1 GROUP BY g.scene_id, g.date_idx, g.r, g.c)",
    ]


OPENED = opened_sql(f"mk AS (SELECT {PKEYS}, coalesce(vv <= -16, false) AS hit FROM grid)")


def dark_mask(v):
    return v.grid.select(*PIXEL, F.coalesce(col("vv") <= -16, F.lit(False)).alias("hit"), "vv")


@query("NB07_morphological_open", ctes("px", "grid", *OPENED) + f"SELECT {PKEYS}, hit FROM op")
def nb07(v):
    return ST.morphological_open(dark_mask(v), SCENE, "hit")


@query(
    "NB08_terrain_shadow",
    ctes(
        "px", "grid", f"dm AS (SELECT {PKEYS}, coalesce(nir, 900.0) / 20 AS z FROM grid)",
        f"""gr AS (SELECT {PKEYS}, z, lag(z) OVER (PARTITION BY {KEYS}, r ORDER BY c) AS w, lead(z) OVER (PARTITION BY {KEYS}, r ORDER BY c) AS e, lag(z) OVER (PARTITION BY {KEYS}, c ORDER BY r) AS n, lead(z) OVER (PARTITION BY {KEYS}, c ORDER BY r) AS s FROM dm)""",
        f"""sl AS (SELECT {PKEYS}, CASE WHEN w IS NULL THEN (e - z) / 10.0 WHEN e IS NULL THEN (z - w) / 10.0 ELSE (e - w) / 20.0 END AS dx, CASE WHEN n IS NULL THEN (s - z) / 10.0 WHEN s IS NULL THEN (z - n) / 10.0 ELSE (s - n) / 20.0 END AS dy FROM gr)""",
        f"al AS (SELECT {PKEYS}, dx * sin(radians(78.0)) - dy * cos(radians(78.0)) AS g FROM sl)",
    )
    + f"SELECT {PKEYS}, round(g, 6) AS along_look, atan(-g) > radians(90.0 - 35.0) AS shadow FROM al",
)
def nb08(v):
    dem = v.grid.select(*PIXEL, (F.coalesce("nir", F.lit(900.0)) / 20).alias("z"))
    return ST.terrain_shadow(dem, SCENE, "z", 10.0, 78.0).withColumn("along_look", F.round("along_look", 6))


@query("NB09_local_std_3x3", ctes("px", "grid", FILL, stencil_sql("sd", "fl", "stddev_pop(n.x) AS s", 1)) + f"SELECT {PKEYS}, round(s, 6) AS std FROM sd")
def nb09(v):
    return ST.local_std_3x3(frame(v), SCENE, "nir").withColumn("std", F.round("std", 6))


@query(
    "PX08_single_pol_stack",
    ctes(
        "px", "grid", *LEE, *GLCM,
        f"st AS (SELECT {PKEYS}, vv AS a, 10 * log10(filtered) AS b, CASE WHEN vv IS NOT NULL THEN entropy END AS e FROM grid JOIN lee USING ({PKEYS}) JOIN ge USING ({PKEYS}))",
        f"sb AS (SELECT {KEYS}, " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}lo, quantile_cont({c}, 0.98) AS {c}hi" for c in "abe") + f" FROM st GROUP BY {KEYS})",
    )
    + f"SELECT {PKEYS}, " + ", ".join(f"round(least(greatest(({c} - {c}lo) / (CASE WHEN {c}hi > {c}lo THEN {c}hi - {c}lo ELSE 1e-6 END), 0), 1), 5) AS {n}" for c, n in (("a", "sigma0"), ("b", "lee_db"), ("e", "entropy"))) + f" FROM st JOIN sb USING ({KEYS}) WHERE a IS NOT NULL",
)
def px08(v):
    out = ST.single_pol_stack(v.grid.select(*PIXEL, "vv"), SCENE, "vv").where("sigma0 IS NOT NULL")
    return out.select(*PIXEL, *[F.round(b, 5).alias(b) for b in ("sigma0", "lee_db", "entropy")])


# Labels by recursive flood over pixels: the smallest reachable cell number names the region.
LABELS = [
    f"hp AS (SELECT {KEYS}, r, c, r * 16777216 + c AS id, vv FROM px WHERE vv <= -16)",
    "lk AS (SELECT a.scene_id, a.date_idx, a.id AS src, b.id AS dst FROM hp a JOIN hp b ON a.scene_id = b.scene_id AND a.date_idx = b.date_idx AND abs(a.r - b.r) + abs(a.c - b.c) = 1)",
    "fd AS (SELECT scene_id, date_idx, id, id AS root FROM hp UNION SELECT f.scene_id, f.date_idx, lk.dst, f.root FROM fd f JOIN lk ON lk.scene_id = f.scene_id AND lk.date_idx = f.date_idx AND lk.src = f.id WHERE f.root < lk.dst)",
    "lab AS (SELECT scene_id, date_idx, id, min(root) AS label FROM fd GROUP BY ALL)",
    "rg AS (SELECT hp.scene_id, hp.date_idx, label, count(*) AS area_px, min(r) AS min_row, min(c) AS min_col, max(r) + 1 AS max_row, max(c) + 1 AS max_col, avg(r) AS cr, avg(c) AS cc, avg(vv) AS mr FROM hp JOIN lab USING (scene_id, date_idx, id) GROUP BY ALL)",
]


def recursive(sql):
    return "WITH RECURSIVE " + sql[len("WITH "):]


def dark_regions(v, min_area=1):
    return RG.components(v.px.where("vv <= -16").select(*PIXEL, "vv"), SCENE, "vv", min_area)


@query("RG01_connected_components", recursive(ctes("px", *LABELS)) + f"SELECT {KEYS}, label, area_px, min_row, min_col, max_row, max_col, round(cr, 6) AS centroid_r, round(cc, 6) AS centroid_c, round(mr, 9) AS mean_response FROM rg WHERE area_px >= 2")
def rg01(v):
    out = dark_regions(v, 2)
    for name in ("centroid_r", "centroid_c", "mean_response"):
        out = out.withColumn(name, F.round(name, 9 if name == "mean_response" else 6))
    return out


@query("RG02_largest_centroid", recursive(ctes("px", *LABELS)) + f"SELECT {KEYS}, area_px, round(cc / 15, 5) AS x, round(cr / 15, 5) AS y FROM rg QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY area_px DESC, label) = 1")
def rg02(v):
    return RG.largest_centroid(dark_regions(v), SCENE, 16, 16)


def proposals_sql(opened, plane, response, aspect, solidity):
    """Regions of an opened mask with the mean ``response`` of ``plane``; ``sh`` holds all, ``rk`` ranks those within the prior."""
    return [
        *opened,
        f"hp AS (SELECT op.scene_id, op.date_idx, op.r, op.c, op.r * 16777216 + op.c AS id, {response} AS vv FROM op JOIN {plane} g ON g.scene_id = op.scene_id AND g.date_idx = op.date_idx AND g.r = op.r AND g.c = op.c WHERE op.hit)",
        *LABELS[1:],
        "sh AS (SELECT *, greatest(max_row - min_row, max_col - min_col) / greatest(1, least(max_row - min_row, max_col - min_col)) AS aspect, area_px / ((max_row - min_row) * (max_col - min_col)) AS solidity FROM rg)",
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY round(mr, 9) DESC, area_px DESC, label) AS rank FROM sh WHERE aspect <= {aspect} AND solidity >= {solidity})",
    ]


PROPOSALS = proposals_sql(OPENED, "grid", "-vv", 1.6, 0.6)
BOXES_SQL = f"SELECT {KEYS}, rank, area_px, round(min_col / 16, 5) AS xmin, round(min_row / 16, 5) AS ymin, round(max_col / 16, 5) AS xmax, round(max_row / 16, 5) AS ymax, round(aspect, 3) AS aspect_ratio, round(solidity, 3) AS solidity, 0.3::DOUBLE AS confidence FROM rk"


@query("RG03_box_proposals", recursive(ctes("px", "grid", *PROPOSALS)) + BOXES_SQL)
def rg03(v):
    # Dark smooth returns: the darker, the stronger the response.
    mask = dark_mask(v).withColumn("response", -col("vv"))
    return unit_boxes(RG.box_proposals(mask, SCENE, "storage tanks", 16, 16))


def unit_boxes(boxes):
    unit = lambda c: F.round(col(c) / 16, 5)
    return boxes.select(
        *SCENE, col("rank").cast("long").alias("rank"), "area_px", unit("min_col").alias("xmin"), unit("min_row").alias("ymin"), unit("max_col").alias("xmax"), unit("max_row").alias("ymax"),
        F.round("aspect_ratio", 3).alias("aspect_ratio"), F.round("solidity", 3).alias("solidity"), "confidence",
    )


RADAR = proposals_sql(opened_sql(f"mk AS (SELECT {PKEYS}, coalesce(vv >= -12, false) AS hit FROM grid)"), "grid", "vv", 4.0, 0.5)


@query("RG03_radar_proposals", recursive(ctes("px", "grid", *RADAR)) + BOXES_SQL + " WHERE rank <= 8")
def rg03_radar(v):
    # The plane's returns lie about the cross-polarised cut.
    return unit_boxes(RG.box_proposals(RG.radar_mask(v.grid, SCENE, "vh", "vv"), SCENE, "new buildings", 16, 16, 8))


OPTICAL = [
    FILL, *VARIANCE, *EDGES, RESPONSE, "tr AS (SELECT scene_id, date_idx, r, c, round(response, 9) AS response FROM tx)", gate_sql("tr", KEYS, "response", "0.35"),
    *proposals_sql(opened_sql(f"mk AS (SELECT {PKEYS}, coalesce(response >= value, false) AS hit FROM tr LEFT JOIN gate USING ({KEYS}))"), "tr", "response", 12.0, 0.15),
]


@query(
    "RG03_optical_summary",
    recursive(ctes("px", "grid", *OPTICAL)) + f"""SELECT {KEYS}, coalesce(n, 0) AS candidates, coalesce(least(b, 8), 0) AS n_boxes, CASE WHEN coalesce(b, 0) > 0 THEN 0.3 ELSE 0.05 END::DOUBLE AS confidence
FROM (SELECT DISTINCT {KEYS} FROM grid) f LEFT JOIN (SELECT {KEYS}, count(*) AS n FROM sh GROUP BY {KEYS}) s USING ({KEYS}) LEFT JOIN (SELECT {KEYS}, count(*) AS b FROM rk GROUP BY {KEYS}) k USING ({KEYS})""",
)
def rg03_optical(v):
    return RG.proposal_summary(RG.optical_mask(frame(v), SCENE, "nir"), SCENE, "jetty", 16, 16)


@query(
    "RG10_rasterize_polygons",
    ctes(
        "boxes", WKT, RINGS,
        "eg AS (SELECT ref_id % 500 AS frame, ref_id, line_no, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'a': ring[i], 'b': ring[i % len(ring) + 1]})) AS e FROM rings WHERE len(ring) >= 3)",
        "rw AS (SELECT CAST(unnest(range(110)) AS BIGINT) AS r)", "cw AS (SELECT CAST(unnest(range(110)) AS BIGINT) AS c)",
        "cr AS (SELECT frame, ref_id, line_no, r, e.a.x + (r + 0.5 - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y) AS x FROM eg JOIN rw ON (e.a.y <= r + 0.5) <> (e.b.y <= r + 0.5))",
        "bb AS (SELECT frame, ref_id, line_no, r, min(x) AS lo, max(x) AS hi FROM cr GROUP BY ALL)",
    )
    + "SELECT DISTINCT frame, r, c FROM (SELECT bb.frame, bb.ref_id, bb.line_no, bb.r, c FROM bb JOIN cw ON c + 0.5 > lo AND c + 0.5 <= hi JOIN cr ON cr.frame = bb.frame AND cr.ref_id = bb.ref_id AND cr.line_no = bb.line_no AND cr.r = bb.r GROUP BY ALL HAVING count(*) FILTER (cr.x < c + 0.5) % 2 = 1) t",
)
def rg10(v):
    shapes = rings(v).select((col("ref_id") % 500).alias("frame"), F.concat_ws("_", "ref_id", "line_no").alias("ring_id"), "ring")
    return RG.rasterize(shapes, ["frame"], 110, 110)


def plan_sql(clamped):
    side, stride = ("least(512, greatest(height, width))", "greatest(1, CAST(round_even(least(512, greatest(height, width)) * 0.9, 0) AS BIGINT))")
    if clamped:
        rows, cols = "range(0, height, 461)", "range(0, width, 461)"
    else:
        def axis(e):
            s = f"least({side}, {e})"
            reg = f"range(0, {e} - {s} + 1, {stride})"
            return f"CASE WHEN list_last({reg}) + {s} >= {e} THEN {reg} ELSE list_append({reg}, CAST({e} - {s} AS BIGINT)) END"
        rows, cols = axis("height"), axis("width")
    return f"""t0 AS (SELECT scene_id, height, width, {side} AS side, {rows} AS rs, {cols} AS cs FROM headers),
t1 AS (SELECT *, unnest(rs) AS row_off, unnest(range(len(rs))) AS i FROM t0),
t2 AS (SELECT *, unnest(cs) AS col_off, unnest(range(len(cs))) AS j FROM t1),
tl AS (SELECT *, CAST(i * len(cs) + j + 1 AS BIGINT) AS tile_idx, len(rs) * len(cs) > 256 AS truncated FROM t2)"""


@query(
    "TK01_plan_tiles",
    ctes("headers", plan_sql(False))
    + """SELECT scene_id, tile_idx, CAST(row_off AS BIGINT) AS row_off, CAST(col_off AS BIGINT) AS col_off, CAST(least(side, height) AS BIGINT) AS h, CAST(least(side, width) AS BIGINT) AS w, false AS is_overview, truncated FROM tl
UNION ALL SELECT scene_id, 0, 0, 0, CAST(height AS BIGINT), CAST(width AS BIGINT), true, NULL FROM headers""",
)
def tk01(v):
    return TK.plan_tiles(v.headers, "scene_id")


@query("TK02_plan_tiles_clamped", ctes("headers", plan_sql(True)) + "SELECT scene_id, tile_idx, CAST(row_off AS BIGINT) AS row_off, CAST(col_off AS BIGINT) AS col_off, CAST(least(512, height - row_off) AS BIGINT) AS h, CAST(least(512, width - col_off) AS BIGINT) AS w, truncated FROM tl")
def tk02(v):
    return TK.plan_tiles_clamped(v.headers, "scene_id")


TILED = [
    "o AS (SELECT unnest([0, 6, 8]) AS o)",
    f"tp AS (SELECT {KEYS}, a.o AS row_off, b.o AS col_off, r - a.o AS tr, c - b.o AS tc, r, c, nir, vv FROM grid JOIN o a ON r >= a.o AND r < a.o + 8 JOIN o b ON c >= b.o AND c < b.o + 8)",
]


def tiled(v):
    return TK.assign_pixels(v.grid.select(*PIXEL, "nir", "vv"), 16, 16, 8, 6)


@query("TK03_assign_pixels_to_tiles", ctes("px", "grid", *TILED) + f"SELECT {PKEYS}, row_off, col_off, tr, tc FROM tp")
def tk03(v):
    return tiled(v).select(*PIXEL, "row_off", "col_off", "tr", "tc")


TKEY = ["scene_id", "date_idx", "row_off", "col_off"]
_T = ", ".join(TKEY)


def tile_stencil(name, source, expressions, k):
    on = " AND ".join(f"n.{x} = g.{x}" for x in TKEY)
    g = ", ".join(f"g.{x}" for x in [*TKEY, "tr", "tc"])
    return f"""{name} AS (SELECT {g}, any_value(g.valid) AS valid, {expressions} FROM {source} g CROSS JOIN {off(k)} a CROSS JOIN (SELECT dr AS dc FROM {off(k)} q) b
JOIN {source} n ON {on} AND n.tr = least(greatest(g.tr + dr, 0), 7) AND n.tc = least(greatest(g.tc + dc, 0), 7) GROUP BY {g})"""


SCORES = [
    *TILED,
    f"tf AS (SELECT {_T}, tr, tc, coalesce(nir, avg(nir) OVER (PARTITION BY {_T})) AS x, nir IS NOT NULL AS valid FROM tp)",
    tile_stencil("tv", "tf", "greatest(var_pop(n.x), 0) AS v", 4),
    tile_stencil("tb", "tf", "sum(n.x * dc * (2 - abs(dr))) AS gx, sum(n.x * dr * (2 - abs(dc))) AS gy", 1),
    f"tm AS (SELECT {_T}, tr, tc, valid, sqrt(gx * gx + gy * gy) AS x FROM tb)",
    tile_stencil("te", "tm", "avg(n.x) AS d", 4),
    f"pk AS (SELECT {_T}, max(v) FILTER (tv.valid) AS vp, quantile_cont(d, 0.99) FILTER (tv.valid) AS ep FROM tv JOIN te USING ({_T}, tr, tc) GROUP BY {_T})",
    f"""sc AS (SELECT {_T}, avg(CASE WHEN tv.valid THEN 1.0 ELSE 0.0 END) AS cov, avg(CASE WHEN tv.valid AND ep > 0 THEN least(d / ep, 1.0) ELSE 0.0 END) AS tx, avg(CASE WHEN tv.valid AND vp > 0 THEN least(v / vp, 1.0) ELSE 0.0 END) AS va FROM tv JOIN te USING ({_T}, tr, tc) JOIN pk USING ({_T}) GROUP BY {_T})""",
    f"sx AS (SELECT {_T}, cov, CASE WHEN cov > 0 THEN least(greatest(0.35 * cov + 0.65 * CASE WHEN scene_id % 2 = 0 THEN 1 - (0.5 * tx + 0.5 * va) ELSE 0.5 * tx + 0.5 * va END, 0), 1) ELSE 0.0 END AS score FROM sc)",
]


def scored_tiles(v):
    local = tiled(v).select(*TKEY, col("tr").alias("r"), col("tc").alias("c"), "nir")
    question = F.when(col("scene_id") % 2 == 0, "How large is the lake?").otherwise("Is there an airport by the sea?")
    wish = v.px.select(*SCENE).distinct().withColumn("wish", TK.texture_wish(question))
    return TK.content_score(local, TKEY, "nir", wish)


@query("TK04_content_score", ctes("px", "grid", *SCORES) + f"SELECT {_T}, round(cov, 6) AS coverage, round(score, 6) AS score FROM sx")
def tk04(v):
    return scored_tiles(v).select(*TKEY, F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


@query(
    "TK05_top_k_tiles",
    ctes("px", "grid", *SCORES, f"al AS (SELECT {KEYS}, CAST(row_off * 100 + col_off + 1 AS BIGINT) AS tile_idx, round(score, 6) AS score, false AS ov FROM sx UNION ALL SELECT DISTINCT {KEYS}, CAST(0 AS BIGINT), 1.0, true FROM px)")
    + f"SELECT {KEYS}, tile_idx, score, row_number() OVER (PARTITION BY {KEYS} ORDER BY ov DESC, score DESC, tile_idx) AS rank FROM al QUALIFY rank <= 5",
)
def tk05(v):
    tiles = scored_tiles(v).select(*SCENE, (col("row_off") * 100 + col("col_off") + 1).alias("tile_idx"), F.round("score", 6).alias("score"), F.lit(False).alias("is_overview"))
    overview = v.px.select(*SCENE).distinct().select(*SCENE, F.lit(0).cast("long").alias("tile_idx"), F.lit(1.0).alias("score"), F.lit(True).alias("is_overview"))
    out = TK.top_k_tiles(tiles.unionByName(overview), SCENE, 4)
    return out.select(*SCENE, "tile_idx", "score", col("rank").cast("long").alias("rank"))


@query("TK06_mosaic_or", ctes("px", "grid", *TILED) + f"SELECT {PKEYS}, coalesce(bool_or(vv <= -14 - (row_off + col_off) / 4), false) AS hit FROM tp GROUP BY {PKEYS}")
def tk06(v):
    # Each tile view uses its own cut, so overlaps genuinely disagree.
    pieces = tiled(v).withColumn("hit", F.coalesce(col("vv") <= -14 - (col("row_off") + col("col_off")) / 4, F.lit(False)))
    pieces = pieces.withColumns({"h": F.lit(8), "w": F.lit(8)})
    return TK.mosaic_or(pieces, v.grid, SCENE, [*SCENE, "row_off", "col_off"])


@query(
    "TK07_grid_boxes",
    ctes("headers", "n AS (SELECT unnest([0, 1, 2]) AS k)")
    + """SELECT scene_id, i, j, CAST(greatest(0, floor(j * (width / 3) - (width / 3) * 0.2)) AS BIGINT) AS left_x, CAST(greatest(0, floor(i * (height / 3) - (height / 3) * 0.2)) AS BIGINT) AS top_y,
CAST(least(width, floor((j + 1) * (width / 3) + (width / 3) * 0.2)) AS BIGINT) AS right_x, CAST(least(height, floor((i + 1) * (height / 3) + (height / 3) * 0.2)) AS BIGINT) AS bottom_y FROM headers, (SELECT k AS i FROM n) a, (SELECT k AS j FROM n) b""",
)
def tk07(v):
    return TK.grid_boxes(v.headers, "scene_id", 3, 0.2)


@query(
    "TK08_rank_labels",
    "WITH e AS (SELECT vec_id, unnest(list_transform(range(1, 20), lambda i: list_sum([CAST(embedding[j] AS DOUBLE) for j in range(i, 65, 19)]))) AS s, unnest(range(1, 20)) AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CAST(s AS DOUBLE) DESC, i) AS rank FROM e) SELECT vec_id, rank, ([" + ", ".join(f"'{c}'" for c in C.LANDCOVER_CLASSES) + "])[i] AS name, CAST(s AS DOUBLE) AS score FROM k WHERE rank <= 5",
)
def tk08(v):
    scores = folded("embedding", 1, 64, 19)
    out = v.embeddings.select("vec_id", F.posexplode(TK.rank_labels(scores, C.LANDCOVER_CLASSES, 5)).alias("p", "t"))
    return out.select("vec_id", (col("p") + 1).cast("long").alias("rank"), "t.name", "t.score")
