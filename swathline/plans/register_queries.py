"""Co-registration over optical and radar planes of each scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.operators import registration as RE
from swathline.plans.registry import query
from swathline.plans.stats_queries import KEYS, SCENE
from swathline.plans.views import ctes

col = F.col
PIXEL = [*SCENE, "r", "c"]
PKEYS = f"{KEYS}, r, c"
#: Bands whose means are the planes to register.
OPTICAL, RADAR = ["red", "green", "nir"], ["vv"]


def plane_sql(name, expr, out):
    return f"""{name}0 AS (SELECT {PKEYS}, {expr} AS p FROM grid), {name}1 AS (SELECT {PKEYS}, coalesce(p, avg(p) OVER (PARTITION BY {KEYS})) AS p FROM {name}0),
{name} AS MATERIALIZED (SELECT {PKEYS}, CASE WHEN stddev_pop(p) OVER (PARTITION BY {KEYS}) > 0 THEN (p - avg(p) OVER (PARTITION BY {KEYS})) / stddev_pop(p) OVER (PARTITION BY {KEYS}) ELSE 0 END AS {out} FROM {name}1)"""


PLANES = [plane_sql("pa", "(0.0 + red + green + nir) / 3", "a"), plane_sql("pb", "(0.0 + vv) / 1", "b")]
PAIRED = f"pr AS (SELECT {PKEYS}, round(a, 9) AS a, round(b, 9) AS b FROM pa JOIN pb USING ({PKEYS}))"


def planes(v):
    a = RE.standardise_plane(v.grid, SCENE, ["red", "green", "nir"], "a").withColumn("a", F.round("a", 9))
    b = RE.standardise_plane(v.grid, SCENE, ["vv"], "b").withColumn("b", F.round("b", 9))
    return a, b


@query("FU01_standardise_plane", ctes("px", "grid", PLANES[0]) + f"SELECT {PKEYS}, round(a, 6) AS z FROM pa")
def fu01(v):
    return RE.standardise_plane(v.grid, SCENE, ["red", "green", "nir"]).withColumn("z", F.round("z", 6))


def mi_sql(source, keys):
    b = lambda c: f"CAST(CASE WHEN {c}1 > {c}0 THEN least(floor(({c} - {c}0) / ({c}1 - {c}0) * 32.0), 31) ELSE 0 END AS INT)"
    return f"""mr AS (SELECT {keys}, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM {source} GROUP BY {keys}),
mh AS (SELECT {keys}, {b('a')} AS i, {b('b')} AS j, count(*) AS n FROM {source} JOIN mr USING ({keys}) GROUP BY ALL),
mj AS (SELECT {keys}, n, sum(n) OVER (PARTITION BY {keys}) AS t, sum(n) OVER (PARTITION BY {keys}, i) AS ni, sum(n) OVER (PARTITION BY {keys}, j) AS nj FROM mh),
mi AS (SELECT {keys}, sum(n / t * log2((n * t) / (ni * nj))) AS mi FROM mj GROUP BY {keys})"""


@query("FU02_mutual_information", ctes("px", "grid", *PLANES, PAIRED, mi_sql("pr", KEYS)) + f"SELECT {KEYS}, round(mi, 6) AS mi FROM mi")
def fu02(v):
    return RE.plane_information(v.grid, SCENE, ["red", "green", "nir"], ["vv"]).withColumn("mi", F.round("mi", 6))


@query("FU03_ncc", ctes("px", "grid", *PLANES, PAIRED) + f"SELECT {KEYS}, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS ncc FROM pr GROUP BY {KEYS}")
def fu03(v):
    a, b = planes(v)
    return RE.ncc(a.join(b, PIXEL), SCENE, "a", "b").withColumn("ncc", F.round("ncc", 6))


def moved_sql(name, plane, shifts):
    """``plane`` beside ``pa`` under each candidate (dy, dx) of ``shifts``, interpolated linearly, borders replicated."""
    at = lambda axis, by: f"least(greatest(x.{axis} + CAST(floor(-s.d{'y' if axis == 'r' else 'x'}) AS BIGINT) + {by}, 0), 15)"
    cell = lambda i, j: f"LEFT JOIN {plane} y{i}{j} ON y{i}{j}.scene_id = x.scene_id AND y{i}{j}.date_idx = x.date_idx AND y{i}{j}.r = {at('r', i)} AND y{i}{j}.c = {at('c', j)}"
    fy, fx = "(-s.dy - floor(-s.dy))", "(-s.dx - floor(-s.dx))"
    across = lambda i: f"CASE WHEN {fx} > 0 THEN y{i}0.b * (1 - {fx}) + y{i}1.b * {fx} ELSE y{i}0.b END"
    return f"""{name} AS MATERIALIZED (SELECT x.scene_id, x.date_idx, s.dy, s.dx, x.r, x.c, x.a, CASE WHEN {fy} > 0 THEN ({across(0)}) * (1 - {fy}) + ({across(1)}) * {fy} ELSE {across(0)} END AS b
 FROM pa x JOIN {shifts} s ON s.scene_id = x.scene_id AND s.date_idx = x.date_idx {cell(0, 0)} {cell(0, 1)} {cell(1, 0)} {cell(1, 1)})"""


def grid_sql(name, centres, n, step):
    """Candidates ``-n * step .. n * step`` around each frame's centre (dy, dx)."""
    axis = lambda a: f"(SELECT unnest(range(0, {2 * n + 1})) * {step} - {n * step} AS {a})"
    return f"{name} AS MATERIALIZED (SELECT {KEYS}, dy + oy AS dy, dx + ox AS dx FROM {centres} CROSS JOIN {axis('oy')} CROSS JOIN {axis('ox')})"


START = f"c0 AS MATERIALIZED (SELECT DISTINCT {KEYS}, CAST(0 AS DOUBLE) AS dy, CAST(0 AS DOUBLE) AS dx FROM pa)"
SKEYS = f"{KEYS}, dy, dx"


def best_sql(name, scored):
    return f"{name} AS MATERIALIZED (SELECT * FROM {scored} QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY s DESC, dy, dx) = 1)"


def ncc_sql(tag, plane):
    """Best integer shift within three pixels by correlation."""
    return [
        grid_sql(f"g{tag}", "c0", 3, 1.0), moved_sql(f"sh{tag}", plane, f"g{tag}"),
        f"sn{tag} AS MATERIALIZED (SELECT {SKEYS}, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS s FROM sh{tag} GROUP BY {SKEYS})", best_sql(f"best{tag}", f"sn{tag}"),
    ]


@query("JN13_shift_search", ctes("px", "grid", *PLANES, START, grid_sql("g", "c0", 3, 1.0), moved_sql("sh", "pb", "g")) + f"SELECT {SKEYS}, round(sum(a * b) / 256, 6) AS correlation FROM sh GROUP BY {SKEYS}")
def jn13(v):
    return RE.plane_correlations(v.grid, SCENE, OPTICAL, RADAR, 3).select(*SCENE, "dy", "dx", F.round(col("ab") / 256, 6).alias("correlation"))


@query("FU04_shift_estimate_integer", ctes("px", "grid", *PLANES, START, *ncc_sql("", "pb")) + f"SELECT {KEYS}, dy, dx, round(s, 6) AS score, round(sqrt(dy * dy + dx * dx), 6) AS residual FROM best")
def fu04_integer(v):
    out = RE.plane_shifts(v.grid, SCENE, OPTICAL, RADAR, cross_modal=False, search=3, refine=0)
    return out.select(*SCENE, "dy", "dx", F.round("score", 6).alias("score"), F.round("residual", 6).alias("residual"))


def mi_stage_sql(i, n, step):
    """One pass of the search by mutual information: candidates around ``c<i>``, the best becomes ``c<i + 1>``."""
    b = lambda c: f"CAST(CASE WHEN {c}1 > {c}0 THEN least(floor(({c} - {c}0) / ({c}1 - {c}0) * 32.0), 31) ELSE 0 END AS INT)"
    return [
        grid_sql(f"g{i}", f"c{i}", n, step), moved_sql(f"sh{i}", "pb", f"g{i}"),
        f"mr{i} AS (SELECT {SKEYS}, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM sh{i} GROUP BY {SKEYS})",
        f"mh{i} AS MATERIALIZED (SELECT {SKEYS}, {b('a')} AS i, {b('b')} AS j, count(*) AS n FROM sh{i} JOIN mr{i} USING ({SKEYS}) GROUP BY ALL)",
        f"mj{i} AS (SELECT {SKEYS}, n, sum(n) OVER (PARTITION BY {SKEYS}) AS t, sum(n) OVER (PARTITION BY {SKEYS}, i) AS ni, sum(n) OVER (PARTITION BY {SKEYS}, j) AS nj FROM mh{i})",
        f"mi{i} AS (SELECT {SKEYS}, round(sum(n / t * log2((n * t) / (ni * nj))), 9) AS s FROM mj{i} GROUP BY {SKEYS})", best_sql(f"c{i + 1}", f"mi{i}"),
    ]


ROUNDED = [*PLANES, f"qa AS MATERIALIZED (SELECT {PKEYS}, round(a, 9) AS a FROM pa)", f"qb AS MATERIALIZED (SELECT {PKEYS}, round(b, 9) AS b FROM pb)"]
MI_SEARCH = [p.replace("FROM pa ", "FROM qa ").replace("JOIN pb ", "JOIN qb ") for p in [START, *mi_stage_sql(0, 8, 1.0), *mi_stage_sql(1, 4, 0.25), *mi_stage_sql(2, 4, 0.0625)]]


@query("FU04_shift_estimate_mi", ctes("px", "grid", *ROUNDED, *MI_SEARCH) + f"SELECT {KEYS}, dy, dx, round(s, 6) AS score, round(sqrt(dy * dy + dx * dx), 6) AS residual FROM c3")
def fu04(v):
    out = RE.plane_shifts(v.grid, SCENE, OPTICAL, RADAR, digits=9, cross_modal=True)
    return out.select(*SCENE, "dy", "dx", F.round("score", 6).alias("score"), F.round("residual", 6).alias("residual"))


HEADERS = """hd AS (SELECT *, CASE WHEN scene_id % 5 = 0 THEN 'EPSG:2056' ELSE 'EPSG:32644' END AS crs_a, 'EPSG:32644' AS crs_b, 10.0 AS gsd_a, CASE WHEN scene_id % 3 = 0 THEN 50.0 ELSE 10.0 END AS gsd_b, scene_id % 13 <> 6 AS same_grid, scene_id % 2 = 0 AND date_idx = 1 AS pre, CASE WHEN scene_id % 4 = 0 THEN 4.0 ELSE 1.0 END AS unit FROM (SELECT DISTINCT scene_id, date_idx FROM px) s)"""

# The correction on its own: the frame moved by the shift found, standardised anew, measured again.
SECOND = [
    f"mv AS MATERIALIZED (SELECT scene_id, date_idx, r, c, b AS p FROM ({moved_sql('x', 'pb', 'best')[len('x AS MATERIALIZED ('):-1]}) z)",
    f"pc AS MATERIALIZED (SELECT {PKEYS}, CASE WHEN stddev_pop(p) OVER (PARTITION BY {KEYS}) > 0 THEN (p - avg(p) OVER (PARTITION BY {KEYS})) / stddev_pop(p) OVER (PARTITION BY {KEYS}) ELSE 0 END AS b FROM mv)",
    *ncc_sql("2", "pc"),
]


@query(
    "FU05_registration_report",
    ctes(
        "px", "grid", *PLANES, START, *ncc_sql("", "pb"), HEADERS, *SECOND,
        "j0 AS (SELECT hd.*, CASE WHEN same_grid THEN b.dy END AS dy, CASE WHEN same_grid THEN b.dx END AS dx, sqrt(b.dy * b.dy + b.dx * b.dx) * unit AS off, sqrt(b2.dy * b2.dy + b2.dx * b2.dx) * unit AS off2 FROM hd LEFT JOIN best b ON b.scene_id = hd.scene_id AND b.date_idx = hd.date_idx LEFT JOIN best2 b2 ON b2.scene_id = hd.scene_id AND b2.date_idx = hd.date_idx)",
        "j AS (SELECT *, CASE WHEN NOT same_grid THEN 'refused_grid' WHEN off > 8 THEN 'refused_residual' WHEN pre AND off <= 1 THEN 'verified' WHEN pre THEN 'verify_only_warning' WHEN off <= 1 THEN 'registered' WHEN off2 <= 1 THEN 'corrected' ELSE 'refused_after_correction' END AS state FROM j0)",
    )
    + f"""SELECT {KEYS}, state, concat_ws(',', CASE WHEN crs_a = crs_b THEN 'crs_match' END, CASE WHEN greatest(gsd_a, gsd_b) / least(gsd_a, gsd_b) <= 4 THEN 'gsd_ratio_ok' END, CASE WHEN same_grid THEN 'extent_overlap' END, CASE WHEN same_grid AND off <= 1 THEN 'residual_shift_ok' END, CASE WHEN state IN ('corrected', 'refused_after_correction') THEN 'residual_shift_corrected' END) AS checks,
dy, dx, CASE WHEN same_grid THEN round(off, 6) END AS first_residual, CASE WHEN same_grid THEN round(CASE WHEN state IN ('corrected', 'refused_after_correction') THEN off2 ELSE off END, 6) END AS residual FROM j""",
)
def fu05(v):
    s = col("scene_id")
    headers = v.px.select(*SCENE).distinct().select(
        *SCENE, F.when(s % 5 == 0, "EPSG:2056").otherwise("EPSG:32644").alias("crs_a"), F.lit("EPSG:32644").alias("crs_b"), F.lit(10.0).alias("gsd_a"),
        F.when(s % 3 == 0, 50.0).otherwise(10.0).alias("gsd_b"), (s % 13 != 6).alias("same_grid"),
        ((s % 2 == 0) & (col("date_idx") == 1)).alias("pregeoreferenced"),
        # Every fourth scene has pixels four times coarser than those of the limits.
        F.when(s % 4 == 0, 4.0).otherwise(1.0).alias("unit"),
    )
    out = RE.registration_report(v.grid, OPTICAL, RADAR, headers, SCENE, cross_modal=False, search=3, refine=0)
    return out.withColumns({c: F.round(c, 6) for c in ("first_residual", "residual")})
