"""Frames worked on whole in numpy give what the window passes give, and frames over several blocks take the latter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import frames as FR
from swathline.operators import stencil as ST

KEYS = ["scene_id", "part"]


def several(spark, shapes, holes=0.1):
    """One frame per shape, numbered, with holes; the second key is NULL for every other one."""
    rng = np.random.default_rng(5)
    rows = []
    for i, (h, w) in enumerate(shapes):
        x = rng.normal(10.0, 3.0, (h, w))
        x[rng.random((h, w)) < holes] = np.nan
        rows += [(i, None if i % 2 else "a", r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "scene_id long, part string, r long, c long, v double")


def rows_of(df, *names):
    return {(r["scene_id"], r["part"], r["r"], r["c"]): tuple(r[n] for n in names) for r in df.collect()}


def agree(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), key


OPERATORS = {
    "texture": (lambda f: ST.texture_parts(f, KEYS, "v", 9), lambda f: ST.spread_texture_parts(f, KEYS, "v", 9), ("valid", "edges", "variance")),
    "variance": (lambda f: ST.local_variance(f, KEYS, "v", 5), lambda f: ST.spread_local_variance(f, KEYS, "v", 5), ("valid", "variance")),
    "edges": (lambda f: ST.edge_density(f, KEYS, "v", 5), lambda f: ST.spread_edge_density(f, KEYS, "v", 5), ("valid", "edges")),
    "lee": (lambda f: ST.refined_lee(f, KEYS, "v"), lambda f: ST.spread_refined_lee(f, KEYS, "v"), ("filtered",)),
    "entropy": (lambda f: ST.glcm_entropy(f, KEYS, "v"), lambda f: ST.spread_glcm_entropy(f, KEYS, "v", 9, 16), ("entropy",)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_whole_frames_like_window_passes(spark, name):
    whole, spread, names = OPERATORS[name]
    frame = several(spark, [(16, 16), (16, 16), (7, 20), (1, 1), (2, 130)])
    agree(rows_of(whole(frame), *names), rows_of(spread(frame), *names))
    empty = several(spark, [(4, 4)], holes=2.0)
    agree(rows_of(whole(empty), *names), rows_of(spread(empty), *names))


def test_frames_over_several_blocks_are_passed_on(spark):
    frame = several(spark, [(16, 16), (16, 16), (130, 3)])
    missing = frame.where("NOT (scene_id = 1 AND r = 3 AND c = 3)")
    seen = []

    def spread(some):
        seen.extend(r["scene_id"] for r in some.select("scene_id").distinct().collect())
        return some.select(*KEYS, "r", "c", (F.col("v") + 1).alias("x"))

    got = rows_of(FR.by_frames(missing, KEYS, ["v"], {"x": "double"}, lambda p: {"x": p["v"] + 1}, spread), "x")
    # A frame that lacks a cell is none that an array can hold.
    assert sorted(seen) == [1, 2]
    agree(got, rows_of(missing.withColumn("x", F.col("v") + 1), "x"))


def test_a_frame_is_worked_on_where_its_pixels_meet(spark):
    """No window, and one exchange after those of the input: statistics of a whole frame are not joined back."""
    frame = several(spark, [(16, 16)] * 3)
    made = FR.whole_frames(frame, KEYS, ["v"], {"x": "double"}, lambda p: {"x": p["v"]})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange ") <= 1


@pytest.mark.parametrize("limit", [None, 1])
def test_proposals_of_whole_frames_like_components(spark, limit):
    from swathline.operators import regions as RG

    frame = several(spark, [(24, 24), (24, 24), (12, 40)], holes=0.05)
    mask = frame.select(*KEYS, (F.col("r") + 5).alias("r"), (F.col("c") + 9).alias("c"), F.col("v").alias("response"), (F.col("v") > 7).alias("hit"))
    names = ("rank", "area_px", "min_row", "min_col", "max_row", "max_col", "centroid_r", "centroid_c", "mean_response")
    # Moved so that blocks cut every frame, which the windows and the labels of pieces are for.
    far = mask.withColumn("r", F.col("r") + 103).withColumn("c", F.col("c") + 103)
    found, want = ([tuple(r) for r in RG.box_proposals(m, KEYS, "storage tanks", 24, 24, limit).orderBy(*KEYS, "rank").select(*KEYS, *names).collect()] for m in (mask, far))
    assert len(found) == len(want) > 0
    for a, b in zip(found, want):
        moved = [x - 103 if n.startswith(("m", "c")) and n != "mean_response" else x for n, x in zip(names, b[2:])]
        assert a[:2] == b[:2] and list(a[2:]) == pytest.approx(moved, abs=1e-9)


def test_stack_and_tile_scores_over_blocks_as_in_whole_frames(spark):
    from swathline.operators import tiles as TK

    frame = several(spark, [(16, 16), (9, 14)]).withColumn("v", F.col("v") - 25)
    far = frame.withColumn("r", F.col("r") + 110).withColumn("c", F.col("c") + 110)
    names = ("sigma0", "lee_db", "entropy")
    back = lambda df: df.withColumn("r", F.col("r") - 110).withColumn("c", F.col("c") - 110)
    agree(rows_of(ST.single_pol_stack(frame, KEYS, "v"), *names), rows_of(back(ST.single_pol_stack(far, KEYS, "v")), *names))
    wish = frame.select("scene_id").distinct().withColumn("wish", F.when(F.col("scene_id") == 0, "smooth").otherwise("structure"))
    scores = [sorted((r["scene_id"], round(r["coverage"], 9), round(r["score"], 9)) for r in TK.content_score(f, KEYS, "v", wish).collect()) for f in (frame, far)]
    assert scores[0] == scores[1] and len(scores[0]) == 2


def test_information_over_blocks_as_in_whole_frames(spark):
    from swathline.operators import registration as RE

    frame = several(spark, [(16, 16), (16, 16), (9, 14), (3, 3)]).withColumn("u", F.when(F.col("scene_id") < 3, F.col("v") * F.col("v") + F.col("r")))
    far = frame.withColumn("r", F.col("r") + 110).withColumn("c", F.col("c") + 118)
    one, other = ({(r["scene_id"], r["part"]): r["mi"] for r in RE.plane_information(f, KEYS, ["v", "u"], ["u"], digits=6).collect()} for f in (frame, far))
    assert len(one) == 4 and one.keys() == other.keys() and one[3, None] == 0.0
    assert all(one[k] == pytest.approx(other[k], abs=1e-9) for k in one)


def test_polygon_boxes_are_not_worked_out_below_the_grouping(spark):
    """A filter pushed down with the parsing of the text would parse it a dozen times for every row."""
    import __spark_entry__ as entrypoint

    made = entrypoint.queries()["RG09_polygon_to_box"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") <= 4


def test_composites_over_blocks_as_in_whole_frames(spark):
    from swathline.operators import rasters as R

    frame = several(spark, [(16, 16), (5, 9)]).withColumn("seen", F.when(F.col("r") != 2, F.lit(True)))
    bands = [b for b in ("B02", "B03", "B04", "B08", "B11", "B12")]
    frame = frame.withColumns({b: F.lit(3.0) if b == "B12" else F.col("v") * (i + 1) + F.col("c") for i, b in enumerate(bands)})
    far = frame.withColumn("r", F.col("r") + 115).withColumn("c", F.col("c") + 112)
    made = [R.composites(f, KEYS, {b: b for b in bands}, "seen") for f in (frame, far)]
    plain = R.composites(frame.where("seen"), KEYS, {b: b for b in bands})
    whole, other, want = (sorted((r["scene_id"], r["r"] % 115, r["c"] % 112, r["composite"], r["red8"], r["green8"], r["blue8"]) for r in df.collect()) for df in (*made, plain))
    assert whole == other == want and len(want) == 3 * (15 * 16 + 4 * 9)


def test_band_facts_of_planes_like_those_of_the_long_table(spark):
    from swathline.operators import rasters as R

    frame = several(spark, [(16, 16), (16, 16), (4, 4)]).withColumn("v", F.col("v") - 8)
    frame = frame.withColumn("flat", F.lit(0.1)).withColumn("none", F.lit(None).cast("double"))
    far = frame.withColumn("r", F.col("r") + 115)
    products = {("a", "v"): "v", ("a", "flat"): "flat", ("b", "none"): "none"}
    whole, other = ({(r["scene_id"], r["part"], r["product"], r["band"]): tuple(r[n] for n in R.FACTS) for r in R.frame_band_facts(f, KEYS, products).collect()} for f in (frame, far))
    agree(whole, other)
    assert len(whole) == 6 and whole[0, "a", "a", "flat"][-2] == 0.0


def decisions(df):
    names = [n for n in df.columns if n not in KEYS]
    return {(r["scene_id"], r["part"]): tuple(r[n] for n in names) for r in df.collect()}


def gate_inputs(spark):
    """Frames in one mode, in two, flat, with holes, with none but holes, without a cut, and one that lacks a cell."""
    frame = several(spark, [(16, 16), (16, 16), (9, 14), (1, 1), (5, 5), (8, 8), (6, 6)])
    k = F.col("scene_id")
    two = F.when(F.col("c") % 3 == 0, F.col("v") / 100).otherwise(F.col("v") / 100 + 0.5)
    v = F.when(k == 0, F.col("v")).when(k == 2, F.lit(0.25)).when(k == 4, F.lit(None)).otherwise(two)
    frame = frame.withColumn("v", F.round(v, 3)).withColumn("cut", F.when(k != 5, F.lit(0.35) + k / 50))
    return frame.where("NOT (scene_id = 6 AND r = 2 AND c = 3)")


@pytest.mark.parametrize("above", [True, False])
def test_gate_of_whole_frames_like_the_grouped_one(spark, above):
    from swathline.operators import stats as S

    frame = gate_inputs(spark)
    whole, grouped = S.gated_frames(frame, KEYS, "v", F.col("cut"), above), S.gated_threshold(frame, KEYS, "v", F.col("cut"), above)
    assert whole.columns == grouped.columns
    # The same doubles, not nearly the same: both work in whole numbers of bins.
    assert decisions(whole) == decisions(grouped)
    assert {r["method"] for r in whole.collect()} == {"otsu", "fixed_fallback"}


def test_texture_gate_over_blocks_as_in_whole_frames(spark):
    from swathline.operators import stats as S

    frame = several(spark, [(16, 16), (16, 16), (9, 14), (4, 4), (1, 1)])
    frame = frame.withColumn("v", F.when(F.col("scene_id") != 3, F.col("v") + F.when(F.col("c") > 6, F.col("r") * F.col("c") % 7 * 40).otherwise(0)))
    far = frame.withColumn("r", F.col("r") + 115)
    response = ST.texture_response(frame, KEYS, "v").withColumn("response", F.round("response", 9))
    whole, over, plain = ST.texture_gate(frame, KEYS, "v", 0.35), ST.texture_gate(far, KEYS, "v", 0.35), S.gated_threshold(response, KEYS, "response", 0.35)
    assert decisions(whole) == decisions(over) == decisions(plain)
    hits = rows_of(ST.texture_hits(frame, KEYS, "v", 0.35), "response", "hit")
    agree(hits, {(s, p, r - 115, c): x for (s, p, r, c), x in rows_of(ST.texture_hits(far, KEYS, "v", 0.35), "response", "hit").items()})
    assert sum(hit for _, hit in hits.values()) == sum(r["hits"] for r in whole.collect())


@pytest.mark.parametrize("name", ["AGG06_texture_seg_summary", "AGG19_measure_variant_texture", "AGG04_spectral_index_summary"])
def test_small_frames_are_decided_on_where_their_pixels_meet(spark, name):
    """One row per frame is left: no pixel is grouped by its value, joined to a cut or shuffled after its frame is whole."""
    import __spark_entry__ as entrypoint

    plan = entrypoint.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "Window"))


def shifted_pairs(spark):
    """Frames whose second band is the first, moved, with noise; one flat, one without values, one of another shape."""
    rng = np.random.default_rng(9)
    rows = []
    for i, (h, w, dy, dx) in enumerate([(16, 16, 1, -1), (16, 16, 0, 0), (9, 14, -2, 1), (8, 8, 0, 0), (16, 16, 3, 2), (6, 6, 0, 0)]):
        b = rng.normal(10.0, 3.0, (h, w)).round(2)
        a = np.roll(b, (dy, dx), axis=(0, 1)) + rng.normal(0.0, 0.2, (h, w)).round(2)
        if i == 3:
            b[:] = 4.0
        for (r, c), x in np.ndenumerate(a):
            hole = rng.random() < 0.05 or i == 5
            rows.append((i, "b" if i % 2 else "a", r, c, None if hole else float(x), float(b[r, c])))
    return spark.createDataFrame(rows, "scene_id long, part string, r long, c long, u double, v double")


@pytest.mark.parametrize("how", [{"cross_modal": True, "search": 4}, {"cross_modal": False, "search": 3, "refine": 0}])
def test_shifts_of_whole_frames_like_those_of_planes(spark, how):
    from swathline.operators import registration as RE

    frame = shifted_pairs(spark)
    a, b = (RE.standardise_plane(frame, KEYS, [n], m).withColumn(m, F.round(m, 9)) for n, m in (("u", "a"), ("v", "b")))
    far = frame.withColumn("r", F.col("r") + 118)
    found = [
        {(r["scene_id"], r["part"]): (r["dy"], r["dx"], pytest.approx(r["score"], abs=2e-9), pytest.approx(r["residual"])) for r in df.collect()}
        for df in (RE.plane_shifts(frame, KEYS, ["u"], ["v"], digits=9, **how), RE.shift_estimate(a, b, KEYS, **how), RE.plane_shifts(far, KEYS, ["u"], ["v"], digits=9, **how))
    ]
    assert len(found[0]) == 6 and found[0] == found[1] == found[2]
    assert [found[0][k][:2] for k in ((0, "a"), (4, "a"))] == [(1.0, -1.0), (3.0, 2.0)]
    plan = RE.plane_shifts(frame, KEYS, ["u"], ["v"], **how)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_correlations_and_report_of_whole_frames_like_those_over_blocks(spark):
    from swathline.operators import registration as RE

    frame = shifted_pairs(spark)
    far = frame.withColumn("c", F.col("c") + 119)
    sums = [{(r["scene_id"], r["part"], r["dy"], r["dx"]): tuple(round(r[n], 6) + 0.0 for n in ("ab", "aa", "bb")) for r in RE.plane_correlations(f, KEYS, ["u"], ["v"], 2).collect()} for f in (frame, far)]
    assert sums[0] == sums[1] and len(sums[0]) == 6 * 25
    names = ("state", "checks", "dy", "dx", "first_residual", "residual")
    headers = frame.select(*KEYS).distinct().select(
        *KEYS, F.lit("x").alias("crs_a"), F.lit("x").alias("crs_b"), F.lit(1.0).alias("gsd_a"), F.lit(1.0).alias("gsd_b"),
        (F.col("scene_id") != 2).alias("same_grid"), F.lit(False).alias("pregeoreferenced"), F.lit(0.8).alias("unit"),
    )
    one, other = ({(r["scene_id"], r["part"]): tuple(r[n] for n in names) for r in RE.registration_report(f, ["u"], ["v"], headers, KEYS, cross_modal=False, search=3, refine=0).collect()} for f in (frame, far))
    assert one == other and len(one) == 6
    assert one[0, "a"][0] == "corrected" and one[1, "b"][0] == "registered" and one[2, "a"][0] == "refused_grid"


def sparse_pixels(spark):
    """Scenes with holes, a cell that comes twice, NULL bands, a pixel without a place, a scene in parts of two blocks and one without a key."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(7):
        for r, c in np.ndindex(12, 12):
            if rng.random() < 0.5:
                red, green, nir = (float(x) for x in rng.integers(1, 90, 3))
                rows.append((None if i == 6 else i, "a", r + (400 if i == 2 and r > 5 else 0), c, None if i == 3 and c < 4 else red, None if i == 5 else green, nir if r else None))
    rows += [rows[0], (1, "a", None, 3, 80.0, 85.0, 4.0), (4, "a", 1, None, 80.0, 85.0, 84.0)]
    return spark.createDataFrame(rows, "scene_id long, part string, r long, c long, red double, green double, nir double")


def test_hints_of_scenes_with_holes_like_joined_ones(spark):
    from swathline.operators import fusion as FU

    pixels = sparse_pixels(spark).withColumn("mark", F.col("red") + 1)
    # Moved so that blocks cut every scene.
    far = pixels.withColumns({"r": F.col("r") + 115, "c": F.col("c") + 113})
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    got = FU.disagreement_hints(pixels, KEYS, ["mark"])
    other = FU.disagreement_hints(far, KEYS, ["mark"]).withColumns({"r": F.col("r") - 115, "c": F.col("c") - 113})
    assert rows(got) == rows(other)
    base = pixels.withColumn("ndvi", (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))).where("ndvi IS NOT NULL")
    cuts = {r["scene_id"]: (r["cut"], r["median"]) for r in base.groupBy("scene_id").agg(F.expr("percentile((red + green) / 2, 0.6)").alias("cut"), F.expr("percentile(ndvi, 0.5)").alias("median")).collect()}
    want = []
    for r in base.where("scene_id IS NOT NULL AND scene_id <> 5").collect():
        cut, median = cuts[r["scene_id"]]
        bright = None if r["green"] is None else (r["red"] + r["green"]) / 2
        want.append((r["scene_id"], "a", r["r"], r["c"], pytest.approx(r["ndvi"]), r["ndvi"] < 0.15 and bright > cut, median < 0.1, r["mark"]))
    assert rows(got) == sorted(want, key=lambda t: repr((*t[:4], got_ndvi(t[4]), *t[5:])))


def got_ndvi(x):
    return x.expected


def test_masks_meet_their_hints_without_a_join(spark):
    """Cuts are taken where a scene's pixels meet and stored with the masks; before, pixels were joined to them twice."""
    import __spark_entry__ as entrypoint

    made = entrypoint.queries()["FU07_classify_disagreement"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "lineitem" not in plan and "l_suppkey" not in plan
