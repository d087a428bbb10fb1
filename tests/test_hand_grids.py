"""Operators on small hand-made inputs, including the refusal paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.functions import answers as A
from swathline.functions import boxes as B
from swathline.functions import headers as H
from swathline.functions import labelling as L
from swathline.functions import pixel as P
from swathline.operators import change as CH
from swathline.operators import fusion as FU
from swathline.operators import regions as RG
from swathline.operators import stats as S
from swathline.operators import stencil as ST
from swathline.operators import tiles as TK
from swathline.sources import readers as RD


def grid(spark, array, name="v"):
    rows = [(1, r, c, None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(np.asarray(array, dtype=float))]
    return spark.createDataFrame(rows, f"scene_id long, r long, c long, {name} double")


def values(spark, items, key=1):
    return spark.createDataFrame([(key, None if x is None else float(x)) for x in items], "scene_id long, v double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for row in df.collect():
        if row[name] is not None:
            out[row["r"], row["c"]] = row[name]
    return out


def gate(spark, items, fixed=0.3):
    return S.gated_threshold(values(spark, items), ["scene_id"], "v", fixed).collect()[0]


def test_bimodal_values_pass_the_gate(spark):
    rng = np.random.default_rng(1)
    row = gate(spark, np.concatenate([rng.normal(0.1, 0.05, 500), rng.normal(0.8, 0.05, 500)]))
    # The criterion is flat across the gap between the modes and its lowest bin wins.
    assert row["method"] == "otsu" and row["ratio"] > 0.9 and 0.2 < row["value"] < 0.7


def test_lopsided_values_fall_back(spark):
    rng = np.random.default_rng(2)
    row = gate(spark, np.concatenate([rng.normal(0.1, 0.05, 990), rng.normal(0.8, 0.05, 10)]))
    assert row["method"] == "fixed_fallback" and row["value"] == 0.3


def test_constant_and_empty_scenes_fall_back(spark):
    assert gate(spark, [0.5] * 20)["ratio"] == 0.0
    row = gate(spark, [None] * 5)
    assert row["method"] == "fixed_fallback" and row["n_valid"] == 0 and row["hits"] == 0


def test_otsu_matches_a_dense_histogram(spark):
    x = np.random.default_rng(3).gamma(2.0, 1.0, 3000)
    counts, edges = np.histogram(x, bins=256)
    centres, w = (edges[:-1] + edges[1:]) / 2, counts / counts.sum()
    omega, mu = np.cumsum(w), np.cumsum(w * centres)
    with np.errstate(all="ignore"):
        between = np.where(omega * (1 - omega) > 0, (mu[-1] * omega - mu) ** 2 / (omega * (1 - omega)), 0)
    row = S.otsu_threshold(values(spark, x), ["scene_id"], "v").collect()[0]
    assert row["threshold"] == pytest.approx(centres[int(np.nanargmax(between))], abs=1e-9)


def test_middle_of_the_bins_does_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("v"))
    dealt = [rows.repartition(n, F.xxhash64("v", F.lit(n))) if n else rows.coalesce(1) for n in (0, 2, 7, 23)]
    sketches = {df.groupBy("k").agg(F.percentile_approx("v", F.lit(0.5), F.lit(100))).collect()[0][1] for df in dealt}
    assert len(sketches) > 1  # why a sketch won't do
    assert len({df.groupBy("k").agg(S.usual_value("v")).collect()[0][1] for df in dealt}) == 1


def test_percentiles_match_numpy_on_skewed_values(spark):
    x = np.concatenate([np.zeros(400), np.random.default_rng(4).lognormal(0, 3, 999), [1e9]])
    shares = {"a": 0.02, "b": 0.5, "c": 0.98, "d": 1.0}
    row = S.exact_percentiles(values(spark, x), ["scene_id"], "v", shares, bins=16).collect()[0]
    for name, p in shares.items():
        assert row[name] == pytest.approx(np.percentile(x, 100 * p), rel=1e-9)


def test_two_blobs(spark):
    mask = np.zeros((10, 10))
    mask[1:3, 1:3] = 1
    mask[5:9, 5:9] = 1
    found = RG.components(grid(spark, mask).where("v > 0"), ["scene_id"]).orderBy(F.desc("area_px")).collect()
    assert [r["area_px"] for r in found] == [16, 4]
    assert (found[0]["min_row"], found[0]["min_col"], found[0]["max_row"], found[0]["max_col"]) == (5, 5, 9, 9)
    assert (found[0]["centroid_r"], found[0]["centroid_c"]) == (6.5, 6.5)


def test_serpentine_is_one_region(spark):
    mask = np.zeros((15, 15))
    mask[::2, :] = 1
    for k, r in enumerate(range(1, 15, 2)):
        mask[r, 14 if k % 2 == 0 else 0] = 1
    found = RG.components(grid(spark, mask).where("v > 0"), ["scene_id"]).collect()
    assert len(found) == 1 and found[0]["area_px"] == int(mask.sum())


def test_box_mean_replicates_edges(spark):
    x = np.arange(35, dtype=float).reshape(5, 7) ** 1.5
    padded = np.pad(x, 2, mode="edge")
    want = np.array([[padded[r : r + 5, c : c + 5].mean() for c in range(7)] for r in range(5)])
    assert np.allclose(as_array(ST.box_mean(grid(spark, x), ["scene_id"], "v", 5), "mean", x.shape), want)


def test_even_window_is_refused(spark):
    with pytest.raises(ValueError):
        ST.box_mean(grid(spark, np.ones((3, 3))), ["scene_id"], "v", 4)


def test_opening_drops_specks(spark):
    mask = np.zeros((8, 8))
    mask[1, 1] = 1
    mask[3:7, 3:7] = 1
    frame = grid(spark, mask).withColumn("hit", F.col("v") > 0)
    out = as_array(ST.morphological_open(frame, ["scene_id"], "hit", 1).withColumn("h", F.col("hit").cast("double")), "h", mask.shape)
    assert out[1, 1] == 0 and out[4, 4] == 1 and out[3, 3] == 0


def test_refined_lee_matches_direct_windows(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(1.0, (9, 11))
    x[2, 3] = np.nan
    out = as_array(ST.refined_lee(grid(spark, x), ["scene_id"], "v"), "filtered", x.shape)
    valid = ~np.isnan(x)
    filled, weight = np.pad(np.where(valid, x, 0), 3, mode="edge"), np.pad(valid.astype(float), 3, mode="edge")
    yy, xx = np.mgrid[-3:4, -3:4]
    masks = [yy <= 0, yy >= 0, xx <= 0, xx >= 0, yy - xx <= 0, yy - xx >= 0, yy + xx <= 0, yy + xx >= 0]
    for (r, c), ok in np.ndenumerate(valid):
        f, w = filled[r : r + 7, c : c + 7], weight[r : r + 7, c : c + 7]
        ref = f[2:5, 2:5].sum() / w[2:5, 2:5].sum()
        stats = [((f * m).sum() / (w * m).sum(), (f * f * m).sum() / (w * m).sum()) for m in masks]
        mean, second = min(stats, key=lambda s: round(abs(s[0] - ref), 12))
        var = max(second - mean**2, 0)
        gain = min(max((var - mean**2) / (2 * var), 0), 1) if var > 0 else 0
        if ok:
            assert out[r, c] == pytest.approx(mean + gain * (x[r, c] - mean), rel=1e-9)
        else:
            assert np.isnan(out[r, c])


def masks(spark, optical, sar):
    rows = [(1, r, c, bool(optical[r][c]), bool(sar[r][c]), False, False) for r in range(len(optical)) for c in range(len(optical[0]))]
    return spark.createDataFrame(rows, "scene_id long, r long, c long, optical boolean, sar boolean, soil boolean, slope boolean")


@pytest.mark.parametrize(
    "optical, sar, target, verdict, cause, winner",
    [
        ([[1, 1], [0, 0]], [[1, 1], [0, 0]], "water", "consistent", None, None),
        ([[0, 0], [0, 0]], [[1, 1], [1, 0]], "water", "conflict", "cloud_over_water", "sar"),
        ([[1, 1], [1, 0]], [[0, 0], [0, 0]], "water", "conflict", "wind_roughened_surface", "optical"),
        ([[1, 1], [1, 0]], [[0, 0], [0, 1]], "builtup", "conflict", None, None),
    ],
)
def test_fusion_verdicts(spark, optical, sar, target, verdict, cause, winner):
    counts = FU.mask_counts(masks(spark, optical, sar), ["scene_id"])
    row = FU.fusion_verdicts(counts, ["scene_id"], F.lit(target), F.lit(False), F.lit(0.6), F.lit(0.5)).collect()[0]
    assert (row["verdict"], row["cause"], row["winner"]) == (verdict, cause, winner)


def test_change_ratio_is_null_when_absent_before(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 1)], "scene_id long, before int, after int")
    rows = {r["class_id"]: r for r in S.class_changes(pairs, ["scene_id"], "before", "after", None).collect()}
    assert rows[1]["class_change_ratio"] is None and rows[1]["delta_px"] == 2
    same = pairs.withColumn("after", F.col("before"))
    assert S.change_summary(same, ["scene_id"], "before", "after").collect()[0]["change_ratio"] == 0.0


def test_uncalibrated_radar_is_refused(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, 200.0), (2, -12.0), (2, 4.0), (3, None)], "scene_id long, db double")
    got = {r["scene_id"]: r["refused"] for r in S.decibel_check(rows, ["scene_id"], "db").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_db_floor(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1e-9,), (None,)], "p double")
    assert [r[0] for r in rows.select(P.to_db(F.col("p"))).collect()] == [-50.0, 0.0, -50.0, None]


@pytest.mark.parametrize(
    "text, want",
    [("north", "no"), ("There are no buildings", "no"), ("Yes.", "yes"), ("there is a lake", "yes"), ("hmm", "no")],
)
def test_yes_no(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in zip("tmb", A.yes_no(F.col("t")))]).collect()[0]
    assert row["t"] == want and row["m"] == (text != "hmm")


@pytest.mark.parametrize(
    "text, want, matched",
    [("1,250", "1", True), ("about 2.5", "2", True), ("none seen", "0", True), ("cannot be determined, not visible", "0", False), ("3.5", "4", True)],
)
def test_count(spark, text, want, matched):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in zip("tmb", A.count(F.col("t")))]).collect()[0]
    assert (row["t"], row["m"]) == (want, matched)


@pytest.mark.parametrize(
    "text, want",
    [
        ("(560,190),(650,290)", "[0.56 0.19, 0.65 0.29]"),
        ('[{"bbox_2d": [287, 97, 333, 148]}]', "[0.29 0.10, 0.33 0.15]"),
        ("[0.5 0.5, 0.5 0.9]", ""),
        ("unable to locate 1 2 3 4", ""),
    ],
)
def test_box_text(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in zip("tmb", A.located_box(F.col("t")))]).collect()[0]
    assert row["t"] == want


def test_normalise_keeps_decimals_and_drops_articles(spark):
    rows = spark.createDataFrame([("The  area: 12.5, an example. A.",)], "t string")
    assert rows.select(A.normalise(F.col("t"))).collect()[0][0] == "area 12.5 example"


def test_longer_vocabulary_entry_wins(spark):
    rows = spark.createDataFrame([("0 to 10 percent",), ("low vegetation",)], "t string")
    bands = rows.select(A.vocabulary(F.col("t"), A.RATIO_BANDS)[0].alias("a"), A.vocabulary(F.col("t"), A.LANDCOVER_ANSWERS)[0].alias("b")).collect()
    assert bands[0]["a"] == "0_to_10" and bands[1]["b"] == "low_vegetation"


def test_box_iou_and_inverted_corners(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    first, second = [F.col(x) for x in "abcd"], [F.col(x) for x in "efgh"]
    assert rows.select(B.box_iou(first, second)).collect()[0][0] == pytest.approx(1 / 7)
    assert rows.select(B.box_iou(first, first)).collect()[0][0] == 1.0
    bad = B.from_pixels([F.lit(5), F.lit(5), F.lit(1), F.lit(9)], F.lit(10), F.lit(10))
    assert rows.select(bad).collect()[0][0] is None


def test_diagonal_patch_settles_nothing(spark):
    row = spark.createDataFrame([("S2A_MSIL2A_20170613T101031_N9999_R022_T33UUP_45_45",), ("S2A_MSIL2A_20170613T101031_N9999_R022_T33UUP_00_91",)], "p string")
    parts = H.parse_patch_id(F.col("p"))
    got = row.select(parts["first"].alias("f"), parts["reject"].alias("x"), parts["original"].alias("o")).collect()
    assert got[0]["x"] is None and got[1]["x"] == "grid_index_out_of_range" and got[1]["o"].endswith("_00_91")
    corners = [H.patch_offsets(F.lit(45), F.lit(45), c) for c in ("col_row_from_northwest", "row_col_from_northwest")]
    same = row.select(*[F.struct(a, b).alias(f"k{i}") for i, (a, b) in enumerate(corners)]).collect()[0]
    assert same["k0"][0] == same["k1"][0] and same["k0"][1] == same["k1"][1]


def test_tiles_cover_the_scene(spark):
    scenes = spark.createDataFrame([(1, 1000, 700)], "scene_id long, height int, width int")
    tiles = TK.plan_tiles(scenes, "scene_id").where("NOT is_overview").collect()
    seen = np.zeros((1000, 700), dtype=bool)
    for t in tiles:
        seen[t["row_off"] : t["row_off"] + t["h"], t["col_off"] : t["col_off"] + t["w"]] = True
    assert seen.all()


def test_oversized_tiles_are_refused(spark):
    scenes = spark.createDataFrame([(1, 10, 10)], "scene_id long, height int, width int")
    with pytest.raises(ValueError):
        TK.plan_tiles_clamped(scenes, "scene_id", size=1024, overlap=0)


def test_footprint_without_id_is_an_error(spark):
    doc = spark.createDataFrame([([((None,), ("Polygon", [[[0.0, 0.0], [1.0, 0.0]]]))],)], RD.SCH.FOOTPRINTS)
    with pytest.raises(Exception, match="persistent Id"):
        RD.footprint_features(doc).collect()


def test_empty_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"sample_id": "1", "adapter": "a", "split": "train"}\n')
    with pytest.raises(ValueError):
        RD.read_manifest(spark, str(tmp_path), adapter="other")


def test_malformed_manifest_line_is_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"sample_id": "1", "adapter": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        RD.read_manifest(spark, str(tmp_path)).collect()


def test_referring_sentence_is_not_a_change_question(spark):
    rows = spark.createDataFrame([("The ship is centered in the image, positioned on the water between the two small harbors.",), ("Is there a ship on the left side of it?",)], "q string")
    got = rows.select(L.label_task(F.col("q"), F.lit(True), F.lit(False), F.lit(1))[0]).collect()
    assert [r[0] for r in got] == ["single_grounding", "single_vqa"]


def test_compass_needs_a_cluster(spark):
    rows = spark.createDataFrame([(10, 20, 7, 5), (10, 20, 5, 5), (5, 20, 5, 5), (10, 20, 7, 9)], "n long, f long, north long, east long")
    got = rows.select(CH.compass_side(F.col("n"), F.col("f"), F.col("north"), F.col("east"))).collect()
    assert [r[0] for r in got] == ["north", None, None, "east"]


def test_rasters_of_overlapping_rings_are_words_not_pixels_per_ring(spark):
    import re

    rng = np.random.default_rng(4)
    rows, want = [], set()
    for ring_id in range(40):
        points = rng.uniform(-9, 160, (int(rng.integers(3, 9)), 2))
        rows.append((ring_id % 3, ring_id, [(float(x), float(y)) for x, y in points]))
        ends = np.roll(points, -1, axis=0)
        for r in range(130):
            xs = [a[0] + (r + 0.5 - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(points, ends) if (a[1] <= r + 0.5) != (b[1] <= r + 0.5)]
            want |= {(ring_id % 3, r, c) for c in range(140) if sum(x < c + 0.5 for x in xs) % 2}
    rings = spark.createDataFrame(rows, "frame long, ring_id long, ring array<struct<x: double, y: double>>")
    out = RG.rasterize(rings, ["frame"], 130, 140)
    got = [tuple(r) for r in out.select("frame", "r", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate .*bit_or", plan) and plan.count("Aggregate") == 1  # pixels are made after the only shuffle


def test_clearest_cover_of_revisits_counts_every_scene(spark):
    from swathline.operators import rasters as R

    foot = [(i, i % 2, (i * 7) % 31, float(i % 3), 0.0, i % 3 + 2.0, 2.0) for i in range(60)]
    areas = [(a, a % 4 + 0.25, 0.5, a % 4 + 0.75, 1.0) for a in range(12)]
    scenes = spark.createDataFrame(foot, "scene_id long, win long, cloud long, west double, south double, east double, north double")
    out = R.clearest_cover(scenes, spark.createDataFrame(areas, "aoi long, west double, south double, east double, north double"), "win")
    want = set()
    for aoi, w, s, e, n in areas:
        for win in (0, 1):
            hits = [(f[2], f[0]) for f in foot if f[1] == win and f[3] <= w and f[4] <= s and f[5] >= e and f[6] >= n]
            if hits:
                want.add((aoi, win, len(hits), min(hits)[1], min(hits)[0]))
    assert {tuple(r) for r in out.collect()} == want
    # Scenes of one footprint are one row before the join.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 4


def test_shifts_of_a_frame_inside_one_block_equal_those_merged_from_blocks(spark):
    from swathline.operators import registration as RE

    rng = np.random.default_rng(9)
    plane = rng.normal(size=(24, 20)).cumsum(axis=0)
    frame = lambda x, name: grid(spark, x, "v").select("scene_id", "r", "c", F.col("v").alias(name))
    offsets, keys = RE.shift_offsets(2.0, 0.25), ["scene_id"]
    blocks = RE.frame_blocks(frame(plane, "a"), frame(np.roll(plane, 1, axis=1) + 0.1, "b"), keys, 4)
    here = RE.centred(blocks, keys, None)
    for cross, alone in ((True, RE.block_information), (False, RE.block_correlation)):
        merged = {(r["dy"], r["dx"]): r["score"] for r in RE.several_block_scores(here, keys, offsets, cross).collect()}
        best = RE.one_block_shifts(here, keys, offsets, alone)
        assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[0]
        got = {(r["dy"], r["dx"]): r["score"] for r in best.collect()}
        top = max(merged.values())
        assert got.keys() == {k for k, x in merged.items() if x >= top - RE.NEAR_BEST}
        assert all(x == pytest.approx(merged[k], abs=1e-12) for k, x in got.items())


def test_rotation_ranks_keys_and_leaves_texts_out_of_the_windows(spark):
    from swathline.operators import sampling as SM

    df = spark.createDataFrame([(i, f"long text {i}", f"ref {i}") for i in range(20)], "k long, payload string, ref string")
    out = SM.rotate_pairing(df, "k", ["ref"], offset=1)
    rows = out.collect()
    assert len(rows) == 20 and {r["ref"] for r in rows} == {f"ref {i}" for i in range(20)}
    assert all(r["payload"] == f"long text {r['k']}" and r["ref"] != f"ref {r['k']}" for r in rows)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x or "RepartitionByExpression" in x]
    assert windows and not any("payload" in x for x in windows)
