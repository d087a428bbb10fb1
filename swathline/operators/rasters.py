"""Raster operators that need a join or an aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions.pixel import stretch, stretch_uint8
from swathline.operators.frames import Planes, by_frames, frame_mean, frame_percentiles
from swathline.operators.joins import attach
from swathline.operators.ranking import null_safe_join
from swathline.operators.stats import exact_percentiles, stretch_bounds


def to_long(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """One row per pixel and band, NULL values dropped."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.band", "p.value").where("value IS NOT NULL")


def band_bounds(df: DataFrame, scene: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """2nd and 98th percentile of every band, one row per scene with a column pair per band."""
    low, high = C.STRETCH_PERCENTILES
    cuts = exact_percentiles(to_long(df, scene, bands), [*scene, "band"], "value", {"lo": low, "hi": high})
    picks = []
    for band in bands:
        for side in ("lo", "hi"):
            picks.append(F.max(F.when(F.col("band") == band, F.col(side))).alias(f"{band}_{side}"))
    return cuts.groupBy(*scene).agg(*picks)


def stretch_bands(df: DataFrame, scene: Sequence[str], bands: Sequence[str], eight_bit: bool = False) -> DataFrame:
    """Replace each band by its percentile stretch; bounds stay as provenance columns."""
    bounds = band_bounds(df, scene, bands)
    joined = attach(df, bounds, scene, "left")
    apply = stretch_uint8 if eight_bit else stretch
    for band in bands:
        joined = joined.withColumn(band, apply(F.col(band), F.col(f"{band}_lo"), F.col(f"{band}_hi")))
    return joined


def percentile_stretch(df: DataFrame, scene: Sequence[str], band: str) -> DataFrame:
    bounds = stretch_bounds(df, scene, band).drop("n")
    return attach(df, bounds, scene).withColumn("stretched", stretch(F.col(band), F.col("p_low"), F.col("p_high")))


def eight_bit_planes(planes: Planes, bands: Sequence[str]) -> Planes:
    """8-bit percentile stretch of bands of stacked frames, as :func:`stretch_uint8` does it."""
    out = {}
    for band in bands:
        x = planes[band]
        valid = ~np.isnan(x)
        low, high = frame_percentiles(x, valid, C.STRETCH_PERCENTILES)
        wide = high > low
        unit = np.clip((np.where(valid, x, 0.0) - low) / np.where(wide, high - low, 1.0), 0.0, 1.0)
        grey = np.where(valid, np.floor(np.nan_to_num(unit) * 255 + 1e-9), 0.0)
        out[band] = np.where(wide, grey, 128.0).astype(np.int32)
    return out


def composites(df: DataFrame, scene: Sequence[str], columns: Mapping[str, str], seen: str | None = None) -> DataFrame:
    """8-bit band triples; ``columns`` maps a band designation to its column.

    With ``seen``, ``df`` are complete frames, in which a NULL there marks the cells to leave out: frames inside
    one block are then stretched whole.
    """
    needed = sorted({b for triple in C.COMPOSITES.values() for b in triple})
    missing = [b for b in needed if b not in columns]
    if missing:
        raise ValueError(f"composites need {needed}; missing {missing}")
    if seen is None:
        renamed = df.select(*scene, "r", "c", *[F.col(columns[b]).cast("double").alias(b) for b in needed])
        pixels = stretch_bands(renamed, scene, needed, eight_bit=True)
    else:
        there = F.col(seen).isNotNull()
        marked = df.select(*scene, "r", "c", *[F.when(there, F.col(columns[b])).cast("double").alias(b) for b in needed], F.when(there, 1.0).alias("_seen"))
        work = lambda planes: eight_bit_planes(planes, needed) | {"_seen": planes["_seen"]}
        spread = lambda some: stretch_bands(some.where("_seen IS NOT NULL"), scene, needed, eight_bit=True)
        pixels = by_frames(marked, scene, [*needed, "_seen"], {b: "int" for b in needed} | {"_seen": "double"}, work, spread).where("_seen IS NOT NULL")
    images = F.array(
        *[
            F.struct(F.lit(name).alias("composite"), *[F.col(b).alias(slot) for b, slot in zip(triple, ("red8", "green8", "blue8"))])
            for name, triple in C.COMPOSITES.items()
        ]
    )
    return pixels.select(*scene, "r", "c", F.explode(images).alias("i")).select(*scene, "r", "c", "i.*")


def target_cells(scenes: DataFrame, height: Column, width: Column) -> DataFrame:
    """Every (r, c) of each scene's target grid, exploded in place."""
    rows = scenes.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), height.cast("long") - 1)))
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1)))


def resample_nearest(source: DataFrame, targets: DataFrame, keys: Sequence[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Nearest resampling by integer index scaling: one equi-join, no range condition."""
    hs, ws = src
    hd, wd = dst
    row = F.least(F.floor(F.col("r") * hs / hd), F.lit(hs - 1)).cast("long")
    col = F.least(F.floor(F.col("c") * ws / wd), F.lit(ws - 1)).cast("long")
    mapped = targets.withColumn("_sr", row).withColumn("_sc", col)
    cells = source.withColumnsRenamed({"r": "_sr", "c": "_sc"})
    return mapped.join(cells, [*keys, "_sr", "_sc"], "left").drop("_sr", "_sc")


def resample_bilinear(source: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Bilinear resampling on pixel centres with replicated edges.

    Each target explodes to its four weighted neighbours, which meet the source in one
    equi-join and fold back with a map-side-combined weighted mean over valid cells.
    """

    def axis(index: str, n_src: int, n_dst: int):
        at = F.least(F.greatest((F.col(index) + 0.5) * n_src / n_dst - 0.5, F.lit(0.0)), F.lit(float(n_src - 1)))
        low = F.floor(at)
        return low, F.least(low + 1, F.lit(n_src - 1)), at - low

    r0, r1, fr = axis("r", src[0], dst[0])
    c0, c1, fc = axis("c", src[1], dst[1])
    corner = lambda r, c, w: F.struct(r.alias("_sr"), c.alias("_sc"), w.alias("_w"))
    corners = F.array(
        corner(r0, c0, (1 - fr) * (1 - fc)), corner(r0, c1, (1 - fr) * fc),
        corner(r1, c0, fr * (1 - fc)), corner(r1, c1, fr * fc),
    )
    spread = targets.select(*keys, "r", "c", F.explode(corners).alias("k")).select(*keys, "r", "c", "k.*").where("_w > 0")
    cells = source.select(*keys, F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v"))
    seen = F.when(F.col("_v").isNotNull(), F.col("_w"))
    joined = spread.join(cells, [*keys, "_sr", "_sc"], "left")
    return joined.groupBy(*keys, "r", "c").agg((F.sum(seen * F.col("_v")) / F.sum(seen)).alias(value))


def resample(source, targets, keys, value, src, dst, classes: bool):
    """Class codes are never interpolated; continuous bands are bilinear."""
    if classes:
        return resample_nearest(source.select(*keys, "r", "c", value), targets, keys, src, dst)
    return resample_bilinear(source, targets, keys, value, src, dst)


def masked_share(df: DataFrame, keys: Sequence[str], bands: Sequence[str], stride: int = 1) -> DataFrame:
    """Share of exactly black pixels, of all or of every ``stride``-th row and column, with the audit band."""
    black = F.lit(True)
    for band in bands:
        black = black & (F.coalesce(F.col(band), F.lit(0)) == 0)
    share = F.avg(black.cast("double")).alias("share")
    sampled = df if stride == 1 else df.where((F.col("r") % stride == 0) & (F.col("c") % stride == 0))
    s = F.col("share")
    label = (
        F.when(s == 0, "clean").when(s < 0.01, "trace").when(s < 0.05, "light")
        .when(s < 0.20, "moderate").when(s < 0.99, "heavy").otherwise("blank")
    )
    return sampled.groupBy(*keys).agg(share).withColumn("band", label).withColumn("reject", s > C.MAX_MASKED_SHARE)


def tile_quality(df: DataFrame, keys: Sequence[str], date: str, red: Column, scl: Column) -> DataFrame:
    """Per tile: worst nodata and cloud share over its dates, and whether it is kept."""
    per_date = df.groupBy(*keys, date).agg(
        F.avg((red == 0).cast("double")).alias("black"),
        F.avg(scl.isin(*C.CLOUD_CLASSES).cast("double")).alias("cloud"),
    )
    worst = per_date.groupBy(*keys).agg(F.max("black").alias("black"), F.max("cloud").alias("cloud"))
    keep = (F.col("black") <= C.MAX_NODATA_SHARE) & (F.coalesce("cloud", F.lit(0.0)) <= C.MAX_CLOUD_SHARE)
    return worst.withColumn("keep", keep)


def clearest_cover(scenes: DataFrame, areas: DataFrame, window: str, cell: float = 1.0) -> DataFrame:
    """Lowest-cloud scene that contains each area, per time window.

    Containment is narrowed by an equi-join: an area sits in the cell of its south-west
    corner and a scene lists the cells its footprint touches, so no pair outside a shared
    cell is ever formed and the exact test only filters. Scenes of one footprint are one row with
    their number and clearest scene, and areas of one extent meet scenes once, so that revisits of
    the same ground add no pairs.
    """
    sides = ["west", "south", "east", "north"]
    scenes = scenes.groupBy(window, *sides).agg(F.count("*").alias("_n"), F.min(F.struct("cloud", "scene_id")).alias("_best"))
    index = lambda v: F.floor(v / cell)
    gridded = scenes.withColumn(
        "_cx", F.explode(F.sequence(index(F.col("west")), index(F.col("east"))))
    ).withColumn("_cy", F.explode(F.sequence(index(F.col("south")), index(F.col("north")))))
    boxes = areas.select(*sides).distinct().select(
        F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"),
        index(F.col("west")).alias("_cx"), index(F.col("south")).alias("_cy"),
    )
    inside = (F.col("west") <= F.col("w")) & (F.col("south") <= F.col("s")) & (F.col("east") >= F.col("e")) & (F.col("north") >= F.col("n"))
    hits = gridded.join(boxes, ["_cx", "_cy"]).where(inside)
    covers = hits.groupBy("w", "s", "e", "n", window).agg(F.sum("_n").alias("candidates"), F.min("_best").alias("best"))
    named = areas.select("aoi", F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"))
    # An area listed twice under one name counts its candidates twice.
    return named.join(covers, ["w", "s", "e", "n"]).groupBy("aoi", window).agg(
        F.sum("candidates").alias("candidates"), F.min("best").alias("best")
    ).select("aoi", window, "candidates", F.col("best.scene_id").alias("scene_id"), F.col("best.cloud").alias("cloud"))


FACTS = {"n": "long", "p_low": "double", "p_high": "double", "lowest": "double", "negative": "double", "n_pos": "long", "mean": "double", "std": "double", "skew": "double"}


def band_facts(bands: DataFrame, keyed: Sequence[str]) -> DataFrame:
    """``keyed`` and ``FACTS`` of the long pixel table: 1st and 99th percentile, lowest, share of negative, moments of positive values."""
    extremes = exact_percentiles(bands, keyed, "value", {"p_low": 0.01, "p_high": 0.99})
    positive = F.when(F.col("value") > 0, F.col("value"))
    moments = bands.groupBy(*keyed).agg(
        F.min("value").alias("lowest"),
        F.avg((F.col("value") < 0).cast("double")).alias("negative"),
        F.count(positive).alias("n_pos"),
        F.avg(positive).alias("mean"),
        F.stddev_pop(positive).alias("std"),
        F.skewness(positive).alias("skew"),
    )
    return null_safe_join(extremes, moments, keyed).select(*keyed, *FACTS)


def plane_facts(x: np.ndarray) -> Planes:
    """:func:`band_facts` of stacked frames, one value per frame."""
    known = ~np.isnan(x)
    positive = known & (np.nan_to_num(x) > 0)
    low, high = (p.ravel() for p in frame_percentiles(x, known, (0.01, 0.99)))
    n, n_pos = known.sum(axis=(1, 2)), positive.sum(axis=(1, 2))
    mean = frame_mean(x, positive)
    away = np.where(positive, x - mean, 0.0)
    some = np.where(n_pos > 0, n_pos, np.nan)
    top, least = (f(np.where(positive, x, other), axis=(1, 2)) for f, other in ((np.max, -np.inf), (np.min, np.inf)))
    std = np.where(top > least, np.sqrt((away**2).sum(axis=(1, 2)) / some), np.where(n_pos > 0, 0.0, np.nan))
    skew = np.divide((away**3).sum(axis=(1, 2)) / some, std**3, out=np.full(len(n), np.nan), where=std > 0)
    lowest, negative = np.min(np.where(known, x, np.inf), axis=(1, 2)), (known & (np.nan_to_num(x) < 0)).sum(axis=(1, 2)) / np.maximum(n, 1)
    return dict(zip(FACTS, (n, low, high, lowest, negative, n_pos, mean.ravel(), std, skew)))


def frame_band_facts(frame: DataFrame, scene: Sequence[str], products: Mapping[tuple[str, str], str]) -> DataFrame:
    """``scene, product, band`` and ``FACTS`` of complete frames; ``products`` maps a product's band to its column. Bands
    without any value have no row."""

    def work(planes: Planes) -> Planes:
        made = []
        for (product, band), column in products.items():
            facts = plane_facts(planes[column])
            of = np.flatnonzero(facts["n"])
            names = {"product": np.full(len(of), product, dtype=object), "band": np.full(len(of), band, dtype=object)}
            made.append(names | {k: v[of] for k, v in facts.items()} | {"_of": of})
        return {k: np.concatenate([m[k] for m in made]) for k in made[0]}

    def spread(some: DataFrame) -> DataFrame:
        values = [F.struct(F.lit(p).alias("product"), F.lit(b).alias("band"), F.col(c).cast("double").alias("value")) for (p, b), c in products.items()]
        return band_facts(some.select(*scene, F.explode(F.array(*values)).alias("x")).select(*scene, "x.*"), [*scene, "product", "band"])

    types = {"product": "string", "band": "string"} | FACTS
    return by_frames(frame, scene, list(products.values()), types, work, spread, per_frame=True)


def detect_modality(facts: DataFrame, keys: Sequence[str], tag_modality: DataFrame) -> DataFrame:
    """Sensor words, then the decibel signature, then the speckle signature, then optical.

    ``facts`` has the columns of :func:`band_facts` for every key and band; ``tag_modality`` has one row per
    key with column ``tagged``.
    """
    lo, hi = C.DB_RANGE
    decibel = (
        (F.col("n") >= C.MIN_BAND_VALUES)
        & F.col("p_low").between(lo, hi) & F.col("p_high").between(lo, hi)
        & (F.col("negative") >= C.DB_NEGATIVE_MIN)
        & (F.col("lowest") <= C.DB_MUST_REACH)
    )
    usable = F.col("n_pos") >= C.MIN_BAND_VALUES
    per_band = facts.select(
        *keys,
        decibel.alias("decibel"),
        F.when(usable, F.col("std") / F.col("mean")).alias("cv"),
        F.when(usable, F.when(F.col("std") > 0, F.col("skew")).otherwise(0.0)).alias("skew"),
    )
    scene = per_band.groupBy(*keys).agg(
        F.bool_or("decibel").alias("decibel"),
        F.percentile("cv", F.lit(0.5)).alias("cv"),
        F.percentile("skew", F.lit(0.5)).alias("skew"),
    )
    at_least = lambda pair: (F.col("cv") >= pair[0]) & (F.col("skew") >= pair[1])
    guess = (
        F.when(F.col("tagged").isNotNull(), F.col("tagged"))
        .when(F.col("decibel"), "sar")
        .when(at_least(C.SPECKLE_MIN), "sar")
        .when(at_least(C.AMBIGUOUS_MIN), "unknown")
        .otherwise("optical")
    )
    basis = (
        F.when(F.col("tagged").isNotNull(), "sensor_tag")
        .when(F.col("decibel") | at_least(C.AMBIGUOUS_MIN), "intensity_signature")
        .otherwise("band_count")
    )
    return null_safe_join(scene, tag_modality, keys, "left").select(
        *keys, guess.alias("modality"), basis.alias("basis"), "cv", "skew"
    )


def band_fingerprint(bands: DataFrame, scene: Sequence[str], reference: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Nearest published band per channel, with runner-up, margin and clash flag.

    The reference table has a fixed handful of rows, so it rides along as an array
    literal on the few channel rows.
    """
    means = (
        bands.groupBy(*scene, "band").agg(F.avg("value").alias("m"))
        .groupBy("band").agg(F.avg("m").alias("observed"))
    )
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(m).alias("mean")) for k, (m, _) in reference.items()])
    ranked = F.array_sort(
        F.transform(table, lambda t: F.struct(F.abs(F.col("observed") - t["mean"]).alias("gap"), t["name"].alias("name"), t["mean"].alias("mean")))
    )
    best = means.withColumn("ranked", ranked).select(
        "band", F.round("observed", 1).alias("observed_mean"),
        F.col("ranked")[0]["name"].alias("nearest"),
        F.round(F.col("ranked")[0]["mean"], 1).alias("nearest_reference_mean"),
        F.round(F.col("ranked")[0]["gap"], 1).alias("residual"),
        F.col("ranked")[1]["name"].alias("runner_up"),
        F.round(F.col("ranked")[1]["gap"] - F.col("ranked")[0]["gap"], 1).alias("margin"),
    )
    clashes = best.groupBy("nearest").agg((F.count("*") > 1).alias("duplicate"))
    return best.join(clashes, "nearest")


def raster_audit(rasters: DataFrame) -> DataFrame:
    """Verdict per modality over (modality, bands, dtype, height, width, vmin, vmax) rows.

    A modality without a single raster is MISSING.
    """
    expected = F.array(*[F.struct(F.lit(m).alias("modality")) for m in C.RASTER_EXPECTATIONS])
    wanted = rasters.sparkSession.range(1).select(F.explode(expected).alias("e")).select("e.modality")
    seen = rasters.groupBy("modality").agg(
        F.count("*").alias("checked"),
        F.min("bands").alias("min_bands"),
        F.array_join(F.array_sort(F.collect_set("dtype")), ",").alias("dtypes"),
        F.count_distinct("height", "width").alias("shapes"),
        F.min("vmin").alias("lowest"),
        F.max("vmax").alias("highest"),
    )
    joined = wanted.join(seen, "modality", "left")
    problems = F.lit(0)
    for modality, want in C.RASTER_EXPECTATIONS.items():
        here = F.col("modality") == modality
        wrong_type = ~F.arrays_overlap(F.split("dtypes", ","), F.array(*[F.lit(d) for d in want["dtypes"]]))
        wrong_range = ~(F.col("lowest") < 0) if want["negative"] else F.col("highest") <= 255
        faults = [F.col("min_bands") < want["min_bands"], wrong_type, wrong_range]
        problems = problems + sum((F.when(here & bad, 1).otherwise(0) for bad in faults), F.lit(0))
    return joined.withColumn("problems", problems).withColumn(
        "verdict",
        F.when(F.col("checked").isNull(), "MISSING").when(F.col("problems") > 0, "SUSPECT").otherwise("OK"),
    ).withColumn("checked", F.coalesce("checked", F.lit(0).cast("long")))
