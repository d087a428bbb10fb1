"""Neighbourhood operators on complete frames.

A frame row or column is the window unit, so a scene of any size is spread over as many tasks as
it has rows. Inputs are complete grids: one row per cell, invalid cells NULL. Borders replicate the
edge cell except where an operator says otherwise. Frames that lie inside one block are worked on
whole, in numpy, by the functions in ``*_planes``; the window passes are for the larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions.pixel import to_db
from swathline.operators.frames import Planes, blurred, by_frames, frame_mean, frame_percentiles, moved, stretched
from swathline.operators.joins import attach
from swathline.operators.ranking import null_safe_join
from swathline.operators.rasters import stretch_bands
from swathline.operators.stats import GATE, exact_percentiles, gate_planes, gated_threshold, with_method
from swathline.session import cut_lineage

Keys = Sequence[str]
#: Cells whose windows of grey-level pairs a task sorts at once.
GLCM_CELLS = 1 << 16


def along_row(keys: Keys):
    return W.partitionBy(*keys, "r").orderBy("c")


def along_column(keys: Keys):
    return W.partitionBy(*keys, "c").orderBy("r")


def by_row(frame: DataFrame, keys: Keys) -> DataFrame:
    """Spread a scene over its rows. The window needs this exchange anyway; asking for it by name keeps
    an input that is already hashed by scene from staying in one task."""
    return frame.repartition(*keys, "r")


def by_column(frame: DataFrame, keys: Keys) -> DataFrame:
    return frame.repartition(*keys, "c")


def neighbour(value: Column, offset: int, window) -> Column:
    """Cell at ``offset`` along the window; beyond the border, the nearest cell."""
    if offset == 0:
        return value
    shift = F.lag if offset < 0 else F.lead
    return F.coalesce(*[shift(value, k).over(window) for k in range(abs(offset), 0, -1)], value)


def fill_invalid(frame: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``filled`` is the value, or the scene mean of valid cells; ``valid`` remembers which."""
    means = frame.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return attach(frame.select(*keys, "r", "c", F.col(value).alias("_raw")), means, keys).select(
        *keys, "r", "c", F.coalesce("_raw", "_mean", F.lit(0.0)).alias("filled"), F.col("_raw").isNotNull().alias("valid")
    )


def texture_planes(x: np.ndarray, window: int) -> Planes:
    """``valid``, ``edges`` and ``variance`` of stacked frames, as in ``texture_parts``."""
    valid = ~np.isnan(x)
    mean = frame_mean(x, valid)
    v = np.where(valid, x, np.nan_to_num(mean))
    m = np.where(valid, x - mean, 0.0)
    # Scales are those of valid cells; a frame without any, or with a flat one, is 0.
    scaled = lambda y, peak: np.where(valid & (peak > 0), np.minimum(np.divide(y, peak, out=np.zeros_like(y), where=peak > 0), 1.0), 0.0)
    left, right = moved(v, -1, 2), moved(v, 1, 2)
    d, s = right - left, left + 2 * v + right
    gx, gy = moved(d, -1, 1) + 2 * d + moved(d, 1, 1), moved(s, 1, 1) - moved(s, -1, 1)
    density = blurred(np.sqrt(gx * gx + gy * gy), window)
    m, q = blurred(m, window), blurred(m * m, window)
    spread = np.maximum(q - m * m, 0.0)
    edge = frame_percentiles(density, valid, [0.99])[0]
    most = np.where(valid, spread, 0.0).max(axis=(1, 2), keepdims=True)
    return {"valid": valid, "edges": scaled(density, edge), "variance": scaled(spread, most)}


def box_means(frame: DataFrame, keys: Keys, columns: Sequence[str], window: int) -> DataFrame:
    """Separable w x w uniform filter of several columns in two window passes."""
    if window % 2 == 0:
        raise ValueError("window must be odd so the response stays grid-aligned")
    k = window // 2

    def blur(df: DataFrame, line, axis) -> DataFrame:
        df, spec = line(df, keys), axis(keys)
        total = lambda c: sum((neighbour(F.col(c), o, spec) for o in range(-k, k + 1)), F.lit(0.0)) / window
        return df.select(*[c for c in df.columns if c not in columns], *[total(c).alias(c) for c in columns])

    return blur(blur(frame, by_row, along_row), by_column, along_column)


def box_mean(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    filled = fill_invalid(frame, keys, value).withColumn("mean", F.col("filled"))
    return box_means(filled, keys, ["mean"], window).select(*keys, "r", "c", "mean")


def local_variance(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """max(E[x^2] - E[x]^2, 0) over its scene maximum; invalid cells are 0."""
    work = lambda planes: texture_planes(planes[value], window)
    return by_frames(frame, keys, [value], {n: TEXTURE_PARTS[n] for n in ("valid", "variance")}, work, lambda some: spread_local_variance(some, keys, value, window))


def spread_local_variance(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """:func:`local_variance` in window passes.

    Values are centred on the scene mean first, which leaves the variance unchanged and keeps
    the difference of squares well conditioned.
    """
    filled = fill_invalid(frame, keys, value)
    centre = filled.where("valid").groupBy(*keys).agg(F.avg("filled").alias("_m"))
    prepared = attach(filled, centre, keys, "left").select(
        *keys, "r", "c", "valid", (F.col("filled") - F.coalesce("_m", F.lit(0.0))).alias("m")
    ).withColumn("s", F.col("m") * F.col("m"))
    spread = box_means(prepared, keys, ["m", "s"], window).select(
        *keys, "r", "c", "valid", F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)).alias("v")
    )
    peak = spread.where("valid").groupBy(*keys).agg(F.max("v").alias("peak"))
    scaled = F.when(F.col("valid") & (F.col("peak") > 0), F.least(F.col("v") / F.col("peak"), F.lit(1.0))).otherwise(0.0)
    return attach(spread, peak, keys, "left").select(*keys, "r", "c", "valid", scaled.alias("variance"))


def edge_density(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """Box mean of the Sobel magnitude over its 99th percentile on valid cells; invalid cells are 0."""
    work = lambda planes: texture_planes(planes[value], window)
    return by_frames(frame, keys, [value], {n: TEXTURE_PARTS[n] for n in ("valid", "edges")}, work, lambda some: spread_edge_density(some, keys, value, window))


def spread_edge_density(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """:func:`edge_density` in window passes."""
    filled = fill_invalid(frame, keys, value)
    across, down = along_row(keys), along_column(keys)
    v = F.col("filled")
    left, right = neighbour(v, -1, across), neighbour(v, 1, across)
    first = by_row(filled, keys).select(*keys, "r", "c", "valid", (right - left).alias("d"), (left + 2 * v + right).alias("s"))
    d, s = F.col("d"), F.col("s")
    gx = neighbour(d, -1, down) + 2 * d + neighbour(d, 1, down)
    gy = neighbour(s, 1, down) - neighbour(s, -1, down)
    magnitude = by_column(first, keys).select(*keys, "r", "c", "valid", gx.alias("gx"), gy.alias("gy")).select(
        *keys, "r", "c", "valid", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("density")
    )
    density = box_means(magnitude, keys, ["density"], window)
    peak = exact_percentiles(density.where("valid"), keys, "density", {"peak": 0.99}).drop("n")
    scaled = F.when(F.col("valid") & (F.col("peak") > 0), F.least(F.col("density") / F.col("peak"), F.lit(1.0))).otherwise(0.0)
    return attach(density, peak, keys, "left").select(*keys, "r", "c", "valid", scaled.alias("edges"))


def texture_terms(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """``density`` and ``spread`` before scaling, as in ``edge_density`` and ``local_variance``, in one chain of passes.

    The first row and column pass carry the gradient and the box sums of value and square side by
    side; the second pair blurs the gradient's size. The mean that fills invalid cells is also the one
    that values are centred on, and neither filter needs a join of pixels.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd so the response stays grid-aligned")
    k = window // 2
    across, down = along_row(keys), along_column(keys)
    means = frame.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    filled = attach(frame.select(*keys, "r", "c", F.col(value).alias("_raw")), means, keys)
    base = filled.select(
        *keys, "r", "c", F.col("_raw").isNotNull().alias("valid"), F.coalesce("_raw", "_mean", F.lit(0.0)).alias("v"),
        F.coalesce(F.col("_raw") - F.col("_mean"), F.lit(0.0)).alias("m"),
    ).withColumn("q", F.col("m") * F.col("m"))
    blur = lambda c, axis: sum((neighbour(F.col(c), o, axis) for o in range(-k, k + 1)), F.lit(0.0)) / window
    v = F.col("v")
    left, right = neighbour(v, -1, across), neighbour(v, 1, across)
    rows = by_row(base, keys).select(
        *keys, "r", "c", "valid", (right - left).alias("d"), (left + 2 * v + right).alias("s"), blur("m", across).alias("m"), blur("q", across).alias("q")
    )
    d, s = F.col("d"), F.col("s")
    gx, gy = neighbour(d, -1, down) + 2 * d + neighbour(d, 1, down), neighbour(s, 1, down) - neighbour(s, -1, down)
    cells = by_column(rows, keys).select(*keys, "r", "c", "valid", gx.alias("gx"), gy.alias("gy"), blur("m", down).alias("m"), blur("q", down).alias("q"))
    cells = cells.select(
        *keys, "r", "c", "valid", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("density"),
        F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)).alias("spread"),
    )
    return box_means(cells, keys, ["density"], window)


TEXTURE_PARTS = {"valid": "boolean", "edges": "double", "variance": "double"}


def texture_parts(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """``keys, r, c, valid, edges, variance``."""
    if window % 2 == 0:
        raise ValueError("window must be odd so the response stays grid-aligned")
    work = lambda planes: texture_planes(planes[value], window)
    return by_frames(frame, keys, [value], TEXTURE_PARTS, work, lambda some: cut_lineage(spread_texture_parts(some, keys, value, window)))


def spread_texture_parts(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """:func:`texture_parts` in window passes. The terms are checkpointed: their scales are read off all of them first."""
    terms = cut_lineage(texture_terms(frame, keys, value, window))
    valid = terms.where("valid")
    peaks = exact_percentiles(valid, keys, "density", {"_edge": 0.99}).drop("n")
    peaks = null_safe_join(valid.groupBy(*keys).agg(F.max("spread").alias("_most")), peaks, keys, "left")
    scaled = lambda c, peak: F.when(F.col("valid") & (F.col(peak) > 0), F.least(F.col(c) / F.col(peak), F.lit(1.0))).otherwise(0.0)
    return attach(terms, peaks, keys, "left").select(*keys, "r", "c", "valid", scaled("density", "_edge").alias("edges"), scaled("spread", "_most").alias("variance"))


def mixed_response(parts: DataFrame, keys: Keys) -> DataFrame:
    mixed = F.least(0.6 * F.col("edges") + 0.4 * F.col("variance"), F.lit(1.0))
    return parts.select(*keys, "r", "c", F.when(F.col("valid"), mixed).alias("response"))


def texture_response(frame: DataFrame, keys: Keys, value: str, window: int = C.TEXTURE_WINDOW) -> DataFrame:
    """clip(0.6 edge density + 0.4 local variance), NULL on invalid cells."""
    return mixed_response(texture_parts(frame, keys, value, window), keys)


def response_planes(x: np.ndarray, window: int) -> np.ndarray:
    """:func:`rounded_response` of stacked frames; it is never negative, so half a unit up rounds as Spark does."""
    parts = texture_planes(x, window)
    response = np.minimum(0.6 * parts["edges"] + 0.4 * parts["variance"], 1.0)
    unit = 10.0**C.TEXTURE_DIGITS
    return np.where(parts["valid"], np.floor(response * unit + 0.5) / unit, np.nan)


def rounded_response(frame: DataFrame, keys: Keys, value: str, window: int) -> DataFrame:
    """:func:`texture_response` of frames over several blocks, to so many digits that the order of its sums moves no pixel past a cut."""
    response = mixed_response(cut_lineage(spread_texture_parts(frame, keys, value, window)), keys)
    return response.withColumn("response", F.round("response", C.TEXTURE_DIGITS))


def texture_gate(frame: DataFrame, keys: Keys, value: str, fixed: float, window: int = C.TEXTURE_WINDOW) -> DataFrame:
    """Decision rows of the texture response, as of :func:`gated_threshold`; no pixel of a small frame leaves the task that scores it."""
    if window % 2 == 0:
        raise ValueError("window must be odd so the response stays grid-aligned")
    work = lambda planes: gate_planes(response_planes(planes[value], window), fixed)
    spread = lambda some: gated_threshold(rounded_response(some, keys, value, window), keys, "response", fixed)
    return with_method(by_frames(frame, keys, [value], GATE, work, spread, per_frame=True), keys)


def texture_hits(frame: DataFrame, keys: Keys, value: str, fixed: float, window: int = C.TEXTURE_WINDOW) -> DataFrame:
    """``response`` of every cell and ``hit``: whether it reaches the cut of :func:`texture_gate`."""

    def work(planes: Planes) -> Planes:
        response = response_planes(planes[value], window)
        return {"response": response, "hit": response >= gate_planes(response, fixed)["value"][:, None, None]}

    def spread(some: DataFrame) -> DataFrame:
        response = rounded_response(some, keys, value, window)
        gate = gated_threshold(response, keys, "response", fixed).select(*keys, F.col("value").alias("_cut"))
        return attach(response, gate, keys, "left").withColumn("hit", F.coalesce(F.col("response") >= F.col("_cut"), F.lit(False)))

    return by_frames(frame, keys, [value], {"response": "double", "hit": "boolean"}, work, spread)


def local_std_3x3(frame: DataFrame, keys: Keys, value: str) -> DataFrame:
    """3 x 3 standard deviation; at distance one a reflected border equals a replicated one."""
    filled = fill_invalid(frame, keys, value)
    across, down = along_row(keys), along_column(keys)
    triple = by_row(filled, keys).withColumn("t", F.array(*[neighbour(F.col("filled"), o, across) for o in (-1, 0, 1)]))
    nine = by_column(triple, keys).select(*keys, "r", "c", F.concat(*[neighbour(F.col("t"), o, down) for o in (-1, 0, 1)]).alias("n"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    centred = nine.withColumn("m", total(F.col("n"), lambda x: x) / 9)
    return centred.select(*keys, "r", "c", F.sqrt(total(F.transform("n", lambda x: x - F.col("m")), lambda x: x * x) / 9).alias("std"))


LEE_RADIUS = 3
#: Columns each direction takes from the row at offset dy; None means the row is outside.
LEE_DIRECTIONS = (
    lambda dy: (-LEE_RADIUS, LEE_RADIUS) if dy <= 0 else None,
    lambda dy: (-LEE_RADIUS, LEE_RADIUS) if dy >= 0 else None,
    lambda dy: (-LEE_RADIUS, 0),
    lambda dy: (0, LEE_RADIUS),
    lambda dy: (dy, LEE_RADIUS),
    lambda dy: (-LEE_RADIUS, dy),
    lambda dy: (-LEE_RADIUS, -dy),
    lambda dy: (-dy, LEE_RADIUS),
)


def lee_planes(plane: np.ndarray, looks: float = 1.0) -> np.ndarray:
    """:func:`refined_lee` of stacked frames; NaN on invalid cells."""
    valid = ~np.isnan(plane)
    x = np.where(valid, plane, 0.0)
    offsets = range(-LEE_RADIUS, LEE_RADIUS + 1)
    prefixes = {}
    for name, y in (("w", valid.astype(float)), ("x", x), ("q", x * x)):
        sums = [np.zeros_like(x)]
        for o in offsets:
            sums.append(sums[-1] + moved(y, o, 2))
        prefixes[name] = np.stack(sums)
    spans: dict[tuple[str, int, int, int], np.ndarray] = {}

    def span(name: str, dy: int, low: int, high: int) -> np.ndarray:
        if (name, dy, low, high) not in spans:
            part = prefixes[name][high + LEE_RADIUS + 1] - prefixes[name][low + LEE_RADIUS]
            spans[name, dy, low, high] = moved(part, dy, 1)
        return spans[name, dy, low, high]

    def gather(rule, name: str) -> np.ndarray:
        return sum((span(name, dy, *rule(dy)) for dy in offsets if rule(dy) is not None), np.zeros_like(x))

    def ratio(rule, name: str, empty: np.ndarray | float) -> np.ndarray:
        weight = gather(rule, "w")
        return np.where(weight > 0.5, gather(rule, name) / np.where(weight > 0.5, weight, 1.0), empty)

    reference = ratio(lambda dy: (-1, 1) if abs(dy) <= 1 else None, "x", x)
    best = [np.full(x.shape, np.inf), np.zeros_like(x), np.zeros_like(x)]
    for rule in LEE_DIRECTIONS:
        m = ratio(rule, "x", 0.0)
        # Rounding the gap makes equal half-windows tie, and the first direction wins a tie.
        gap = np.round(np.abs(m - reference), 12)
        nearer = gap < best[0]
        best = [np.where(nearer, new, old) for new, old in zip((gap, m, ratio(rule, "q", 0.0)), best)]
    _, m, q = best
    variance = np.maximum(q - m * m, 0.0)
    cu2 = 1.0 / looks
    gain = np.where(variance > 0, (variance - cu2 * m * m) / np.where(variance > 0, variance * (1 + cu2), 1.0), 0.0)
    return np.where(valid, m + np.clip(gain, 0.0, 1.0) * (x - m), np.nan)


def refined_lee(frame: DataFrame, keys: Keys, value: str, looks: float = 1.0) -> DataFrame:
    """Eight half-window refined Lee filter (7 x 7) on linear power; invalid cells carry no weight and stay NULL."""
    work = lambda planes: {"filtered": lee_planes(planes[value], looks)}
    return by_frames(frame, keys, [value], {"filtered": "double"}, work, lambda some: spread_refined_lee(some, keys, value, looks))


def spread_refined_lee(frame: DataFrame, keys: Keys, value: str, looks: float = 1.0) -> DataFrame:
    """:func:`refined_lee` in window passes.

    A row pass keeps the seven prefix sums of weight, value and square, so any span of columns
    is a difference of two; a column pass adds the span each direction wants from every row. Two
    window passes replace a 49-cell join.
    """
    across, down = along_row(keys), along_column(keys)
    radius, directions = LEE_RADIUS, LEE_DIRECTIONS
    x = F.coalesce(F.col(value), F.lit(0.0))
    base = frame.select(*keys, "r", "c", F.col(value).isNotNull().alias("valid"), F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0).alias("w"), x.alias("x"))
    cell = F.struct("w", "x")
    row = by_row(base, keys).withColumn("n", F.array(*[neighbour(cell, o, across) for o in range(-radius, radius + 1)]))
    at = lambda i: F.get(F.col("n"), F.lit(i))

    def prefixes(pick) -> Column:
        sums, acc = [], F.lit(0.0)
        for i in range(2 * radius + 1):
            acc = acc + pick(at(i))
            sums.append(acc)
        return F.array(F.lit(0.0), *sums)

    summed = row.select(
        *keys, "r", "c", "valid", "x",
        F.struct(prefixes(lambda n: n["w"]).alias("w"), prefixes(lambda n: n["x"]).alias("x"), prefixes(lambda n: n["x"] * n["x"]).alias("q")).alias("p"),
    )
    stacked = by_column(summed, keys).select(*keys, "r", "c", "valid", "x", *[neighbour(F.col("p"), o, down).alias(f"p{o + radius}") for o in range(-radius, radius + 1)])

    def span(dy: int, field: str, low: int, high: int) -> Column:
        part = F.col(f"p{dy + radius}.{field}")
        return F.get(part, F.lit(high + radius + 1)) - F.get(part, F.lit(low + radius))

    def gather(rule, field: str) -> Column:
        spans = [(dy, rule(dy)) for dy in range(-radius, radius + 1)]
        return sum((span(dy, field, *cols) for dy, cols in spans if cols is not None), F.lit(0.0))

    near = lambda dy: (-1, 1) if abs(dy) <= 1 else None
    sums = stacked.select(
        *keys, "r", "c", "valid", "x", gather(near, "w").alias("w3"), gather(near, "x").alias("x3"),
        *[gather(rule, field).alias(f"{field}_{i}") for i, rule in enumerate(directions) for field in "wxq"],
    )
    reference = F.when(F.col("w3") > 0.5, F.col("x3") / F.col("w3")).otherwise(F.col("x"))
    ratio = lambda field, i: F.when(F.col(f"w_{i}") > 0.5, F.col(f"{field}_{i}") / F.col(f"w_{i}")).otherwise(0.0)
    means = sums.select(
        *keys, "r", "c", "valid", "x", reference.alias("ref"),
        *[ratio(field, i).alias(f"{name}_{i}") for i in range(len(directions)) for field, name in (("x", "m"), ("q", "s"))],
    )
    # Rounding the gap makes equal half-windows tie, and the first direction wins a tie.
    ranked = F.array(*[
        F.struct(F.round(F.abs(F.col(f"m_{i}") - F.col("ref")), 12).alias("gap"), F.lit(i).alias("i"), F.col(f"m_{i}").alias("m"), F.col(f"s_{i}").alias("q"))
        for i in range(len(directions))
    ])
    best = means.select(*keys, "r", "c", "valid", "x", F.array_min(ranked).alias("b"))
    variance = F.greatest(F.col("b.q") - F.col("b.m") * F.col("b.m"), F.lit(0.0))
    cu2 = 1.0 / looks
    gain = F.when(F.col("var") > 0, (F.col("var") - cu2 * F.col("b.m") * F.col("b.m")) / (F.col("var") * (1 + cu2))).otherwise(0.0)
    out = best.withColumn("var", variance).withColumn("gain", F.least(F.greatest(gain, F.lit(0.0)), F.lit(1.0)))
    return out.select(*keys, "r", "c", F.when(F.col("valid"), F.col("b.m") + F.col("gain") * (F.col("x") - F.col("b.m"))).alias("filtered"))


def quantise(frame: DataFrame, keys: Keys, value: str, levels: int) -> DataFrame:
    """Grey levels between the 2nd and 98th percentile of valid cells; invalid cells take the mean."""
    low, high = C.STRETCH_PERCENTILES
    cuts = exact_percentiles(frame, keys, value, {"lo": low, "hi": high}).drop("n")
    top = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + C.STRETCH_EPSILON).otherwise(F.col("hi"))
    level = F.floor((F.col("filled") - F.col("lo")) / (top - F.col("lo")) * levels)
    bounded = F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1)).cast("int")
    return attach(fill_invalid(frame, keys, value), cuts, keys, "left").select(*keys, "r", "c", "valid", F.coalesce(bounded, F.lit(0)).alias("level"))


def glcm_planes(x: np.ndarray, window: int, levels: int) -> np.ndarray:
    """:func:`glcm_entropy` of stacked frames."""
    valid = ~np.isnan(x)
    low, high = frame_percentiles(x, valid, C.STRETCH_PERCENTILES)
    top = np.where(high <= low, low + C.STRETCH_EPSILON, high)
    level = np.floor((np.where(valid, x, np.nan_to_num(frame_mean(x, valid))) - low) / (top - low) * levels)
    level = np.clip(np.nan_to_num(level), 0, levels - 1).astype(np.int32)
    pair = level * levels + np.roll(level, -1, axis=2)
    k, n = window // 2, window * window
    wide = np.pad(pair, ((0, 0), (k, k), (k, k)), mode="edge").astype(np.int16 if levels * levels < 2**15 else np.int32)
    around = np.lib.stride_tricks.sliding_window_view(wide, (window, window), axis=(1, 2))
    term = np.arange(n + 1) * np.log2(np.maximum(np.arange(n + 1), 1))
    mass = np.empty(x.shape)
    size = max(1, GLCM_CELLS // (x.shape[1] * x.shape[2]))
    for at in range(0, len(x), size):
        symbols = np.sort(around[at : at + size].reshape(-1, n), axis=1)
        new = np.ones(symbols.shape, dtype=bool)
        np.not_equal(symbols[:, 1:], symbols[:, :-1], out=new[:, 1:])
        first = np.flatnonzero(new)
        runs = term[np.diff(np.r_[first, symbols.size])]
        mass[at : at + size] = np.add.reduceat(runs, np.r_[0, np.cumsum(new.sum(axis=1))[:-1]]).reshape(-1, *x.shape[1:])
    entropy = (np.log2(float(n)) - mass / n) / np.log2(float(levels * levels))
    return np.where(valid, np.clip(entropy, 0.0, 1.0), 0.0)


def glcm_entropy(frame: DataFrame, keys: Keys, value: str, window: int = C.TEXTURE_WINDOW, levels: int = C.GLCM_LEVELS) -> DataFrame:
    """Entropy of horizontal grey-level pairs in a window, over log2(levels^2); invalid cells are 0.

    The right neighbour of the last column is the first one.
    """
    work = lambda planes: {"entropy": glcm_planes(planes[value], window, levels)}
    return by_frames(frame, keys, [value], {"entropy": "double"}, work, lambda some: spread_glcm_entropy(some, keys, value, window, levels))


def spread_glcm_entropy(frame: DataFrame, keys: Keys, value: str, window: int, levels: int) -> DataFrame:
    """:func:`glcm_entropy` in window passes.

    A window's symbols are an array of w^2 ints built by two window passes; sorted run lengths give sum(c log2 c).
    """
    across, down = along_row(keys), along_column(keys)
    k = window // 2
    whole_row = W.partitionBy(*keys, "r").orderBy("c").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    symbols = by_row(quantise(frame, keys, value, levels), keys).withColumn(
        "sym", F.col("level") * levels + F.coalesce(F.lead("level", 1).over(across), F.first("level").over(whole_row))
    )
    rows = symbols.withColumn("a", F.array(*[neighbour(F.col("sym"), o, across) for o in range(-k, k + 1)]))
    cells = by_column(rows, keys).select(*keys, "r", "c", "valid", F.array_sort(F.concat(*[neighbour(F.col("a"), o, down) for o in range(-k, k + 1)])).alias("w"))
    term = lambda n: F.when(n > 0, n * F.log2(F.when(n > 0, n))).otherwise(0.0)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        run = F.when(same, acc["run"] + 1).otherwise(1.0)
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + term(run) - F.when(same, term(acc["run"])).otherwise(0.0)).alias("sum"))

    n = float(window * window)
    mass = F.aggregate("w", start, step, lambda acc: acc["sum"])
    entropy = (F.log2(F.lit(n)) - mass / n) / F.log2(F.lit(float(levels * levels)))
    return cells.select(*keys, "r", "c", F.when(F.col("valid"), F.least(F.greatest(entropy, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("entropy"))


def stack_planes(x: np.ndarray, window: int, levels: int) -> Planes:
    """Decibels, speckle-filtered decibels and entropy of stacked frames, each stretched between its 2nd and 98th percentile."""
    valid = ~np.isnan(x)
    power = lee_planes(10.0 ** (x / 10))
    floor = np.where(power > 0, np.maximum(10.0 * np.log10(np.where(power > 0, power, 1.0)), C.DB_FLOOR), C.DB_FLOOR)
    bands = {"sigma0": x, "lee_db": floor, "entropy": glcm_planes(x, window, levels)}
    return {n: np.where(valid, stretched(y, *frame_percentiles(y, valid, C.STRETCH_PERCENTILES)), np.nan) for n, y in bands.items()}


def single_pol_stack(frame: DataFrame, keys: Keys, value: str, window: int = C.TEXTURE_WINDOW, levels: int = C.GLCM_LEVELS) -> DataFrame:
    """``sigma0``, ``lee_db`` and ``entropy`` of one polarisation in decibels, stretched; NULL on invalid cells."""

    def spread(some: DataFrame) -> DataFrame:
        linear = some.select(*keys, "r", "c", F.pow(F.lit(10.0), F.col(value) / 10).alias("_p"))
        filtered = spread_refined_lee(linear, keys, "_p").withColumn("lee_db", to_db(F.col("filtered")))
        stack = some.select(*keys, "r", "c", F.col(value).alias("sigma0"))
        for more, name in ((filtered, "lee_db"), (spread_glcm_entropy(some, keys, value, window, levels), "entropy")):
            stack = null_safe_join(stack, more.select(*keys, "r", "c", name), [*keys, "r", "c"])
        stack = stack.withColumn("entropy", F.when(F.col("sigma0").isNotNull(), F.col("entropy")))
        return stretch_bands(stack, keys, ["sigma0", "lee_db", "entropy"])

    made = {n: "double" for n in ("sigma0", "lee_db", "entropy")}
    return by_frames(frame, keys, [value], made, lambda planes: stack_planes(planes[value], window, levels), spread)


def opened_planes(hit: np.ndarray, radius: int) -> np.ndarray:
    """:func:`morphological_open` of stacked frames."""
    for erode in (True, False) if radius > 0 else ():
        wide = np.pad(hit, ((0, 0), (radius, radius), (radius, radius)))
        at = [(radius + dy, radius + dx) for dy, w in disk_spans(radius).items() for dx in range(-w, w + 1)]
        cells = [wide[:, r : r + hit.shape[1], c : c + hit.shape[2]] for r, c in at]
        hit = (np.logical_and if erode else np.logical_or).reduce(cells)
    return hit


def disk_spans(radius: int) -> dict[int, int]:
    """Row offset -> half width of the disk."""
    return {dy: int((radius * radius - dy * dy) ** 0.5) for dy in range(-radius, radius + 1)}


def morphological_open(frame: DataFrame, keys: Keys, hit: str, radius: int = C.OPENING_RADIUS) -> DataFrame:
    """Erosion then dilation with a disk; outside the frame counts as background."""
    if radius <= 0:
        return frame.select(*keys, "r", "c", F.col(hit).alias("hit"))
    spans = disk_spans(radius)
    widths = sorted(set(spans.values()))

    def pass_(df: DataFrame, erode: bool) -> DataFrame:
        across, down = along_row(keys), along_column(keys)
        v = F.col("hit").cast("int")
        sums = [F.coalesce(F.sum(v).over(across.rowsBetween(-w, w)), F.lit(0)).alias(f"s{w}") for w in widths]
        flat = by_row(df, keys).select(*keys, "r", "c", *sums)
        flags = flat.select(*keys, "r", "c", *[(F.col(f"s{w}") == 2 * w + 1 if erode else F.col(f"s{w}") > 0).alias(f"f{w}") for w in widths])
        out = None
        for dy, w in spans.items():
            cell = F.col(f"f{w}") if dy == 0 else (F.lag(f"f{w}", -dy, False).over(down) if dy < 0 else F.lead(f"f{w}", dy, False).over(down))
            out = cell if out is None else (out & cell if erode else out | cell)
        return by_column(flags, keys).select(*keys, "r", "c", out.alias("hit"))

    start = frame.select(*keys, "r", "c", F.coalesce(F.col(hit), F.lit(False)).alias("hit"))
    return pass_(pass_(start, True), False)


def terrain_shadow(frame: DataFrame, keys: Keys, dem: str, pixel_size: float, look_azimuth: float, incidence: float = 35.0) -> DataFrame:
    """Slope away from the look direction steeper than the grazing angle."""
    across, down = along_row(keys), along_column(keys)
    z = F.col(dem)

    def gradient(spec) -> Column:
        before, after = F.lag(z).over(spec), F.lead(z).over(spec)
        return F.when(before.isNull(), (after - z) / pixel_size).when(after.isNull(), (z - before) / pixel_size).otherwise((after - before) / (2 * pixel_size))

    easting = by_row(frame.select(*keys, "r", "c", dem), keys).withColumn("east", gradient(across))
    slopes = by_column(easting, keys).select(*keys, "r", "c", "east", (-gradient(down)).alias("north"))
    azimuth = F.radians(F.lit(look_azimuth))
    along = F.col("east") * F.sin(azimuth) + F.col("north") * F.cos(azimuth)
    return slopes.select(*keys, "r", "c", along.alias("along_look"), (F.atan(-along) > F.radians(F.lit(90.0 - incidence))).alias("shadow"))
