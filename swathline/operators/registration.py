"""Co-registration of two planes by searching shifts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.frames import Planes, by_frames, frame_mean
from swathline.operators.joins import attach
from swathline.operators.ranking import null_safe_join
from swathline.operators.stats import equal_width_bin
from swathline.session import cut_lineage

Keys = Sequence[str]
SEARCH_PX = 8
REFINE_STEPS = 2
MAX_GSD_RATIO = 4.0
#: Frames are read in blocks of this many rows and columns, each with a rim that shifts may reach into.
BLOCK_PX = 128
#: Cells of shifted planes that a task holds at once.
PLANE_CELLS = 1 << 19
#: Cells of shifted planes that are worked on at once where whole frames are stacked: few enough for a core's cache.
STACK_CELLS = 1 << 17
#: Logarithms are whole numbers of this many parts, so that equal histograms score alike in any order of their cells.
LOG_PARTS = float(1 << 44)
#: Shifts this close to a frame's best score go on to the choice by rounded score.
NEAR_BEST = 1e-8


def standardise_plane(frame: DataFrame, keys: Keys, bands: Sequence[str], name: str = "z") -> DataFrame:
    """Mean over bands, invalid cells filled with the mean, zero mean and unit scale; constant is 0."""
    plane = sum((F.col(b) for b in bands), F.lit(0.0)) / len(bands)
    base = frame.select(*keys, "r", "c", plane.alias("_p"))
    means = base.groupBy(*keys).agg(F.avg("_p").alias("_m"))
    filled = attach(base, means, keys).withColumn("_p", F.coalesce("_p", "_m") - F.col("_m"))
    # After filling with the mean the mean is unchanged, so the centred plane has mean zero.
    spread = filled.groupBy(*keys).agg(F.stddev_pop("_p").alias("_s"))
    scaled = F.when(F.col("_s") > 0, F.col("_p") / F.col("_s")).otherwise(0.0)
    return attach(filled, spread, keys).select(*keys, "r", "c", scaled.alias(name))


def mutual_information(pairs: DataFrame, keys: Keys, a: str, b: str, bins: int = C.MI_BINS) -> DataFrame:
    """Bits of mutual information over a bins x bins histogram on each plane's own range.

    The histogram of a key has at most bins x bins rows, so its marginals are grouped sums of that
    bounded table.
    """
    ranges = pairs.groupBy(*keys).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    cell = equal_width_bin(F.col(a), F.col("_a0"), F.col("_a1"), bins).cast("long") * bins + equal_width_bin(F.col(b), F.col("_b0"), F.col("_b1"), bins)
    counts = attach(pairs, ranges, keys).groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    tables = counts.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "_n")).alias("_h"))

    @F.pandas_udf("double")
    def bits(histograms: pd.Series) -> pd.Series:
        return pd.Series([information(np.bincount([x["_cell"] for x in h], [x["_n"] for x in h], bins * bins).reshape(bins, bins)) for h in histograms])

    return tables.select(*keys, bits("_h").alias("mi"))


def standardised(stack: np.ndarray) -> np.ndarray:
    """:func:`standardise_plane` of stacked frames."""
    valid = ~np.isnan(stack)
    filled = np.where(valid, stack - frame_mean(stack, valid), 0.0)
    spread = filled.std(axis=(1, 2), keepdims=True)
    return np.divide(filled, spread, out=np.zeros_like(filled), where=spread > 0)


def stack_information(a: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    """:func:`mutual_information` of stacked frames, one value per frame."""
    n, total = len(a), float(a[0].size)
    cell = np.arange(n)[:, None]
    for x in (a.reshape(n, -1), b.reshape(n, -1)):
        low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
        wide = high > low
        place = np.where(wide, np.minimum(np.floor((x - low) / np.where(wide, high - low, 1.0) * float(bins)), bins - 1), 0)
        cell = cell * bins + place.astype(np.int64)
    joint = np.bincount(cell.ravel(), minlength=n * bins * bins).reshape(n, bins, bins)
    f, i, j = np.nonzero(joint)
    count = joint[f, i, j].astype(float)
    expected = joint.sum(axis=2)[f, i].astype(float) * joint.sum(axis=1)[f, j].astype(float)
    return np.bincount(f, count / total * np.log2(count * total / expected), n)


def plane_information(frame: DataFrame, keys: Keys, first: Sequence[str], second: Sequence[str], bins: int = C.MI_BINS, digits: int = 9) -> DataFrame:
    """``keys, mi``: mutual information of two standardised planes of one complete frame, each the mean of its bands."""

    def work(planes: Planes) -> Planes:
        a, b = (standardised(sum((planes[x] for x in bands), 0.0) / len(bands)).round(digits) for bands in (first, second))
        size = max(1, PLANE_CELLS // (bins * bins))
        parts = [stack_information(a[at : at + size], b[at : at + size], bins) for at in range(0, len(a), size)]
        return {"mi": np.concatenate(parts)}

    def spread(some: DataFrame) -> DataFrame:
        a, b = (standardise_plane(some, keys, bands, n).withColumn(n, F.round(n, digits)) for bands, n in ((first, "a"), (second, "b")))
        return mutual_information(null_safe_join(a, b, [*keys, "r", "c"]), keys, "a", "b", bins)

    return by_frames(frame, keys, [*dict.fromkeys([*first, *second])], {"mi": "double"}, work, spread, per_frame=True)


def information(counts: np.ndarray) -> float:
    """Bits of mutual information of a joint histogram."""
    i, j = np.nonzero(counts)
    n, total = counts[i, j].astype(float), float(counts.sum())
    expected = counts.sum(axis=1)[i].astype(float) * counts.sum(axis=0)[j].astype(float)
    return float(np.sum(n / total * np.log2(n * total / expected)))


def ncc(pairs: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    norm = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return pairs.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(x * y), norm), F.lit(0.0)).alias("ncc"))


def shift_offsets(radius: float, step: float) -> np.ndarray:
    """Candidate shifts (dy, dx) around a centre in row-major order."""
    axis = np.arange(int(round(2 * radius / step)) + 1) * step - radius
    return np.stack(np.meshgrid(axis, axis, indexing="ij"), axis=-1).reshape(-1, 2)


def frame_blocks(reference: DataFrame, moving: DataFrame, keys: Keys, reach: int, block: int = BLOCK_PX) -> DataFrame:
    """One row per block of a frame: the reference cells inside it and the moving cells of it and of a rim of ``reach``.

    Each pixel is shuffled once, with the copies that the rims of neighbouring blocks need; a frame
    of any size is many blocks. Missing reference cells are NaN and left out of every score.
    """
    near = lambda x, by: F.floor((F.col(x) + by) / block)
    own = reference.select(*keys, near("r", 0).alias("br"), near("c", 0).alias("bc"), F.lit(0).alias("kind"), "r", "c", F.col("a").alias("v"))
    copies = moving.select(*keys, "r", "c", F.col("b").alias("v"), F.explode(F.sequence(near("r", -reach), near("r", reach))).alias("br"))
    copies = copies.select("*", F.explode(F.sequence(near("c", -reach), near("c", reach))).alias("bc"))
    cells = own.unionByName(copies.withColumn("kind", F.lit(1)))
    names = [*keys, "br", "bc"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[names].head(1).reset_index(drop=True)
        for kind, prefix in ((0, "a"), (1, "b")):
            part = pdf[pdf["kind"] == kind]
            if not len(part):
                return out.iloc[:0].reindex(columns=columns)
            r, c = part["r"].to_numpy(np.int64), part["c"].to_numpy(np.int64)
            grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
            grid[r - r.min(), c - c.min()] = part["v"].to_numpy(float)
            out[f"{prefix}_r"], out[f"{prefix}_c"], out[f"{prefix}_w"] = r.min(), c.min(), grid.shape[1]
            out[f"{prefix}_v"] = [grid.tobytes()]
        return out[columns]

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    made = [f"{p}_{x} {'binary' if x == 'v' else 'long'}" for p in "ab" for x in ("r", "c", "w", "v")]
    columns = [*names, *[m.split()[0] for m in made]]
    schema = ", ".join([*[f"`{n}` {types[n]}" for n in names], *made])
    return cells.groupBy(*names).applyInPandas(pack, schema)


class Block:
    """The cells of one block, and the moving cells beside them under a shift."""

    def __init__(self, row: dict) -> None:
        a = np.frombuffer(row["a_v"], dtype=float).reshape(-1, row["a_w"])
        self.moving = np.frombuffer(row["b_v"], dtype=float).reshape(-1, row["b_w"])
        r, c = np.nonzero(~np.isnan(a))
        self.a = a[r, c]
        self.r, self.c = r + row["a_r"] - row["b_r"], c + row["a_c"] - row["b_c"]

    def at(self, dy: float, dx: float) -> np.ndarray:
        """The moving plane shifted by (dy, dx), interpolated linearly; beyond its border the border goes on."""
        i, j = int(np.floor(-dy)), int(np.floor(-dx))
        fy, fx = -dy - i, -dx - j
        rows, columns = self.moving.shape
        line = lambda di: np.clip(self.r + (i + di), 0, rows - 1)
        place = lambda dj: np.clip(self.c + (j + dj), 0, columns - 1)

        def across(di: int) -> np.ndarray:
            left = self.moving[line(di), place(0)]
            return left * (1 - fx) + self.moving[line(di), place(1)] * fx if fx > 0 else left

        return across(0) * (1 - fy) + across(1) * fy if fy > 0 else across(0)


    def planes(self, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """:meth:`at` of many shifts, one row each, in parts of at most ``PLANE_CELLS`` cells."""
        size = max(1, PLANE_CELLS // max(1, len(self.a)))
        rows, columns = self.moving.shape
        for start in range(0, len(shifts), size):
            part = slice(start, min(start + size, len(shifts)))
            if np.isnan(self.moving).any():
                yield part, np.stack([self.at(dy, dx) for dy, dx in shifts[part]])
                continue
            whole = np.floor(-shifts[part])
            (i, j), (fy, fx) = whole.astype(np.int64).T, (-shifts[part] - whole).T[:, :, None]
            line = lambda di: np.clip(self.r + (i + di)[:, None], 0, rows - 1) * columns
            place = lambda dj: np.clip(self.c + (j + dj)[:, None], 0, columns - 1)
            left, right = place(0), place(1) if fx.any() else None

            def across(di: int) -> np.ndarray:
                at = line(di)
                first = self.moving.ravel()[at + left]
                return first if right is None else first * (1 - fx) + self.moving.ravel()[at + right] * fx

            yield part, across(0) * (1 - fy) + across(1) * fy if fy.any() else across(0)


def bins_of(values: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    if not high > low:
        return np.zeros(len(values), dtype=np.int64)
    return np.minimum(np.floor((values - low) / (high - low) * float(bins)), bins - 1).astype(np.int64)


def per_block(blocks: DataFrame, keys: Keys, schema: str, score) -> DataFrame:
    """``score(block, row)`` of every block, one row per candidate shift: a dictionary of columns of equal length."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                made = score(Block(row), row)
                yield pd.DataFrame({k: [row[k]] * len(next(iter(made.values()))) for k in keys} | made)

    return blocks.mapInPandas(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], schema]))


def products(block: Block, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ab, bb = np.zeros(len(shifts)), np.zeros(len(shifts))
    for part, b in block.planes(shifts):
        ab[part], bb[part] = b @ block.a, np.einsum("ij,ij->i", b, b)
    return ab, bb


def block_correlation(block: Block, shifts: np.ndarray) -> np.ndarray:
    """Correlation of a frame that is one block under each shift."""
    ab, bb = products(block, shifts)
    norm = np.sqrt(float(block.a @ block.a) * bb)
    return np.divide(ab, norm, out=np.zeros(len(ab)), where=norm != 0)


def block_information(block: Block, shifts: np.ndarray, bins: int = C.MI_BINS) -> np.ndarray:
    """Bits of mutual information of a frame that is one block under each shift."""
    if not len(block.a):
        return np.zeros(0)
    out = np.zeros(len(shifts))
    i = bins_of(block.a, block.a.min(), block.a.max(), bins) * bins
    for part, b in block.planes(shifts):
        low, high = b.min(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        spread = np.where(high > low, high - low, np.inf)
        if np.isnan(b).any():
            j = np.stack([bins_of(x, x.min(), x.max(), bins) for x in b])
        else:
            j = np.minimum(np.floor((b - low) / spread * float(bins)), bins - 1).astype(np.int64)
        first = np.arange(len(b))[:, None] * bins * bins
        joint = np.bincount((first + i + j).ravel(), minlength=len(b) * bins * bins).reshape(-1, bins, bins)
        s, x, y = np.nonzero(joint)
        n, total = joint[s, x, y].astype(float), float(len(block.a))
        expected = joint.sum(axis=2)[s, x].astype(float) * joint.sum(axis=1)[s, y].astype(float)
        out[part] = np.bincount(s, n / total * np.log2(n * total / expected), len(b))
    return out


def one_block_shifts(blocks: DataFrame, keys: Keys, offsets: np.ndarray, scores) -> DataFrame:
    """``keys, dy, dx, score`` of frames that are one block: the shifts whose score is the best or next to it.

    A whole frame's score needs nothing from elsewhere, so no histogram and no sum is shuffled.
    """

    def best(block: Block, row: dict) -> dict:
        shifts = offsets + [row["cy"], row["cx"]]
        score = scores(block, shifts)
        keep = np.flatnonzero(~(score < score.max() - NEAR_BEST)) if len(score) else []
        return {"dy": shifts[keep, 0], "dx": shifts[keep, 1], "score": score[keep]} if len(score) else {"dy": [], "dx": [], "score": []}

    return per_block(blocks, keys, "dy double, dx double, score double", best)


def correlation_sums(blocks: DataFrame, keys: Keys, offsets: np.ndarray) -> DataFrame:
    """``keys, s, ab, aa, bb``: sums of products per candidate shift around each key's centre (cy, cx)."""

    def score(block: Block, row: dict) -> dict:
        ab, bb = products(block, offsets + [row["cy"], row["cx"]])
        return {"s": np.arange(len(offsets)), "ab": ab, "aa": float(block.a @ block.a), "bb": bb}

    parts = per_block(blocks, keys, "s long, ab double, aa double, bb double", score)
    return parts.groupBy(*keys, "s").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])


def information_by_shift(blocks: DataFrame, keys: Keys, offsets: np.ndarray, bins: int = C.MI_BINS) -> DataFrame:
    """``keys, s, score``: mutual information per candidate shift. Two readings of the blocks: the value
    ranges of each shifted plane, then joint histograms, of which only the counts of their filled cells
    are shuffled and merged."""

    def extremes(block: Block, row: dict) -> dict:
        planes = (block.at(row["cy"] + dy, row["cx"] + dx) for dy, dx in offsets)
        low, high = zip(*((b.min(), b.max()) for b in planes)) if len(block.a) else ((), ())
        n = len(low)
        a0, a1 = (block.a.min(), block.a.max()) if n else (0.0, 0.0)
        return {"s": np.arange(n), "a0": np.full(n, a0), "a1": np.full(n, a1), "b0": low, "b1": high}

    ranges = per_block(blocks, keys, "s long, a0 double, a1 double, b0 double, b1 double", extremes)
    ranges = ranges.groupBy(*keys, "s").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    ranges = ranges.groupBy(*keys).agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.array_sort(F.collect_list(F.struct("s", "b0", "b1"))).alias("b"))
    ranges = cut_lineage(ranges.select(*keys, "a0", "a1", F.col("b.b0").alias("b0"), F.col("b.b1").alias("b1")))

    def histograms(block: Block, row: dict) -> dict:
        i = bins_of(block.a, row["a0"], row["a1"], bins) * bins
        cells, counts = [], []
        for s, (dy, dx) in enumerate(offsets if len(block.a) else []):
            found = np.bincount(i + bins_of(block.at(row["cy"] + dy, row["cx"] + dx), row["b0"][s], row["b1"][s], bins))
            cell = np.flatnonzero(found)
            cells.append(cell.astype(np.int32).tobytes())
            counts.append(found[cell].astype(np.int64).tobytes())
        return {"s": np.arange(len(cells)), "cells": cells, "counts": counts}

    parts = per_block(attach(blocks, ranges, keys), keys, "s long, cells binary, counts binary", histograms)
    return merged_information(parts, keys, bins)


def merged_information(parts: DataFrame, keys: Keys, bins: int) -> DataFrame:
    """``keys, s, score`` from the blocks' histograms; a task streams them in order and holds one sum."""
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    by = [*keys, "s"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            out = []
            for row in batch[[*by, "cells", "counts"]].itertuples(index=False, name=None):
                if row[:-2] != at:
                    if at is not None:
                        out.append((*at, information(total.reshape(bins, bins))))
                    at, total = row[:-2], np.zeros(bins * bins, dtype=np.int64)
                total[np.frombuffer(row[-2], dtype=np.int32)] += np.frombuffer(row[-1], dtype=np.int64)
            yield pd.DataFrame(out, columns=[*by, "score"])
        if at is not None:
            yield pd.DataFrame([(*at, information(total.reshape(bins, bins)))], columns=[*by, "score"])

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in by], "score double"])
    return parts.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def stack_shifts(moving: np.ndarray, centres: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """:meth:`Block.at` of stacked frames, shifted by ``axis`` down and across around each frame's centre: (frame, dy, dx, row, column)."""
    n, h, w = moving.shape
    frame = np.arange(n)

    def ends(shift: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.floor(-shift)
        at = np.arange(size) + whole.astype(np.int64)[:, :, None]
        return np.clip(at, 0, size - 1), np.clip(at + 1, 0, size - 1), -shift - whole

    left, right, fx = ends(centres[:, 1:] + axis, w)
    line = np.arange(h)[:, None]
    across = moving[frame[:, None, None, None], line, left[:, :, None, :]]
    if fx.any():
        f = fx[:, :, None, None]
        across = across * (1 - f) + moving[frame[:, None, None, None], line, right[:, :, None, :]] * f
    low, high, fy = ends(centres[:, :1] + axis, h)
    # Rows come last but one, so that a whole line of columns is taken at once.
    pick = lambda at: across[frame[:, None, None, None], np.arange(len(axis))[:, None], at[:, :, None, :]]
    made = pick(low)
    if fy.any():
        f = fy[:, :, None, None, None]
        made = made * (1 - f) + pick(high) * f
    return made


def stack_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of products of each frame with its shifted planes: ``ab`` and ``bb`` per shift, ``aa`` per frame."""
    n = len(a)
    a, b = a.reshape(n, -1), b.reshape(n, -1, a[0].size)
    return np.matmul(b, a[:, :, None])[:, :, 0], np.einsum("nsk,nsk->ns", b, b), np.einsum("nk,nk->n", a, a)


def stack_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`block_correlation` of stacked frames, one value per frame and shift."""
    ab, bb, aa = stack_products(a, b)
    norm = np.sqrt(aa[:, None] * bb)
    return np.divide(ab, norm, out=np.zeros(ab.shape), where=norm != 0)


def stack_shift_information(a: np.ndarray, b: np.ndarray, bins: int = C.MI_BINS) -> np.ndarray:
    """:func:`block_information` of stacked frames, one value per frame and shift.

    With counts n of the joint and of both single histograms the sum of n log n over cells is that of log n over pixels.
    """
    n, size = len(a), a[0].size
    a, b = a.reshape(n, 1, size), b.reshape(n, -1, size)
    logs = np.round(np.log2(np.maximum(np.arange(size + 1), 1)) * LOG_PARTS).astype(np.int64)

    def places(x: np.ndarray) -> np.ndarray:
        low, high = x.min(axis=2, keepdims=True), x.max(axis=2, keepdims=True)
        x = (x - low) / np.where(high > low, high - low, np.inf)
        return np.minimum(np.floor(x * float(bins)), bins - 1).astype(np.int64)

    def entropy(at: np.ndarray, width: int) -> np.ndarray:
        code = (at + (np.arange(at.shape[0] * at.shape[1]) * width).reshape(at.shape[0], at.shape[1], 1)).ravel()
        counts = np.bincount(code, minlength=at.shape[0] * at.shape[1] * width)
        return logs[counts[code]].reshape(at.shape).sum(axis=2)

    i, j = places(a), places(b)
    shared = entropy(i * bins + j, bins * bins) - entropy(i, bins) - entropy(j, bins)
    return np.log2(size) + shared / LOG_PARTS / size


def stack_parts(n: int, cells: int) -> Iterator[slice]:
    step = max(1, STACK_CELLS // max(1, cells))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def stack_estimate(a: np.ndarray, b: np.ndarray, cross_modal: bool, search: int, refine: int) -> Planes:
    """:func:`shift_estimate` of stacked frames: ``dy, dx, score`` per frame."""
    scores, n = stack_shift_information if cross_modal else stack_correlation, len(a)
    centres, best, step, radius = np.zeros((n, 2)), np.zeros(n), 1.0, float(search)
    for _ in range(refine + 1):
        offsets = shift_offsets(radius, step)
        axis = offsets[: round(len(offsets) ** 0.5), 1]
        for part in stack_parts(n, len(offsets) * a[0].size):
            found = np.round(scores(a[part], stack_shifts(b[part], centres[part], axis)), 9)
            # The first of equal scores has the smaller (dy, dx).
            first = found.argmax(axis=1)
            best[part] = found[np.arange(len(found)), first]
            centres[part] += offsets[first]
        radius, step = step, step / 4.0
    return {"dy": centres[:, 0], "dx": centres[:, 1], "score": best}


def band_mean(planes: Planes, bands: Sequence[str], digits: int | None) -> np.ndarray:
    """The standardised mean of bands, rounded where ``digits`` say so."""
    plane = standardised(sum((planes[x] for x in bands), 0.0) / len(bands))
    return plane if digits is None else plane.round(digits)


def two_planes(some: DataFrame, keys: Keys, first: Sequence[str], second: Sequence[str], digits: int | None) -> list[DataFrame]:
    """The planes a and b of :func:`band_mean` for frames of any size."""
    made = [standardise_plane(some, keys, bands, n) for bands, n in ((first, "a"), (second, "b"))]
    return made if digits is None else [p.withColumn(n, F.round(n, digits)) for p, n in zip(made, "ab")]


def plane_correlations(frame: DataFrame, keys: Keys, first: Sequence[str], second: Sequence[str], radius: int) -> DataFrame:
    """:func:`shift_correlations` of two standardised planes of one complete frame, each the mean of its bands."""
    offsets = shift_offsets(float(radius), 1.0)
    axis = offsets[: 2 * radius + 1, 1]

    def work(planes: Planes) -> Planes:
        a, b = (band_mean(planes, bands, None) for bands in (first, second))
        n = len(a)
        sums = [stack_products(a[part], stack_shifts(b[part], np.zeros((len(a[part]), 2)), axis)) for part in stack_parts(n, len(offsets) * a[0].size)]
        ab, bb, aa = (np.concatenate(x) for x in zip(*sums))
        dy, dx = (np.tile(x, n) for x in offsets.T)
        return {"dy": dy, "dx": dx, "ab": ab, "aa": np.repeat(aa, len(offsets)), "bb": bb, "_of": np.repeat(np.arange(n), len(offsets))}

    def spread(some: DataFrame) -> DataFrame:
        return shift_correlations(*two_planes(some, keys, first, second, None), keys, radius)

    return by_frames(frame, keys, [*dict.fromkeys([*first, *second])], dict.fromkeys(("dy", "dx", "ab", "aa", "bb"), "double"), work, spread, per_frame=True)


def plane_shifts(
    frame: DataFrame, keys: Keys, first: Sequence[str], second: Sequence[str], digits: int | None = None,
    cross_modal: bool = True, search: int = SEARCH_PX, refine: int = REFINE_STEPS,
) -> DataFrame:
    """:func:`shift_estimate` of two standardised planes of one complete frame, each the mean of its bands: a frame inside one block
    is standardised and searched where its pixels meet."""

    def work(planes: Planes) -> Planes:
        return stack_estimate(*(band_mean(planes, bands, digits) for bands in (first, second)), cross_modal, search, refine)

    def spread(some: DataFrame) -> DataFrame:
        return shift_estimate(*two_planes(some, keys, first, second, digits), keys, cross_modal, search, refine)

    rows = by_frames(frame, keys, [*dict.fromkeys([*first, *second])], dict.fromkeys(("dy", "dx", "score"), "double"), work, spread, per_frame=True)
    return rows.withColumn("residual", residual("dy", "dx"))


def residual(dy: str, dx: str) -> Column:
    return F.sqrt(F.col(dy) * F.col(dy) + F.col(dx) * F.col(dx))


def shift_table(df: DataFrame, offsets: np.ndarray) -> DataFrame:
    """(oy, ox) of each candidate number; a few hundred rows from the search radius alone."""
    rows = [(s, float(y), float(x)) for s, (y, x) in enumerate(offsets)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "s long, oy double, ox double"))


def centred(blocks: DataFrame, keys: Keys, centres: DataFrame | None) -> DataFrame:
    if centres is None:
        return blocks.withColumn("cy", F.lit(0.0)).withColumn("cx", F.lit(0.0))
    return attach(blocks, centres.select(*keys, F.col("dy").alias("cy"), F.col("dx").alias("cx")), keys)


def shift_correlations(reference: DataFrame, moving: DataFrame, keys: Keys, radius: int) -> DataFrame:
    """``keys, dy, dx, ab, aa, bb`` for every integer shift up to ``radius``."""
    offsets = shift_offsets(float(radius), 1.0)
    sums = correlation_sums(centred(frame_blocks(reference, moving, keys, radius + 1), keys, None), keys, offsets)
    return sums.join(shift_table(sums, offsets), "s").select(*keys, F.col("oy").alias("dy"), F.col("ox").alias("dx"), "ab", "aa", "bb")


def best_shift(scores: DataFrame, keys: Keys, score: str) -> DataFrame:
    """Highest score; the smaller (dy, dx) wins a tie."""
    top = scores.groupBy(*keys).agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))).alias("t"))
    return top.select(*keys, (-F.col("t.y")).alias("dy"), (-F.col("t.x")).alias("dx"), F.col("t.s").alias(score))


def several_block_scores(blocks: DataFrame, keys: Keys, offsets: np.ndarray, cross_modal: bool) -> DataFrame:
    """``keys, dy, dx, score`` of every candidate shift, merged from the blocks of a frame."""
    if cross_modal:
        scored = information_by_shift(blocks, keys, offsets)
    else:
        sums = correlation_sums(blocks, keys, offsets)
        scored = sums.select(*keys, "s", F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("score"))
    scored = scored.join(shift_table(scored, offsets), "s")
    before = blocks.select(*keys, "cy", "cx").distinct()
    return scored.join(before, list(keys)).select(*keys, (F.col("cy") + F.col("oy")).alias("dy"), (F.col("cx") + F.col("ox")).alias("dx"), "score")


def shift_estimate(
    reference: DataFrame, moving: DataFrame, keys: Keys,
    cross_modal: bool = True, search: int = SEARCH_PX, refine: int = REFINE_STEPS,
) -> DataFrame:
    """Integer grid, then refinements of a quarter step: ``keys, dy, dx, score, residual``.

    Cross-modal pairs are scored by mutual information, same-modality pairs by correlation.
    ``reference`` has column a, ``moving`` column b. Every candidate of a grid is scored on every
    pixel, block by block; what is shuffled per block and candidate is a histogram or three sums.
    """
    made = frame_blocks(reference, moving, keys, search + refine + 1)
    # A frame inside one block can be scored where it is; others are merged from their blocks.
    near = lambda x, end: F.floor(end(x) / BLOCK_PX)
    spans = reference.groupBy(*keys).agg(((near("r", F.min) == near("r", F.max)) & (near("c", F.min) == near("c", F.max))).alias("_one"))
    blocks = cut_lineage(attach(made, spans, keys))
    several = blocks.where(~F.col("_one")).drop("_one")
    split = not several.isEmpty()
    centres, step, radius = None, 1.0, float(search)
    for _ in range(refine + 1):
        offsets = shift_offsets(radius, step)
        alone = centred(blocks.where("_one").drop("_one"), keys, centres)
        scored = one_block_shifts(alone, keys, offsets, block_information if cross_modal else block_correlation)
        if split:
            scored = scored.unionByName(several_block_scores(centred(several, keys, centres), keys, offsets, cross_modal))
        centres = cut_lineage(best_shift(scored, keys, "score"))
        radius, step = step, step / 4.0
    return centres.withColumn("residual", residual("dy", "dx"))


def shift_plane(frame: DataFrame, keys: Keys, shifts: DataFrame, value: str) -> DataFrame:
    """``value`` of each frame moved by its (dy, dx), interpolated linearly, borders replicated.

    Each cell names the up to four cells it is made of, so the move is an equi-join on pixel indices.
    Frames without a shift are left out.
    """
    box = frame.groupBy(*keys).agg(*[f(x).alias(f"_{x}{i}") for x in "rc" for i, f in enumerate((F.min, F.max))])
    cells = attach(attach(frame.select(*keys, "r", "c"), box, keys), shifts.select(*keys, "dy", "dx"), keys)
    down, along = F.floor(-F.col("dy")), F.floor(-F.col("dx"))
    cells = cells.withColumns({"_fy": -F.col("dy") - down, "_fx": -F.col("dx") - along})
    clip = lambda x, by: F.least(F.greatest(F.col(x) + by, F.col(f"_{x}0")), F.col(f"_{x}1"))
    corners = [F.struct(F.lit(2 * i + j).alias("k"), clip("r", down + i).alias("r"), clip("c", along + j).alias("c")) for i in (0, 1) for j in (0, 1)]
    wanted = cells.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "_fy", "_fx", F.explode(F.array(*corners)).alias("_s"))
    wanted = wanted.where(((F.col("_fx") > 0) | (F.col("_s.k") % 2 == 0)) & ((F.col("_fy") > 0) | (F.col("_s.k") < 2)))
    wanted = wanted.select(*keys, "_r", "_c", "_fy", "_fx", "_s.k", "_s.r", "_s.c")
    parts = wanted.join(frame.select(*keys, "r", "c", F.col(value).alias("_v")), [*keys, "r", "c"])
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"_v{k}")
    grid = parts.groupBy(*keys, "_r", "_c").agg(F.first("_fy").alias("_fy"), F.first("_fx").alias("_fx"), *[pick(k) for k in range(4)])
    across = lambda k: F.when(F.col("_fx") > 0, F.col(f"_v{k}") * (1 - F.col("_fx")) + F.col(f"_v{k + 1}") * F.col("_fx")).otherwise(F.col(f"_v{k}"))
    moved = F.when(F.col("_fy") > 0, across(0) * (1 - F.col("_fy")) + across(2) * F.col("_fy")).otherwise(across(0))
    return grid.select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), moved.alias(value))


def corrected_shifts(frame: DataFrame, keys: Keys, first: Sequence[str], second: Sequence[str], cross_modal: bool = True, search: int = SEARCH_PX, refine: int = REFINE_STEPS) -> DataFrame:
    """:func:`plane_shifts` with ``again``, the residual found anew after the second plane was moved by the shift and standardised.

    ``again`` is made for frames inside one block that are off at all, and NULL for all others.
    """

    def work(planes: Planes) -> Planes:
        a, b = (band_mean(planes, bands, None) for bands in (first, second))
        found = stack_estimate(a, b, cross_modal, search, refine)
        off, again = (found["dy"] != 0) | (found["dx"] != 0), np.full(len(a), np.nan)
        centres = np.stack([found["dy"], found["dx"]], axis=1)[off]
        if len(centres):
            moved = np.concatenate([stack_shifts(b[off][part], centres[part], np.zeros(1))[:, 0, 0] for part in stack_parts(len(centres), a[0].size)])
            second_found = stack_estimate(a[off], standardised(moved), cross_modal, search, refine)
            again[off] = np.sqrt(second_found["dy"] ** 2 + second_found["dx"] ** 2)
        return found | {"again": again}

    def spread(some: DataFrame) -> DataFrame:
        return shift_estimate(*two_planes(some, keys, first, second, None), keys, cross_modal, search, refine).withColumn("again", F.lit(None).cast("double"))

    rows = by_frames(frame, keys, [*dict.fromkeys([*first, *second])], dict.fromkeys(("dy", "dx", "score", "again"), "double"), work, spread, per_frame=True)
    return rows.withColumn("residual", residual("dy", "dx"))


def registration_report(frame: DataFrame, first: Sequence[str], second: Sequence[str], headers: DataFrame, keys: Keys, **how) -> DataFrame:
    """``keys, state, checks, dy, dx, first_residual, residual``: what the check of each pair finds and does.

    The pair are two standardised planes of one complete ``frame``, each the mean of its bands.
    ``headers`` has (crs_a, crs_b, gsd_a, gsd_b, same_grid, pregeoreferenced, unit) per pair; ``unit`` is
    the size of a search pixel in the pixels of the limits. Pairs on different grids and those off by more
    than the upper limit are refused; pairs declared registered are only measured; pairs within the lower
    limit pass. The others are moved by the shift found and measured again: ``residual`` is then that of
    the second estimate, and the state says whether it is within the limit.
    """
    found = corrected_shifts(frame, keys, first, second, **how)
    named = headers.join(found.select(*keys, "dy", "dx", F.col("residual").alias("_r"), "again"), list(keys), "left")
    named = cut_lineage(named.withColumn("first_residual", F.when(F.col("same_grid"), F.col("_r") * F.col("unit"))).drop("_r"))
    off = F.col("first_residual")
    state = (
        F.when(~F.col("same_grid"), "refused_grid").when(off > C.COREG_REFUSE_PX, "refused_residual")
        .when(F.col("pregeoreferenced") & (off <= C.COREG_MAX_PX), "verified").when(F.col("pregeoreferenced"), "verify_only_warning")
        .when(off <= C.COREG_MAX_PX, "registered").otherwise("correct")
    )
    judged = named.withColumn("_state", state)
    # Frames over several blocks are moved and measured again only where it is called for.
    left = judged.where("_state = 'correct' AND again IS NULL").select(*keys, "dy", "dx")
    second_found = judged.where("again IS NOT NULL").select(*keys, F.col("again").alias("_second"))
    if not left.isEmpty():
        some = attach(frame, left.select(*keys, F.lit(True).alias("_again")), keys).drop("_again")
        reference, moving = two_planes(some, keys, first, second, None)
        corrected = standardise_plane(shift_plane(moving, keys, left, "b"), keys, ["b"], "b")
        second_found = second_found.unionByName(shift_estimate(reference, corrected, keys, **how).select(*keys, F.col("residual").alias("_second")))
    joined = judged.drop("again").join(second_found, list(keys), "left")
    corrected_state = F.when(F.col("_second") * F.col("unit") <= C.COREG_MAX_PX, "corrected").otherwise("refused_after_correction")
    gsd = F.greatest("gsd_a", "gsd_b") / F.least("gsd_a", "gsd_b")
    moved = F.col("_state") == "correct"
    checks = F.concat_ws(
        ",", F.when(F.col("crs_a") == F.col("crs_b"), "crs_match"), F.when(gsd <= MAX_GSD_RATIO, "gsd_ratio_ok"),
        F.when(F.col("same_grid"), "extent_overlap"), F.when(F.col("same_grid") & (off <= C.COREG_MAX_PX), "residual_shift_ok"),
        F.when(moved, "residual_shift_corrected"),
    )
    return joined.select(
        *keys, F.when(moved, corrected_state).otherwise(F.col("_state")).alias("state"), checks.alias("checks"),
        F.when(F.col("same_grid"), F.col("dy")).alias("dy"), F.when(F.col("same_grid"), F.col("dx")).alias("dx"), "first_residual",
        F.when(moved, F.col("_second") * F.col("unit")).otherwise(off).alias("residual"),
    )
