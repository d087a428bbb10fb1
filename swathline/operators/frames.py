"""Whole frames in numpy: a frame that lies inside one block of pixels is worked on where the shuffle brings it.

Archives hold many more frames than a frame holds pixels. Small ones need no window passes and no joins of their
statistics; frames that span several blocks go on to the operators that spread a frame over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.joins import attach
from swathline.session import stored

Keys = Sequence[str]
#: Side of a block. Blocks begin ``MARGIN_PX`` before pixel 0, so that a frame from 0 on touches no border.
BLOCK_PX, MARGIN_PX = 128, 8
#: Pixels that a task collects before it works on the frames among them.
HELD_PIXELS = 1 << 18

Planes = dict[str, np.ndarray]
Work = Callable[[Planes], Planes]


def changes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Rows at which a sorted table's next group begins, the first included; NULL is a value of its own."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for name in columns:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


class Held:
    """Sorted pixels of some blocks as arrays: which of the blocks are whole frames, and each pixel's place in its frame."""

    def __init__(self, table: pa.Table, groups: Sequence[str], block: int) -> None:
        self.table = table
        self.starts = changes(table, groups)
        self.sizes = np.diff(np.r_[self.starts, len(table)])
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        self.low = [np.minimum.reduceat(x, self.starts) for x in (r, c)]
        high = [np.maximum.reduceat(x, self.starts) for x in (r, c)]
        self.shape = [h - l + 1 for l, h in zip(self.low, high)]
        self.whole = self.sizes == self.shape[0] * self.shape[1]
        for l, h in zip(self.low, high):
            self.whole &= ((l + MARGIN_PX) % block > 0) & ((h + MARGIN_PX) % block < block - 1) & ((l + MARGIN_PX) // block == (h + MARGIN_PX) // block)
        of = np.repeat(np.arange(len(self.starts)), self.sizes)
        place = self.starts[of] + (r - self.low[0][of]) * self.shape[1][of] + c - self.low[1][of]
        # A cell that comes twice leaves another one empty.
        filled = np.zeros(len(table) + 1, dtype=np.int64)
        filled[np.where(self.whole[of], place, len(table))] = 1
        self.whole &= np.add.reduceat(filled[:-1], self.starts) == self.sizes
        self.place = np.where(self.whole[of], place, len(table))

    def plane(self, name: str) -> np.ndarray:
        """A column's values in reading order inside each frame; NULL is NaN."""
        out = np.full(len(self.table) + 1, np.nan)
        out[self.place] = self.table.column(name).to_numpy()
        return out[:-1]

    def stacks(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """Numbers of whole frames of equal shape, with their height and width."""
        shapes = np.stack([*self.shape, np.where(self.whole, 0, 1)])
        for h, w, large in np.unique(shapes, axis=1).T:
            if not large:
                yield np.flatnonzero(self.whole & (self.shape[0] == h) & (self.shape[1] == w)), int(h), int(w)


def whole_frames(frame: DataFrame, keys: Keys, columns: Sequence[str], made: Mapping[str, str], work: Work, per_frame: bool = False, block: int = BLOCK_PX) -> DataFrame:
    """``keys, r, c``, the columns ``made`` and ``_large``; without r and c where there is one result row ``per_frame``.

    ``work`` takes planes of frames of one shape, stacked as (frame, row, column) with NaN for NULL, and the frames' first row and
    column as ``_r`` and ``_c``. It returns one value per cell, or per frame; with ``_of``, the frame that each value is of, any
    number per frame. NaN becomes NULL. A block that is no whole frame yields one row with ``_large`` true.
    """
    keys, columns = list(keys), list(columns)
    at = [] if per_frame else ["r", "c"]
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"{x} long" for x in at], *[f"`{n}` {t}" for n, t in made.items()], "_large boolean"])
    groups = [*keys, "_br", "_bc"]
    near = lambda x: F.floor((F.col(x) + MARGIN_PX) / block)
    cells = frame.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(n).cast("double").alias(n) for n in columns], near("r").alias("_br"), near("c").alias("_bc"))
    arrow = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def rows(named: pa.Table, where: list[np.ndarray], values: Planes, large: bool) -> Iterator[pa.RecordBatch]:
        for name, column in zip(at, where):
            named = named.append_column(name, pa.array(column, pa.int64()))
        for name, t in made.items():
            column = pa.nulls(len(named), arrow[t]) if large else pa.array(values[name].ravel(), from_pandas=True).cast(arrow[t])
            named = named.append_column(name, column)
        yield from named.append_column("_large", pa.array(np.full(len(named), large))).combine_chunks().to_batches()

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        held = Held(table, groups, block)
        flat = {n: held.plane(n) for n in columns}
        named = table.select(keys)
        large = held.starts[~held.whole]
        if len(large):
            yield from rows(named.take(pa.array(large)), [held.low[0][~held.whole], held.low[1][~held.whole]], {}, True)
        for frames, h, w in held.stacks():
            cells_of = held.starts[frames][:, None] + np.arange(h * w)
            first = {f"_{x}": held.low[i][frames] for i, x in enumerate("rc")}
            values = work({n: x[cells_of].reshape(-1, h, w) for n, x in flat.items()} | first)
            if per_frame:
                yield from rows(named.take(pa.array(held.starts[frames][values.pop("_of", slice(None))])), [], values, False)
            else:
                r, c = np.divmod(np.arange(h * w), w)
                where = [(held.low[i][frames][:, None] + x).ravel() for i, x in enumerate((r, c))]
                yield from rows(named.take(pa.array(np.repeat(held.starts[frames], h * w))), where, values, False)

    return cells.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(lambda batches: over_groups(batches, groups, finished), schema)


def by_frames(
    frame: DataFrame, keys: Keys, columns: Sequence[str], made: Mapping[str, str], work: Work, spread: Callable[[DataFrame], DataFrame],
    per_frame: bool = False, block: int = BLOCK_PX,
) -> DataFrame:
    """``work`` on the frames that lie inside one block, ``spread`` on all others, in columns ``keys, r, c`` and those ``made``."""
    rows = stored(whole_frames(frame, keys, columns, made, work, per_frame, block))
    names = [*keys, *([] if per_frame else ["r", "c"]), *made]
    done = rows.where("NOT _large").select(*names)
    large = rows.where("_large").select(*keys).distinct()
    if large.isEmpty():
        return done
    some = attach(frame, large.withColumn("_several", F.lit(True)), keys).drop("_several")
    whole = attach(done, large.withColumn("_several", F.lit(True)), keys, "left").where("_several IS NULL").select(*names)
    return whole.unionByName(spread(some).select(*names))


def with_block_facts(rows: DataFrame, keys: Keys, columns: Sequence[str], made: Mapping[str, str], work: Callable[[Planes, np.ndarray], Planes], spread: Callable[[DataFrame], DataFrame], block: int = BLOCK_PX) -> DataFrame:
    """``rows`` and the columns ``made``, facts of each row's frame; cells may be missing or come twice.

    ``work`` takes columns with NaN for NULL and the number of each row's frame, which rises, and returns one value per frame. It is
    tried on every block; the frames that turn out to have rows in several go to ``spread``, which returns ``rows`` with ``made``.
    """
    keys, columns = list(keys), list(columns)
    near = lambda x: F.floor((F.col(x) + MARGIN_PX) / block)
    # Cells without a place are a block of their own, so that their frame has several.
    part = F.coalesce(near("r") * F.lit(1 << 32) + near("c"), F.lit(-1 << 62)).alias("_part")
    groups = [*keys, "_part"]
    named = rows.select("*", part)
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    schema = ", ".join([*[f"`{n}` {t}" for n, t in types.items()], *[f"`{n}` {t}" for n, t in made.items()]])
    arrow = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = changes(table, groups)
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        values = work({n: table.column(n).cast(pa.float64()).to_numpy() for n in columns}, of)
        for n, t in made.items():
            table = table.append_column(n, pa.array(values[n][of], from_pandas=True).cast(arrow[t]))
        yield from table.combine_chunks().to_batches()

    found = stored(named.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(lambda batches: over_groups(batches, groups, finished), schema))
    names = [*rows.columns, *made]
    large = found.groupBy(*keys).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).where("_a < _b").select(*keys)
    large = stored(large.withColumn("_several", F.lit(True)))
    if large.isEmpty():
        return found.select(*names)
    some = attach(rows, large, keys).drop("_several")
    whole = attach(found, large, keys, "left").where("_several IS NULL").select(*names)
    return whole.unionByName(spread(some).select(*names))


def over_groups(batches: Iterator[pa.RecordBatch], groups: Sequence[str], finished: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``finished`` of sorted rows, some ``HELD_PIXELS`` at a time and each group whole."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n >= HELD_PIXELS:
            table = pa.Table.from_batches(waiting).combine_chunks()
            last = int(changes(table, groups)[-1])
            if last:
                yield from finished(table.slice(0, last).combine_chunks())
            waiting = table.slice(last).to_batches()
            n = len(table) - last
    if n:
        yield from finished(pa.Table.from_batches(waiting).combine_chunks())


def ragged_percentile(x: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
    """Percentile of the values of each frame that are not NaN, linearly interpolated, NaN without any; ``of`` rises from 0."""
    frames = int(of[-1]) + 1
    ordered = x[np.lexsort((x, of))]
    first = np.searchsorted(of, np.arange(frames))
    n = np.bincount(of[~np.isnan(x)], minlength=frames)
    position = share * (n - 1)
    low, high = (np.maximum(f(position), 0).astype(np.int64) for f in (np.floor, np.ceil))
    below, above = ordered[first + low], ordered[first + high]
    return np.where(n > 0, below + (above - below) * (position - np.floor(position)), np.nan)


def stretched(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(x - low) / (high - low) clipped to [0, 1], the degenerate range widened."""
    return np.clip((x - low) / (np.where(high <= low, low + C.STRETCH_EPSILON, high) - low), 0.0, 1.0)


def moved(x: np.ndarray, offset: int, axis: int) -> np.ndarray:
    """Each cell's neighbour at ``offset`` along an axis (1 down, 2 across); beyond the border, the nearest cell."""
    return np.take(x, np.clip(np.arange(x.shape[axis]) + offset, 0, x.shape[axis] - 1), axis=axis)


def blurred(x: np.ndarray, window: int) -> np.ndarray:
    """Box mean with replicated borders: across, then down."""
    for axis in (2, 1):
        total = 0.0
        for o in range(-(window // 2), window // 2 + 1):
            total = total + moved(x, o, axis)
        x = total / window
    return x


def frame_mean(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Mean of the valid cells of each frame, NaN without any; shape (frame, 1, 1)."""
    n = valid.sum(axis=(1, 2), keepdims=True)
    return np.divide(np.where(valid, x, 0.0).sum(axis=(1, 2), keepdims=True), n, out=np.full(n.shape, np.nan), where=n > 0)


def frame_percentiles(x: np.ndarray, valid: np.ndarray, shares: Sequence[float]) -> list[np.ndarray]:
    """Percentiles of each frame's valid cells, linearly interpolated, NaN without any; shape (frame, 1, 1)."""
    ordered = np.sort(np.where(valid, x, np.inf).reshape(len(x), -1), axis=1)
    n = valid.sum(axis=(1, 2))
    out = []
    for p in shares:
        position = p * (n - 1)
        low = np.maximum(np.floor(position), 0).astype(np.int64)
        high = np.maximum(np.ceil(position), 0).astype(np.int64)
        pick = lambda i: np.take_along_axis(ordered, i[:, None], axis=1)[:, 0]
        below, above = pick(low), pick(high)
        rise = np.subtract(above, below, out=np.zeros(len(n)), where=(n > 0) & (above > below))
        out.append(np.where(n > 0, below + rise * (position - np.floor(position)), np.nan)[:, None, None])
    return out
