"""Connected regions, shape-filtered proposals and polygon rasters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.frames import Planes, by_frames
from swathline.operators.joins import attach
from swathline.operators.ranking import null_safe_join
from swathline.operators.stencil import morphological_open, opened_planes, texture_hits
from swathline.session import cut_lineage

Keys = Sequence[str]
ROW_STRIDE = 1 << 24  # pixel id = r * ROW_STRIDE + c
BLOCK_PX = 128
# Confidence of the fallback with and without a proposal.
FOUND, NOT_FOUND = 0.3, 0.05

#: Pixels per word of a raster row: the bits of a long without its sign.
WORD_PX = 62


def label_block(pdf: pd.DataFrame, r: str = "r", c: str = "c") -> np.ndarray:
    """For each pixel of a block the id of the first pixel, in reading order, of its 4-connected piece inside the block."""
    rows, columns = pdf[r].to_numpy(np.int64), pdf[c].to_numpy(np.int64)
    order = np.lexsort((columns, rows))
    ids = (rows * ROW_STRIDE + columns)[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[1:] != ids[:-1] + 1
    run = np.cumsum(new) - 1
    below = np.searchsorted(ids, ids + ROW_STRIDE)
    touch = np.flatnonzero((below < len(ids)) & (ids[np.minimum(below, len(ids) - 1)] == ids + ROW_STRIDE))
    root = smallest_roots(run[-1] + 1, run[touch], run[below[touch]])
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = ids[np.flatnonzero(new)][root[run]]
    return out


def smallest_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the edges (u, v) lead to."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def component_labels(hits: DataFrame, keys: Keys, block: int = BLOCK_PX) -> DataFrame:
    """4-connected component label of every positive pixel, the id of its first pixel: ``keys, r, c, label``.

    Pieces are labelled inside blocks of ``block`` x ``block`` pixels, each a bounded group. Only the
    pixels on either side of a block border are then paired, and a graph of pieces is left, which
    ``joined_pieces`` contracts. No row of a pixel ever carries the label of a whole region as a join
    key: pixels learn it by their piece, which one block holds.
    """
    keys = list(keys)
    names = [*keys, "r", "c", "piece"]
    types = {f.name: f.dataType.simpleString() for f in hits.schema.fields}

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(piece=label_block(pdf))[names]

    pixels = hits.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    near = [F.floor(F.col(x) / block).alias(f"_b{x}") for x in ("r", "c")]
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "r long, c long, piece long"])
    pieces = cut_lineage(pixels.select("*", *near).groupBy(*keys, "_br", "_bc").applyInPandas(label, schema))
    edges = []
    for x in ("r", "c"):
        last = pieces.where(F.pmod(x, F.lit(block)) == block - 1).select(*keys, "r", "c", F.col("piece").alias("u"))
        first = pieces.where(F.pmod(x, F.lit(block)) == 0).select(*keys, *[(F.col(y) - 1 if y == x else F.col(y)).alias(y) for y in ("r", "c")], F.col("piece").alias("v"))
        edges.append(null_safe_join(last, first, [*keys, "r", "c"]).select(*keys, "u", "v"))
    roots = joined_pieces(edges[0].unionByName(edges[1]).distinct(), keys).withColumnRenamed("node", "piece")
    return attach(pieces, roots, [*keys, "piece"], "left").select(*keys, "r", "c", F.coalesce("root", "piece").alias("label"))


def joined_pieces(edges: DataFrame, keys: Keys) -> DataFrame:
    """``keys, node, root``: for every node of ``edges(keys, u, v)`` the smallest node it is connected with.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots and
    contracts the edges to those between different roots. Nodes that no edge is left of are settled and
    leave; the others go on under their roots, so the graph at least halves. Where many edges or pointers
    meet in one node, the small side is repeated and the other salted.
    """
    keys = list(keys)
    edges = cut_lineage(edges.where("u <> v"))
    labels = cut_lineage(edges.select(*keys, F.col("u").alias("node")).union(edges.select(*keys, "v")).distinct().withColumn("root", F.col("node")))
    done = labels.limit(0)
    while not edges.isEmpty():
        both = edges.select(*keys, "u", "v").union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut_lineage(both.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("p")).withColumn("p", F.least("node", "p")))
        moving = True
        while moving:
            up = parent.select(*keys, F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = cut_lineage(attach(parent.select(*keys, "node", "p"), up, [*keys, "p"]).select(*keys, "node", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")))
            moving = not parent.where("moved").isEmpty()
        ends = lambda name, out: parent.select(*keys, F.col("node").alias(name), F.col("p").alias(out))
        both_ends = attach(attach(edges, ends("u", "pu"), [*keys, "u"]), ends("v", "pv"), [*keys, "v"]).where("pu <> pv")
        edges = cut_lineage(both_ends.select(*keys, F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        moved = attach(labels, ends("root", "up"), [*keys, "root"]).select(*keys, "node", F.col("up").alias("root"))
        open_roots = edges.select(*keys, F.col("u").alias("root")).union(edges.select(*keys, "v")).distinct().withColumn("_open", F.lit(True))
        labels = cut_lineage(attach(moved, open_roots, [*keys, "root"], "left"))
        done = done.union(labels.where("_open IS NULL").select(*keys, "node", "root"))
        labels = labels.where("_open").select(*keys, "node", "root")
    return done


def components(hits: DataFrame, keys: Keys, response: str | None = None, min_area: int = 1) -> DataFrame:
    """One row per region: area, box (maximum exclusive), centroid, mean response."""
    labels = component_labels(hits, keys)
    value = F.lit(1.0)
    if response is not None:
        labels = null_safe_join(labels, hits.select(*keys, "r", "c", response), [*keys, "r", "c"])
        value = F.col(response)
    out = labels.groupBy(*keys, "label").agg(
        F.count("*").alias("area_px"), F.min("r").alias("min_row"), F.min("c").alias("min_col"),
        (F.max("r") + 1).alias("max_row"), (F.max("c") + 1).alias("max_col"),
        F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"), F.avg(value).alias("mean_response"),
    )
    return out.where(F.col("area_px") >= min_area)


REGION = {n: "long" for n in ("label", "area_px", "min_row", "min_col", "max_row", "max_col")} | {n: "double" for n in ("centroid_r", "centroid_c", "mean_response")}


def region_planes(hit: np.ndarray, planes: Planes) -> Planes:
    """:func:`components` of stacked frames, with the mean of plane ``response``: one value per region of frame ``_of``."""
    of, r, c = np.nonzero(hit)
    if not len(of):
        return {n: np.zeros(0, dtype=np.int64 if t == "long" else float) for n, t in REGION.items()} | {"_of": of}
    # A row of background between frames keeps their pieces apart.
    tall = hit.shape[1] + 1
    piece, inverse = np.unique(label_block(pd.DataFrame({"r": of * tall + r, "c": c})), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    starts = np.flatnonzero(np.diff(inverse[order], prepend=-1))
    area = np.bincount(inverse)
    frame, first = np.divmod(piece // ROW_STRIDE, tall)
    r0, c0 = planes["_r"][frame], planes["_c"][frame]
    response = planes["response"][of, r, c]
    known = ~np.isnan(response)
    n = np.bincount(inverse, known)
    total = np.bincount(inverse, np.where(known, response, 0.0))
    return {
        "_of": frame, "label": (first + r0) * ROW_STRIDE + piece % ROW_STRIDE + c0, "area_px": area,
        "min_row": np.minimum.reduceat(r[order], starts) + r0, "min_col": np.minimum.reduceat(c[order], starts) + c0,
        "max_row": np.maximum.reduceat(r[order], starts) + r0 + 1, "max_col": np.maximum.reduceat(c[order], starts) + c0 + 1,
        "centroid_r": np.bincount(inverse, r) / area + r0, "centroid_c": np.bincount(inverse, c) / area + c0,
        "mean_response": np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0),
    }


def largest_centroid(regions: DataFrame, keys: Keys, height: int, width: int) -> DataFrame:
    """Normalised (x, y) centroid of the largest region; the earliest label wins a tie."""
    top = regions.groupBy(*keys).agg(F.max(F.struct("area_px", (-F.col("label")).alias("o"), "centroid_r", "centroid_c")).alias("t"))
    return top.select(
        *keys, F.col("t.area_px").alias("area_px"),
        F.round(F.col("t.centroid_c") / max(1, width - 1), 5).alias("x"), F.round(F.col("t.centroid_r") / max(1, height - 1), 5).alias("y"),
    )


def prior_for(target: str) -> tuple[float, float]:
    """(max aspect, min solidity) of the last word of the phrase that has a prior."""
    for word in reversed(target.lower().split()):
        for noun, prior in C.SHAPE_PRIORS.items():
            if noun.rstrip("s") == word.rstrip("s"):
                return prior
    return C.DEFAULT_PRIOR


def radar_mask(frame: DataFrame, keys: Keys, pol: str, band: str) -> DataFrame:
    """Step one on radar: the backscatter is the response, and what reaches the built-up cut of ``pol`` hits."""
    cut = C.SAR_CUTS_DB[pol]["builtup"]
    return frame.select(*keys, "r", "c", F.col(band).alias("response"), F.coalesce(F.col(band) >= cut, F.lit(False)).alias("hit"))


def optical_mask(frame: DataFrame, keys: Keys, band: str) -> DataFrame:
    """Step one on an optical plane: texture response, cut by the gated threshold."""
    return texture_hits(frame, keys, band, C.TEXTURE_CUT)


def shaped_regions(mask: DataFrame, keys: Keys, target: str, height: int, width: int) -> DataFrame:
    """Regions of the opened mask with aspect, solidity and ``fits``: whether the noun's shape prior allows them.

    ``mask`` is a complete frame with ``hit`` and ``response``.
    """

    def spread(some: DataFrame) -> DataFrame:
        opened = morphological_open(some, keys, "hit").where("hit")
        hits = null_safe_join(opened, some.select(*keys, "r", "c", "response"), [*keys, "r", "c"])
        return components(hits, keys, "response")

    work = lambda planes: region_planes(opened_planes(planes["hit"] == 1, C.OPENING_RADIUS), planes)
    found = by_frames(mask, keys, ["hit", "response"], REGION, work, spread, per_frame=True)
    found = found.where(F.col("area_px") >= max(1, int(C.MIN_COMPONENT_FRACTION * height * width)))
    h, w = F.col("max_row") - F.col("min_row"), F.col("max_col") - F.col("min_col")
    max_aspect, min_solidity = prior_for(target)
    shaped = found.withColumn("aspect_ratio", F.greatest(h, w) / F.greatest(F.lit(1), F.least(h, w))).withColumn("solidity", F.col("area_px") / F.greatest(F.lit(1), h * w))
    return shaped.withColumn("fits", (F.col("aspect_ratio") <= max_aspect) & (F.col("solidity") >= min_solidity))


def box_proposals(mask: DataFrame, keys: Keys, target: str, height: int, width: int, limit: int | None = None) -> DataFrame:
    """Open the mask, keep regions the noun's shape prior allows, best mean response first, at most ``limit``.

    Every proposal has the confidence of a fallback that found something.
    """
    kept = shaped_regions(mask, keys, target, height, width).where("fits").drop("fits")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.round("mean_response", 9).desc(), F.col("area_px").desc(), "label"))
    ranked = kept.withColumn("rank", rank).withColumn("confidence", F.lit(min(FOUND, C.PROPOSAL_CEILING)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def proposal_summary(mask: DataFrame, keys: Keys, target: str, height: int, width: int, limit: int = C.MAX_PROPOSALS) -> DataFrame:
    """One row per frame, those without a region included: regions before the shape prior, proposals, confidence."""
    counts = shaped_regions(mask, keys, target, height, width).groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.least(F.count_if("fits"), F.lit(limit)).alias("n_boxes")
    )
    frames = attach(mask.select(*keys).distinct(), counts, keys, "left").fillna(0, ["candidates", "n_boxes"])
    confidence = F.least(F.when(F.col("n_boxes") > 0, FOUND).otherwise(NOT_FOUND), F.lit(C.PROPOSAL_CEILING))
    return frames.withColumn("confidence", confidence)


def ring_words(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, group: np.ndarray, height: int, width: int) -> tuple[np.ndarray, ...]:
    """``group, row, word, bits`` of the pixels inside rings, whose points lie one ring after the other in ``x`` and ``y``."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    after = np.arange(1, len(x) + 1)
    after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    x1, y1 = x[after], y[after]
    low, high = np.minimum(y, y1), np.maximum(y, y1)
    # Row r is crossed when low <= r + 0.5 < high.
    first = np.maximum(np.ceil(low - 0.5), 0).astype(np.int64)
    rows = np.maximum(np.minimum(np.ceil(high - 0.5) - 1, height - 1).astype(np.int64) - first + 1, 0)
    edge = np.repeat(np.arange(len(x)), rows)
    r = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows) + first[edge]
    at = x[edge] + (r + 0.5 - y[edge]) * (x1 - x)[edge] / (y1 - y)[edge]
    order = np.lexsort((at, r, ring[edge]))
    # A ring crosses each row an even number of times, so its sorted crossings pair up.
    at, r, of = at[order], r[order][::2], group[ring[edge[order][::2]]]
    # Column c is inside when a < c + 0.5 <= b.
    c0 = np.maximum(np.floor(at[::2] - 0.5) + 1, 0).astype(np.int64)
    c1 = np.minimum(np.floor(at[1::2] - 0.5), width - 1).astype(np.int64)
    some = c1 >= c0
    c0, c1, r, of = c0[some], c1[some], r[some], of[some]
    n = c1 // WORD_PX - c0 // WORD_PX + 1
    span = np.repeat(np.arange(len(n)), n)
    w = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n) + (c0 // WORD_PX)[span]
    start, end = np.maximum(c0[span] - w * WORD_PX, 0), np.minimum(c1[span] - w * WORD_PX, WORD_PX - 1)
    bits = ((np.int64(1) << (end - start + 1)) - 1) << start
    r, of = r[span], of[span]
    order = np.lexsort((w, r, of))
    r, of, w, bits = r[order], of[order], w[order], bits[order]
    new = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(r) != 0) | (np.diff(w) != 0)]) if len(w) else np.zeros(0, np.int64)
    return of[new], r[new], w[new], np.bitwise_or.reduceat(bits, new) if len(new) else bits


def rasterize(rings: DataFrame, keys: Keys, height: int, width: int) -> DataFrame:
    """Pixels whose centre lies inside a ring (even-odd), by scan lines.

    An edge is repeated for the pixel rows it crosses, and the sorted crossings of a ring and row pair up into spans: in numpy,
    for a batch of rings. Spans are bits in words of a raster row, or-ed in the batch and map-side, so what is shuffled follows
    the rasters, not the rings' summed areas. ``rings`` has (keys, ring_id, ring array<struct<x, y>>) in pixel units, a ring a row.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "r long, w long, bits long"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.Table.from_batches([batch]).select(keys)
            group = named.to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("_x", "_y"))
            sizes = np.diff(x.offsets.to_numpy())
            of, *made = ring_words(x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False), sizes, group, height, width)
            where = named.take(pa.array(np.unique(group, return_index=True)[1][of]))
            for name, column in zip(("r", "w", "bits"), made):
                where = where.append_column(name, pa.array(column))
            yield from where.combine_chunks().to_batches()

    points = rings.where(F.size("ring") >= 3).select(*keys, F.col("ring.x").alias("_x"), F.col("ring.y").alias("_y"))
    filled = points.mapInArrow(words, schema).groupBy(*keys, "r", "w").agg(F.bit_or("bits").alias("bits"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_PX - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return filled.select(*keys, "r", "w", F.explode(set_bits).alias("i")).select(*keys, "r", (F.col("w") * WORD_PX + F.col("i")).alias("c"))
