"""Tiles of scenes: planning, assignment, ranking and mosaics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.frames import Planes, by_frames
from swathline.operators.ranking import null_safe_join
from swathline.operators.stencil import spread_texture_parts, texture_planes

# Query words that ask for structured or for smooth tiles.
HIGH_TEXTURE = (
    "building", "buildings", "urban", "built-up", "builtup", "city", "settlement", "road", "roads", "runway", "airport",
    "aircraft", "ship", "ships", "harbour", "harbor", "port", "bridge", "construction",
)
LOW_TEXTURE = (
    "water", "lake", "river", "reservoir", "pond", "flood", "sea", "coast", "bare", "sand", "desert", "field", "fields",
    "crop", "crops", "farmland", "vegetation", "forest",
)


def flushed_offsets(extent: Column, side: Column, stride: Column) -> Column:
    """Tile starts along one axis; a last tile is flushed to the edge."""
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(extent - side, F.lit(0)).cast("long"), stride.cast("long"))
    reached = F.element_at(regular, -1) + side >= extent
    return F.when(reached, regular).otherwise(F.concat(regular, F.array((extent - side).cast("long"))))


def numbered(scenes: DataFrame, key: str, max_tiles: int | None) -> DataFrame:
    """Row-major tile index from array positions; with ``max_tiles`` cut there, and flagged."""
    grid = scenes.select("*", F.posexplode("rows").alias("i", "row_off")).select("*", F.posexplode("cols").alias("j", "col_off"))
    index = F.col("i") * F.size("cols") + F.col("j") + 1
    grid = grid.withColumn("tile_idx", index)
    if max_tiles is None:
        return grid.withColumn("truncated", F.lit(False))
    return grid.where(F.col("tile_idx") <= max_tiles).withColumn("truncated", F.size("rows") * F.size("cols") > max_tiles)


def plan_tiles(scenes: DataFrame, key: str, side_px: int = C.TILE_SIDE, overlap: float = C.TILE_OVERLAP, max_tiles: int | None = None) -> DataFrame:
    """Overlapping tiles flushed to the edge, with the whole scene as tile 0."""
    side = F.least(F.lit(side_px), F.greatest("height", "width"))
    sized = scenes.select(key, "height", "width", side.alias("side")).withColumn(
        "stride", F.greatest(F.lit(1), F.bround(F.col("side") * F.lit(1.0 - overlap)).cast("int"))
    )
    h, w = F.least("side", "height"), F.least("side", "width")
    tiles = numbered(
        sized.withColumn("rows", flushed_offsets(F.col("height"), h, F.col("stride"))).withColumn("cols", flushed_offsets(F.col("width"), w, F.col("stride"))),
        key, max_tiles,
    ).select(key, "tile_idx", "row_off", "col_off", h.cast("long").alias("h"), w.cast("long").alias("w"), F.lit(False).alias("is_overview"), "truncated")
    zero = F.lit(0).cast("long")
    overview = scenes.select(key, F.lit(0).alias("tile_idx"), zero.alias("row_off"), zero.alias("col_off"), F.col("height").cast("long").alias("h"), F.col("width").cast("long").alias("w"), F.lit(True).alias("is_overview"), F.lit(None).cast("boolean").alias("truncated"))
    return tiles.unionByName(overview)


def plan_tiles_clamped(scenes: DataFrame, key: str, size: int = C.TILE_SIDE, overlap: int | None = None, max_tiles: int | None = None) -> DataFrame:
    """Fixed stride; tiles shrink at the edge."""
    overlap = round(size * C.TILE_OVERLAP) if overlap is None else overlap
    if overlap >= size:
        raise ValueError("tile overlap must be smaller than the tile size")
    if size * size > C.MAX_TILE_PIXELS:
        raise ValueError("tile size exceeds the pixel cap")
    starts = lambda extent: F.sequence(F.lit(0).cast("long"), (F.col(extent) - 1).cast("long"), F.lit(size - overlap).cast("long"))
    tiles = numbered(scenes.select(key, "height", "width").withColumn("rows", starts("height")).withColumn("cols", starts("width")), key, max_tiles)
    return tiles.select(
        key, "tile_idx", "row_off", "col_off", F.least(F.lit(size), F.col("height") - F.col("row_off")).alias("h"),
        F.least(F.lit(size), F.col("width") - F.col("col_off")).alias("w"), "truncated",
    )


def covering_starts(index: Column, extent: int, side: int, stride: int) -> Column:
    """Starts of the flushed tiles that contain a pixel index, by arithmetic."""
    last = (extent - side) // stride * stride
    flush = extent - side
    low = F.greatest(F.ceil((index - side + 1) / stride), F.lit(0))
    high = F.least(F.floor(index / stride), F.lit(last // stride))
    regular = F.when(high >= low, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
    if flush == last:
        return regular
    return F.when(index >= flush, F.concat(regular, F.array(F.lit(flush).cast("long")))).otherwise(regular)


def assign_pixels(pixels: DataFrame, height: int, width: int, side: int, stride: int) -> DataFrame:
    """Each pixel once per tile that contains it, with its tile-local position. No range join."""
    out = pixels.withColumn("row_off", F.explode(covering_starts(F.col("r"), height, min(side, height), stride)))
    out = out.withColumn("col_off", F.explode(covering_starts(F.col("c"), width, min(side, width), stride)))
    return out.withColumn("tr", F.col("r") - F.col("row_off")).withColumn("tc", F.col("c") - F.col("col_off"))


def texture_wish(question: Column) -> Column:
    """'smooth' when only smooth words occur; every other query ranks by structure."""
    text = F.lower(question)
    any_of = lambda words: text.rlike("|".join(words))
    return F.when(any_of(LOW_TEXTURE) & ~any_of(HIGH_TEXTURE), "smooth").otherwise("structure")


def content_score(cells: DataFrame, tile: Sequence[str], value: str, wish: DataFrame, window: int = C.TEXTURE_WINDOW) -> DataFrame:
    """0.35 coverage + 0.65 relevance per tile; ``cells`` has tile-local r and c, ``wish`` one row per tile or per value of
    some of the columns that name one."""

    def means(planes: Planes) -> Planes:
        parts = texture_planes(planes[value], window)
        return {n: parts[x].mean(axis=(1, 2)) for n, x in (("coverage", "valid"), ("texture", "edges"), ("variance", "variance"))}

    def spread(some: DataFrame) -> DataFrame:
        return spread_texture_parts(some, tile, value, window).groupBy(*tile).agg(
            F.avg(F.col("valid").cast("double")).alias("coverage"), F.avg("edges").alias("texture"), F.avg("variance").alias("variance")
        )

    stats = by_frames(cells, tile, [value], {n: "double" for n in ("coverage", "texture", "variance")}, means, spread, per_frame=True)
    structure = 0.5 * F.col("texture") + 0.5 * F.col("variance")
    joined = null_safe_join(stats, wish, [k for k in tile if k in wish.columns])
    relevance = F.when(F.col("wish") == "smooth", 1 - structure).otherwise(structure)
    score = F.when(F.col("coverage") > 0, F.least(F.greatest(0.35 * F.col("coverage") + 0.65 * relevance, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return joined.select(*tile, "coverage", score.alias("score"))


def top_k_tiles(scored: DataFrame, key: Sequence[str], k: int = C.TOP_K_TILES) -> DataFrame:
    """Overview first, then the k best tiles; the lower index wins a tie."""
    order = W.partitionBy(*key).orderBy(F.col("is_overview").desc(), F.col("score").desc(), "tile_idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)


def mosaic_or(pieces: DataFrame, frame: DataFrame, keys: Sequence[str], tile: Sequence[str] = ()) -> DataFrame:
    """Full-scene mask: OR of every tile's view of a pixel, false where no tile saw it.

    ``pieces`` are whole tile masks. With ``tile``, the columns that name one, and its height and width
    in ``h`` and ``w``, a mask that does not have h x w pixels of its tile ends the job.
    """
    if tile:
        at = (F.col("r") - F.col("row_off")).between(0, F.col("h") - 1) & (F.col("c") - F.col("col_off")).between(0, F.col("w") - 1)
        sizes = pieces.groupBy(*tile).agg(F.count("*").alias("n"), F.max(F.col("h") * F.col("w")).alias("want"), F.bool_and(at).alias("inside"))
        wrong = F.when((F.col("n") != F.col("want")) | ~F.col("inside"), F.concat(F.lit("tile "), F.concat_ws(", ", *tile), F.lit(" has a mask of "), F.col("n"), F.lit(" pixels, expected "), F.col("want")))
        # One sum over all tiles carries the check into the result, whichever of its pixels are read.
        fine = sizes.agg(F.sum(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(1)).alias("_tiles"))
    merged = pieces.groupBy(*keys, "r", "c").agg(F.bool_or("hit").alias("hit"))
    out = frame.select(*keys, "r", "c").join(merged, [*keys, "r", "c"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return out.crossJoin(F.broadcast(fine)).where("_tiles IS NULL OR _tiles >= 0").drop("_tiles") if tile else out


def grid_boxes(scenes: DataFrame, key: str, tiles: int, overlap: float) -> DataFrame:
    """n x n crop boxes padded by a share of the step and clipped to the frame."""
    n = F.sequence(F.lit(0), F.lit(tiles - 1))
    cells = scenes.select(key, "height", "width", F.explode(n).alias("i")).select("*", F.explode(n).alias("j"))
    sx, sy = F.col("width") / tiles, F.col("height") / tiles
    cut = lambda v: F.floor(v).cast("long")
    box = {
        "left_x": F.greatest(F.lit(0), cut(F.col("j") * sx - sx * overlap)), "top_y": F.greatest(F.lit(0), cut(F.col("i") * sy - sy * overlap)),
        "right_x": F.least(F.col("width"), cut((F.col("j") + 1) * sx + sx * overlap)), "bottom_y": F.least(F.col("height"), cut((F.col("i") + 1) * sy + sy * overlap)),
    }
    return cells.select(key, "i", "j", *[v.cast("long").alias(k) for k, v in box.items()]).where("right_x > left_x AND bottom_y > top_y")


def rank_labels(scores: Column, names: Sequence[str], k: int) -> Column:
    """Top k (class, score) pairs of a score array."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("o"), i.alias("i")))
    table = F.array(*[F.lit(n) for n in names])
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(F.get(table, p["i"]).alias("name"), (-p["o"]).alias("score")))
