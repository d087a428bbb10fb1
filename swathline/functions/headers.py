"""Scene-header logic as Column expressions over description and tag columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C


def containing(word: str):
    return lambda tokens: F.array_contains(tokens, word)


def described_slots(descriptions: Column) -> dict[str, Column]:
    """Band -> 1-based slot from words, then from S2 designations; 0 when absent."""
    words = F.transform(descriptions, lambda d: F.regexp_extract_all(F.lower(d), F.lit("[a-z]+"), F.lit(0)))
    exact = F.transform(descriptions, lambda d: F.lower(F.trim(d)))
    slots = {}
    for band in C.BAND_NAMES:
        by_word = F.array_position(F.transform(words, containing(band)), True)
        slot = F.when(by_word > 0, by_word)
        for designation, canonical in C.S2_DESIGNATIONS:
            if canonical == band:
                position = F.array_position(exact, designation)
                slot = F.coalesce(slot, F.when(position > 0, position))
        slots[band] = F.coalesce(slot, F.lit(0)).cast("int")
    return slots


def band_inventory(df: DataFrame, descriptions: str, modality: str) -> DataFrame:
    """One slot column per band, completed from the assumed order when too sparse.

    A description that contradicts the assumed order disables the assumption and the
    inventory becomes empty, so an index can never be computed on the wrong band.
    """
    kind, count = F.col(modality), F.size(descriptions)
    described = described_slots(F.col(descriptions))
    staged = df.select("*", *[slot.alias(f"_{band}") for band, slot in described.items()])
    seen = {band: F.col(f"_{band}") for band in described}
    staged = staged.withColumn("_matched", sum(((slot > 0).cast("int") for slot in seen.values()), F.lit(0)))
    for size, order in C.ASSUMED_ORDERS.items():
        clash = F.lit(False)
        for band, slot in seen.items():
            expected = order.index(band) + 1 if band in order else -1
            clash = clash | ((slot > 0) & (slot != expected))
        staged = staged.withColumn(f"_clash{size}", clash)
    slots = []
    for band, slot in seen.items():
        value = slot
        for size, order in C.ASSUMED_SAR_ORDERS.items():
            assumed = order.index(band) + 1 if band in order else 0
            value = F.when((F.col("_matched") == 0) & (kind == "sar") & (count == size), F.lit(assumed)).otherwise(value)
        for size, order in C.ASSUMED_ORDERS.items():
            assumed = order.index(band) + 1 if band in order else 0
            completed = F.when(F.col(f"_clash{size}"), F.lit(0)).when(slot > 0, slot).otherwise(F.lit(assumed))
            value = F.when((F.col("_matched") < 2) & (kind == "optical") & (count == size), completed).otherwise(value)
        slots.append(value.cast("int").alias(band))
    return staged.select(*df.columns, *slots)


def computable_indices(has: dict[str, Column]) -> Column:
    """Array of the index names whose two bands are both present, in fixed order."""
    named = [F.when(has[p] & has[n], F.lit(name)) for name, (p, n) in C.INDEX_BANDS.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def bit_depth(dtype: Column, nbits: Column) -> tuple[Column, Column]:
    """(bits, source): declared NBITS of 8/12/16 wins, floats are 32, else the container."""
    declared = F.when(nbits.try_cast("int").isin(8, 12, 16), nbits.try_cast("int"))
    container = F.when(dtype.rlike("8$"), 8).when(dtype.rlike("16$"), 16).when(dtype.rlike("64$"), 64).otherwise(32)
    bits = F.coalesce(declared, F.when(dtype.startswith("float"), F.lit(32)).otherwise(container))
    source = (
        F.when(declared.isNotNull(), "nbits_metadata")
        .when(dtype.startswith("float"), "float_dtype")
        .otherwise("container_dtype")
    )
    return bits, source


def metric_pixel_size(a: Column, e: Column, projected: Column) -> Column:
    return F.when(projected, (F.abs(a) + F.abs(e)) / 2.0)


def sensor_modality(text: Column) -> Column:
    """'sar' / 'optical' by word-bounded sensor tokens, radar first; NULL without one."""

    def pattern(tokens):
        return r"\b(" + "|".join(t.replace("-", r"\-") for t in tokens) + r")\b"

    upper = F.upper(text)
    return F.when(upper.rlike(pattern(C.SAR_SENSOR_TOKENS)), "sar").when(
        upper.rlike(pattern(C.OPTICAL_SENSOR_TOKENS)), "optical"
    )


def parse_patch_id(raw: Column) -> dict[str, Column]:
    """Eight parsed parts, the untouched original and a reject reason."""
    text = F.trim(raw)
    names = ("mission", "level", "sensing", "baseline", "orbit", "tile", "first", "second")
    matches = text.rlike(C.PATCH_ID_PATTERN)
    parts: dict[str, Column] = {}
    for group, name in enumerate(names, start=1):
        piece = F.when(matches, F.regexp_extract(text, C.PATCH_ID_PATTERN, group))
        parts[name] = piece.cast("int") if name in ("first", "second") else piece
    limit = C.PATCHES_PER_AXIS - 1
    parts["reject"] = F.when(~matches, "not_a_patch_id").when(
        (parts["first"] > limit) | (parts["second"] > limit), "grid_index_out_of_range"
    )
    parts["original"] = text
    return parts


def patch_offsets(first: Column, second: Column, convention: str) -> tuple[Column, Column]:
    """(row_off, col_off) in granule pixels under one grid convention."""
    row, col = (first, second) if convention.startswith("row_col") else (second, first)
    if convention.endswith("from_southwest"):
        row = F.lit(C.PATCHES_PER_AXIS - 1) - row
    return row * C.PATCH_SIDE_PX, col * C.PATCH_SIDE_PX


def window_bounds(row_off: Column, col_off: Column, a: Column, c: Column, e: Column, f: Column) -> dict[str, Column]:
    """World bounds of one patch window under a north-up affine."""
    side = F.lit(C.PATCH_SIDE_PX)
    return {
        "left_x": c + a * col_off,
        "bottom_y": f + e * (row_off + side),
        "right_x": c + a * (col_off + side),
        "top_y": f + e * row_off,
    }


def tile_origin(c: Column, f: Column, a: Column, e: Column, row_off: Column, col_off: Column) -> tuple[Column, Column]:
    """Origin of scene transform x translation(col, row)."""
    return c + a * col_off, f + e * row_off


def world_to_pixel(x: Column, y: Column, a: Column, c: Column, e: Column, f: Column) -> tuple[Column, Column]:
    return F.floor((y - f) / e), F.floor((x - c) / a)
