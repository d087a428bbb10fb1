"""Pixel algebra as Column expressions. Invalid pixels are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline import config as C


def null_if_nan(value: Column) -> Column:
    """Turn NaN into NULL once, at ingest."""
    return F.when(~F.isnan(value), value)


def valid_mask(bands: Sequence[str], nodata: Column | None = None) -> Column:
    """True where every band is finite and the pixel is not nodata."""
    ok = F.lit(True)
    for band in bands:
        value = F.col(band).cast("double")
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        ok = ok & F.coalesce(finite, F.lit(False))
    if nodata is not None:
        ok = ok & ~F.coalesce(nodata, F.lit(False))
    return ok


def normalised_difference(positive: Column, negative: Column, valid: Column | None = None) -> Column:
    """(p - n) / (p + n); NULL on a zero denominator or an invalid pixel."""
    total = positive + negative
    usable = total != 0
    if valid is not None:
        usable = usable & valid
    return F.when(usable, (positive - negative) / total)


def spectral_index(name: str, valid: Column | None = None) -> Column:
    positive, negative = C.INDEX_BANDS[name.upper()]
    return normalised_difference(F.col(positive), F.col(negative), valid)


def to_db(power: Column, floor_db: float = C.DB_FLOOR) -> Column:
    """10 log10 with a physical floor; NULL stays NULL."""
    floor = F.lit(floor_db)
    positive = F.when(power > 0, power)
    return F.when(power > 0, F.greatest(F.lit(10.0) * F.log10(positive), floor)).when(
        power.isNotNull(), floor
    )


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Clip (v - low) / (high - low) to [0, 1] with the degenerate range widened."""
    top = F.when(high <= low, low + F.lit(C.STRETCH_EPSILON)).otherwise(high)
    scaled = (value - low) / (top - low)
    return F.when(value.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def stretch_uint8(value: Column, low: Column, high: Column) -> Column:
    """8-bit stretch, truncated; invalid pixels are 0, a degenerate or empty band is mid-grey."""
    unit = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    # The nudge keeps exact grey levels from falling one short through rounding of the cuts.
    grey = F.when(value.isNotNull(), F.floor(unit * 255 + F.lit(1e-9))).otherwise(F.lit(0))
    return F.when(high > low, grey).otherwise(F.lit(128)).cast("int")


def area_km2(pixels: Column, pixel_size_m: Column) -> Column:
    """NULL rather than a wrong unit when there is no metric pixel size."""
    return F.when(pixel_size_m > 0, pixels * pixel_size_m * pixel_size_m / 1_000_000.0)


def past_cut(value: Column, cut: Column, above: bool) -> Column:
    """Threshold test on valid pixels only: invalid pixels are never positive."""
    hit = value >= cut if above else value <= cut
    return F.coalesce(hit, F.lit(False))
