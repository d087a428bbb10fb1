"""Box and ring geometry as Column expressions (x first, normalised to [0, 1])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns and limits of the box conventions.
MIN_EXTENT = 0.01
PROMPT_SCALE = 1000
REFERENCE_SCALE = 100
ANSWER_NUMBER = r"-?\d+\.?\d*"
BOX_NUMBER = r"(?<![A-Za-z0-9_])-?\d+(?:\.\d+)?(?![A-Za-z_])"
REFERENCE_COORD = r"<(\d+)>"
WKT_PAIR = r"(-?\d+\.?\d*)\s+(-?\d+\.?\d*)"


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("xmin"), y1.alias("ymin"), x2.alias("xmax"), y2.alias("ymax"))


def inverted(b: Column) -> Column:
    return (b["xmin"] > b["xmax"]) | (b["ymin"] > b["ymax"])


def from_pixels(values: Sequence[Column], width: Column, height: Column, order: str = "yxyx") -> Column:
    """Normalised, clamped box; NULL when the corners are inverted."""
    a, b, c, d = values
    x1, y1, x2, y2 = (b, a, d, c) if order == "yxyx" else (a, b, c, d)
    made = box(x1 / width, y1 / height, x2 / width, y2 / height)
    clamped = box(*[clamp01(made[k]) for k in ("xmin", "ymin", "xmax", "ymax")])
    return F.when(~inverted(made), clamped)


def to_prompt(b: Column, scale: int = PROMPT_SCALE) -> Column:
    """Half-even integers on the prompt scale, x first."""
    return F.array(*[F.bround(clamp01(b[k]) * scale).cast("int") for k in ("xmin", "ymin", "xmax", "ymax")])


def rescale_text(text: Column, scale: int = PROMPT_SCALE) -> Column:
    """Rewrite a [0, 1] box answer onto the prompt scale; anything else is left alone."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(ANSWER_NUMBER), F.lit(0)), lambda n: n.cast("double"))
    first = F.slice(numbers, 1, 4)
    whole = F.transform(first, lambda v: F.bround(v * scale).cast("int").cast("string"))
    piece = lambda i: F.get(whole, F.lit(i))
    rewritten = F.concat(F.lit("["), piece(0), F.lit(" "), piece(1), F.lit(", "), piece(2), F.lit(" "), piece(3), F.lit("]"))
    done = (F.size(numbers) < 4) | F.exists(first, lambda v: v > 1.0)
    return F.when(done, text).otherwise(rewritten)


def widen(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Widen a span that two decimals cannot express, keeping it inside the frame."""
    enough = F.bround(hi, 2) - F.bround(lo, 2) >= MIN_EXTENT
    low, high = (lo + hi) / 2 - MIN_EXTENT / 2, (lo + hi) / 2 + MIN_EXTENT / 2
    new_low = F.when(low < 0, 0.0).when(high > 1, 1.0 - MIN_EXTENT).otherwise(low)
    new_high = F.when(low < 0, MIN_EXTENT).when(high > 1, 1.0).otherwise(high)
    return F.when(enough, lo).otherwise(new_low), F.when(enough, hi).otherwise(new_high)


def box_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.format_string("[%.2f %.2f, %.2f %.2f]", x1, y1, x2, y2)


def box_string(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clamped, widened two-decimal box text."""
    x1, x2 = widen(clamp01(x1), clamp01(x2))
    y1, y2 = widen(clamp01(y1), clamp01(y2))
    return box_text(x1, y1, x2, y2)


def touches_edge(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 1.0) -> Column:
    return (x <= margin) | (y <= margin) | (x + w >= width - margin) | (y + h >= height - margin)


def quadrant(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    vertical = F.when((y + h / 2) / height < 0.5, "top").otherwise("bottom")
    horizontal = F.when((x + w / 2) / width < 0.5, "left").otherwise("right")
    return F.concat_ws(" ", vertical, horizontal)


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    zero = F.lit(0.0)
    inter = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def reference_box(text: Column) -> Column:
    """``{<x1><y1><x2><y2>}`` on 0-100 -> ordered normalised box, NULL on zero area."""
    v = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE_COORD), F.lit(1)), lambda n: n.cast("double") / REFERENCE_SCALE)
    at = lambda i: F.get(v, F.lit(i))
    made = box(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3)))
    return F.when((F.size(v) == 4) & (made["xmax"] > made["xmin"]) & (made["ymax"] > made["ymin"]), made)


def wkt_ring(wkt: Column) -> Column:
    """Exterior ring as array<struct<x, y>>; empty for EMPTY or malformed text."""
    body = F.regexp_extract(wkt, r"\(([^()]*)\)", 1)
    xs = F.regexp_extract_all(body, F.lit(WKT_PAIR), F.lit(1))
    ys = F.regexp_extract_all(body, F.lit(WKT_PAIR), F.lit(2))
    ring = F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    empty = F.slice(ring, 1, 0)
    return F.when(wkt.isNull() | F.upper(wkt).contains("EMPTY"), empty).otherwise(ring)


def ring_area(ring: Column) -> Column:
    """Shoelace area; fewer than three points enclose nothing."""
    rotated = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, rotated, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(ring) >= 3, F.abs(total) / 2).otherwise(0.0)


def ring_box(ring: Column, a: Column, c: Column, e: Column, f: Column, width: Column, height: Column) -> Column:
    """Ring extent through the inverse affine, clipped to the frame; NULL when degenerate."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    left, right = F.floor((F.array_min(xs) - c) / a), F.floor((F.array_max(xs) - c) / a)
    top, bottom = F.floor((F.array_max(ys) - f) / e), F.floor((F.array_min(ys) - f) / e)
    clip = lambda v, top_value: F.least(F.greatest(v, F.lit(0)), top_value)
    made = box(clip(left, width), clip(top, height), clip(right, width), clip(bottom, height))
    # Held in an array, the box is worked out once for the test and the result.
    return F.get(F.filter(F.array(made), lambda b: (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"])), F.lit(0))
