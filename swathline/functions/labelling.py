"""Labelling a question by task, target and answerability, as Column cascades."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term groups of the labelling rules.
CHANGE_TERMS = (
    "change", "changed", "changes", "difference", "differences", "before", "after", "over time", "between the two",
    "new construction", "deforestation", "expanded", "grown", "since",
)
GROUNDING_TERMS = (
    "where is", "where are", "locate", "find the", "find all", "find any", "find every", "detect the", "detect all",
    "detect any", "detect every", "show me the", "mark the", "highlight", "bounding box", "bbox", "point to",
    "identify the location", "segment the",
)
CAPTION_TERMS = ("describe", "description of", "write a short", "caption", "summarise", "summarize", "what does this", "overview of")
MASK_TERMS = ("mask", "map of", "raster", "segmentation", "footprint", "delineate", "extract", "shapefile")
QUANTITATIVE_TERMS = (
    "how much", "how many", "what fraction", "what percentage", "what proportion", "ratio", "area of", "count",
    "largest", "smallest", "most", "least",
)
SPECTRAL_TERMS = ("healthy", "vegetation health", "ndvi", "ndwi", "ndbi", "mndwi", "chlorophyll", "moisture", "spectral")
IRREDUCIBLE_TERMS = (
    "healthy", "health", "ndvi", "ndwi", "ndbi", "mndwi", "chlorophyll", "moisture", "stress", "vigour", "vigor",
    "greenness", "spectral", "reflectance",
)
POLARIMETRIC_TERMS = ("polarimetric", "polarisation", "polarization", "dual-pol", "quad-pol", "cross-pol")
COLOUR_TERMS = ("colour", "color", "rgb", "how green", "what shade", "hue")
WATER_TERMS = ("water", "lake", "river", "reservoir", "flood", "pond", "sea", "coast", "wetland")
BUILTUP_TERMS = ("building", "urban", "built-up", "builtup", "settlement", "city", "construction", "house")
VEGETATION_TERMS = ("vegetation", "forest", "crop", "farm", "green cover", "tree", "plantation")
SPATIAL_TERMS = (
    "located", "positioned", "situated", "can be found", "is found",
    "top-left", "top-right", "bottom-left", "bottom-right", "upper-left", "upper-right", "lower-left", "lower-right",
    "top left", "top right", "bottom left", "bottom right", "upper left", "upper right", "lower left", "lower right",
    "left side", "right side", "left edge", "right edge", "middle-left", "middle-right", "middle left", "middle right",
    "section of", "portion of", "part of the image", "within the", "occupying", "encompassing", "encircling", "spanning",
    "crossing the", "running through", "across the", "diagonal", "centered in", "centred in", "visible in the",
    "top edge", "bottom edge", "corner", "centre of", "center of", "middle of", "next to", "adjacent to", "beside",
    "surrounded by", "closest to", "nearest to", "in front of", "behind the", "to the left", "to the right",
    "at the top", "at the bottom",
)
OBJECT_WORDS = (
    "airplane", "airport", "baseball-diamond", "basketball-court", "bridge", "chimney", "container-crane", "dam",
    "expressway-service-area", "expressway-toll-station", "golffield", "ground-track-field", "harbor", "harbour",
    "helicopter", "helipad", "overpass", "roundabout", "soccer-ball-field", "stadium", "storage-tank", "swimming-pool",
    "tennis-court", "trainstation", "windmill", "runway", "terminal", "building", "buildings", "house", "houses",
    "structure", "structures", "aircraft", "aeroplane", "plane", "planes", "jet", "ship", "ships", "vessel", "vessels",
    "boat", "boats", "water", "lake", "river", "reservoir", "forest", "vegetation", "cropland", "farmland", "urban",
    "built-up", "builtup", "bare", "sand", "grassland", "pasture", "wetland", "region", "area",
)
OBJECT_PHRASES = (
    "baseball diamond", "basketball court", "container crane", "expressway service area", "expressway toll station",
    "golf field", "golf course", "ground track field", "soccer ball field", "soccer field", "storage tank",
    "storage tanks", "swimming pool", "tennis court", "train station",
)
LOCATE_PHRASE = (
    r"(?:where (?:is|are)|locate|find|highlight|point to)\s+(?:the\s+|all\s+|any\s+|every\s+)?([a-z\-]+(?:\s+[a-z\-]+)?)"
)
# Change operation -> pattern; the first match wins, the most specific stands first.
OPERATION_RULES = (
    ("magnitude", r"none,\s*a few,\s*dozens,?\s*or many"),
    ("where", r"north,\s*south,\s*east,?\s*or west"),
    ("direction", r"increase,\s*decrease,?\s*or stay unchanged"),
    ("compare", r"which image contains more"),
    ("count_demolished", r"how many buildings were demolished"),
    ("count_appeared", r"how many new buildings appeared"),
    ("presence_demolished", r"were any buildings demolished"),
    ("presence_appeared", r"did any new buildings appear"),
)
# Task -> bundle types it can run on.
TASK_REQUIRES = {
    "single_vqa": ("single", "crossmodal", "bitemporal"),
    "single_caption": ("single", "crossmodal", "bitemporal"),
    "single_grounding": ("single", "crossmodal", "bitemporal"),
    "change_description": ("bitemporal",),
    "change_vqa": ("bitemporal",),
    "change_map": ("bitemporal",),
    "crossmodal_extraction": ("crossmodal",),
    "crossmodal_vqa": ("crossmodal",),
}


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """One alternation instead of a chain of substring tests."""
    return text.rlike("|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms))


def lowered(question: Column) -> Column:
    return F.lower(F.btrim(question, F.lit(" \t\r\n")))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[a-z\-]+"), F.lit(0))


def is_referring_expression(question: Column) -> Column:
    """Not a question, at least six words, names a known object and places it."""
    text = lowered(question)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    known = F.arrays_overlap(word_list(text), F.array(*[F.lit(w) for w in OBJECT_WORDS])) | has_any(text, OBJECT_PHRASES)
    return ~text.endswith("?") & (words >= 6) & known & has_any(text, SPATIAL_TERMS)


def targets(question: Column) -> Column:
    """Array of the target groups the question mentions, in fixed order."""
    text = lowered(question)
    groups = (("water", WATER_TERMS), ("builtup", BUILTUP_TERMS), ("vegetation", VEGETATION_TERMS))
    return F.filter(F.array(*[F.when(has_any(text, terms), F.lit(name)) for name, terms in groups]), lambda t: t.isNotNull())


def grounding_noun(question: Column) -> Column:
    """First vocabulary word, else the phrase after a locate-style verb."""
    text = lowered(question)
    vocabulary = F.array(*[F.lit(w) for w in OBJECT_WORDS])
    known = F.get(F.filter(word_list(text), lambda w: F.array_contains(vocabulary, w)), F.lit(0))
    phrase = F.regexp_extract(text, LOCATE_PHRASE, 1)
    kept = F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: ~w.isin("in", "on", "at", "of", "from", ""))
    return F.coalesce(known, F.when(F.size(kept) > 0, F.array_join(kept, " ")))


def label_task(question: Column, optical: Column, sar: Column, images: Column) -> tuple[Column, Column]:
    """(task, path) by inputs first, then change, grounding, caption and question wording."""
    text = lowered(question)
    mask, numbers = has_any(text, MASK_TERMS), has_any(text, QUANTITATIVE_TERMS)
    caption, grounding, change = has_any(text, CAPTION_TERMS), has_any(text, GROUNDING_TERMS), has_any(text, CHANGE_TERMS)
    refers = is_referring_expression(question)
    cross = optical & sar
    temporal = (images >= 2) & ~cross
    task = (
        F.when(cross & (mask | numbers), "crossmodal_extraction").when(cross, "crossmodal_vqa")
        .when(temporal & mask, "change_map").when(temporal & numbers, "change_vqa").when(temporal & caption, "change_description")
        .when(temporal, "change_vqa")
        .when(change & (images < 2) & ~refers, "change_vqa")
        .when(grounding | mask | refers, "single_grounding")
        .when(caption & ~text.endswith("?"), "single_caption")
        .otherwise("single_vqa")
    )
    tie = ~cross & ~temporal & ~(change & (images < 2) & ~refers) & ~(grounding | mask | refers) & caption & text.endswith("?")
    return task, F.when(tie, "llm").otherwise("rules")


def choose_measurement(target: Column, indices: Column, pan_only: Column, sar_band: Column) -> Column:
    """Tool and index for a target under the bands at hand, or 'refusal'."""
    has = lambda i: F.array_contains(indices, i)
    index = lambda *names: reduce(lambda acc, n: acc.when(has(n), f"spectral_index:{n}"), names[1:], F.when(has(names[0]), f"spectral_index:{names[0]}"))
    water = F.coalesce(index("MNDWI", "NDWI"), F.when(~pan_only, "texture_seg"), F.lit("refusal"))
    vegetation = F.coalesce(index("NDVI"), F.when(~pan_only, "texture_seg"), F.lit("refusal"))
    builtup = F.coalesce(index("NDBI"), F.when(sar_band.isNotNull(), "sar_backscatter"), F.when(~pan_only, "texture_seg"), F.lit("refusal"))
    return F.when(target == "water", water).when(target == "vegetation", vegetation).when(target == "builtup", builtup).otherwise("refusal")


def refusal(question: Column, task: Column, optical: Column, sar: Column, images: Column, blind: Column, texture_planned: Column) -> tuple[Column, Column]:
    """(reason, category) of a question the inputs cannot answer; NULLs when they can."""
    text = lowered(question)
    spectral = has_any(text, SPECTRAL_TERMS)
    reason = (
        F.when(task.startswith("change_") & (images < 2), "change_needs_two_images")
        .when(task.startswith("crossmodal_") & ~(optical & sar), "cross_modal_needs_both")
        .when(sar & ~optical & has_any(text, COLOUR_TERMS), "radar_has_no_colour")
        .when(blind & spectral & has_any(text, IRREDUCIBLE_TERMS) & ~sar, "no_infrared_band")
        .when(blind & spectral & ~sar & ~texture_planned, "no_spectral_band")
    )
    category = F.when(reason.isin("change_needs_two_images", "cross_modal_needs_both"), "missing_input").when(reason.isNotNull(), "modality_limitation")
    return reason, category


def warnings(question: Column, optical: Column, sar: Column, crs_distinct: Column, crs_missing: Column, nodata: Column, single_pol: Column) -> Column:
    """Array of warning codes, in fixed order."""
    text = lowered(question)
    return F.filter(
        F.array(
            F.when(crs_distinct > 1, F.lit("crs_mismatch")), F.when(crs_missing > 0, F.lit("crs_missing")),
            F.when(sar & ~optical & has_any(text, SPECTRAL_TERMS), F.lit("spectral_on_radar")),
            F.when(single_pol & has_any(text, POLARIMETRIC_TERMS), F.lit("single_polarisation")),
            F.when(nodata > 0.5, F.lit("mostly_nodata")),
        ),
        lambda w: w.isNotNull(),
    )


def change_operation(question: Column) -> Column:
    first, *rest = [(question.rlike("(?i)" + p), name) for name, p in OPERATION_RULES]
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(*first))
