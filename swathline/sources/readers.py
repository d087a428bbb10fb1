"""Strict readers. Schemas are explicit and malformed input fails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline import schema as SCH
from swathline.operators.joins import nest_in_parts

EXCLUDED_CATEGORIES = ("country", "season", "climate zone")
ANNOTATION_COLUMNS = ("patch_id", "input", "output", "type", "category", "split", "country", "season", "climate_zone")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty selection is a staging mistake: one-row probe, then the lazy frame."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def read_manifest(spark: SparkSession, path: str, adapter: str | None = None, split: str | None = None) -> DataFrame:
    """Question rows as JSON lines; malformed lines and empty selections are errors."""
    rows = spark.read.schema(SCH.QA).json(path, mode="FAILFAST")
    if adapter is not None:
        rows = rows.where(F.col("adapter") == adapter)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return require_rows(rows, f"{path} for adapter={adapter} split={split}")


def clean_annotations(rows: DataFrame, split: str) -> DataFrame:
    """Nine columns of one split; blank categories become caption, excluded ones go."""
    category = F.coalesce(F.nullif(F.nullif(F.col("category"), F.lit("None")), F.lit("")), F.lit("caption"))
    kept = rows.select(*ANNOTATION_COLUMNS).where(F.col("split") == split).withColumn("category", category)
    return kept.where(~F.lower("category").isin(*EXCLUDED_CATEGORIES))


def read_annotation_parquet(spark: SparkSession, path: str, split: str) -> DataFrame:
    return require_rows(clean_annotations(spark.read.parquet(path), split), f"{path} split={split}")


def footprint_features(documents: DataFrame) -> DataFrame:
    """Feature collections -> (identifier, ring-mean centroid); a feature without Id is an error."""
    features = documents.select(F.explode("features").alias("f"))
    identifier = F.coalesce(F.col("f.properties.Id"), F.raise_error(F.lit("footprint feature without a persistent Id")).cast("long"))
    ring = F.get(F.col("f.geometry.coordinates"), F.lit(0))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i))) / F.size(ring)
    return features.select(identifier.alias("obj_id"), mean(0).alias("x"), mean(1).alias("y"))


def read_footprints_geojson(spark: SparkSession, path: str) -> DataFrame:
    return footprint_features(spark.read.schema(SCH.FOOTPRINTS).json(path, multiLine=True, mode="FAILFAST"))


def coco_boxes(images: DataFrame, annotations: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed images with their boxes nested in bounded parts; the class comes from ``role``."""
    tiles = images.join(listed, "image_id")
    box = F.struct("role", "x", "y", "w", "h", "truncated")
    order = F.sha2(F.concat_ws("|", "image_id", "box_id"), 256)
    parts = nest_in_parts(annotations, ["image_id"], order, "box_id", box)
    return tiles.join(parts.withColumnRenamed("items", "boxes"), "image_id", "left")


def listed_gap(images: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed tiles that the image table lacks."""
    return listed.join(images, "image_id", "left_anti")


def vqa_release(questions: DataFrame, answers: DataFrame, images: DataFrame, splits: DataFrame) -> DataFrame:
    """Active questions with answer, image and split, by equi-joins on their ids."""
    active = questions.where("active")
    return active.join(answers, "question_id").join(images, "image_id").join(splits.where("active").select("image_id", "split"), "image_id")


def unanswered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.where("active").join(answers, "question_id", "left_anti")


def alias(*names: str) -> Column:
    """First non-empty of several alias columns."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def benchmark_records(rows: DataFrame, aliases: Mapping[str, Sequence[str]], files: DataFrame, eval_only: Sequence[str]) -> DataFrame:
    """Alias-tolerant records; the image resolves by file name or stem, evaluation-only sets become test rows."""
    name = F.regexp_extract(alias(*aliases["image"]), r"([^/\\]+)$", 1)
    base = rows.select("record_id", "source", "split", *[alias(*aliases[k]).alias(k) for k in ("question", "answer", "type")], name.alias("name"))
    base = base.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    by_name = files.select(F.col("file").alias("name"), F.col("path").alias("p1"))
    stems = files.groupBy(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem")).agg(F.min("path").alias("p2"))
    found = base.join(by_name, "name", "left").join(stems, "stem", "left")
    split = F.when(F.col("source").isin(*eval_only), "test").otherwise(F.col("split"))
    return found.select("record_id", "question", "answer", "type", F.coalesce("p1", "p2").alias("path"), split.alias("split"))


def modality_inventory(listing: DataFrame, key: str, modalities: Sequence[str]) -> DataFrame:
    """Keys present in every modality, and how many each modality loses."""
    flags = [F.max((F.col("modality") == m).cast("int")).alias(m) for m in modalities]
    seen = listing.groupBy(key).agg(*flags)
    return seen.withColumn("complete", sum((F.col(m) for m in modalities), F.lit(0)) == len(modalities))


def drop_counts(inventory: DataFrame, modalities: Sequence[str]) -> DataFrame:
    losses = [F.sum(F.when(~F.col("complete"), F.col(m)).otherwise(0)).alias(f"{m}_dropped") for m in modalities]
    return inventory.agg(F.sum(F.col("complete").cast("long")).alias("kept"), *losses)


def pair_s1_s2(metadata: DataFrame, radar: DataFrame, optical: DataFrame) -> DataFrame:
    """Metadata rows with both rasters, through the patch and radar names."""
    return metadata.join(optical, metadata["patch_id"] == optical["stem_s2"], "left").join(radar, metadata["s1_name"] == radar["stem_s1"], "left")


def first_decodable_pair(files: DataFrame) -> DataFrame:
    """First readable path per (name, side); a name lacking a side is rejected."""
    readable = files.where("readable")
    side = lambda s: F.min(F.when(F.col("side") == s, F.col("path")))
    return readable.groupBy("name").agg(side("before").alias("before"), side("after").alias("after")).where("before IS NOT NULL AND after IS NOT NULL")


def pixel_window(pixels: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """Windowed read: a range predicate that reaches the Parquet scan."""
    return pixels.where(F.col("r").between(row_off, row_off + height - 1) & F.col("c").between(col_off, col_off + width - 1))


def overview(pixels: DataFrame, keys: Sequence[str], height: int, width: int, max_side: int, bands: Sequence[str]) -> DataFrame:
    """Nearest-pixel decimation to at most ``max_side`` on the longer side.

    Output cell (i, j) takes source cell (floor((i + 0.5) h / oh), ...): a filter and a renaming, no
    aggregate.
    """
    factor = max(height, width) / max_side
    oh, ow = (height, width) if factor <= 1 else (round(height / factor), round(width / factor))
    cell = lambda index, size, out: F.floor(F.col(index) * out / F.lit(float(size)))
    source = lambda cell_index, size, out: F.floor((cell_index + 0.5) * size / F.lit(float(out)))
    i, j = cell("r", height, oh), cell("c", width, ow)
    chosen = (source(i, height, oh) == F.col("r")) & (source(j, width, ow) == F.col("c"))
    return pixels.where(chosen).select(*keys, i.alias("r"), j.alias("c"), *bands)


def resolve_granule(patches: DataFrame, products: DataFrame) -> DataFrame:
    """Exactly one online product per patch, else the reason: none, all_offline, ambiguous.

    Matches are counted per patch with map-side combine before the verdict.
    """
    on = ["mission", "level", "sensing", "orbit", "tile"]
    joined = patches.join(products, on, "left")
    online = F.coalesce("online", F.lit(False))
    counts = joined.groupBy("patch_id").agg(
        F.count("product").alias("matches"), F.sum(online.cast("long")).alias("live"), F.min(F.when(online, F.col("product"))).alias("product")
    )
    reject = F.when(F.col("matches") == 0, "none").when(F.col("live") == 0, "all_offline").when(F.col("live") > 1, "ambiguous")
    return counts.select("patch_id", "matches", reject.alias("reject"), F.when(reject.isNull(), F.col("product")).alias("product"))
