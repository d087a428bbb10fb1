"""Corpus checks as aggregates; each returns findings, never a driver-side list of rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.stats import exact_percentiles
from swathline.session import cut_lineage

# Limits of the corpus checks.
REQUIRED_FIELDS = ("sample_id", "adapter", "task", "images", "question", "answer")
MAX_ANSWER_SHARE = 0.80
MIN_ROWS_FOR_WARNING = 20
MAX_ROWS_PER_SET = 16
MIN_PIXEL_STD = 1.0
GRAM, GRAM_SLICE = 4, 1 << 20  # words of a gram; words worked on at once
GRAM_MIXES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xD6E8FEB86659FD93, 0x94D049BB133111EB))


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def check_schema(rows: DataFrame) -> DataFrame:
    """Rows with an empty required field, without a type, without a licence."""
    missing = F.lit(False)
    for name in REQUIRED_FIELDS:
        missing = missing | blank(name)
    return rows.agg(
        F.count("*").alias("rows"), count_if(missing).alias("missing_required"),
        count_if(blank("question_type") & blank("task")).alias("untyped"), count_if(blank("licence")).alias("unlicensed"),
    )


def check_duplicates(rows: DataFrame) -> DataFrame:
    """Repeated (images, question) pairs with the worst count, and repeated sample ids."""
    asked = rows.groupBy("images", "question").agg(F.count("*").alias("n")).where("n > 1")
    ids = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")
    return asked.agg(F.count("*").alias("repeated_questions"), F.coalesce(F.max("n"), F.lit(0)).alias("worst")).crossJoin(
        ids.agg(F.count("*").alias("duplicate_ids"))
    )


def check_twins(rows: DataFrame) -> DataFrame:
    """Twins across splits, complete, opposing and single; warn when under half oppose.

    Minimum and maximum tell whether a twin's splits or answers differ without a distinct set.
    """
    twins = rows.where(F.col("twin_id").isNotNull()).groupBy("twin_id").agg(
        F.count("*").alias("n"), (F.min("split") != F.max("split")).alias("straddles"), (F.min("answer") != F.max("answer")).alias("flips")
    )
    out = twins.agg(
        F.count("*").alias("twins"), count_if(F.col("n") > 1).alias("complete"),
        count_if((F.col("n") > 1) & F.col("flips")).alias("opposing"), count_if(F.col("n") == 1).alias("single"),
        count_if(F.col("straddles")).alias("straddling"),
    )
    return out.withColumn("warn", F.coalesce(F.try_divide("opposing", "complete") < 0.5, F.lit(False)))


def answer_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, F.lower(F.col("answer").cast("string")).alias("answer")).agg(F.count("*").alias("n"))


def check_balance(rows: DataFrame, kind: str) -> DataFrame:
    """Per type: n, distinct answers, mode and share; constant is an error, a dominant mode a warning."""
    per = answer_counts(rows, [kind]).groupBy(kind).agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct_answers"),
        F.max(F.struct("n", "answer")).alias("top"),
    )
    share = F.col("top.n") / F.col("n")
    level = (
        F.when((F.col("distinct_answers") == 1) & (F.col("n") > 1), "error")
        .when((share > MAX_ANSWER_SHARE) & (F.col("n") >= MIN_ROWS_FOR_WARNING), "warning").otherwise("ok")
    )
    return per.select(kind, "n", "distinct_answers", F.col("top.answer").alias("most_common"), F.round(share, 3).alias("share"), level.alias("level"))


def check_image_load(rows: DataFrame) -> DataFrame:
    """Rows per image and per unordered image set; warn past the per-set cap."""
    images = rows.select(F.explode("images").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    sets = rows.groupBy(F.array_sort(F.array_distinct("images")).alias("s")).agg(F.count("*").alias("n"))
    per_image = images.agg(F.count("*").alias("distinct_images"), F.max("n").alias("rows_per_image_max"))
    per_set = sets.agg(F.count("*").alias("distinct_image_sets"), F.max("n").alias("rows_per_set_max"), count_if(F.col("n") > MAX_ROWS_PER_SET).alias("overloaded_sets"))
    return per_image.crossJoin(per_set).withColumn("warn", F.col("rows_per_set_max") > MAX_ROWS_PER_SET)


def check_pixels(items: DataFrame, pixels: DataFrame, key: Sequence[str], band: str) -> DataFrame:
    """Listed images that have no pixels, or whose pixels are flat."""
    spread = pixels.groupBy(*key).agg(F.coalesce(F.stddev_pop(band), F.lit(0.0)).alias("std"))
    state = F.when(F.col("std").isNull(), "missing").when(F.col("std") < MIN_PIXEL_STD, "blank").otherwise("ok")
    return items.join(spread, list(key), "left").select(*key, state.alias("state"))


def check_splits(rows: DataFrame) -> DataFrame:
    name = F.coalesce("split", F.lit(""))
    return rows.groupBy(name.alias("split")).agg(F.count("*").alias("n")).withColumn("error", F.col("split") == "")


def balance_report(rows: DataFrame, kind: str) -> DataFrame:
    """Rows per image mean and maximum, yes share, and the type table."""
    images = rows.groupBy("images").agg(F.count("*").alias("n"))
    load = images.agg(F.sum("n").alias("rows"), F.count("*").alias("images"), F.max("n").alias("rows_per_image_max"))
    counts = answer_counts(rows, [kind])
    yes = F.sum(F.when(F.col("answer") == "yes", F.col("n")))
    polar = F.sum(F.when(F.col("answer").isin("yes", "no"), F.col("n")))
    share = counts.agg(F.round(F.try_divide(yes, polar), 3).alias("yes_share"), F.count_distinct(kind).alias("types"))
    return load.crossJoin(share).withColumn("rows_per_image_mean", F.round(F.col("rows") / F.col("images"), 2))


def verify_rows(rows: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored answers against answers recomputed from labels, joined on pair, order and question."""
    joined = rows.join(recomputed.select(*keys, F.col("answer").alias("expected")), list(keys), "left")
    state = (
        F.when(F.col("order_error"), "order_error").when(F.col("expected").isNull(), "not_produced")
        .when(F.col("expected") == F.col("answer"), "verified").otherwise("mismatch")
    )
    return joined.groupBy("task", state.alias("state")).agg(F.count("*").alias("n"))


def blind_ceiling(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of the majority answer: what guessing it scores."""
    return answer_counts(rows, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.round(100 * F.max("n") / F.sum("n"), 2).alias("blind_ceiling")
    )


def gram_codes(words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """Two 64-bit codes for each run of ``GRAM`` words inside a row of hashed words; a run repeated in a slice comes once."""
    ends = words.offsets.to_numpy()
    codes = words.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    left = np.repeat(ends[1:] - ends[0], np.diff(ends)) - np.arange(len(codes))  # words of the row from here on
    for at in range(0, len(codes), GRAM_SLICE):
        part = codes[at : at + GRAM_SLICE + GRAM - 1]
        begin = np.flatnonzero(left[at : at + GRAM_SLICE] >= GRAM)
        out = []
        for by, spread in GRAM_MIXES:
            total = np.zeros(len(begin), dtype=np.uint64)
            for k in range(GRAM):
                total = (total + part[begin + k]) * np.uint64(by)
                total ^= total >> np.uint64(29)
                total *= np.uint64(spread)
                total ^= total >> np.uint64(32)
            out.append(total.view(np.int64))
        order = np.argsort(out[0])
        a, b = (x[order] for x in out)
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def caption_diversity(captions: DataFrame, text: str) -> DataFrame:
    """Top opening share, distinct openings, distinct 4-gram ratio, median words and sentences.

    One reading of the texts gives openings and sizes, another the grams, which are told apart by 128 bits and never written out."""
    # Five pieces hold the first four words, as only the first piece can be empty.
    first = F.filter(F.slice(F.split(F.col(text), r"\s+", 6), 1, 5), lambda w: w != "")
    words, stops = F.regexp_count(F.col(text), F.lit(r"\S+")), F.regexp_count(F.col(text), F.lit(r"\."))
    base = cut_lineage(captions.select(F.array_join(F.slice(first, 1, 4), " ").alias("o"), words.alias("words"), stops.alias("stops"), F.lit(0).alias("one")))
    openings = base.groupBy("o").agg(F.count("*").alias("n"))
    head = openings.agg(F.sum("n").alias("captions"), F.count("*").alias("distinct_openings"), F.max("n").alias("top"))
    lower = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    hashed = captions.where(F.col(text).isNotNull()).select(F.transform(lower, lambda w: F.xxhash64(w)).alias("w"))
    codes = hashed.mapInArrow(lambda batches: (out for b in batches for out in gram_codes(b.column(0))), "a long, b long")
    # Slices are without repeats, so no gram is hot and rows go unsummed to where they are told apart.
    distinct = codes.repartition("a").groupBy("a", "b").agg(F.lit(1)).agg(F.count("*").alias("distinct_grams"))
    total = base.agg(F.coalesce(F.nullif(F.sum(F.greatest(F.col("words") - (GRAM - 1), F.lit(0))), F.lit(0)), F.lit(1)).alias("grams"))
    ratio = distinct.crossJoin(total)
    sized = base.select("one", F.col("words").cast("double"), F.col("stops").cast("double"))
    middle = lambda c, name: exact_percentiles(sized, ["one"], c, {name: 0.5}, nearest_rank=True).select(F.col(name).cast("long").alias(name))
    return head.crossJoin(ratio).crossJoin(middle("words", "median_words")).crossJoin(middle("stops", "median_sentences")).select(
        "captions", F.round(F.col("top") / F.col("captions"), 4).alias("top_opening_share"), "distinct_openings",
        F.round(F.col("distinct_grams") / F.col("grams"), 4).alias("distinct_4gram_ratio"), "median_words", "median_sentences",
    )


def licence_gate(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Train rows whose source matches a blocked, evaluation-only or unstaged pattern."""
    verdict = F.coalesce(*[F.when(F.col("source").rlike(f"(?i){pattern}"), F.lit(reason)) for pattern, reason in rules.items()])
    return rows.where(F.col("split") == "train").withColumn("reason", verdict).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n"))


def parameter_audit(calls: DataFrame, permitted: Mapping[str, Mapping[str, dict]], bands: Mapping[str, Sequence[str]]) -> DataFrame:
    """Reasons a (tool, param, value) is not allowed: unknown tool or parameter, enum, type or range, missing band."""
    reason = F.lit("unknown_tool")
    for tool, params in permitted.items():
        inner = F.lit("unknown_parameter")
        for name, rule in params.items():
            number = F.col("value").try_cast("double")
            bad = F.lit(None).cast("string")
            if "enum" in rule:
                bad = F.when(~F.col("value").isin(*rule["enum"]), "not_in_enum")
            if "range" in rule:
                low, high = rule["range"]
                bad = F.when(number.isNull(), "not_a_number").when((number < low) | (number > high), "out_of_range")
            if rule.get("int"):
                bad = F.when(number.isNull() | (number != F.floor(number)), "not_an_integer").otherwise(bad)
            inner = F.when(F.col("param") == name, bad).otherwise(inner)
        if tool in bands:
            lacking = F.size(F.array_except(F.array(*[F.lit(b) for b in bands[tool]]), F.col("bands"))) > 0
            inner = F.when(lacking, "missing_band").otherwise(inner)
        reason = F.when(F.col("tool") == tool, inner).otherwise(reason)
    return calls.withColumn("reason", reason)


def mask_conformance(masks: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask tables against the scene frame: pixel count, bounds, CRS; positives and area."""
    facts = masks.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.max("r").alias("r_max"), F.max("c").alias("c_max"), F.min(F.least("r", "c")).alias("low"),
        count_if(F.col("hit")).alias("positive_px"), F.min("crs").alias("mask_crs"), F.max("crs").alias("mask_crs_hi"),
    )
    joined = headers.join(facts, list(keys), "left")
    reject = (
        F.when(F.col("pixels").isNull(), "no_mask")
        .when((F.col("pixels") != F.col("height") * F.col("width")) | (F.col("r_max") >= F.col("height")) | (F.col("c_max") >= F.col("width")) | (F.col("low") < 0), "shape")
        .when((F.col("mask_crs") != F.col("crs")) | (F.col("mask_crs") != F.col("mask_crs_hi")), "crs")
    )
    area = F.round(F.col("positive_px") * F.col("pixel_size") * F.col("pixel_size"), 3)
    return joined.select(*keys, reject.alias("reject"), "positive_px", area.alias("area_m2"))


def trace_shape(raw: DataFrame, text: str, schema: str, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose JSON breaks the schema or an enumeration."""
    parsed = raw.withColumn("j", F.from_json(F.col(text), schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    fault = F.when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), "malformed")
    for field, allowed in enums.items():
        fault = fault.when(F.col(f"j.{field}").isNull(), f"missing_{field}").when(~F.col(f"j.{field}").isin(*allowed), f"bad_{field}")
    return parsed.withColumn("fault", fault)
