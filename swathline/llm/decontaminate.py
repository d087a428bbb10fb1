"""Benchmark decontamination by templates, in built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import sized, stored

#: Tokens of a template window, tokens in it that must be words and not placeholders, share of an item's windows that a
#: document must hold, and share of the slots whose values must map alike.
WINDOW, LITERALS, COVER, CONSISTENT = 5, 2, 0.4, 0.8
#: Windows of the benchmark up to which their table is broadcast (about 60 bytes each).
WINDOWS = 1_000_000

#: Placeholders from the private use area, so that no word of a text is one.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
# Words that are a unit after a number.
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|foot|feet|yd|yard|yards|mile|miles|meter|meters|metre|metres|kilometer|kilometers|kilometre"
    "|kilometres|mg|g|kg|gram|grams|kilogram|kilograms|lb|lbs|pound|pounds|oz|ounce|ounces|ton|tons|tonne|tonnes|ml|cl|l|liter"
    "|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months"
    "|year|years|percent|degree|degrees|dollar|dollars|cent|cents|euro|euros|usd|eur|mph|kmh|hz|khz|mhz|w|kw|v|j|kj"
)


def tokens(text: Column) -> Column:
    """Words and numbers of a text, parted by one space; ``.`` and ``,`` between digits stay in the number."""
    return F.trim(F.regexp_replace(text, rf"(?:[^\p{{L}}\p{{M}}\p{{N}}.,{NUMBER}-{NAME}]|[.,](?![0-9])|(?<![0-9])[.,])+", " "))


def template(text: Column) -> Column:
    """As ``tokens``, one for one, with typed placeholders: numbers, units after a number, capitalised words inside a sentence.

    The rest is in lower case, words in capitals too, so a passage set in capitals keeps its template.
    """
    named = F.regexp_replace(text, r"(?<=[\p{L},] )\p{Lu}\p{Ll}[\p{L}\p{M}]*", NAME)
    numbered = F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER)
    spaced = F.regexp_replace(numbered, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{NAME}]+", " ")
    return F.trim(F.lower(F.regexp_replace(spaced, rf"{NUMBER} (?i:{UNITS})(?![^ ])", f"{NUMBER} {UNIT}")))


def shifted(form: Column) -> list[Column]:
    return [form if i == 0 else F.slice(form, i + 1, F.greatest(F.size(form) - i, F.lit(0))) for i in range(WINDOW)]


def windows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, window)``: the hash of every template window of a text. Texts of fewer tokens have none."""
    form = rows.select(F.col(key), F.split(template(F.col(text)), " ").alias("_form")).where(F.size("_form") >= WINDOW)
    names = [f"_t{i}" for i in range(WINDOW)]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(shifted(F.col("_form")), names)])
    return form.select(key, F.inline(zipped)).where(F.col(names[-1]).isNotNull()).select(key, F.xxhash64(*names).alias("window"))


def placed_windows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, at, window, kind, value, words)``: windows with their place, how many of their tokens are words, and the kind and
    value of the first token where that is a placeholder."""
    read = rows.select(F.col(key), F.split(template(F.col(text)), " ").alias("_form"), F.split(tokens(F.col(text)), " ").alias("_raw"))
    names = [f"_t{i}" for i in range(WINDOW)]
    parts = [c.alias(n) for c, n in zip(shifted(F.col("_form")), names)] + [F.col("_raw").alias("_raw")]
    out = read.where(F.size("_form") >= WINDOW).select(key, F.posexplode(F.arrays_zip(*parts)).alias("at", "_w")).select(key, "at", "_w.*")
    held = lambda n: F.substring(n, 1, 1).isin(NUMBER, UNIT, NAME)
    return out.where(F.col(names[-1]).isNotNull()).select(
        key, "at", F.xxhash64(*names).alias("window"),
        F.when(held(names[0]), F.col(names[0])).alias("kind"), F.when(held(names[0]), F.col("_raw")).alias("value"),
        reduce(lambda a, b: a + b, [F.when(held(n), 0).otherwise(1) for n in names]).alias("words"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item, matched, total, coverage, changed_slots, slots)``: items of which a row holds enough of the template.

    Template windows of all documents meet those of the benchmark in a hash join; the benchmark's side is broadcast after it is
    counted, or shuffled beyond ``WINDOWS``. Items are taken with and without placeholders for names. Documents that hold ``COVER`` of an item's windows are read again for the slots:
    matches that run in parallel (one shift between the two texts) are an alignment, in which every slot value of the item must
    map to one value of the document, in ``CONSISTENT`` of the slots at least. So re-parameterised copies count, and texts of
    like shape do not. ``matched`` windows are those of all consistent alignments.

    Items and texts of fewer than ``WINDOW`` tokens, NULL and empty ones have no windows and never match. Rows that share a key
    are one document. Repeated benchmark rows and rows with one item key count as one item.
    """
    items = benchmark.select(item, F.col(item_text).alias("_text"))
    # In lower case no word is a name, which is how items set in capitals or in lower case read.
    items = items.union(items.select(item, F.lower("_text")))
    theirs = placed_windows(items, item, "_text").where(F.col("words") >= LITERALS)
    theirs = stored(theirs.select(
        F.col(item).alias("_item"), F.col("at").alias("_iat"), "window", F.col("kind").alias("_ikind"), F.col("value").alias("_ivalue")
    ).distinct())
    totals = stored(theirs.groupBy("_item").agg(F.countDistinct("_iat").alias("total")))
    hashes = theirs.select("_item", "_iat", "window").distinct()
    met = windows(docs, key, text).join(sized(hashes, WINDOWS), "window").groupBy(key, "_item").agg(F.countDistinct("_iat").alias("_n"))
    enough = met.join(sized(totals, WINDOWS), "_item").where(F.col("_n") >= F.col("total") * COVER)
    enough = stored(enough.select(F.col(key).alias("_key"), "_item"))
    suspects = docs.select(key, text).join(sized(enough.select("_key").distinct()), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    aligned = placed_windows(suspects, key, text).join(sized(theirs, WINDOWS), "window").groupBy(
        F.col(key), "_item", (F.col("at") - F.col("_iat")).alias("_shift")
    ).agg(
        F.collect_set("_iat").alias("_ats"),
        F.collect_set(F.when(F.col("_ikind").isNotNull(), F.struct("_ikind", "_ivalue", "value"))).alias("_slots"),
    )
    values = F.size(F.array_distinct(F.transform("_slots", lambda s: F.struct(s["_ikind"], s["_ivalue"]))))
    changed = F.size(F.filter("_slots", lambda s: ~s["_ivalue"].eqNullSafe(s["value"])))
    kept = aligned.withColumns({"_n": F.size("_slots"), "_changed": changed}).where(values >= F.size("_slots") * CONSISTENT)
    pairs = kept.groupBy(key, "_item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_ats")))).cast("long").alias("matched"),
        F.sum("_changed").alias("changed_slots"), F.sum("_n").alias("slots"),
    )
    out = pairs.join(sized(totals, WINDOWS), "_item").withColumn("coverage", F.col("matched") / F.col("total"))
    return out.where(F.col("coverage") >= COVER).select(
        key, F.col("_item").alias(item), "matched", "total", "coverage", "changed_slots", "slots"
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, columns as they were. Rows with a NULL key are matched among themselves
    as one document."""
    found = stored(contaminated(docs, benchmark, key, **columns).select(F.col(key).alias("_leaks")).distinct())
    return docs.join(sized(found), docs[key].eqNullSafe(found["_leaks"]), "left_anti")
