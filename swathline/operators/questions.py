"""Question rows from labels. Answers are columns first; rows appear in one explode at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions.answers import numeric_answer
from swathline.operators.change import change_answers, magnitude_band
from swathline.operators.ranking import seeded

# Question wording of the change corpus, (task, operation, question, answer type).
CHANGE_QUESTIONS = (
    ("change_presence", "presence_appeared", "Comparing the first image to the second, did any new buildings appear?", "yesno"),
    ("change_presence", "presence_demolished", "Comparing the first image to the second, were any buildings demolished?", "yesno"),
    ("change_direction", "direction", "Did the number of buildings increase, decrease, or stay unchanged between the first and second image?", "text"),
    ("change_compare", "compare", "Which image contains more buildings, the first or the second?", "text"),
    ("change_magnitude", "magnitude", "How many new buildings appeared in the second image: none, a few, dozens, or many?", "text"),
    ("change_count", "count_appeared", "How many new buildings appeared in the second image?", "number"),
    ("change_count", "count_demolished", "How many buildings were demolished by the second image?", "number"),
    ("change_where", "where", "In which part of the second image did the new buildings mostly appear: north, south, east, or west?", "text"),
)
ANSWER_OPTIONS = {
    "change_presence": "yes,no",
    "change_direction": "increased,decreased,unchanged",
    "change_compare": "first,second",
    "change_magnitude": "none,a few,dozens,many",
    "change_where": "north,south,east,west",
}
OPEN_TASKS = ("change_count",)
COVERAGE_BINS = ((0.01, "none"), (0.10, "a small part"), (0.35, "some"), (0.65, "about half"), (0.90, "most"), (1.01, "nearly all"))
COUNT_BUCKETS = ((0, "0"), (1, "1"), (3, "2-3"), (10, "4-10"), (30, "11-30"))
LEGIBLE_PX = 12
INDEX_NOUNS = {"ndvi": "vegetation cover", "ndwi": "surface water", "ndbi": "built-up surface"}
CHANGE_MIN, NOISE_MAX = 0.10, 0.05
ARMS = ("optical", "sar", "fused")
SAR_ANSWERABLE = ("Inland waters", "Marine waters", "Urban fabric", "Industrial or commercial units")


def qa(task: Column | str, question: Column | str, answer: Column | str, keep: Column | None = None, **extra: Column) -> Column:
    """One candidate row; NULL (and so dropped) when ``keep`` is false or it has no answer."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = F.struct(lit(task).alias("task"), lit(question).alias("question"), lit(answer).alias("answer"), *[v.alias(k) for k, v in extra.items()])
    good = lit(answer).isNotNull() if keep is None else keep & lit(answer).isNotNull()
    return F.when(good, made)


def explode_rows(df: DataFrame, keys: Sequence[str], rows: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Drop absent candidates, number the rest from 0, keep at most ``limit`` per record."""
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    if limit is not None:
        present = F.slice(present, 1, limit)
    return df.select(*keys, F.posexplode(present).alias("idx", "r")).select(*keys, "idx", "r.*")


def months_between(first: Column, second: Column) -> Column:
    """Absolute month gap of two YYYY-MM strings."""
    months = lambda m: F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int")
    return F.abs(months(second) - months(first))


def change_rows(stats: DataFrame, group: str) -> DataFrame:
    """Every question each ordered date pair supports, with its twin id.

    ``stats`` holds one row per ordered pair (``first``/``second`` as YYYY-MM plus the counts of
    :func:`~swathline.operators.change.pair_statistics`). The twin id keys on the unordered dates, the
    task and the question, so both orderings of a question share it.
    Counts above what people count exactly stay and are flagged ``large_count``.
    """
    answers = change_answers(stats)
    rows = [
        qa(task, question, answers[op], answer_type=F.lit(kind), answer_options=F.lit(ANSWER_OPTIONS.get(task)).cast("string"))
        for task, op, question, kind in CHANGE_QUESTIONS
    ]
    out = explode_rows(stats, [group, "first", "second", "appeared", "demolished"], rows)
    digest = F.substring(F.sha1("question"), 1, 8)
    ids = F.concat_ws("_", F.col(group), F.least("first", "second"), F.greatest("first", "second"), "task", digest)
    return out.withColumn("twin_id", ids).withColumn(
        "sample_id", F.concat_ws("_", F.col(group), "first", "second", "task", digest)
    ).withColumn("gap_months", months_between(F.col("first"), F.col("second"))).withColumn(
        "large_count", (F.col("task") == "change_count") & (F.expr("try_cast(answer AS bigint)") > C.EXACT_COUNT_MAX)
    )


def seeded_order(items: Column, seed: str, key: Column) -> Column:
    """Array of strings in seeded order."""
    tagged = F.transform(items, lambda x: F.concat(F.sha2(F.concat_ws("|", F.lit(seed), key, x), 256), x))
    return F.transform(F.array_sort(tagged), lambda t: F.substring(t, 65, 1 << 20))


def multilabel_rows(df: DataFrame, key: str, labels: str, vocabulary: Sequence[str], limit: int | None = None) -> DataFrame:
    """Presence in equal halves, one true and one false co-occurrence, class count; ``limit`` caps an image's rows."""
    half = len(vocabulary) if limit is None else max(1, limit // 3)
    words = F.array(*[F.lit(w) for w in vocabulary])
    name = F.col(key).cast("string")
    base = df.where(F.size(labels) > 0).select(
        key, labels,
        F.slice(seeded_order(F.col(labels), "pos", name), 1, half).alias("pos"),
        seeded_order(F.array_except(words, F.col(labels)), "neg", name).alias("neg"),
    ).withColumn("neg", F.slice("neg", F.lit(1), F.size("pos")))
    item = lambda arr, i: F.lower(F.get(F.col(arr), F.lit(i)))
    ask = lambda label: F.concat(F.lit("Is "), label, F.lit(" present in this image?"))
    both = lambda a, b: F.concat(F.lit("Do both "), a, F.lit(" and "), b, F.lit(" appear in this image?"))
    rows = [qa("presence", ask(item("pos", i)), "yes", item("pos", i).isNotNull()) for i in range(half)]
    rows += [qa("presence", ask(item("neg", i)), "no", item("neg", i).isNotNull()) for i in range(half)]
    rows.append(qa("co_occurrence", both(item("pos", 0), item("pos", 1)), "yes", F.size("pos") >= 2))
    rows.append(qa("co_occurrence", both(item(labels, 0), item("neg", 0)), "no", F.size("neg") >= 1))
    rows.append(qa("class_count", "How many distinct land-cover classes are present in this image?", numeric_answer(F.size(labels))))
    return explode_rows(base, [key], rows, limit)


def bucket_of(count: Column) -> Column:
    first, *rest = COUNT_BUCKETS
    ladder = F.when(count <= first[0], first[1])
    for ceiling, label in rest:
        ladder = ladder.when(count <= ceiling, label)
    return ladder.otherwise("31+")


def coverage_bin(share: Column) -> Column:
    first, *rest = COVERAGE_BINS
    ladder = F.when(share < first[0], first[1])
    for ceiling, label in rest:
        ladder = ladder.when(share < ceiling, label)
    return ladder.otherwise("nearly all")


def box_rows(boxes: DataFrame, frame: str, width: int, height: int, seed: str) -> DataFrame:
    """One referring box and the count of legible objects per image.

    ``boxes`` has (frame, obj, kind, xmin, ymin, xmax, ymax). The target is a seeded minimum and the
    count a sum, both combined map-side.
    """
    legible = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) >= LEGIBLE_PX
    pick = F.when(legible, F.struct(seeded(seed, frame, "obj").alias("o"), "obj", "kind", "xmin", "ymin", "xmax", "ymax"))
    image = boxes.groupBy(frame).agg(F.sum(legible.cast("long")).alias("n"), F.min(pick).alias("t"))
    scaled = lambda c, side: F.bround(F.least(F.greatest(F.col(f"t.{c}") / side, F.lit(0.0)), F.lit(1.0)) * 1000).cast("int").cast("string")
    where = F.concat(F.lit("["), F.concat_ws(", ", scaled("xmin", width), scaled("ymin", height), scaled("xmax", width), scaled("ymax", height)), F.lit("]"))
    kind = F.coalesce("t.kind", F.lit("aircraft"))
    rows = [
        qa("refer_box", F.concat(F.lit("Find the "), F.col("t.kind"), F.lit(" in this image and provide its bounding box.")),
           F.concat(F.lit("There is an "), F.col("t.kind"), F.lit(" located at "), where, F.lit(".")),
           balance_key=F.concat(F.lit("refer_box|"), F.col("t.kind"))),
        qa("count", F.concat(F.lit("How many "), kind, F.lit("s are visible in the image?")), F.col("n").cast("string"),
           balance_key=F.concat_ws("|", F.lit("count"), kind, bucket_of(F.col("n")))),
    ]
    return explode_rows(image, [frame], rows)


def polygon_rows(shapes: DataFrame, frame: str, gsd: float, noun: str = "building") -> DataFrame:
    """Count, presence and total area of the real rings of a frame; area only if there are any."""
    real = F.col("points") >= 3
    frames = shapes.groupBy(frame).agg(
        F.sum(real.cast("long")).alias("n"), F.coalesce(F.sum(F.when(real, F.col("area_px"))), F.lit(0.0)).alias("area")
    )
    rows = [
        qa("count", f"How many {noun}s are visible in this image?", numeric_answer(F.col("n"))),
        qa("presence", f"Are there any {noun}s in this image?", F.when(F.col("n") > 0, "yes").otherwise("no")),
        qa("area", f"What is the total {noun} footprint area in this image, in square metres?", numeric_answer(F.col("area") * (gsd * gsd), "m2"), F.col("n") > 0),
    ]
    return explode_rows(frames, [frame], rows)


def segmask_rows(fractions: DataFrame, keys: Sequence[str], vocabulary: Sequence[str], limit: int | None = None) -> DataFrame:
    """Dominant class, coverage of the two largest, absent and present presence, class count.

    ``fractions`` has one row per (scene, class) - a table bounded by the class list.
    """
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    scene = fractions.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("o"), "name"))).alias("ranked"),
    )
    seen = F.filter("ranked", lambda x: x["o"] <= -0.01)
    base = scene.withColumn("seen", F.transform(seen, lambda x: F.struct(x["name"].alias("name"), (-x["o"]).alias("share")))).where(F.size("seen") > 0)
    names = F.transform("seen", lambda s: s["name"])
    absent = F.get(seeded_order(F.array_except(F.array(*[F.lit(v) for v in vocabulary]), names), "p4", name), F.lit(0))
    at = lambda i: F.get(F.col("seen"), F.lit(i))
    cover = lambda i: qa("coverage", F.concat(F.lit("How much of this image is covered by "), F.lower(at(i)["name"]), F.lit("?")), coverage_bin(at(i)["share"]), F.size("seen") > i)
    present = lambda n, a: qa("presence", F.concat(F.lit("Is "), F.lower(n), F.lit(" present in this image?")), a, n.isNotNull())
    rows = [
        qa("dominant_class", "Which land-cover class covers the largest area in this image?", F.get(F.col("ranked"), F.lit(0))["name"]),
        cover(0), cover(1), present(absent, "no"), present(at(0)["name"], "yes"),
        qa("class_count", "How many distinct land-cover classes are present in this image?", numeric_answer(F.size("seen"))),
    ]
    return explode_rows(base, keys, rows, limit)


def delta_rows(deltas: DataFrame, keys: Sequence[str], noun: str = "building", limit: int | None = None) -> DataFrame:
    """Questions from (added, removed, persisted) and/or a changed area; nothing without either."""
    added, removed, kept, area = (F.col(c) for c in ("added", "removed", "persisted", "area_m2"))
    counts = added.isNotNull() & removed.isNotNull()
    yes_no = lambda c: F.when(c > 0, "yes").otherwise("no")
    rows = [
        qa("change_presence", f"Did the number of {noun}s change between the first and second image?", yes_no(added + removed), counts),
        qa("change_count", f"How many {noun}s were added between the first and second image?", numeric_answer(added), counts),
        qa("change_count", f"How many {noun}s were removed between the first and second image?", numeric_answer(removed), counts),
        qa("change_direction", f"Were more {noun}s built or demolished between the two images?",
           F.when(added > removed, "built").when(removed > added, "demolished").otherwise("neither"), counts),
        qa("change_count", f"How many {noun}s are present in both images?", numeric_answer(kept), counts),
        qa("change_presence", "Did any part of this area change between the two images?", yes_no(area), area.isNotNull()),
        qa("change_area", "What area changed between the two images, in square metres?", numeric_answer(area, "m2"), area > 0),
    ]
    return explode_rows(deltas, keys, rows, limit)


def crossmodal_arms(rows: DataFrame, arms: Column | None = None) -> DataFrame:
    """The same question over the optical, radar and fused image subsets."""
    views = [
        F.struct(F.lit(arm).alias("arm"), images.alias("images"), F.lit("crossmodal_vqa" if arm == "fused" else "single_vqa").alias("task"))
        for arm, images in zip(ARMS, (F.array("optical"), F.array("sar"), F.array("optical", "sar")))
    ]
    chosen = F.array(*views)
    if arms is not None:
        chosen = F.filter(chosen, lambda a: F.array_contains(arms, a["arm"]))
    out = rows.withColumn("v", F.explode(chosen))
    return out.select("*", "v.arm", "v.images", "v.task").drop("v").withColumn("question_type", F.concat_ws("_", "question_type", "arm"))


def index_delta_rows(tiles: DataFrame, key: str) -> DataFrame:
    """Direction, presence and comparison per index and ordering; the dead band is skipped."""
    orders = F.array(F.struct(F.lit("t0t1").alias("ordering"), F.lit(1).alias("sign")), F.struct(F.lit("t1t0").alias("ordering"), F.lit(-1).alias("sign")))
    pairs = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(noun).alias("noun"), F.col(f"{i}_delta").alias("raw")) for i, noun in INDEX_NOUNS.items()])
    base = tiles.select(key, F.explode(pairs).alias("p")).select(key, "p.*", F.explode(orders).alias("o"))
    base = base.select(key, "index", "noun", "o.ordering", (F.col("o.sign") * F.col("raw")).alias("delta"))
    delta = F.col("delta")
    moved, still = F.abs(delta) >= CHANGE_MIN, F.abs(delta) <= NOISE_MAX
    noun = F.col("noun")
    rows = [
        qa("index_direction", F.concat(F.lit("Between the first and second image, did "), noun, F.lit(" increase, decrease, or stay unchanged?")),
           F.when(moved & (delta > 0), "increased").when(moved, "decreased").when(still, "unchanged")),
        qa("index_presence", F.concat(F.lit("Is there a noticeable change in "), noun, F.lit(" between the first and second image?")),
           F.when(moved, "yes").when(still, "no")),
        qa("index_compare", F.concat(F.lit("Which image shows more "), noun, F.lit(", the first or the second?")),
           F.when(moved, F.when(delta > 0, "second").otherwise("first"))),
    ]
    return explode_rows(base, [key, "index", "ordering"], rows)


def grounding_rows(boxes: DataFrame, frame: str, width: int, height: int, seed: str) -> DataFrame:
    """Referring questions by unique role and unique quadrant, and a point prompt per frame.

    Truncated boxes and boxes on the frame edge are dropped. A group of (frame, label) that counts
    one row is a unique target, found with a map-side-combined count.
    """
    from swathline.functions.boxes import box_string, quadrant, touches_edge

    w, h = F.lit(width), F.lit(height)
    x, y, bw, bh = (F.col(c) for c in ("x", "y", "w", "h"))
    usable = boxes.where(~F.coalesce("truncated", F.lit(False)) & ~touches_edge(x, y, bw, bh, w, h)).select(
        frame, "obj", "role", quadrant(x, y, bw, bh, w, h).alias("quadrant"),
        box_string(x / w, y / h, (x + bw) / w, (y + bh) / h).alias("box"),
        F.bround((x + bw / 2) / w, 2).alias("cx"), F.bround((y + bh / 2) / h, 2).alias("cy"),
    )
    member = F.max(F.struct("obj", "box")).alias("m")

    def unique(label: str) -> DataFrame:
        return usable.groupBy(frame, label).agg(F.count("*").alias("n"), member).where("n = 1").select(
            frame, F.col(label).alias("detail"), F.col("m.box").alias("answer")
        )

    refer = lambda df, phrase: df.select(
        frame, F.lit("ground_reference").alias("task"), reference_form(phrase, F.concat_ws("|", F.col(frame).cast("string"), "detail"), seed).alias("question"), "answer", "detail"
    )
    by_role = refer(unique("role"), F.concat(F.col("detail"), F.lit(" aircraft")))
    by_place = refer(unique("quadrant"), F.concat(F.lit("aircraft at the "), F.col("detail"), F.lit(" of the image")))
    chosen = usable.groupBy(frame).agg(F.min(F.struct(seeded(seed, frame, "obj").alias("o"), "box", "cx", "cy", "role")).alias("t"))
    point = chosen.select(
        frame, F.lit("ground_point").alias("task"),
        F.format_string("Create a bounding box enclosing the object located at <point>(%.2f, %.2f)</point> in the image.", "t.cx", "t.cy").alias("question"),
        F.col("t.box").alias("answer"), F.col("t.role").alias("detail"),
    )
    return by_role.unionByName(by_place).unionByName(point)


# Surface forms of a referring expression.
REFERENCE_FORMS = (
    "Where can the <ref>{p}</ref> be found?",
    "Provide the bounding box for the <ref>{p}</ref>.",
    "Locate the {p}.",
    "The {p}.",
    "{p}",
    "Give the region containing the {p}.",
)


def choose(count: int, seed: str, key: Column) -> Column:
    """0-based template number from the first eight hex digits of a digest."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), key), 256), 1, 8), 16, 10).cast("long") % count).cast("int")


def reference_form(phrase: Column, key: Column, seed: str) -> Column:
    forms = F.array(*[F.lit(f) for f in REFERENCE_FORMS])
    return F.replace(F.get(forms, choose(len(REFERENCE_FORMS), seed, key)), F.lit("{p}"), phrase)


def presence_pairs(roles: DataFrame, frame: str, vocabulary: Sequence[str], seed: str) -> DataFrame:
    """One present and one absent class per frame, so both answers occur."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    name = F.col(frame).cast("string")
    frames = roles.groupBy(frame).agg(F.array_sort(F.collect_set("role")).alias("present"))
    pick = lambda items, s: F.get(seeded_order(items, f"{seed}:{s}", name), F.lit(0))
    yes, no = pick(F.array_intersect("present", words), "yes"), pick(F.array_except(words, F.col("present")), "no")
    ask = lambda role: F.concat(F.lit("Is there a "), role, F.lit(" in this image?"))
    return explode_rows(frames, [frame], [qa("ground_presence", ask(yes), "yes", yes.isNotNull()), qa("ground_presence", ask(no), "no", no.isNotNull())])


def optsar_rows(patches: DataFrame, key: str, labels: str, vocabulary: Sequence[str], forest_pool: DataFrame) -> DataFrame:
    """Present/absent pair on the optical arm, radar-legible pair on three arms when both sides exist,
    grouped forest question on the balanced pool."""
    name = F.col(key).cast("string")
    lit_array = lambda items: F.array(*[F.lit(i) for i in items])
    radar, words, forest = lit_array(SAR_ANSWERABLE), lit_array(vocabulary), lit_array(C.FOREST_CLASSES)
    pick = lambda items, s: F.get(seeded_order(items, s, name), F.lit(0))
    base = patches.join(forest_pool.select(key).withColumn("_pool", F.lit(True)), key, "left")
    have = F.col(labels)
    yes = pick(F.array_except(have, radar), "present")
    no = pick(F.array_except(F.array_except(words, have), radar), "absent")
    radar_yes, radar_no = F.array_intersect(have, radar), F.array_except(radar, have)
    both = (F.size(radar_yes) > 0) & (F.size(radar_no) > 0)
    ask = lambda c: F.concat(F.lit("Is there "), F.lower(c), F.lit(" in this image?"))
    optical, every = lit_array(["optical"]), lit_array(ARMS)
    rows = [
        qa("landcover_presence", ask(yes), "yes", yes.isNotNull(), arms=optical),
        qa("landcover_presence", ask(no), "no", no.isNotNull(), arms=optical),
        qa("landcover_presence", ask(pick(radar_yes, "radar_yes")), "yes", both, arms=every),
        qa("landcover_presence", ask(pick(radar_no, "radar_no")), "no", both, arms=every),
        qa("landcover_forest", "Is there forest in this image?", F.when(F.arrays_overlap(have, forest), "yes").otherwise("no"), F.coalesce("_pool", F.lit(False)), arms=every),
    ]
    out = explode_rows(base, [key], rows).withColumnRenamed("task", "question_type")
    out = out.withColumn("optical", F.lit("optical")).withColumn("sar", F.lit("sar"))
    return crossmodal_arms(out, F.col("arms")).drop("arms", "images", "task", "optical", "sar")


def caption_inventory(boxes: DataFrame, frame: str, width: int, height: int) -> DataFrame:
    """Group boxes by phrase: count, size word, dominant quadrant and quadrant counts.

    Two-level grouping: (frame, phrase, quadrant) counts, then (frame, phrase).
    """
    from swathline.functions.boxes import quadrant

    cell = quadrant(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    cells = boxes.groupBy(frame, "phrase", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))
    phrase = cells.groupBy(frame, "phrase").agg(
        F.sum("n").alias("count"), F.sum("area").alias("area"),
        F.min(F.struct((-F.col("n")).alias("o"), "cell")).alias("top"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "cell", "n"))), ";").alias("cells"),
    )
    share = F.col("area") / F.lit(float(max(1, width * height))) / F.col("count")
    return phrase.select(frame, "phrase", "count", F.when(share >= 0.02, "large").otherwise("small").alias("size"), F.col("top.cell").alias("cell"), "cells")


# Wording of the template captions.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
OPENERS = ("This aerial image shows", "The satellite scene contains", "In this overhead view there is")


def count_words(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    return F.when(n < len(NUMBER_WORDS), F.get(words, n.cast("int"))).otherwise(n.cast("string"))


def caption_render(inventory: DataFrame, frame: str, seed: str, most: int | None = None) -> DataFrame:
    """One deterministic template sentence group per frame, largest groups first.

    An inventory holds one row per phrase of a frame, a list bounded by the vocabulary.
    """
    subject = F.when(F.col("count") > 1, F.concat_ws(" ", count_words(F.col("count")), "size", F.concat(F.col("phrase"), F.lit("s")))).otherwise(
        F.concat_ws(" ", F.lit("a"), "size", "phrase")
    )
    clause = F.concat_ws(" ", subject, F.lit("at the"), "cell")
    frames = inventory.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "phrase", clause.alias("clause")))).alias("g"))
    clauses = F.transform("g", lambda x: x["clause"])
    clauses = clauses if most is None else F.slice(clauses, 1, most)
    opener = F.get(F.array(*[F.lit(o) for o in OPENERS]), choose(len(OPENERS), seed, F.col(frame).cast("string")))
    return frames.select(frame, F.concat(opener, F.lit(" "), F.array_join(clauses, ", "), F.lit(".")).alias("caption"))


def facts_from_qa(rows: DataFrame, image: str, nouns: Sequence[str]) -> DataFrame:
    """Fold presence and count rows into per-image facts; a question is about the first noun it names."""
    text, answer = F.lower("question"), F.lower(F.trim("answer"))
    noun = F.coalesce(*[F.when(text.contains(n), F.regexp_replace(F.lit(n), "s+$", "")) for n in nouns])
    tagged = rows.select(image, "question_type", answer.alias("answer"), noun.alias("noun")).where("noun IS NOT NULL")
    present = (F.col("question_type") == "presence") & (F.col("answer") == "yes")
    number = F.when((F.col("question_type") == "count") & F.col("answer").rlike("^[0-9]+$"), F.col("answer").cast("long"))
    return tagged.groupBy(image, "noun").agg(F.bool_or(present).alias("present"), F.max(F.when(number > 0, number)).alias("count")).where(
        "present OR count IS NOT NULL"
    )


def attribute_list(items: DataFrame, frame: str, phrase: str) -> DataFrame:
    """Sorted distinct phrases of a frame, only when there are at least two."""
    kinds = items.groupBy(frame).agg(F.array_sort(F.collect_set(phrase)).alias("k"))
    return kinds.where(F.size("k") >= 2).select(frame, F.array_join("k", ", ").alias("answer"))


def classify_question(question: Column, answer: Column) -> tuple[Column, Column, Column]:
    """(adapter, task, question type) from markup and answer shape."""
    q, a = F.lower(question), F.trim(answer)
    box = q.contains("bounding box") | q.contains("<point>")
    refer = q.contains("<ref>") | q.contains("where is") | q.contains("locate the") | q.contains("identify the location")
    yes_no = F.lower(a).isin("yes", "no")
    long_answer = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != "")) > 12
    mcq = a.rlike("^[a-dA-D]$") & question.rlike(r"(^|\s)a\)\s")
    subject = F.when(q.contains("country"), "mcq_country").when(q.contains("season"), "mcq_season").when(q.contains("climate"), "mcq_climate").otherwise("mcq")
    grounded = box | refer
    adapter = F.when(grounded | (~yes_no & long_answer), "rs_ground_caption").otherwise("rs_vqa")
    task = F.when(grounded, "single_grounding").when(~yes_no & long_answer, "single_caption").otherwise("single_vqa")
    kind = F.when(box, "bbox").when(refer, "referring").when(yes_no, "presence").when(long_answer, "caption").when(mcq, subject).otherwise("other")
    return adapter, task, kind


# Size thresholds stated for the two sources that use size words.
SIZE_RULES = {
    "RSVQA-HR": "small <100 m2, medium <500 m2, large >=500 m2",
    "RSVQA-LR": "small <3000 m2, medium <10000 m2, large >=10000 m2",
}


def plain_number(value: Column) -> Column:
    """Number without a trailing '.0'."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def scale_prefix(gsds: Column, question: Column, source: Column, width: Column, height: Column) -> Column:
    """'[ground sample distance: 10 m; scene 2560 x 2560 m, 6,553,600 m2; small <3000 m2, ...] '."""
    values = F.filter(gsds, lambda v: v > 0)
    first = F.get(values, F.lit(0))
    same = F.size(F.array_distinct(F.transform(values, lambda v: F.round(v, 4)))) == 1
    distance = F.when(same, F.concat(F.lit("ground sample distance: "), plain_number(first), F.lit(" m"))).otherwise(
        F.concat(F.lit("ground sample distance per view: "), F.array_join(F.transform(values, lambda v: F.concat(plain_number(v), F.lit(" m"))), ", "))
    )
    across, down = width * first, height * first
    extent = F.when((width > 0) & (height > 0), F.concat(
        F.lit("scene "), plain_number(across), F.lit(" x "), plain_number(down), F.lit(" m, "), F.format_number(F.bround(across * down).cast("long"), 0), F.lit(" m2")
    ))
    rule = F.coalesce(*[F.when(source.startswith(k), F.lit(r)) for k, r in SIZE_RULES.items()])
    sized = F.when(question.rlike(r"(?i)\b(small|medium|large)\b"), rule)
    return F.when(F.size(values) > 0, F.concat(F.lit("["), F.concat_ws("; ", distance, extent, sized), F.lit("] "))).otherwise("")
