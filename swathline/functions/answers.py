"""Free-text answers onto closed contracts, as Column expressions.

Every formatter returns ``(text, matched, basis)`` columns; an answer that cannot be read
falls back to the contract's default with ``matched`` false, so no row is ever lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline.functions.boxes import BOX_NUMBER, box_text, clamp01

Answer = tuple[Column, Column, Column]

# Token lists, patterns and answer vocabularies of the contracts.
NO_TOKENS = ("no", "false", "incorrect", "absent", "negative", "there is no", "there are no", "it does not")
YES_TOKENS = ("yes", "true", "correct", "present", "affirmative", "there is", "there are", "it does")
NUMBER = r"-?\d+(?:[.,]\d+)?"
PLAIN_NUMBER = r"-?\d+(?:\.\d+)?"
SIGNED_DECIMAL = r"[-+]?\d*\.\d+|\d+"
ABSENT = (
    r"(?i)\b(?:no|none|zero|not any|no new|nothing|neither)\b|"
    r"\bno (?:evidence|buildings|change|new)\b|"
    r"\b(?:did|were|was|have|has|are|is) not\b"
)
UNSURE = (
    r"(?i)cannot|can't|unable|not possible|impossible|unclear|uncertain|difficult to|hard to|"
    r"insufficient|no way to|cannot be determined|not determinable"
)
MCQ_LEAD = r"(?i)^\s*\(?([a-d])\)?\s*(?:[.):\-]|$)"
OPTION = r"(?is)\b([a-d])\)\s*(.+?)(?=\s+\b[a-d]\)|$)"
AREA_VALUE = r"(?i)(\d[\d,]*)\s*m2"
AREA_ANSWER = r"^\s*(\d+)\s*m2\s*$"
COUNT_CLASSES = ("0", "between 1 and 10", "between 11 and 100", "between 101 and 1000", "more than 1000")
AREA_CLASSES = ("0m2", "between 1m2 and 10m2", "between 11m2 and 100m2", "between 101m2 and 1000m2", "more than 1000m2")
CLASS_CEILINGS = (0, 10, 100, 1000)
RATIO_BUCKETS = ((0.0, "no"), (0.02, "very small"), (0.1, "small"), (0.3, "medium"), (0.6, "large"), (1.01, "very large"))
LANDCOVER_ANSWERS = ("NVG_surface", "buildings", "low_vegetation", "trees", "water", "playgrounds")
RATIO_BANDS = (
    "0", "0_to_10", "10_to_20", "20_to_30", "30_to_40", "40_to_50",
    "50_to_60", "60_to_70", "70_to_80", "80_to_90", "90_to_100",
)
# contract -> (kind, vocabulary)
CONTRACTS = {
    "change_presence": ("binary", ()),
    "change_direction": ("vocabulary", ("increased", "decreased", "unchanged")),
    "change_compare": ("vocabulary", ("first", "second")),
    "change_magnitude": ("vocabulary", ("none", "a few", "dozens", "many")),
    "change_where": ("vocabulary", ("north", "south", "east", "west")),
    "change_count": ("count", ()),
    "rsvqa_lr_presence": ("binary", ()),
    "rsvqa_lr_comparison": ("binary", ()),
    "rsvqa_lr_count": ("count_class", COUNT_CLASSES),
    "rsvqa_lr_rural_urban": ("vocabulary", ("rural", "urban")),
    "rsvqa_hr_presence": ("binary", ()),
    "rsvqa_hr_comparison": ("binary", ()),
    "rsvqa_hr_count": ("count", ()),
    "rsvqa_hr_area": ("vocabulary", AREA_CLASSES),
    "cdvqa_change_or_not": ("binary", ()),
    "cdvqa_increase_or_not": ("binary", ()),
    "cdvqa_decrease_or_not": ("binary", ()),
    "cdvqa_change_ratio": ("vocabulary", RATIO_BANDS),
    "cdvqa_change_ratio_types": ("vocabulary", RATIO_BANDS),
    "cdvqa_change_to_what": ("vocabulary", LANDCOVER_ANSWERS),
    "cdvqa_largest_change": ("vocabulary", LANDCOVER_ANSWERS),
    "cdvqa_smallest_change": ("vocabulary", LANDCOVER_ANSWERS),
    "ben_binary_vqa": ("binary", ()),
    "ben_mcq": ("mcq", ("a", "b", "c", "d")),
    "ben_caption": ("free_text", ()),
    "ben_ref_detection": ("bbox", ()),
    "ground_reference": ("bbox", ()),
    "ground_point": ("bbox", ()),
    "ground_presence": ("binary", ()),
    "vrsbench_referring": ("bbox", ()),
}
BOX_SCALES = {"vrsbench_referring": 100.0}
# (source, question-type prefix, contract); the first match wins.
CONTRACT_RULES = (
    ("ben", "binary", "ben_binary_vqa"),
    ("ben", "mcq", "ben_mcq"),
    ("ben", "captioning", "ben_caption"),
    ("ben", "bounding_box", "ben_ref_detection"),
    ("rsvqa_lr", "presence", "rsvqa_lr_presence"),
    ("rsvqa_lr", "comp", "rsvqa_lr_comparison"),
    ("rsvqa_lr", "count", "rsvqa_lr_count"),
    ("rsvqa_lr", "rural_urban", "rsvqa_lr_rural_urban"),
    ("rsvqa_hr", "presence", "rsvqa_hr_presence"),
    ("rsvqa_hr", "comp", "rsvqa_hr_comparison"),
    ("rsvqa_hr", "count", "rsvqa_hr_count"),
    ("rsvqa_hr", "area", "rsvqa_hr_area"),
    ("change_vqa", "change_presence", "change_presence"),
    ("change_vqa", "change_direction", "change_direction"),
    ("change_vqa", "change_compare", "change_compare"),
    ("change_vqa", "change_magnitude", "change_magnitude"),
    ("change_vqa", "change_where", "change_where"),
    ("change_vqa", "change_count", "change_count"),
    ("cdvqa", "change_ratio_types", "cdvqa_change_ratio_types"),
    ("cdvqa", "change_ratio", "cdvqa_change_ratio"),
    ("cdvqa", "change_or_not", "cdvqa_change_or_not"),
    ("cdvqa", "change_to_what", "cdvqa_change_to_what"),
    ("cdvqa", "increase_or_not", "cdvqa_increase_or_not"),
    ("cdvqa", "decrease_or_not", "cdvqa_decrease_or_not"),
    ("cdvqa", "largest_change", "cdvqa_largest_change"),
    ("cdvqa", "smallest_change", "cdvqa_smallest_change"),
    ("rs_ground_caption", "ground_reference", "ground_reference"),
    ("rs_ground_caption", "ground_point", "ground_point"),
    ("rs_ground_caption", "ground_presence", "ground_presence"),
    ("vrsbench", "ref", "vrsbench_referring"),
)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\f\x0b"))


def yes_no(text: Column) -> Answer:
    """Negation before affirmation; a token counts when space-bounded or a bare prefix."""
    bare = F.lower(strip(text))
    padded = F.concat(F.lit(" "), bare, F.lit(" "))
    seen = lambda tokens: any_of([padded.contains(f" {t} ") | bare.startswith(t) for t in tokens])
    no, yes = seen(NO_TOKENS), seen(YES_TOKENS)
    return (
        F.when(no, "no").when(yes, "yes").otherwise("no"),
        no | yes,
        F.when(no, "negation match").when(yes, "affirmation match").otherwise("no polarity found"),
    )


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def parsed_number(text: Column) -> Column:
    """First number, a comma read as the decimal mark."""
    return F.regexp_replace(first_match(text, NUMBER), ",", ".").cast("double")


def whole(value: Column) -> Column:
    """Half-even integer as text."""
    return F.bround(value).cast("long").cast("string")


def count(text: Column, value: Column | None = None) -> Answer:
    number = parsed_number(text)
    unsure, absent = text.rlike(UNSURE), text.rlike(ABSENT)
    out = F.when(number.isNotNull(), whole(number)).otherwise("0")
    matched = number.isNotNull() | (~unsure & absent)
    basis = (
        F.when(number.isNotNull(), "number parsed from text").when(unsure, "model declined to answer")
        .when(absent, "stated absence read as zero").otherwise("no number in the answer text")
    )
    if value is not None:
        given = value.isNotNull()
        return F.when(given, whole(value)).otherwise(out), given | matched, F.when(given, "numeric input").otherwise(basis)
    return out, matched, basis


def ladder(value: Column, classes: Sequence[str]) -> Column:
    """The class of a non-negative magnitude: exactly 0, then ceilings 10, 100, 1000."""
    out = F.when(value == 0, classes[0])
    for ceiling, label in zip(CLASS_CEILINGS[1:], classes[1:]):
        out = out.when(value <= ceiling, label)
    return out.otherwise(classes[-1])


def count_class(text: Column, value: Column | None = None) -> Answer:
    cleaned = F.lower(strip(text))
    exact = cleaned.isin(*COUNT_CLASSES)
    number = F.bround(parsed_number(cleaned))
    longest_first = sorted(COUNT_CLASSES, key=len, reverse=True)
    inside = reduce(lambda acc, label: acc.when(cleaned.contains(label), label), longest_first[1:], F.when(cleaned.contains(longest_first[0]), longest_first[0]))
    given = value.isNotNull() if value is not None else F.lit(False)
    bucketed = ladder(F.bround(value), COUNT_CLASSES) if value is not None else F.lit(None).cast("string")
    return (
        F.when(exact, cleaned).when(given, bucketed).when(number.isNotNull(), ladder(number, COUNT_CLASSES)).otherwise(F.coalesce(inside, F.lit("0"))),
        exact | given | number.isNotNull() | inside.isNotNull(),
        F.when(exact, "exact class match").when(given, "numeric input bucketed").when(number.isNotNull(), "number parsed and bucketed")
        .when(inside.isNotNull(), "class substring match").otherwise("no count"),
    )


def area_class(answer: Column) -> Column:
    """Idempotent rewrite of a raw area answer; NULL when it is not an area."""
    text = strip(answer)
    value = first_match(text, AREA_ANSWER, 1).cast("long")
    return F.when(text.isin(*AREA_CLASSES), text).when(value.isNotNull(), ladder(value, AREA_CLASSES))


def ratio(value: Column) -> Column:
    bounded = clamp01(value)
    first, *rest = RATIO_BUCKETS
    return reduce(lambda acc, b: acc.when(bounded <= b[0], b[1]), rest, F.when(bounded <= first[0], first[1])).otherwise("very large")


def vocabulary_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"[\s_\-]+", " ")


def fold(entry: str) -> str:
    return " ".join(entry.strip().lower().replace("_", " ").replace("-", " ").split())


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def parts(answer: Answer) -> Column:
    return F.struct(answer[0].alias("text"), answer[1].alias("matched"), answer[2].alias("basis"))


def vocabulary_parts(text: Column, entries: Sequence[str]) -> Column:
    """Exact after folding separators, else the longest contained entry, else the first unmatched."""
    named: dict[str, str] = {}
    for entry in entries:
        named.setdefault(fold(entry), entry)
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    longest_first = sorted(named, key=len, reverse=True)

    def match(key: Column) -> Column:
        exact = F.try_element_at(table, key)
        inside = F.lit(None).cast("string")
        for name in reversed(longest_first):
            inside = F.when(key.contains(name), named[name]).otherwise(inside)
        return F.when(exact.isNotNull(), F.struct(exact.alias("text"), F.lit(True).alias("matched"), F.lit("exact vocabulary match").alias("basis"))).otherwise(
            bound(inside, lambda found: parts((
                F.coalesce(found, F.lit(entries[0])), found.isNotNull(),
                F.when(found.isNotNull(), "vocabulary substring match").otherwise("outside the vocabulary"),
            )))
        )

    return bound(vocabulary_key(text), match)


def vocabulary(text: Column, entries: Sequence[str]) -> Answer:
    made = vocabulary_parts(text, entries)
    return made["text"], made["matched"], made["basis"]


def token_run(text: Column) -> Column:
    """Lower-case tokens joined and padded by single spaces, for whole-run containment."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))


def mcq(text: Column, question: Column) -> Answer:
    """Leading letter, else the first option whose whole phrase appears, else 'a' unmatched."""
    lead = F.lower(first_match(text, MCQ_LEAD, 1))
    letters = F.regexp_extract_all(question, F.lit(OPTION), F.lit(1))
    phrases = F.transform(F.regexp_extract_all(question, F.lit(OPTION), F.lit(2)), token_run)
    answered = token_run(text)
    hits = F.filter(
        F.zip_with(letters, phrases, lambda l, p: F.when((F.length(p) > 2) & answered.contains(p), F.lower(l))),
        lambda l: l.isNotNull(),
    )
    option = F.get(hits, F.lit(0))
    return (
        F.coalesce(lead, option, F.lit("a")),
        lead.isNotNull() | option.isNotNull(),
        F.when(lead.isNotNull(), "option letter").when(option.isNotNull(), "option text matched").otherwise("names no option"),
    )


def located_box(text: Column, scale: Column | None = None, width: Column | None = None, height: Column | None = None) -> Answer:
    """First four free-standing numbers as an ordered, clamped two-decimal box."""
    unsure = text.rlike(UNSURE)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(BOX_NUMBER), F.lit(0)), lambda n: n.cast("double"))
    scale = scale if scale is not None else F.lit(None).cast("double")
    width = width if width is not None else F.lit(None).cast("double")
    height = height if height is not None else F.lit(None).cast("double")
    first = F.slice(numbers, 1, 4)
    big = F.array_max(F.transform(first, F.abs)) > 1.5
    divisor = lambda side: F.when(scale.isNotNull(), scale).when(big, F.coalesce(side, F.lit(1000.0))).otherwise(1.0)
    at = lambda i: F.get(numbers, F.lit(i)) / divisor(width if i % 2 == 0 else height)
    x1, x2 = clamp01(F.least(at(0), at(2))), clamp01(F.greatest(at(0), at(2)))
    y1, y2 = clamp01(F.least(at(1), at(3))), clamp01(F.greatest(at(1), at(3)))
    enough = F.size(numbers) >= 4
    fine = ~unsure & enough & (x2 > x1) & (y2 > y1)
    basis = (
        F.when(unsure, "declined").when(~enough, "too few numbers").when(~fine, "degenerate box")
        .when(scale.isNotNull(), "declared scale").when(big & width.isNotNull(), "pixel coordinates")
        .when(big, "assumed 0-1000 scale").otherwise("normalised 0-1")
    )
    return F.when(fine, box_text(x1, y1, x2, y2)).otherwise(""), fine, basis


def contract_for(source: Column, question_type: Column) -> Column:
    """First (source, type prefix) rule in table order; NULL when the type has no contract."""
    kind = F.coalesce(question_type, F.lit(""))
    conditions = [((source == s) & kind.startswith(p), name) for s, p, name in CONTRACT_RULES]
    first, *rest = conditions
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(*first))


def cleaned_text(text: Column, lower: bool = True) -> Column:
    value = F.lower(strip(text)) if lower else strip(text)
    return F.regexp_replace(F.btrim(value, F.lit(" .!\"'`\n\t")), r"\s+", " ")


def format_answer(contract: Column, text: Column, question: Column, numeric: Column | None = None) -> Answer:
    """Dispatch by contract; an exact numeric value from a tool beats anything read from prose."""
    branches: list[tuple[Column, Column]] = []
    by_kind: dict[tuple, list[str]] = {}
    for name, (kind, words) in CONTRACTS.items():
        by_kind.setdefault((kind, words, BOX_SCALES.get(name, 1.0)), []).append(name)
    for (kind, words, scale), names in by_kind.items():
        if kind == "binary":
            made = yes_no(text)
        elif kind == "bbox":
            made = located_box(text, F.lit(scale))
        elif kind == "count":
            made = count(text, numeric)
        elif kind == "count_class":
            made = count_class(text, numeric)
        elif kind == "mcq":
            made = mcq(text, question)
        elif kind == "vocabulary":
            made = vocabulary_parts(cleaned_text(text), words)
            if words == AREA_CLASSES:
                raw = F.coalesce(first_match(text, AREA_VALUE, 1), first_match(text, NUMBER))
                value = F.floor(F.regexp_replace(raw, ",", "").cast("double"))
                rescued = parts((ladder(value, AREA_CLASSES), F.lit(True), F.lit("raw area value bucketed")))
                made = bound(made, lambda m: F.when(m["matched"] | raw.isNull(), m).otherwise(rescued))
        else:
            made = (cleaned_text(text, lower=False), F.lit(True), F.lit("free text passed through"))
        branches.append((contract.isin(*names), parts(made) if isinstance(made, tuple) else made))
    # One nested value per row: only the row's own contract is worked out, and once for all three parts.
    chosen = parts((strip(text), F.lit(True), F.lit("no contract")))
    for condition, made in branches:
        chosen = F.when(condition, made).otherwise(chosen)
    return chosen["text"], chosen["matched"], chosen["basis"]


def normalise(text: Column) -> Column:
    """Lower-case, drop punctuation, stray full stops and articles, collapse spaces."""
    value = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_\s\p{Z}.]", " ")
    value = F.regexp_replace(value, r"(?<!\d)\.|\.(?!\d)", " ")
    value = F.regexp_replace(value, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " "))


def numeric_answer(value: Column, unit: str = "") -> Column:
    """Integer, or one decimal; no thousands separator."""
    text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1)))
    return F.when(value.isNotNull(), F.trim(F.concat(text, F.lit(f" {unit}"))))


def class_name(text: Column, classes: Sequence[str]) -> Column:
    """Longest contained class name, else the text itself."""
    lowered = F.lower(text)
    ordered = sorted(classes, key=len, reverse=True)
    first, *rest = ordered
    found = reduce(lambda acc, c: acc.when(lowered.contains(c.lower()), c), rest, F.when(lowered.contains(first.lower()), first))
    return found.otherwise(strip(text))


def first_number(text: Column) -> Column:
    return first_match(text, PLAIN_NUMBER).cast("double")


def number_text(text: Column) -> Column:
    return F.coalesce(first_match(text, SIGNED_DECIMAL), F.lit("0"))


def source_of(corpus_source: Column, source: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(corpus_source, blank), F.nullif(source, blank), F.lit("?"))


def type_of(question_type: Column, task: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(question_type, blank), F.nullif(task, blank), F.lit("?"))


def three_significant(value: Column) -> Column:
    """Three significant digits without trailing zeros, for magnitudes from 0.0001 up."""
    shown = F.format_string("%.6f", value)
    for decimals in range(5, -1, -1):
        floor = 10.0 ** (2 - decimals)
        shown = F.when(value >= floor, F.format_string(f"%.{decimals}f", F.bround(value, decimals))).otherwise(shown)
    return F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)


def covers_sentence(target: Column, sensor: Column, coverage: Column, area: Column) -> Column:
    """'By optical, water covers 12.3% of the valid pixels, about 0.5 km2.'"""
    lead = F.when(sensor.isNull(), F.concat(target, F.lit(" covers"))).otherwise(F.concat(F.lit("by "), sensor, F.lit(", "), target, F.lit(" covers")))
    body = F.concat(lead, F.format_string(" %.1f%% of the valid pixels", coverage * 100))
    area_text = F.when(area.isNotNull(), F.concat(F.lit("about "), three_significant(area), F.lit(" km²")))
    sentence = F.lower(F.concat_ws(", ", body, area_text))
    return F.concat(F.upper(F.substring(sentence, 1, 1)), F.substring(sentence, 2, 1 << 30), F.lit("."))


def agreement_sentence(verdict: Column, target: Column, iou: Column, explanation: Column) -> Column:
    shown = F.format_string("(IoU %.2f)", iou)
    return (
        F.when(verdict == "consistent", F.concat(F.lit("Optical and SAR agree on "), target, F.lit(" "), shown, F.lit(".")))
        .when(explanation.isNotNull(), F.concat(F.lit("Optical and SAR disagree on "), target, F.lit(" "), shown, F.lit(": "), explanation, F.lit(".")))
        .otherwise(F.concat(F.lit("Optical and SAR only partly agree on "), target, F.lit(" "), shown, F.lit("; reporting the agreed extent.")))
    )


def changed_sentence(change_ratio: Column, largest: Column) -> Column:
    tail = F.when(largest.isNotNull(), F.concat(F.lit(", with the largest change in "), largest, F.lit("."))).otherwise(".")
    return F.concat(F.format_string("%.1f%% of the valid area changed", change_ratio * 100), tail)
