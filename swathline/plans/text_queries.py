"""Answer contracts, normalisation and wording over reply, prediction and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import answers as A
from swathline.operators import fusion as FU
from swathline.plans.change_queries import COUNTS, HINTS, MASKS, VERDICTS
from swathline.plans.change_queries import verdicts as fusion_verdicts
from swathline.plans.registry import query
from swathline.plans.stats_queries import KEYS, SCENE
from swathline.plans.views import VIEWS, ctes

col = F.col

REPLIES = (
    "Yes, there are several.",
    "There are no buildings.",
    "A few.",
    "It is not possible to determine this",
    "about 1,250 objects",
    "north",
    "The answer is b) bare soil",
    "(c)",
    "low vegetation",
    "NVG surface was the smallest",
    "0 to 10 percent",
    "More than 1000",
    "10631m2",
    "[0.11 0.22, 0.53 0.64]",
    "(560,190),(650,290)",
    "bbox_2d: [287, 97, 333, 148]",
    "I cannot locate it at 1 2 3 4",
    "[0.5 0.5, 0.5 0.9]",
    "The largest part is urban fabric.",
    "roughly 2.5 houses or -3",
    "No new construction was seen",
    "increased   slightly",
    "dense forest and a lake",
    "between 11 and 100",
    "it does",
    "There is a school; none were not seen",
)
QUESTION = "Which class dominates? a) water b) bare soil c) dense forest d) urban fabric"
_rules = [(s, p + ("_x" if i % 3 == 0 else "")) for i, (s, p, _) in enumerate(A.CONTRACT_RULES)] + [("ben", "area"), ("other", "presence")]
VIEWS["replies"] = (
    "SELECT o_orderkey AS sample_id, o_custkey, CASE o_orderkey % " + str(len(REPLIES))
    + "".join(f" WHEN {i} THEN '{r}'" for i, r in enumerate(REPLIES))
    + f" END AS reply, '{QUESTION}' AS question, CASE o_custkey % {len(_rules)}"
    + "".join(f" WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(_rules))
    + f" END AS source, CASE o_custkey % {len(_rules)}"
    + "".join(f" WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_rules))
    + " END AS question_type, CASE WHEN o_orderkey % 10 = 7 THEN CAST(o_custkey % 1400 AS DOUBLE) + 0.5 END AS measured FROM orders"
)


def tri(frame, made, *ids):
    return frame.select(*ids, made[0].alias("answer"), made[1].alias("matched"), made[2].alias("basis"))


_NO = "no|false|incorrect|absent|negative|there is no|there are no|it does not"
_YES = "yes|true|correct|present|affirmative|there is|there are|it does"


def polarity(tokens, t):
    starts = " OR ".join(f"starts_with({t}, '{x}')" for x in tokens.split("|"))
    return f"(regexp_matches({t}, '(^| )({tokens})( |$)') OR {starts})"


def yes_no_sql(t):
    no, yes = polarity(_NO, t), polarity(_YES, t)
    return (
        f"CASE WHEN {no} THEN 'no' WHEN {yes} THEN 'yes' ELSE 'no' END", f"({no} OR {yes})",
        f"CASE WHEN {no} THEN 'negation match' WHEN {yes} THEN 'affirmation match' ELSE 'no polarity found' END",
    )


def as_row(parts):
    return f"{parts[0]} AS answer, {parts[1]} AS matched, {parts[2]} AS basis"


@query("TX01_format_yes_no", ctes("replies", "t AS (SELECT sample_id, lower(trim(reply)) AS x FROM replies)") + f"SELECT sample_id, {as_row(yes_no_sql('x'))} FROM t")
def tx01(v):
    return tri(v.replies, A.yes_no(col("reply")), "sample_id")


NUM = "TRY_CAST(replace(nullif(regexp_extract({t}, '-?\\d+(?:[.,]\\d+)?'), ''), ',', '.') AS DOUBLE)"
_UNSURE = "regexp_matches({t}, 'cannot|can''t|unable|not possible|impossible|unclear|uncertain|difficult to|hard to|insufficient|no way to|cannot be determined|not determinable', 'i')"
_ABSENT = "regexp_matches({t}, '\\b(?:no|none|zero|not any|no new|nothing|neither)\\b|\\bno (?:evidence|buildings|change|new)\\b|\\b(?:did|were|was|have|has|are|is) not\\b', 'i')"
WHOLE = "CAST(CAST(round_even({v}, 0) AS BIGINT) AS VARCHAR)"


def count_sql(t, value=None):
    n, unsure, absent = NUM.format(t=t), _UNSURE.format(t=t), _ABSENT.format(t=t)
    given = f"{value} IS NOT NULL" if value else "false"
    given_out = WHOLE.format(v=value) if value else "NULL"
    return (
        f"CASE WHEN {given} THEN {given_out} WHEN {n} IS NOT NULL THEN {WHOLE.format(v=n)} ELSE '0' END",
        f"({given} OR {n} IS NOT NULL OR (NOT {unsure} AND {absent}))",
        f"CASE WHEN {given} THEN 'numeric input' WHEN {n} IS NOT NULL THEN 'number parsed from text' WHEN {unsure} THEN 'model declined to answer' WHEN {absent} THEN 'stated absence read as zero' ELSE 'no number in the answer text' END",
    )


@query("TX02_format_count", ctes("replies") + f"SELECT sample_id, {as_row(count_sql('reply', 'measured'))} FROM replies")
def tx02(v):
    return tri(v.replies, A.count(col("reply"), col("measured")), "sample_id")


def ladder_sql(v, classes):
    return f"CASE WHEN {v} = 0 THEN '{classes[0]}' WHEN {v} <= 10 THEN '{classes[1]}' WHEN {v} <= 100 THEN '{classes[2]}' WHEN {v} <= 1000 THEN '{classes[3]}' ELSE '{classes[4]}' END"


def count_class_sql(t, value=None):
    c = f"lower(trim({t}))"
    exact = f"{c} IN (" + ", ".join(f"'{x}'" for x in A.COUNT_CLASSES) + ")"
    n = f"round_even({NUM.format(t=c)}, 0)"
    given = f"{value} IS NOT NULL" if value else "false"
    inside = f"CASE WHEN contains({c}, 'between 101 and 1000') THEN 'between 101 and 1000' WHEN contains({c}, 'between 11 and 100') THEN 'between 11 and 100' WHEN contains({c}, 'between 1 and 10') THEN 'between 1 and 10' WHEN contains({c}, 'more than 1000') THEN 'more than 1000' WHEN contains({c}, '0') THEN '0' END"
    given_out = ladder_sql(f"round_even({value}, 0)", A.COUNT_CLASSES) if value else "NULL"
    return (
        f"CASE WHEN {exact} THEN {c} WHEN {given} THEN {given_out} WHEN {n} IS NOT NULL THEN {ladder_sql(n, A.COUNT_CLASSES)} ELSE coalesce({inside}, '0') END",
        f"({exact} OR {given} OR {n} IS NOT NULL OR {inside} IS NOT NULL)",
        f"CASE WHEN {exact} THEN 'exact class match' WHEN {given} THEN 'numeric input bucketed' WHEN {n} IS NOT NULL THEN 'number parsed and bucketed' WHEN {inside} IS NOT NULL THEN 'class substring match' ELSE 'no count' END",
    )


@query("TX03_format_count_class", ctes("replies") + f"SELECT sample_id, {as_row(count_class_sql('reply', 'measured'))} FROM replies")
def tx03(v):
    return tri(v.replies, A.count_class(col("reply"), col("measured")), "sample_id")


AREAS = "areas AS (SELECT o_orderkey AS sample_id, CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_custkey % 1200 AS STRING), 'm2') WHEN 1 THEN 'between 11m2 and 100m2' WHEN 2 THEN 'about 30m2' WHEN 3 THEN concat(' ', CAST(o_custkey % 12 AS STRING), ' m2 ') ELSE '0m2' END AS answer FROM orders)"


@query(
    "TX04_format_area_class",
    "WITH " + AREAS + ", p AS (SELECT *, TRY_CAST(nullif(regexp_extract(answer, '^\\s*(\\d+)\\s*m2\\s*$', 1), '') AS BIGINT) AS n FROM areas) "
    + "SELECT sample_id, answer, CASE WHEN trim(answer) IN (" + ", ".join(f"'{c}'" for c in A.AREA_CLASSES) + f") THEN trim(answer) WHEN n IS NOT NULL THEN {ladder_sql('n', A.AREA_CLASSES)} END AS area_class FROM p",
)
def tx04(v):
    raw = v.sql(AREAS[len("areas AS ("):-1])
    return raw.select("sample_id", "answer", A.area_class(col("answer")).alias("area_class"))


@query(
    "TX05_format_ratio",
    "SELECT l_orderkey, l_linenumber, l_tax * l_discount * 40 - 0.01 AS ratio, CASE WHEN x <= 0 THEN 'no' WHEN x <= 0.02 THEN 'very small' WHEN x <= 0.1 THEN 'small' WHEN x <= 0.3 THEN 'medium' WHEN x <= 0.6 THEN 'large' ELSE 'very large' END AS label FROM (SELECT *, l_tax * l_discount * 40 - 0.01 AS x FROM lineitem) t",
)
def tx05(v):
    ratio = col("l_tax") * col("l_discount") * 40 - 0.01
    return v.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("ratio"), A.ratio(ratio).alias("label"))


def vocab_sql(t, words):
    key = f"regexp_replace(lower(trim({t})), '[\\s_\\-]+', ' ', 'g')"
    exact = "CASE " + " ".join(f"WHEN {key} = '{A.fold(w)}' THEN '{w}'" for w in words) + " END"
    order = sorted(words, key=lambda w: len(A.fold(w)), reverse=True)
    inside = "CASE " + " ".join(f"WHEN contains({key}, '{A.fold(w)}') THEN '{w}'" for w in order) + " END"
    return (
        f"coalesce({exact}, {inside}, '{words[0]}')", f"({exact} IS NOT NULL OR {inside} IS NOT NULL)",
        f"CASE WHEN {exact} IS NOT NULL THEN 'exact vocabulary match' WHEN {inside} IS NOT NULL THEN 'vocabulary substring match' ELSE 'outside the vocabulary' END",
    )


@query(
    "TX06_match_vocabulary",
    ctes("replies") + " UNION ALL ".join(f"SELECT sample_id, '{n}' AS vocabulary, {as_row(vocab_sql('reply', w))} FROM replies" for n, w in (("classes", A.LANDCOVER_ANSWERS), ("bands", A.RATIO_BANDS))),
)
def tx06(v):
    parts = [
        tri(v.replies.withColumn("vocabulary", F.lit(n)), A.vocabulary(col("reply"), w), "sample_id", "vocabulary")
        for n, w in (("classes", A.LANDCOVER_ANSWERS), ("bands", A.RATIO_BANDS))
    ]
    return parts[0].unionByName(parts[1])


def mcq_sql(t):
    lead = f"nullif(regexp_extract(lower({t}), '^\\s*\\(?([a-d])\\)?\\s*(?:[.):\\-]|$)', 1), '')"
    run = f"concat(' ', array_to_string(regexp_extract_all(lower({t}), '[a-z0-9]+'), ' '), ' ')"
    option = f"CASE WHEN contains({run}, ' water ') THEN 'a' WHEN contains({run}, ' bare soil ') THEN 'b' WHEN contains({run}, ' dense forest ') THEN 'c' WHEN contains({run}, ' urban fabric ') THEN 'd' END"
    return (
        f"coalesce({lead}, {option}, 'a')", f"({lead} IS NOT NULL OR {option} IS NOT NULL)",
        f"CASE WHEN {lead} IS NOT NULL THEN 'option letter' WHEN {option} IS NOT NULL THEN 'option text matched' ELSE 'names no option' END",
    )


@query("TX07_format_mcq", ctes("replies") + f"SELECT sample_id, {as_row(mcq_sql('reply'))} FROM replies")
def tx07(v):
    return tri(v.replies, A.mcq(col("reply"), col("question")), "sample_id")


def box_ctes(source, text, scale, width="CAST(NULL AS DOUBLE)", height="CAST(NULL AS DOUBLE)", p="bx"):
    """CTE ``{p}(sample_id, answer, matched, basis)``; words go first, so identifiers lose their digits."""
    return f"""{p}1 AS (SELECT sample_id, {_UNSURE.format(t=text)} AS unsure, list_transform(regexp_extract_all(regexp_replace({text}, '[A-Za-z_][A-Za-z0-9_]*', ' ', 'g'), '-?\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS n, CAST({scale} AS DOUBLE) AS sc, {width} AS w, {height} AS h FROM {source}),
{p}2 AS (SELECT *, list_max(list_transform(n[1:4], lambda x: abs(x))) > 1.5 AS big FROM {p}1),
{p}3 AS (SELECT *, n[1] / d1 AS a, n[2] / d2 AS b, n[3] / d1 AS c, n[4] / d2 AS d FROM (SELECT *, CASE WHEN sc IS NOT NULL THEN sc WHEN big THEN coalesce(w, 1000.0) ELSE 1.0 END AS d1, CASE WHEN sc IS NOT NULL THEN sc WHEN big THEN coalesce(h, 1000.0) ELSE 1.0 END AS d2 FROM {p}2) q),
{p}4 AS (SELECT *, least(greatest(least(a, c), 0.0), 1.0) AS x1, least(greatest(greatest(a, c), 0.0), 1.0) AS x2, least(greatest(least(b, d), 0.0), 1.0) AS y1, least(greatest(greatest(b, d), 0.0), 1.0) AS y2 FROM {p}3),
{p}5 AS (SELECT *, NOT unsure AND len(n) >= 4 AND coalesce(x2 > x1 AND y2 > y1, false) AS fine FROM {p}4),
{p} AS (SELECT sample_id, CASE WHEN fine THEN format('[{{:.2f}} {{:.2f}}, {{:.2f}} {{:.2f}}]', x1, y1, x2, y2) ELSE '' END AS answer, fine AS matched,
 CASE WHEN unsure THEN 'declined' WHEN len(n) < 4 THEN 'too few numbers' WHEN NOT fine THEN 'degenerate box' WHEN sc IS NOT NULL THEN 'declared scale' WHEN big AND w IS NOT NULL THEN 'pixel coordinates' WHEN big THEN 'assumed 0-1000 scale' ELSE 'normalised 0-1' END AS basis FROM {p}5)"""


SIDES = ("CASE WHEN o_custkey % 3 = 1 THEN 800.0 END", "CASE WHEN o_custkey % 3 = 1 THEN 600.0 END")
SCALE = "CASE WHEN o_custkey % 3 = 2 THEN 100.0 END"


@query("TX08_format_box", ctes("replies", box_ctes("replies", "reply", SCALE, *SIDES)) + "SELECT * FROM bx")
def tx08(v):
    made = A.located_box(col("reply"), F.expr(SCALE).cast("double"), F.expr(SIDES[0]).cast("double"), F.expr(SIDES[1]).cast("double"))
    return tri(v.replies, made, "sample_id")


CONTRACT_SQL = "CASE " + " ".join(f"WHEN source = '{s}' AND starts_with(question_type, '{p}') THEN '{n}'" for s, p, n in A.CONTRACT_RULES) + " END"


@query("TX09_contract_for", ctes("replies") + f"SELECT sample_id, source, question_type, {CONTRACT_SQL} AS contract FROM replies")
def tx09(v):
    return v.replies.select("sample_id", "source", "question_type", A.contract_for(col("source"), col("question_type")).alias("contract"))


def format_answer_sql(p):
    clean = "regexp_replace(trim(lower(trim(reply)), ' .!\"''`'), '\\s+', ' ', 'g')"
    area = vocab_sql(clean, A.AREA_CLASSES)
    raw = "coalesce(nullif(regexp_extract(reply, '(\\d[\\d,]*)\\s*m2', 1, 'i'), ''), nullif(regexp_extract(reply, '-?\\d+(?:[.,]\\d+)?'), ''))"
    value = f"floor(CAST(replace({raw}, ',', '') AS DOUBLE))"
    arms = []
    for name, (kind, words) in A.CONTRACTS.items():
        if kind == "binary":
            parts = yes_no_sql("lower(trim(reply))")
        elif kind == "count":
            parts = count_sql("reply", "measured")
        elif kind == "count_class":
            parts = count_class_sql("reply", "measured")
        elif kind == "mcq":
            parts = mcq_sql("reply")
        elif kind == "bbox":
            b = "b100" if name in A.BOX_SCALES else "b1"
            parts = (f"{b}.answer", f"{b}.matched", f"{b}.basis")
        elif words == A.AREA_CLASSES:
            rescue = f"(NOT {area[1]} AND {raw} IS NOT NULL)"
            parts = (f"CASE WHEN {rescue} THEN {ladder_sql(value, A.AREA_CLASSES)} ELSE {area[0]} END", f"({area[1]} OR {rescue})", f"CASE WHEN {rescue} THEN 'raw area value bucketed' ELSE {area[2]} END")
        elif kind == "vocabulary":
            parts = vocab_sql(clean, words)
        else:
            parts = ("regexp_replace(trim(trim(reply), ' .!\"''`'), '\\s+', ' ', 'g')", "true", "'free text passed through'")
        arms.append((name, parts))
    columns = []
    for i, (label, default) in enumerate((("answer", "trim(reply)"), ("matched", "true"), ("basis", "'no contract'"))):
        columns.append("CASE contract " + " ".join(f"WHEN '{n}' THEN {parts[i]}" for n, parts in arms) + f" ELSE {default} END AS {label}")
    return ctes(
        "replies", f"asked AS (SELECT *, {CONTRACT_SQL} AS contract FROM replies)",
        box_ctes("replies", "reply", "1.0", p="b1"), box_ctes("replies", "reply", "100.0", p="b100"),
        f"fmt AS (SELECT a.sample_id, a.contract, a.source, a.question_type, {', '.join(columns)} FROM asked a JOIN b1 USING (sample_id) JOIN b100 USING (sample_id))",
    )


def formatted(v):
    asked = v.replies.withColumn("contract", A.contract_for(col("source"), col("question_type")))
    text, matched, basis = A.format_answer(col("contract"), col("reply"), col("question"), col("measured"))
    return asked.select("sample_id", "contract", "source", "question_type", text.alias("answer"), matched.alias("matched"), basis.alias("basis"))


@query("TX10_format_answer", format_answer_sql("x") + "SELECT sample_id, contract, answer, matched, basis FROM fmt")
def tx10(v):
    return formatted(v).select("sample_id", "contract", "answer", "matched", "basis")


def normalise_sql(t):
    """No look-around: decimal points are parked on a private mark before full stops go."""
    base = f"regexp_replace(lower(trim({t}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}.]', ' ', 'g')"
    parked = f"regexp_replace(regexp_replace({base}, '([0-9])\\.([0-9])', '\\1~\\2', 'g'), '([0-9])\\.([0-9])', '\\1~\\2', 'g')"
    plain = f"replace(replace({parked}, '.', ' '), '~', '.')"
    return f"array_to_string(list_filter(string_split(regexp_replace({plain}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("TX11_normalise_answer", f"SELECT doc_id, {normalise_sql('text')} AS normalised FROM documents")
def tx11(v):
    return v.documents.select("doc_id", A.normalise(col("text")).alias("normalised"))


@query(
    "TX12_numeric_answer",
    "SELECT l_orderkey, l_linenumber, CASE WHEN x = floor(x) THEN concat(CAST(CAST(x AS BIGINT) AS VARCHAR), ' m2') ELSE format('{:.1f} m2', round_even(x, 1)) END AS answer FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_extendedprice END AS x FROM lineitem) t",
)
def tx12(v):
    value = F.when(col("l_linenumber") % 2 == 0, col("l_quantity")).otherwise(col("l_extendedprice"))
    return v.lineitem.select("l_orderkey", "l_linenumber", A.numeric_answer(value, "m2").alias("answer"))


@query(
    "TX13_class_name_first_number",
    ctes("replies")
    + "SELECT sample_id, CASE " + " ".join(f"WHEN contains(lower(reply), '{c.lower()}') THEN '{c}'" for c in ("urban fabric", "vegetation", "NVG surface", "buildings", "forest", "lake")[0:6] if True)
    + " ELSE trim(reply) END AS class_name, TRY_CAST(nullif(regexp_extract(reply, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS first_number, coalesce(nullif(regexp_extract(reply, '[-+]?\\d*\\.\\d+|\\d+'), ''), '0') AS number_text FROM replies",
)
def tx13(v):
    classes = ("lake", "forest", "buildings", "NVG surface", "vegetation", "urban fabric")
    return v.replies.select(
        "sample_id", A.class_name(col("reply"), classes).alias("class_name"),
        A.first_number(col("reply")).alias("first_number"), A.number_text(col("reply")).alias("number_text"),
    )


@query(
    "TX15_compose_answer",
    ctes("px", HINTS, MASKS, COUNTS, VERDICTS)
    + f"""SELECT {KEYS}, concat(CASE WHEN verdict = 'consistent' THEN format('Optical and SAR agree on {{}} (IoU {{:.2f}}).', target, ir) WHEN cause IS NOT NULL THEN format('Optical and SAR disagree on {{}} (IoU {{:.2f}}): {{}}.', target, ir, replace(cause, '_', ' '))
ELSE format('Optical and SAR only partly agree on {{}} (IoU {{:.2f}}); reporting the agreed extent.', target, ir) END, ' ', format('By optical, {{}} covers {{:.1f}}% of the valid pixels.', target, round_even(share * 100, 1))) AS answer
FROM (SELECT *, round_even(round(iou, 4), 2) AS ir, CAST(b + oo AS DOUBLE) / (SELECT count(*) FROM px p WHERE p.scene_id = wn.scene_id AND p.date_idx = wn.date_idx) AS share FROM wn) t""",
)
def tx15(v):
    masks, verdict = fusion_verdicts(v)
    coverage = masks.groupBy(*SCENE).agg(F.avg(col("optical").cast("double")).alias("share"))
    target = F.when(col("scene_id") % 11 == 10, "builtup").otherwise("water")
    sentence = F.concat_ws(
        " ",
        A.agreement_sentence(col("verdict"), target, F.bround("iou", 2), F.replace(col("cause"), F.lit("_"), F.lit(" "))),
        A.covers_sentence(target, F.lit("optical"), F.bround(col("share") * 100, 1) / 100, F.lit(None).cast("double")),
    )
    return verdict.join(coverage, SCENE).select(*SCENE, sentence.alias("answer"))


@query(
    "TX16_field_aliases",
    ctes("replies") + "SELECT sample_id, coalesce(nullif(CASE WHEN sample_id % 3 = 0 THEN '' WHEN sample_id % 3 = 1 THEN concat('c_', source) END, ''), nullif(source, ''), '?') AS source, coalesce(nullif(CASE WHEN sample_id % 4 <> 0 THEN question_type ELSE '' END, ''), nullif(CASE WHEN sample_id % 8 = 0 THEN 'task' END, ''), '?') AS question_type FROM replies",
)
def tx16(v):
    corpus = F.when(col("sample_id") % 3 == 0, "").when(col("sample_id") % 3 == 1, F.concat(F.lit("c_"), col("source")))
    kind = F.when(col("sample_id") % 4 != 0, col("question_type")).otherwise("")
    task = F.when(col("sample_id") % 8 == 0, "task")
    return v.replies.select("sample_id", A.source_of(corpus, col("source")).alias("source"), A.type_of(kind, task).alias("question_type"))
