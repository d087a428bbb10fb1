"""Accuracy, caption metrics, gates and replay over predictions and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import answers as A
from swathline.operators import sampling as SM
from swathline.operators import scoring as SC
from swathline.plans.box_queries import IOU_SQL, iou
from swathline.plans.registry import query
from swathline.plans.text_queries import format_answer_sql, formatted, normalise_sql
from swathline.plans.views import ctes
from swathline.session import stored

col = F.col

HITS = f"hits AS (SELECT q.sample_id, q.source, q.question_type, q.split, {normalise_sql('p.prediction')} = {normalise_sql('q.answer')} AS hit FROM qa q JOIN pred p USING (sample_id))"


def hits(v):
    joined = v.qa.join(v.pred.select("sample_id", "prediction"), "sample_id")
    return joined.withColumn("hit", A.normalise(col("prediction")) == A.normalise(col("answer")))


@query(
    "SC01_accuracy_by_type",
    ctes("qa", "pred", HITS, "t AS (SELECT question_type, count(*) AS n, count(*) FILTER (hit) AS correct FROM hits GROUP BY question_type)")
    + """SELECT question_type, n, correct, round(correct / n, 4) AS accuracy, CAST(NULL AS DOUBLE) AS average_accuracy FROM t
UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), CAST(sum(correct) AS BIGINT), round(sum(correct) / sum(n), 4), round(avg(correct / n), 4) FROM t""",
)
def sc01(v):
    return SC.accuracy_by_type(hits(v), col("hit"), "question_type")


@query(
    "SC02_instruction_following",
    format_answer_sql("x") + "SELECT contract, count(*) AS n, round(avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END), 4) AS instruction_following, count(*) FILTER (NOT matched) AS unparsable FROM fmt GROUP BY contract",
)
def sc02(v):
    return SC.instruction_following(formatted(v), "matched", ["contract"])


TOK = "tk AS (SELECT row_id, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r, reference FROM caps)"


def gram_sql(words, n):
    if n == 1:
        return words
    return f"list_transform(range(1, greatest(len({words}) - {n - 1}, 0) + 1), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


GRAMS = (
    "pg AS (SELECT row_id, n, g, count(*) AS cp FROM (" + " UNION ALL ".join(f"SELECT row_id, {n} AS n, unnest({gram_sql('p', n)}) AS g FROM tk" for n in range(1, 5)) + ") u GROUP BY ALL),\n"
    "rg AS (SELECT row_id, n, g, count(*) AS cr FROM (" + " UNION ALL ".join(f"SELECT row_id, {n} AS n, unnest({gram_sql('r', n)}) AS g FROM tk" for n in range(1, 5)) + ") u GROUP BY ALL)"
)


@query(
    "SC05_bleu",
    ctes(
        "caps", TOK, GRAMS,
        "pr AS (SELECT n, sum(cp) AS total, sum(least(cp, coalesce(cr, 0))) AS clip FROM pg LEFT JOIN rg USING (row_id, n, g) GROUP BY n)",
        "ln AS (SELECT sum(len(p)) AS pl, sum(len(r)) AS rl FROM tk)",
        "x AS (SELECT max(CASE WHEN n = 1 THEN clip / total END) AS p1, max(CASE WHEN n = 2 THEN clip / total END) AS p2, max(CASE WHEN n = 3 THEN clip / total END) AS p3, max(CASE WHEN n = 4 THEN clip / total END) AS p4 FROM pr)",
        "y AS (SELECT *, least(p1, p2, p3, p4) AS lo, CASE WHEN pl > rl THEN 1.0 ELSE exp(1 - rl / greatest(pl, 1)) END AS bp FROM x, ln)",
    )
    + """SELECT round(p1, 4) AS bleu_1, round(p2, 4) AS bleu_2, round(p3, 4) AS bleu_3, round(p4, 4) AS bleu_4,
CASE WHEN lo > 0 THEN round(bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 4) ELSE 0.0 END AS bleu, CASE WHEN lo > 0 THEN round(bp, 4) ELSE 0.0 END AS brevity_penalty FROM y""",
)
def sc05(v):
    return SC.corpus_bleu(v.caps, "row_id", "prediction", "reference")


# Longest common subsequence has no practical SQL form on whole documents; tests use brute force.
@query("SC06_rouge_l")
def sc06(v):
    scored = SC.rouge_rows(v.caps, "prediction", "reference").withColumn("rouge_f1", SC.rouge_f1(col("prediction"), col("reference")))
    return scored.select("row_id", "lang", "lcs", F.round("rouge_l", 6).alias("rouge_l"), F.round("rouge_f1", 6).alias("rouge_f1"))


@query(
    "SC07_cider_d",
    ctes(
        "caps", TOK, GRAMS,
        "nd AS (SELECT ln(greatest(count(*), 1)) AS log_n FROM tk)",
        "df AS (SELECT n, g, count(*) AS df FROM rg GROUP BY n, g)",
        "pv AS (SELECT row_id, n, g, cp * (log_n - ln(greatest(coalesce(df, 0), 1))) AS v FROM pg LEFT JOIN df USING (n, g), nd)",
        "rv AS (SELECT row_id, n, g, cr * (log_n - ln(df)) AS v FROM rg JOIN df USING (n, g), nd)",
        "pn AS (SELECT row_id, n, sqrt(sum(v * v)) AS nrm FROM pv GROUP BY row_id, n)",
        "rn AS (SELECT row_id, n, sqrt(sum(v * v)) AS nrm FROM rv GROUP BY row_id, n)",
        "dt AS (SELECT row_id, n, sum(least(pv.v, rv.v) * rv.v) AS d FROM pv JOIN rv USING (row_id, n, g) GROUP BY row_id, n)",
        "sc AS (SELECT row_id, sum(CASE WHEN pn.nrm > 0 AND rn.nrm > 0 THEN coalesce(d, 0) / (pn.nrm * rn.nrm) ELSE 0 END) AS t FROM pn LEFT JOIN rn USING (row_id, n) LEFT JOIN dt USING (row_id, n) GROUP BY row_id)",
    )
    + "SELECT row_id, round(CASE WHEN len(p) > 0 AND len(r) > 0 THEN exp(-((len(p) - len(r)) * (len(p) - len(r))) / 72.0) * 10.0 * coalesce(t, 0) / 4 ELSE 0.0 END, 6) AS cider_d FROM tk LEFT JOIN sc USING (row_id)",
)
def sc07(v):
    return SC.cider_rows(v.caps, "row_id", "prediction", "reference").select("row_id", F.round("cider_d", 6).alias("cider_d"))


@query("SC08_caption_scores")
def sc08(v):
    """The caption scores, and the floor: the same predictions against rotated references."""
    # The rotated pairs are shuffled once and read twice.
    rotated = stored(SM.rotate_pairing(v.caps.select("row_id", "prediction", "reference"), "row_id", ["reference"], offset=1))
    own = SC.caption_scores(v.caps, "row_id", "prediction", "reference").withColumn("arm", F.lit("scores"))
    floor = SC.caption_scores(rotated, "row_id", "prediction", "reference").withColumn("arm", F.lit("blind_floor"))
    return own.unionByName(floor)


@query(
    "SC09_numeric_accuracy",
    ctes(
        "qa", "pred",
        "n AS (SELECT q.source, TRY_CAST(nullif(regexp_extract(p.prediction, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS got, CAST(q.image_id * 7 AS DOUBLE) AS want FROM qa q JOIN pred p USING (sample_id))",
        "e AS (SELECT *, abs(got - want) / CASE WHEN want <> 0 THEN abs(want) ELSE 1.0 END AS err FROM n)",
        "m AS (SELECT source, err, row_number() OVER (PARTITION BY source ORDER BY err) - 1 AS k, count(*) OVER (PARTITION BY source) AS c FROM e WHERE err IS NOT NULL)",
    )
    + """SELECT source, count(*) AS n, round(count(*) FILTER (err <= 0.05) / count(*), 4) AS accuracy, count(*) FILTER (got IS NULL) AS unparsable,
(SELECT round(max(err), 4) FROM m WHERE m.source = e.source AND k = c // 2) AS median_relative_error FROM e GROUP BY source""",
)
def sc09(v):
    rows = v.qa.join(v.pred.select("sample_id", "prediction"), "sample_id").withColumn("want", F.concat((col("image_id") * 7).cast("string"), F.lit(" m2")))
    return SC.numeric_accuracy(rows, ["source"], "prediction", "want")


REPLAY = "CASE sample_id % 7 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'change_magnitude' WHEN 3 THEN 'box_iou_0.5' WHEN 4 THEN 'rsvqa_hr_count' WHEN 5 THEN 'rouge_l' WHEN 6 THEN 'change_direction' END"
GOLD = """CASE sample_id % 7 WHEN 4 THEN CAST(image_id AS STRING) WHEN 6 THEN 'Increased'
WHEN 5 THEN CASE image_id % 3 WHEN 0 THEN 'There are several new buildings.' WHEN 1 THEN 'not possible to determine' ELSE 'about 7 objects' END ELSE answer END"""


@query(
    "SC11_replay_score",
    "WITH RECURSIVE " + ctes(
        "qa", "pred", "boxes",
        f"b AS (SELECT ref_id AS sample_id, max({IOU_SQL}) AS best FROM boxes GROUP BY ref_id)",
        f"x AS (SELECT q.sample_id, {REPLAY.replace('sample_id', 'q.sample_id')} AS contract, {GOLD.replace('sample_id', 'q.sample_id').replace(' AS STRING', ' AS VARCHAR')} AS gold, p.prediction, best, nullif(q.image_id % 4, 0) * 0.25 AS least, CASE WHEN q.sample_id % 3 = 0 THEN 'scored' ELSE 'pending' END AS status, q.sample_id % 10 <> 9 AS replayed FROM qa q JOIN pred p USING (sample_id) LEFT JOIN b USING (sample_id))",
        # The longest common subsequence word by word: a row of the table at a time.
        "tk AS (SELECT DISTINCT prediction, gold, string_split(lower(prediction), ' ') AS p, string_split(lower(gold), ' ') AS r FROM x WHERE contract = 'rouge_l')",
        """lc AS (SELECT prediction, gold, p, r, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(r) + 1), lambda j: CAST(0 AS BIGINT)) AS dp FROM tk
 UNION ALL SELECT prediction, gold, p, r, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda y: CASE WHEN p[i + 1] = r[y] THEN dp[y] + 1 ELSE dp[y + 1] END)))) FROM lc WHERE i < len(p))""",
        "ro AS (SELECT prediction, gold, 2.0 * dp[len(r) + 1] / (len(p) + len(r)) AS rouge FROM lc WHERE i = len(p))",
        """y AS (SELECT x.*, CASE contract WHEN 'box_iou_0.5' THEN coalesce(best >= 0.5, false) WHEN 'rouge_l' THEN rouge >= coalesce(least, 0)
WHEN 'yes_no' THEN CASE WHEN regexp_matches(lower(x.prediction), '(^| )(no|there are no)( |$)') OR starts_with(lower(x.prediction), 'no') THEN 'no' WHEN starts_with(lower(x.prediction), 'yes') THEN 'yes' ELSE 'no' END = lower(x.gold)
WHEN 'rsvqa_hr_count' THEN coalesce(nullif(regexp_extract(x.prediction, '[0-9]+'), ''), '0') = x.gold
WHEN 'change_direction' THEN CASE WHEN contains(lower(x.prediction), 'decreased') THEN 'decreased' WHEN contains(lower(x.prediction), 'unchanged') THEN 'unchanged' ELSE 'increased' END = lower(x.gold)
WHEN 'change_magnitude' THEN CASE WHEN contains(lower(x.prediction), 'a few') THEN 'a few' WHEN contains(lower(x.prediction), 'dozens') THEN 'dozens' WHEN contains(lower(x.prediction), 'none') THEN 'none' WHEN contains(lower(x.prediction), 'many') THEN 'many' ELSE 'none' END = lower(x.gold)
ELSE lower(trim(x.prediction)) = lower(trim(x.gold)) END AS passed FROM x LEFT JOIN ro ON ro.prediction = x.prediction AND ro.gold = x.gold)""",
    )[len("WITH "):]
    + "SELECT sample_id, contract, CASE WHEN replayed THEN passed END AS passed, CASE WHEN NOT replayed OR status = 'scored' THEN status WHEN passed THEN 'verified' ELSE 'failed' END AS status FROM y",
)
def sc11(v):
    """Pass rule by the item's own contract, then a left join folds the replayed rows back into the list."""
    best = iou(v).groupBy(col("ref_id").alias("sample_id")).agg(F.max("iou").alias("best"))
    items = v.qa.select(
        "sample_id", F.lit("How many?").alias("question"), F.expr(GOLD).alias("answer"), F.expr(REPLAY).alias("contract"), (F.nullif(col("image_id") % 4, F.lit(0)) * 0.25).alias("floor"),
        F.when(col("sample_id") % 3 == 0, "scored").otherwise("pending").alias("status"),
    )
    run = v.pred.where("sample_id % 10 <> 9").select("sample_id", "prediction")
    return SC.replay_merge(items, run, best)


@query(
    "SC12_arm_comparison",
    ctes("qa", "pred", HITS, "t AS (SELECT source, question_type, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM hits GROUP BY ALL)",
         "s AS (SELECT source, CAST(sum(n) AS BIGINT) AS samples, avg(a) AS av FROM t GROUP BY source)")
    + """SELECT s.source, s.samples, round(s.av, 4) AS average_accuracy, round(s.av - b.av, 4) AS delta, CASE WHEN greatest(s.av, b.av) < 0.1 THEN 'no verdict' WHEN s.av - b.av >= 0.02 THEN 'better' WHEN s.av - b.av <= -0.005 THEN 'worse' ELSE 'within noise' END AS verdict
FROM s, (SELECT av FROM s WHERE source = 'src0') b""",
)
def sc12(v):
    return SC.arm_comparison(hits(v), "source", "question_type", col("hit"), "src0")


TARGETS = {"src0": 10.0, "src1": 45.0, "src2": 15.0, "src3": 85.0}


@query(
    "SC13_gate_table",
    ctes("qa", "pred", HITS, "t AS (SELECT source, question_type, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS a FROM hits GROUP BY ALL)",
         "s AS (SELECT source, round(100 * avg(a), 2) AS accuracy FROM t GROUP BY source)",
         "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {t})" for k, t in TARGETS.items()) + ") x(source, target))")
    + "SELECT source, target, accuracy, CASE WHEN accuracy IS NULL THEN 'not run' WHEN accuracy >= target THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g LEFT JOIN s USING (source)",
)
def sc13(v):
    per_type = hits(v).groupBy("source", "question_type").agg(F.avg(col("hit").cast("double")).alias("a"))
    scores = per_type.groupBy("source").agg(F.round(100 * F.avg("a"), 2).alias("accuracy"))
    return SC.gate_table(scores, TARGETS, "source", "accuracy")
