"""Sampling, balancing, splitting and merging of question rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import headers as H
from swathline.operators import change as CH
from swathline.operators import questions as Q
from swathline.operators import ranking as RK
from swathline.operators import sampling as SM
from swathline.plans.change_queries import PAIR_STATS, WHERE_SQL, BAND_SQL
from swathline.plans.registry import query
from swathline.plans.views import ctes

col = F.col


def month(p):
    return F.format_string("%04d-%02d", (F.lit(1995) + F.floor(p / 4)).cast("int"), (p % 4 * 3 + 1).cast("int"))


def change_rows(v):
    stats = CH.pair_statistics(v.obj, "aoi", "period", "obj_id")
    return Q.change_rows(stats.withColumn("first", month(col("first"))).withColumn("second", month(col("second"))), "aoi")


def change_sql():
    m = lambda c: f"format('{{:04d}}-{{:02d}}', CAST(1995 + floor({c} / 4) AS BIGINT), CAST({c} % 4 * 3 + 1 AS BIGINT))"
    answers = {
        "presence_appeared": "CASE WHEN appeared > 0 THEN 'yes' ELSE 'no' END",
        "presence_demolished": "CASE WHEN demolished > 0 THEN 'yes' ELSE 'no' END",
        "direction": "CASE WHEN total_second > total_first THEN 'increased' WHEN total_second < total_first THEN 'decreased' ELSE 'unchanged' END",
        "compare": "CASE WHEN total_second > total_first THEN 'second' WHEN total_second < total_first THEN 'first' END",
        "magnitude": BAND_SQL,
        "count_appeared": "CAST(appeared AS VARCHAR)",
        "count_demolished": "CAST(demolished AS VARCHAR)",
        "where": WHERE_SQL,
    }
    rows = " UNION ALL ".join(
        f"SELECT aoi, first, second, appeared, demolished, '{t}' AS task, '{q}' AS question, {answers[op]} AS answer, '{k}' AS answer_type, "
        + (f"'{Q.ANSWER_OPTIONS[t]}'" if t in Q.ANSWER_OPTIONS else "CAST(NULL AS VARCHAR)") + " AS answer_options FROM pm"
        for t, op, q, k in Q.CHANGE_QUESTIONS
    )
    return (
        PAIR_STATS + f",\npm AS (SELECT aoi, {m('first')} AS first, {m('second')} AS second, total_first, total_second, appeared, demolished, north, east FROM ps),\n"
        + f"cr0 AS ({rows}),\n"
        + """cr AS (SELECT *, concat_ws('_', aoi, least(first, second), greatest(first, second), task, substr(sha1(question), 1, 8)) AS twin_id,
concat_ws('_', aoi, first, second, task, substr(sha1(question), 1, 8)) AS sample_id,
abs((CAST(substr(second, 1, 4) AS INT) * 12 + CAST(substr(second, 6, 2) AS INT)) - (CAST(substr(first, 1, 4) AS INT) * 12 + CAST(substr(first, 6, 2) AS INT))) AS gap_months FROM cr0 WHERE answer IS NOT NULL)"""
    )


@query("QG08_qa_change_pairs", ctes("obj", change_sql()) + "SELECT sample_id, twin_id, task, question, answer, answer_type, answer_options, appeared, demolished, gap_months, task = 'change_count' AND TRY_CAST(answer AS BIGINT) > 20 AS large_count FROM cr")
def qg08(v):
    return change_rows(v).select("sample_id", "twin_id", "task", "question", "answer", "answer_type", "answer_options", "appeared", "demolished", "gap_months", "large_count")


def ranked_sql(group, seed, key="sample_id", source="qa"):
    parts = ", ".join(group)
    return f"SELECT *, row_number() OVER (PARTITION BY {parts} ORDER BY sha256(concat_ws('|', '{seed}', {parts}, {key})), {key}) AS rank FROM {source}"


@query("SM01_take_n", ctes("qa", "k AS (" + ranked_sql(["image_id"], "take") + ")") + "SELECT sample_id, image_id, rank FROM k WHERE rank <= 5")
def sm01(v):
    out = SM.take_n(v.qa, ["image_id"], 5, "take", "sample_id")
    return out.select("sample_id", "image_id", col("rank").cast("long").alias("rank"))


GRID = "g AS (SELECT c_custkey, string_split(patch_id, '_')[6] || '_' || string_split(patch_id, '_')[3] AS tile, CAST(string_split(patch_id, '_')[7] AS INT) % 30 AS i, CAST(string_split(patch_id, '_')[8] AS INT) % 30 AS j, sha256(concat_ws('|', 'spread', patch_id, c_custkey)) AS o FROM patch)"


def grid_patches(v):
    p = H.parse_patch_id(col("patch_id"))
    return v.patch.select(
        "c_custkey", F.concat_ws("_", p["tile"], p["sensing"]).alias("tile"), (p["first"] % 30).alias("i"), (p["second"] % 30).alias("j"),
        RK.seeded("spread", "patch_id", "c_custkey").alias("o"),
    )


@query(
    "SM02_spread_within_tile",
    "WITH RECURSIVE " + ctes("patch", GRID)[len("WITH "):]
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY o) AS k FROM g),
w AS (SELECT tile, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i INT, j INT)[]) AS kept, CAST(NULL AS BIGINT) AS c_custkey, false AS ok FROM (SELECT DISTINCT tile FROM n) d
 UNION ALL SELECT w.tile, n.k, CASE WHEN len(list_filter(w.kept, lambda q: greatest(abs(q.i - n.i), abs(q.j - n.j)) < 3)) = 0 THEN list_append(w.kept, {'i': n.i, 'j': n.j}) ELSE w.kept END,
 n.c_custkey, len(list_filter(w.kept, lambda q: greatest(abs(q.i - n.i), abs(q.j - n.j)) < 3)) = 0 FROM w JOIN n ON n.tile = w.tile AND n.k = w.k + 1)
SELECT c_custkey, tile FROM w WHERE ok""",
)
def sm02(v):
    return SM.spread_within_tile(grid_patches(v), ["tile"], "o", "i", "j").select("c_custkey", "tile")


SEASON_SQL = "CASE WHEN m IN ('12', '01', '02') THEN 'winter' WHEN m IN ('03', '04', '05') THEN 'spring' WHEN m IN ('06', '07', '08') THEN 'summer' WHEN m IN ('09', '10', '11') THEN 'autumn' ELSE 'unknown' END"


@query(
    "SM03_stratified_round_robin",
    "WITH RECURSIVE " + ctes(
        "patch",
        "g0 AS (SELECT c_custkey, coalesce(CAST(country AS VARCHAR), 'unknown') AS country, substr(string_split(patch_id, '_')[3], 5, 2) AS m, string_split(patch_id, '_')[6] || '_' || string_split(patch_id, '_')[3] AS tile, CAST(string_split(patch_id, '_')[7] AS INT) % 30 AS i, CAST(string_split(patch_id, '_')[8] AS INT) % 30 AS j FROM patch)",
        f"g AS (SELECT c_custkey, country, {SEASON_SQL} AS season, tile, i, j FROM g0)",
        "n AS (SELECT *, sha256(concat_ws('|', 'strata', country, season, c_custkey)) || '|' || c_custkey AS o, row_number() OVER (PARTITION BY country, season, tile ORDER BY sha256(concat_ws('|', 'strata', country, season, c_custkey)) || '|' || c_custkey) AS k FROM g)",
        """w AS (SELECT country, season, tile, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i INT, j INT)[]) AS kept, CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS o, false AS ok FROM (SELECT DISTINCT country, season, tile FROM n) d
 UNION ALL SELECT w.country, w.season, w.tile, n.k, CASE WHEN len(list_filter(w.kept, lambda q: greatest(abs(q.i - n.i), abs(q.j - n.j)) < 3)) = 0 THEN list_append(w.kept, {'i': n.i, 'j': n.j}) ELSE w.kept END,
 n.c_custkey, n.o, len(list_filter(w.kept, lambda q: greatest(abs(q.i - n.i), abs(q.j - n.j)) < 3)) = 0 FROM w JOIN n ON n.country = w.country AND n.season = w.season AND n.tile = w.tile AND n.k = w.k + 1)""",
        "k AS (SELECT *, row_number() OVER (PARTITION BY country, season ORDER BY o) AS round FROM w WHERE ok)",
        "p AS (SELECT *, row_number() OVER (ORDER BY round, concat_ws('|', country, season)) AS place FROM k)",
    )[len("WITH "):]
    + "SELECT c_custkey, country, season, round, place FROM p WHERE place <= 300",
)
def sm03(v):
    """Strata of country and season, each thinned within its tiles and dates before the rounds are dealt."""
    p = H.parse_patch_id(col("patch_id"))
    rows = v.patch.select(
        "c_custkey", "country", SM.season_of(col("patch_id")).alias("season"), F.concat_ws("_", p["tile"], p["sensing"]).alias("tile"),
        (p["first"] % 30).alias("i"), (p["second"] % 30).alias("j"),
    )
    out = SM.stratified_round_robin(rows, ["country", "season"], 300, "strata", "c_custkey", ["tile"], "i", "j")
    return out.select("c_custkey", "country", "season", col("round").cast("long").alias("round"), col("place").cast("long").alias("place"))


QUOTAS = {"1-URGENT": 100, "2-HIGH": 40, "3-MEDIUM": 7, "9-NONE": 50}
QUOTA_SQL = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTAS.items()) + " ELSE 0 END"


@query("SM04_quota_per_type", ctes("qa", "k AS (" + ranked_sql(["question_type"], "quota") + ")") + f"SELECT sample_id, question_type FROM k WHERE rank <= {QUOTA_SQL}")
def sm04(v):
    return SM.quota_per_type(v.qa, "question_type", QUOTAS, "quota", "sample_id").select("sample_id", "question_type")


FILL = {"src0": 300, "src1": 33, "src2": 3}


def backfill_sql(source, quotas, seed):
    q = "CASE source " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in quotas.items()) + " END"
    return f"""bq AS (SELECT *, {q} AS quota FROM {source}),
bt AS (SELECT source, count(DISTINCT question_type) AS types FROM bq WHERE quota IS NOT NULL GROUP BY source),
bk AS (SELECT bq.*, greatest(1, quota // types) AS share, row_number() OVER (PARTITION BY source, question_type ORDER BY sha256(concat_ws('|', '{seed}', source, question_type, sample_id)), sample_id) AS k FROM bq JOIN bt USING (source) WHERE quota IS NOT NULL),
bp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k <= share THEN 0 ELSE 1 END, CASE WHEN k <= share THEN question_type END NULLS FIRST, CASE WHEN k <= share THEN k END NULLS FIRST, sha256(concat_ws('|', '{seed}:spare', source, sample_id)), sample_id) AS place FROM bk),
picked AS (SELECT * FROM bp WHERE place <= quota)"""


@query("SM05_quota_with_backfill", ctes("qa", backfill_sql("qa", FILL, "fill")) + "SELECT sample_id, source, question_type FROM picked")
def sm05(v):
    return SM.quota_with_backfill(v.qa, "source", "question_type", FILL, "fill", "sample_id").select("sample_id", "source", "question_type")


@query("SM06_cap_per_group", ctes("qa") + "SELECT sample_id, image_id, question_type FROM qa QUALIFY row_number() OVER (PARTITION BY image_id, question_type ORDER BY sample_id) <= 2")
def sm06(v):
    return SM.cap_per_group(v.qa, ["image_id", "question_type"], ["sample_id"], 2).select("sample_id", "image_id", "question_type")


def split_rows(v):
    return change_rows(v).withColumn("split", F.when(col("aoi") % 5 == 0, "val").otherwise("train"))


SPLIT_CR = "sr AS (SELECT *, CASE WHEN aoi % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM cr)"


def admission_sql(source: str, cap: str, order: str) -> str:
    """The sequential walk: groups of a (split, task) one after the other, each admitted if every answer stays within its cap."""
    return f"""dm AS (SELECT split, task, twin_id, answer, count(*) AS n FROM {source} GROUP BY ALL),
rr AS (SELECT split, task, min(t) AS rarest FROM (SELECT split, task, answer, sum(n) AS t FROM dm GROUP BY ALL) x GROUP BY ALL),
gd AS (SELECT split, task, twin_id, list({{'a': answer, 'n': n}}) AS needs, count(*) > 1 AS flips FROM dm GROUP BY split, task, twin_id),
gk AS (SELECT gd.*, {cap} AS cap, row_number() OVER (PARTITION BY split, task ORDER BY {order}, twin_id) AS k FROM gd JOIN rr USING (split, task)),
wk AS (SELECT split, task, CAST(0 AS BIGINT) AS k, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS tally, CAST(NULL AS VARCHAR) AS twin_id, false AS ok FROM (SELECT DISTINCT split, task FROM gk) b
 UNION ALL SELECT split, task, k, CASE WHEN fits THEN map_concat(tally, map_from_entries(list_transform(needs, lambda x: {{'k': x.a, 'v': coalesce(tally[x.a], 0) + x.n}}))) ELSE tally END, twin_id, fits
 FROM (SELECT gk.split, gk.task, gk.k, wk.tally, gk.needs, gk.twin_id, len(list_filter(gk.needs, lambda x: coalesce(wk.tally[x.a], 0) + x.n > gk.cap)) = 0 AS fits FROM wk JOIN gk ON gk.split = wk.split AND gk.task = wk.task AND gk.k = wk.k + 1) s)"""


ADMITTED = "SELECT sample_id, twin_id, split, task, answer FROM {source} SEMI JOIN (SELECT * FROM wk WHERE ok) k USING (split, task, twin_id)"


@query(
    "SM07_cap_twin_groups",
    "WITH RECURSIVE " + ctes("obj", change_sql(), SPLIT_CR, admission_sql("sr", "CASE WHEN split = 'train' THEN 400 ELSE 80 END", "sha256(concat_ws('|', 'cap', twin_id))"))[len("WITH "):]
    + ADMITTED.format(source="sr"),
)
def sm07(v):
    return SM.cap_twin_groups(split_rows(v), 400, "cap").select("sample_id", "twin_id", "split", "task", "answer")


OPEN_SQL = ", ".join(f"'{t}'" for t in Q.OPEN_TASKS)


@query(
    "SM08_balance_answers",
    "WITH RECURSIVE " + ctes(
        "obj", change_sql(), SPLIT_CR, f"cd AS (SELECT * FROM sr WHERE task NOT IN ({OPEN_SQL}))",
        admission_sql("cd", "rarest", "CASE WHEN flips THEN '0' ELSE '1' END || sha256(concat_ws('|', 'balance', twin_id))"),
    )[len("WITH "):]
    + ADMITTED.format(source="cd") + f" UNION ALL SELECT sample_id, twin_id, split, task, answer FROM sr WHERE task IN ({OPEN_SQL})",
)
def sm08(v):
    return SM.balance_answers(split_rows(v), Q.OPEN_TASKS, "balance").select("sample_id", "twin_id", "split", "task", "answer")


@query("SM09_task_cap", ctes("obj", change_sql(), SPLIT_CR) + "SELECT sample_id, twin_id, split, task FROM sr QUALIFY row_number() OVER (PARTITION BY split, task ORDER BY twin_id, sample_id) <= 2500")
def sm09(v):
    return SM.cap_per_group(split_rows(v), ["split", "task"], ["twin_id", "sample_id"], 2500).select("sample_id", "twin_id", "split", "task")


@query(
    "SM10_holdout_by_group",
    ctes("qa", "g AS (SELECT image_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'hold', image_id)), image_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM qa) d)")
    + "SELECT sample_id, image_id, CASE WHEN k <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM qa JOIN g USING (image_id)",
)
def sm10(v):
    return SM.holdout_by_group(v.qa, "image_id", 0.15, "hold").select("sample_id", "image_id", "split")


@query(
    "SM11_eval_split",
    ctes("qa", "h AS (SELECT sample_id, coalesce(CASE WHEN sample_id % 4 > 0 THEN question_type END, question_type) AS question_type, answer FROM qa WHERE split = 'val')", "k AS (" + ranked_sql(["question_type"], "eval", source="h") + ")")
    + "SELECT sample_id, question_type, question_type AS task, answer FROM k WHERE rank <= 120",
)
def sm11(v):
    raw = v.qa.withColumn("task", col("question_type")).withColumn("question_type", F.when(col("sample_id") % 4 > 0, col("question_type")))
    return SM.eval_split(raw, "val", 120, "eval", "sample_id").select("sample_id", "question_type", "task", "answer")


@query(
    "SM12_positive_negative_ratio",
    ctes("qa", "n AS (SELECT sample_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'ratio', sample_id)), sample_id) AS k FROM qa WHERE answer <> 'a few')")
    + "SELECT sample_id, answer FROM qa WHERE answer = 'a few' UNION ALL SELECT sample_id, answer FROM qa JOIN n USING (sample_id) WHERE k <= (SELECT floor(count(*) * 0.4) FROM qa WHERE answer = 'a few')",
)
def sm12(v):
    return SM.positive_negative_ratio(v.qa, col("answer") == "a few", 0.4, "ratio", "sample_id").select("sample_id", "answer")


@query("SM13_sample_per_bucket", ctes("qa", "k AS (" + ranked_sql(["source", "question_type", "aoi"], "sample") + ")") + "SELECT sample_id, source, question_type, aoi FROM k WHERE rank <= 3")
def sm13(v):
    return SM.take_n(v.qa, ["source", "question_type", "aoi"], 3, "sample", "sample_id").select("sample_id", "source", "question_type", "aoi")


@query(
    "SM14_strided_sample",
    ctes("qa", "d AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS k, greatest(1, count(*) OVER () // 60) AS step FROM (SELECT DISTINCT image_id FROM qa) x)")
    + "SELECT image_id FROM d WHERE k % step = 0 AND k // step < 60",
)
def sm14(v):
    return SM.strided_sample(v.qa, "image_id", F.floor(col("image_id") / 16), 60)


@query(
    "SM15_rotate_pairing",
    ctes("qa", "i AS (SELECT sample_id, image_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'rotate', sample_id)), sample_id) - 1 AS k, count(*) OVER () AS n FROM qa)")
    + "SELECT a.sample_id, b.image_id FROM i a JOIN i b ON b.k = (a.k + greatest(1, a.n // 2)) % a.n",
)
def sm15(v):
    return SM.rotate_pairing(v.qa.select("sample_id", "image_id"), "sample_id", ["image_id"]).select("sample_id", "image_id")


DROP = "dp AS (SELECT o_orderkey AS sample_id, CASE o_orderkey % 4 WHEN 0 THEN 'vv,vh' WHEN 1 THEN 'hh,hv' WHEN 2 THEN 'hv' ELSE 'vh,hh' END AS pols, CAST('0x' || substr(sha256(concat_ws('|', 'drop', o_orderkey)), 1, 8) AS BIGINT) / 4294967296.0 AS f FROM orders)"
DROPPED = "dd AS (SELECT *, pols <> 'hv' AS eligible, pols <> 'hv' AND f < 0.25 AS dropped FROM dp)"


def pols(v):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'vv,vh' WHEN 1 THEN 'hh,hv' WHEN 2 THEN 'hv' ELSE 'vh,hh' END")
    rows = v.orders.select(col("o_orderkey").alias("sample_id"), F.split(text, ",").alias("pols"))
    return SM.pol_dropout(rows, "pols", "drop", "sample_id")


@query(
    "SM16_pol_dropout",
    "WITH " + DROP + ", " + DROPPED + " SELECT sample_id, eligible, dropped, CASE WHEN dropped THEN CASE pols WHEN 'vv,vh' THEN 'vv' ELSE 'hh' END ELSE array_to_string(list_sort(string_split(pols, ',')), ',') END AS kept FROM dd",
)
def sm16(v):
    return pols(v).select("sample_id", "eligible", "dropped", F.array_join("kept", ",").alias("kept"))


@query(
    "SM16_dropout_rate",
    "WITH " + DROP + ", " + DROPPED + " SELECT count(*) AS samples, count(*) FILTER (eligible) AS eligible, count(*) FILTER (dropped) AS dropped, round(count(*) FILTER (dropped) / count(*) FILTER (eligible), 4) AS realised_rate FROM dd",
)
def sm16_rate(v):
    n = lambda c: F.sum(col(c).cast("long"))
    return pols(v).agg(F.count("*").alias("samples"), n("eligible").alias("eligible"), n("dropped").alias("dropped"), F.round(n("dropped") / n("eligible"), 4).alias("realised_rate"))


SEASON_SQL = "CASE substr(string_split(patch_id, '_')[3], 5, 2) WHEN '12' THEN 'winter' WHEN '01' THEN 'winter' WHEN '02' THEN 'winter' WHEN '03' THEN 'spring' WHEN '04' THEN 'spring' WHEN '05' THEN 'spring' WHEN '06' THEN 'summer' WHEN '07' THEN 'summer' WHEN '08' THEN 'summer' ELSE 'autumn' END"


@query(
    "SM17_coverage_report",
    ctes("patch", f"p AS (SELECT country, {SEASON_SQL} AS season, string_split(patch_id, '_')[6] AS tile FROM patch)")
    + "SELECT count(*) AS patches, count(DISTINCT country) AS countries, count(DISTINCT season) AS seasons, count(DISTINCT tile) AS tiles, round((SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY tile) t) / count(*), 3) AS largest_tile_share FROM p",
)
def sm17(v):
    return SM.coverage_report(v.patch, "country", SM.season_of(col("patch_id")), F.get(F.split("patch_id", "_"), F.lit(5)))


MERGE_ROWS = "mr AS (SELECT sample_id, source, question_type, concat('Is a ', CASE WHEN sample_id % 7 = 0 THEN 'Small' ELSE 'red' END, ' house there?') AS question, image_id FROM qa WHERE split = 'train')"


@query(
    "SM18_merge_sources",
    ctes("qa", MERGE_ROWS, "mk AS (SELECT * FROM mr WHERE NOT (source = 'src0' AND question_type IN ('5-LOW')) AND NOT (source = 'src1' AND regexp_matches(question, '\\b(small|large)\\b', 'i')))", backfill_sql("mk", {"src0": 500, "src1": 200, "src2": 50}, "merge"))
    + "SELECT concat(source, '_', sample_id) AS sample_id, source AS corpus_source, question_type, concat(source, '/img', image_id, '.png') AS image FROM picked",
)
def sm18(v):
    rows = v.qa.where("split = 'train'").select(
        "sample_id", "source", "question_type",
        F.concat(F.lit("Is a "), F.when(col("sample_id") % 7 == 0, "Small").otherwise("red"), F.lit(" house there?")).alias("question"),
        F.array(F.concat(F.lit("img"), col("image_id"), F.lit(".png"))).alias("images"),
    )
    out = SM.merge_sources(rows, {"src0": 500, "src1": 200, "src2": 50}, {"src0": ["5-LOW"]}, {"src1": r"\b(small|large)\b"}, "merge")
    return out.select("sample_id", "corpus_source", "question_type", F.get("images", F.lit(0)).alias("image"))
