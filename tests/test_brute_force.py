"""Operators without a SQL check, against a direct sequential computation on a fixture."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathline.functions.tokens import lcs_bits
from swathline.operators import calibrate as CF
from swathline.operators import ranking as RK
from swathline.operators import regions as RG
from swathline.operators import registration as RE
from swathline.operators import sampling as SM
from swathline.operators import scoring as SC
from swathline.operators import validate as V


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def test_bit_parallel_lcs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 150))] for _ in range(2))
        assert lcs_bits(a, b) == lcs(a, b)


CAPTIONS = [
    ("a large ship near the harbour and a small ship", "a ship in the harbour near a large dock"),
    ("forest forest forest", "dense forest beside a lake"),
    ("", "an empty field"),
    ("a ship in the harbour near a large dock", "a ship in the harbour near a large dock"),
    ("roads and houses", "dense forest beside a lake"),
]


def words(t):
    return re.findall("[a-z0-9]+", t.lower())


def grams(t, n):
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


@pytest.fixture(scope="module")
def captions(spark):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(CAPTIONS)], "row_id long, prediction string, reference string")


def test_caption_metrics(captions):
    got = SC.caption_scores(captions, "row_id", "prediction", "reference").collect()[0]
    pairs = [(words(p), words(r)) for p, r in CAPTIONS]
    precisions = []
    for n in range(1, 5):
        clip = sum(min(c, grams(r, n)[g]) for p, r in pairs for g, c in grams(p, n).items())
        precisions.append(clip / sum(sum(grams(p, n).values()) for p, _ in pairs))
    pl, rl = sum(len(p) for p, _ in pairs), sum(len(r) for _, r in pairs)
    penalty = 1.0 if pl > rl else math.exp(1 - rl / pl)
    assert got["bleu_2"] == round(precisions[1], 4)
    assert got["bleu"] == pytest.approx(penalty * math.exp(sum(map(math.log, precisions)) / 4), abs=1e-4)
    rouge = []
    for p, r in pairs:
        k = lcs(p, r)
        a, b = (k / len(p), k / len(r)) if p and r and k else (0, 0)
        rouge.append((1 + 1.44) * a * b / (b + 1.44 * a) if k else 0.0)
    assert got["rouge_l"] == pytest.approx(sum(rouge) / len(rouge), abs=1e-4)
    df = [Counter(g for _, r in pairs for g in grams(r, n)) for n in range(1, 5)]
    weigh = lambda t, n: {g: c * math.log(len(pairs) / max(df[n - 1][g], 1)) for g, c in grams(t, n).items()}
    scores = []
    for p, r in pairs:
        total = 0.0
        for n in range(1, 5):
            vp, vr = weigh(p, n), weigh(r, n)
            norm = math.sqrt(sum(x * x for x in vp.values())) * math.sqrt(sum(x * x for x in vr.values()))
            total += sum(min(v, vr.get(g, 0)) * vr.get(g, 0) for g, v in vp.items()) / norm if norm else 0
        scores.append(math.exp(-((len(p) - len(r)) ** 2) / 72) * 10 * total / 4 if p and r else 0.0)
    assert got["cider_d"] == pytest.approx(sum(scores) / len(scores), abs=1e-4)
    assert got["empty_predictions"] == 1


def test_rouge_rows_reach_every_row(captions):
    rows = SC.rouge_rows(captions, "prediction", "reference").collect()
    assert len(rows) == len(CAPTIONS) and all(0 <= r["rouge_l"] <= 1 for r in rows)


def twins(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(400):
        task = "change_presence" if g % 3 else "change_count"
        options = ["yes", "no"] if g % 3 else [str(k) for k in range(5)]
        for half in range(1 + int(rng.random() < 0.8)):
            answer = str(rng.choice(options, p=[0.8, 0.2] if g % 3 else None))
            rows.append((f"s{g}_{half}", f"t{g:03d}", "val" if g % 4 == 0 else "train", task, answer))
    return spark.createDataFrame(rows, "sample_id string, twin_id string, split string, task string, answer string"), rows


def ordered(spark, rows, seed):
    ids = spark.createDataFrame([(t,) for t in sorted({r[1] for r in rows})], "twin_id string")
    return {r["twin_id"]: r["o"] for r in ids.withColumn("o", RK.seeded(seed, "twin_id")).collect()}


def replay(rows, order, cap_of):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    tally, kept = Counter(), set()
    for twin in sorted(groups, key=lambda t: order[t]):
        demand = Counter((r[2], r[3], r[4]) for r in groups[twin])
        if all(tally[k] + n <= cap_of(k) for k, n in demand.items()):
            tally.update(demand)
            kept |= {r[0] for r in groups[twin]}
    return kept


@pytest.mark.parametrize("cap", [1, 7, 40, 1000])
def test_cap_twin_groups_equals_the_sequential_walk(spark, cap):
    df, rows = twins(spark)
    order = ordered(spark, rows, "cap")
    want = replay(rows, order, lambda k: cap if k[0] == "train" else max(1, cap // 5))
    assert {r["sample_id"] for r in SM.cap_twin_groups(df, cap, "cap").collect()} == want


def test_walk_in_blocks_carries_its_counters(spark):
    """Blocks of nine groups, NULL answers, a NULL group and answers that close at different places."""
    df, rows = twins(spark)
    rows = [(*r[:4], None if r[4] == "3" else r[4]) for r in rows] + [("s_null", None, "train", "change_count", "1")]
    df = spark.createDataFrame(rows, df.schema)
    order = ordered(spark, rows[:-1], "cap")
    seeds = {None: spark.range(1).select(RK.seeded("cap", F.lit(None).cast("string"))).first()[0], **order}
    demand = SM.twin_demand(df.where("twin_id IS NOT NULL"), RK.seeded("cap", "twin_id")).withColumn("cap", F.lit(11))
    lost = demand.limit(1).selectExpr("'train' AS split", "'change_count' AS task", "CAST(NULL AS STRING) AS twin_id", "'1' AS answer", "1L AS n", "false AS flips", f"'{seeds[None]}' AS `order`", "11 AS cap")
    got = SM.greedy_admission(demand.unionByName(lost), ["split", "task"], "twin_id", "answer", "n", "order", "cap", block=9)
    want = replay(rows, seeds, lambda k: 11)
    assert {r["twin_id"] for r in got.collect()} == {r[1] for r in rows if r[0] in want}


def test_balance_answers_equals_the_sequential_walk(spark):
    df, rows = twins(spark)
    closed = [r for r in rows if r[3] != "change_count"]
    base = ordered(spark, closed, "bal")
    answers = defaultdict(set)
    for r in closed:
        answers[r[1]].add(r[4])
    order = {t: ("0" if len(answers[t]) > 1 else "1") + o for t, o in base.items()}
    totals = Counter((r[2], r[3], r[4]) for r in closed)
    rarest = lambda k: min(n for b, n in totals.items() if b[:2] == k[:2])
    want = replay(closed, order, rarest) | {r[0] for r in rows if r[3] == "change_count"}
    assert {r["sample_id"] for r in SM.balance_answers(df, ["change_count"], "bal").collect()} == want


def test_rank_of_a_hot_group_matches_a_plain_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).alias("k")).withColumn("o", RK.seeded("x", "id"))
    ranked = RK.dense_rank_rows(df, ["k"], ["o", "id"], RK.hash_bucket(F.col("o")))
    plain = df.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("o", "id")))
    assert ranked.join(plain.select("id", "want"), "id").where("rank <> want").isEmpty()


def pav(points):
    blocks = []
    for y, w in points:
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            y1, w1, n1 = blocks.pop()
            y0, w0, n0 = blocks.pop()
            blocks.append([(y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return [y for y, _, n in blocks for _ in range(n)]


def test_isotonic_fit_equals_pool_adjacent_violators(spark):
    rng = np.random.default_rng(9)
    rows = [(round(float(s), 2), int(rng.random() < s)) for s in rng.random(600)]
    got = {r["score"]: r["fitted"] for r in CF.isotonic_fit(spark.createDataFrame(rows, "p double, correct int"), "p", "correct").collect()}
    by = defaultdict(list)
    for s, c in rows:
        by[s].append(c)
    scores = sorted(by)
    want = pav([(sum(by[s]) / len(by[s]), len(by[s])) for s in scores])
    assert [got[s] for s in scores] == pytest.approx(want, abs=1e-9)


def features(spark, n):
    rng = np.random.default_rng(11)
    rows = [(*[float(x) for x in rng.random(8)], 0) for _ in range(n)]
    rows = [(*r[:8], int(r[0] + 0.3 * rng.random() > 0.6)) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in CF.FEATURES) + ", correct int")


def test_calibrator_is_monotone_and_calibrated(spark):
    rows = CF.fit_calibrator(features(spark, 400), "correct").orderBy("score").collect()
    fitted = [r["calibrated"] for r in rows]
    assert fitted == sorted(fitted)
    assert sum(fitted) / len(fitted) == pytest.approx(sum(r["correct"] for r in rows) / len(rows), abs=1e-6)


def test_too_few_samples_are_refused(spark):
    with pytest.raises(ValueError):
        CF.fit_calibrator(features(spark, 9), "correct")


def test_shift_search_recovers_a_known_shift(spark):
    rng = np.random.default_rng(13)
    big = rng.random((40, 40))
    for _ in range(2):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, (1, 1), (0, 1))) / 4
    ref, mov = big[8:28, 8:28], big[11:31, 6:26]
    rows = lambda a, n: spark.createDataFrame([(1, r, c, float(x)) for (r, c), x in np.ndenumerate(a)], f"scene_id long, r long, c long, {n} double")
    got = RE.shift_estimate(rows(ref, "a"), rows(mov, "b"), ["scene_id"], cross_modal=False, search=4, refine=1).collect()[0]
    assert (got["dy"], got["dx"]) == (3.0, -2.0) and got["score"] > 0.8


def test_mutual_information_matches_a_dense_histogram(spark):
    rng = np.random.default_rng(17)
    a = rng.random(900)
    b = a + rng.normal(0, 0.1, 900)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b)], "scene_id long, a double, b double")
    hist = np.histogram2d(a, b, bins=32)[0] / 900
    px, py = hist.sum(1, keepdims=True), hist.sum(0, keepdims=True)
    want = (hist[hist > 0] * np.log2(hist[hist > 0] / (px @ py)[hist > 0])).sum()
    assert RE.mutual_information(df, ["scene_id"], "a", "b").collect()[0]["mi"] == pytest.approx(want, abs=1e-9)


def test_streamed_windows_drop_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    from swathline.streaming import jobs

    start = datetime(2024, 1, 1)
    schema = "ts timestamp, tool string, latency_ms double, threshold_method string"
    batches = [[start + timedelta(minutes=m) for m in (5, 20)], [start + timedelta(hours=9)], [start + timedelta(minutes=7)]]
    folder = str(tmp_path / "in")
    for times in batches:
        frame = spark.createDataFrame([(t, "index", 1.0, "otsu") for t in times], schema).coalesce(1)
        frame.write.mode("append").parquet(folder)
        # One run per arrival; the checkpoint carries the watermark from run to run.
        stream = jobs.prediction_stream(spark, folder, frame.schema, 1)
        jobs.run_to_table(jobs.latency_windows(stream), "update", str(tmp_path / "out"), str(tmp_path / "state"), ["window_start", "tool"])
    table = jobs.latest(spark.read.parquet(str(tmp_path / "out")), ["window_start", "tool"], ["steps"])
    # The third file is nine hours late, so the first window still counts two steps.
    assert {r["window_start"].hour: r["steps"] for r in table.collect()} == {0: 2, 9: 1}


def flooded(cells):
    """Label of every cell by plain flooding: the first cell of its region in reading order."""
    left, out = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        region, todo = [], [start]
        left.discard(start)
        while todo:
            r, c = todo.pop()
            region.append((r, c))
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in left:
                    left.discard(near)
                    todo.append(near)
        out |= dict.fromkeys(region, start[0] * RG.ROW_STRIDE + start[1])
    return out


@pytest.mark.parametrize("block", [128, 8, 5])
def test_regions_across_blocks(spark, block):
    """Noise, a spiral through all blocks, one region with nearly all pixels of its frame, and a NULL frame; no broadcast."""
    rng = np.random.default_rng(block)
    frames = {1: {(int(r), int(c)) for r, c in np.argwhere(rng.random((40, 40)) < 0.58)}, 2: {(r, c) for r in range(40) for c in range(40) if (r, c) != (20, 20)}}
    spiral, r, c, dr, dc, reach = set(), 0, 0, 0, 1, 40
    for turn in range(38):
        for _ in range(reach - 1):
            spiral.add((r, c))
            r, c = r + dr, c + dc
        dr, dc = dc, -dr
        reach -= 2 if turn > 1 and turn % 2 == 0 else 0
        if reach < 3:
            break
    frames |= {3: spiral, None: {(0, 0), (0, 1), (7, 7), (8, 7)}}
    hits = spark.createDataFrame([(k, r, c) for k, cells in frames.items() for r, c in cells], "k long, r long, c long").repartition(7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(x["k"], x["r"], x["c"]): x["label"] for x in RG.component_labels(hits, ["k"], block).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(k, *cell): label for k, cells in frames.items() for cell, label in flooded(cells).items()}


def test_a_mask_of_the_wrong_size_is_an_error(spark):
    from swathline.operators import tiles as TK

    cells = [(0, c // 2 * 2, r, c, (r + c) % 3 == 0, 2, 2) for r in range(2) for c in range(4)]
    schema = "row_off long, col_off long, r long, c long, hit boolean, h long, w long"
    frame = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(5)], "k long, r long, c long")
    whole = spark.createDataFrame(cells, schema).withColumn("k", F.lit(1))
    got = {(x["r"], x["c"]): x["hit"] for x in TK.mosaic_or(whole, frame, ["k"], ["k", "row_off", "col_off"]).collect()}
    assert got == {(r, c): c < 4 and (r + c) % 3 == 0 for r in range(2) for c in range(5)}
    short = whole.where("NOT (r = 1 AND c = 3)")
    with pytest.raises(Exception, match="tile 1, 0, 2 has a mask of 3 pixels, expected 4"):
        TK.mosaic_or(short, frame, ["k"], ["k", "row_off", "col_off"]).collect()
    assert TK.mosaic_or(whole.limit(0), frame, ["k"], ["k", "row_off", "col_off"]).where("hit").count() == 0


def test_strata_are_thinned_before_the_rounds(spark):
    """Replayed row by row: seeded order, thinning per stratum, tile and date, rows without a cell kept, one per round."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice(["a", "b", None]), f"t{i % 2}", *((int(x) for x in rng.integers(0, 9, 2)) if i % 7 else (None, None))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, country string, tile string, i long, j long")
    got = [(r["id"], r["place"]) for r in SM.stratified_round_robin(df, ["country"], 20, "s", "id", ["tile"], "i", "j").orderBy("place").collect()]
    named = df.withColumn("o", RK.seeded("s", F.coalesce("country", F.lit("unknown")), "id"))
    pools = defaultdict(list)
    kept = defaultdict(list)
    for r in sorted(named.collect(), key=lambda r: r["o"]):
        name = r["country"] or "unknown"
        near = any(max(abs(r["i"] - a), abs(r["j"] - b)) < 3 for a, b in kept[name, r["tile"]]) if r["i"] is not None else False
        if not near:
            pools[name].append(r["id"])
            if r["i"] is not None:
                kept[name, r["tile"]].append((r["i"], r["j"]))
    turns = [(k, name) for k in range(150) for name in sorted(pools) if k < len(pools[name])][:20]
    assert got == [(pools[name][k], place) for place, (k, name) in enumerate(turns, 1)]


def test_window_reads_few_row_groups(spark, tmp_path):
    """The bounds reach the scan, and the footers of the sorted table rule out nearly all row groups."""
    import glob

    import pyarrow.parquet as pq

    from swathline.sources import readers as RD
    from swathline.sources import writers as WR

    pixels = spark.range(2 * 400 * 400).selectExpr("id div 160000 AS scene_id", "id div 400 % 400 AS r", "id % 400 AS c", "CAST(hash(id) AS DOUBLE) AS red")
    WR.write_pixel_table(pixels.orderBy(F.rand(3)), ["scene_id"], str(tmp_path / "px"), row_group_bytes=64 << 10)
    window = RD.pixel_window(spark.read.parquet(str(tmp_path / "px")), 100, 30, 20, 50)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(window._jdf.queryExecution(), "formatted")
    assert all(f"{kind}({x}," in plan for kind in ("GreaterThanOrEqual", "LessThanOrEqual") for x in "rc")
    assert window.count() == 2 * 20 * 50
    groups, met = 0, 0
    for path in glob.glob(str(tmp_path / "px" / "*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i).statistics for i in range(meta.num_columns)}
            groups, met = groups + 1, met + (stats["r"].max >= 100 and stats["r"].min <= 119 and stats["c"].max >= 30 and stats["c"].min <= 79)
    assert groups >= 20 and met <= groups / 4


@pytest.mark.parametrize("size", [200_000, 40, 1])
def test_isotonic_by_ranges_equals_the_plain_walk(spark, size):
    """Rising, falling, flat and noisy stretches, ties, NULL scores; ranges of any size."""
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.random(300), np.linspace(1, 2, 60), np.linspace(2, 3, 60), [5.0] * 9]), 3)
    y = np.concatenate([(rng.random(300) < 0.3 + 0.4 * x[:300]).astype(float), np.linspace(1, 0, 60), np.linspace(0, 1, 60), rng.integers(0, 2, 9)])
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0)], "s double, y double")
    if size == 1:
        df, x, y = df.where("s BETWEEN 1.9 AND 2.2"), *(v[(x >= 1.9) & (x <= 2.2)] for v in (x, y))
    points = sorted((float(s), float(y[x == s].sum()), int((x == s).sum())) for s in set(x.tolist()))
    stack = []
    for s, t, w in points:
        stack.append([t, w, [s]])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] > stack[-1][0] / stack[-1][1]:
            t, w, own = stack.pop()
            stack[-1] = [stack[-1][0] + t, stack[-1][1] + w, stack[-1][2] + own]
    want = {s: t / w for t, w, own in stack for s in own}
    got = {r["score"]: r["fitted"] for r in CF.isotonic_fit(df, "s", "y", size).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_split_join_spreads_a_key_of_nearly_all_rows(spark):
    """One key holds 99 % of the rows; no partition of the joined rows gets more than its share of it."""
    from swathline.operators.joins import split_join

    rows = spark.range(20_000).selectExpr("id", "IF(id % 100 = 0, id % 700, 7) AS k")
    table = spark.range(600).selectExpr("id AS k", "id * 10 AS v", "IF(id = 7, 99, 1) AS w")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for n, value in zip(names, ("-1", "false", "16")):
        spark.conf.set(n, value)
    try:
        out = split_join(rows, table, ["k"], "w", heavy=3)
        got = {(r["id"], r["k"], r["v"]) for r in out.collect()}
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert got == {(i, k, k * 10) for i in range(20_000) if (k := i % 700 if i % 100 == 0 else 7) < 600}
    assert len(sizes) >= 9 and max(sizes) < 3 * 20_000 / 16


def test_caption_metrics_shuffle_sums_and_no_grams(spark, monkeypatch):
    """The vocabulary in slices gives the same scores, and no n-gram of a text passes an exchange."""
    import re

    from swathline.operators import scoring as SC

    rows = [(i, f"a b c{i % 5} d e f{i % 3} a b " * (1 + i % 4), f"a b c{i % 7} d e x{i % 4}") for i in range(60)]
    rows += [(60, "", "a b"), (61, None, "a b"), (62, "a b", None)]
    pairs = spark.createDataFrame(rows, "row_id long, p string, r string")
    whole = SC.cider_rows(pairs, "row_id", "p", "r")
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, " in plan and "strategy=broadcast" in plan
    want = {r["row_id"]: r["cider_d"] for r in whole.collect()}
    monkeypatch.setattr(SC, "VOCABULARY_ROWS", 20)
    got = {r["row_id"]: r["cider_d"] for r in SC.cider_rows(pairs, "row_id", "p", "r").collect()}
    assert got.keys() == want.keys() == set(range(63))
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and max(want.values()) > 0
    bleu = SC.corpus_bleu(pairs, "row_id", "p", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|Generate", bleu)


def test_caption_diversity_codes_grams_in_place(spark, capsys):
    texts = ["A b c d e", " a B c d\te ", "Ther Ther Ther Ther Ther", "", "one two three", "ÉTÉ été Été ÉTÉ x", "\n\tp q r s t u", None]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    split = [t.split() for t in texts * 3 if t is not None]
    grams = [tuple(w.lower() for w in s[i : i + 4]) for s in split for i in range(len(s) - 3)]
    openings = Counter(" ".join(s[:4]) for s in split)
    out = V.caption_diversity(rows, "text")
    r = out.first()
    assert r["distinct_4gram_ratio"] == round(len(set(grams)) / len(grams), 4)
    assert r["distinct_openings"] == len(openings) + 1 and r["captions"] == len(texts) * 3
    out.explain()
    assert "MapInArrow" in capsys.readouterr().out  # no gram is written out as text


def test_gram_codes_over_slices_and_rows(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 5, n).tolist() for n in (0, 3, 4, 50, 0, 17, 4, 1)]
    grams = {tuple(r[i : i + 4]) for r in rows for i in range(len(r) - 3)}
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(V, "GRAM_SLICE", size)
        for given, want in ((pa.array(rows, pa.list_(pa.int64())), grams), (pa.array([[1], []], pa.list_(pa.int64())), set()), (pa.array([], pa.list_(pa.int64())), set())):
            found = [pair for out in V.gram_codes(given) for pair in zip(*(c.to_pylist() for c in out.columns))]
            assert len(set(found)) == len(want) and len({a for a, _ in found}) == len(want)


def test_members_are_nested_whole_and_only_large_keys_are_ranked(spark):
    import hashlib

    from swathline.operators import joins as JO

    sizes = {1: 3, 2: 10, 3: 11, 4: 47, None: 25, 5: 1}
    rows = [(k, f"m{k}-{i}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, id string").repartition(5)
    parts = {}
    for r in JO.nest_in_parts(df, ["k"], F.sha2("id", 256), "id", F.struct("id"), 10).collect():
        assert (r["k"], r["part"]) not in parts
        parts[r["k"], r["part"]] = {x["id"] for x in r["items"]}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for k, n in sizes.items():
        ordered = sorted((x for j, x in rows if j == k), key=digest)
        want |= {(k, i // 10): set(ordered[i : i + 10]) for i in range(0, n, 10)}
    assert parts == want
    few = JO.nest_in_parts(df.where("k < 3"), ["k"], F.sha2("id", 256), "id", F.struct("id"), 10)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not any(word in plan for word in ("Window", "Join", "sha2"))
