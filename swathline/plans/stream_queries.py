"""Streaming jobs fed from files derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.plans.registry import query
from swathline.plans.source_queries import scratch
from swathline.plans.text_queries import normalise_sql
from swathline.plans.views import ctes
from swathline.streaming import jobs as ST

col = F.col


@query(
    "ST01_running_scoreboard",
    ctes("qa", "pred") + f"SELECT q.question_type, count(*) AS n, count(*) FILTER ({normalise_sql('p.prediction')} = {normalise_sql('q.answer')}) AS correct FROM qa q JOIN pred p USING (sample_id) GROUP BY q.question_type",
)
def st01(v):
    """Prediction files arrive; the newest state per type after the drain equals the batch score."""
    rows = v.qa.select("sample_id", "question_type", "answer").join(v.pred.select("sample_id", "prediction"), "sample_id")
    rows = rows.join(v.orders.select(col("o_orderkey").alias("sample_id"), col("o_orderdate").cast("timestamp").alias("arrived")), "sample_id")
    folder, out, state = scratch(v, "arrivals"), scratch(v, "scoreboard"), scratch(v, "state")
    rows.repartition(4).write.parquet(folder)
    # All rows count: the watermark only bounds state, and the key has no event time.
    board = ST.running_scoreboard(ST.prediction_stream(v.spark, folder, rows.schema, 2), "arrived", "3650 days")
    ST.run_to_table(board, "update", out, state, ["question_type"])
    return ST.latest(v.spark.read.parquet(out), ["question_type"], ["n", "correct"])


@query(
    "ST02_trace_latency_windows",
    ctes("trace_steps") + "SELECT date_trunc('hour', ts) AS window_start, tool, count(*) AS steps, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(CASE WHEN threshold_method = 'fixed_fallback' THEN 1.0 ELSE 0.0 END), 6) AS fallback_share FROM trace_steps GROUP BY 1, 2",
)
def st02(v):
    """A replay in several triggers: files come in any order, so lateness covers the backlog and every step counts."""
    folder, out, state = scratch(v, "steps"), scratch(v, "windows"), scratch(v, "wstate")
    steps = v.trace_steps.withColumn("ts", col("ts").cast("timestamp"))
    steps.repartition(6).write.parquet(folder)
    span = steps.agg(F.coalesce(F.datediff(F.max("ts"), F.min("ts")), F.lit(0))).first()[0]
    stream = ST.prediction_stream(v.spark, folder, steps.schema, 2)
    ST.run_to_table(ST.latency_windows(stream, lateness=f"{span + 1} days"), "update", out, state, ["window_start", "tool"])
    newest = ST.latest(v.spark.read.parquet(out), ["window_start", "tool"], ["steps", "mean_latency_ms", "fallback_share"])
    newest = newest.withColumn("window_start", col("window_start").cast("timestamp_ntz"))
    return newest.withColumn("mean_latency_ms", F.round("mean_latency_ms", 6)).withColumn("fallback_share", F.round("fallback_share", 6))
