"""The paths taken when facts are too large to broadcast give the same rows."""

from __future__ import annotations

import pytest
from compare import compare, connect

from swathline.plans import load_all
from swathline.plans.registry import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = (
    "AGG02_exact_percentiles", "AGG03_threshold_with_gate", "PX12_composites", "FU08_fused_mask", "FU02_mutual_information",
    "NB03_edge_density", "RG01_connected_components", "SM05_quota_with_backfill", "SM10_holdout_by_group", "SC07_cider_d",
    "JN11_candidate_box_join", "FU10_change_answer", "QG11_qa_optsar",
)
OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
load_all()


@pytest.fixture()
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in OFF}
    for key, value in OFF.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_query_without_broadcast(shuffled, name):
    status, message = compare(shuffled, ENTRIES[name], SF_DIR, connect(SF_DIR))
    assert status == "ok", message


def test_hot_scene_spreads_over_tasks(shuffled):
    """One scene holding nearly all pixels is not left in one task by the salted join."""
    from pyspark.sql import functions as F

    from swathline.operators.joins import attach

    pixels = shuffled.range(40_000).select(F.when(F.col("id") % 100 > 0, 0).otherwise(F.col("id")).alias("scene_id"), F.col("id").alias("r"))
    facts = pixels.groupBy("scene_id").agg(F.max("r").alias("top"))
    joined = attach(pixels, facts, ["scene_id"])
    assert joined.count() == 40_000
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = joined.where("scene_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        shuffled.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1
