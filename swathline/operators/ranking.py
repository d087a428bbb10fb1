"""Seeded order and ranks that no single task has to hold.

A shuffle with a seed becomes an order by ``sha2(seed | key)``: independent of partitioning and
repeatable after executor loss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: str | int, *keys: Column | str) -> Column:
    """Deterministic pseudo-random sort key."""
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def hash_bucket(order: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a hex digest: its leading digits."""
    return F.substring(order, 1, digits)


def dense_rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "rank"
) -> DataFrame:
    """``row_number`` within ``keys`` by ``order`` for groups of any size: a running count of ones."""
    return running_totals(df, keys, order, bucket, {name: F.lit(1)})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, name: str = "rank") -> DataFrame:
    """At most ``limit`` rows per key. The literal bound lets Spark cut every map task to
    ``limit`` rows per key before the shuffle, so a hot key never travels whole."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= limit)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet; the left side's keys are kept."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_k_{k}"]) for k in keys])
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums within ``keys`` by ``order`` that no single task has to hold.

    ``bucket`` must be non-decreasing along ``order``. Bucket sums are prefix-summed (one small row
    per bucket) and rows are accumulated inside their bucket only.
    """
    keys, names = list(keys), list(values)
    # Exchanged on (keys, bucket) explicitly: an input already hashed by key alone would keep a
    # hot key in one task.
    parts = df.withColumn("_bucket", bucket).repartition(*keys, "_bucket")
    for name, value in values.items():
        parts = parts.withColumn(f"_v_{name}", value)
    upto = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    offsets = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in names])
    within = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = parts.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_r_{n}") for n in names])
    joined = null_safe_join(summed, offsets, [*keys, "_bucket"])
    totals = [(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    return joined.select(*df.columns, *totals)
