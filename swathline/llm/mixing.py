"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import hash_share, sized, stored

#: Weights dealt to the sources in code point order, repeating; the mix's size as a share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words per source from ``(source, size)`` rows.

    Every source gets ``share`` of all words in proportion to its weight, stopped at ``most`` times its own size; what is cut
    off is shared again by weight among the rest. The fixed point is ``min(most * size, level * weight)`` for one level,
    which a sort by ``most * size / weight`` finds without rounds. The windows hold one row per source.

    NULL is a source of its own and comes last. A table without words has targets of 0; an empty one has no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.select(
        "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * F.lit(most)).alias("cap"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("total"),
    )
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / left)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    per = per.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def copies(rate: Column, key: Column, salt: str = "mix") -> Column:
    """``floor(rate)`` copies and one more with the probability of the fraction, drawn from ``key`` alone."""
    return (F.floor(rate) + F.when(hash_share(key, salt) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def repetition_plan(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **rule) -> DataFrame:
    """One row ``(key, size, source_size, target, copies)`` per row of ``docs``.

    Sizes are read off the texts once and stored; the text itself is never shuffled. Sources are summed map-side, and the
    table of sources goes to the documents by broadcast after its rows are counted, or by a shuffle beyond that size.
    Repeated rows, and rows with equal or NULL keys, are drawn alike. A source without words takes none.
    """
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")))
    targets = stored(source_targets(sizes, **rule)).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(sized(targets), F.col("source").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", copies(rate, F.col("key")).alias("copies"))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **rule) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they were.

    The copies are drawn from the key and the source's rate, so rows need no join by key, only the small table of rates.
    """
    sizes = docs.select(F.col(source).alias("source"), size.alias("size"))
    targets = stored(source_targets(sizes, **rule))
    rates = targets.select(
        F.col("source").alias("_mix_of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_mix_rate"),
    )
    joined = docs.join(sized(rates), docs[source].eqNullSafe(rates["_mix_of"]))
    often = F.array_repeat(F.lit(True), copies(rates["_mix_rate"], docs[key]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(often).alias("_mix_copy")).drop("_mix_copy")
