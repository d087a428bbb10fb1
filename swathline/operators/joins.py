"""Joins and nesting that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.ranking import dense_rank_rows, hash_bucket, null_safe_join
from swathline.session import stored

SALTS = 16
#: Most frequent keys that are told apart in ``split_join``: a bounded broadcast whatever the table.
HEAVY_KEYS = 2_000
PART_ROWS = 500


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows per key to one fact row per key.

    While the facts are small enough Spark broadcasts them. Beyond that a plain join would put a
    hot key in one task, and everything grouped by key after it as well; so the facts are
    repeated per salt and each row draws its salt from its own content, which is repeatable.
    NULL keys meet NULL keys, so no row is lost to them.
    """
    keys = list(keys)
    others = [f.name for f in rows.schema.fields if f.name not in keys and f.dataType.typeName() != "map"]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0)
    salts = F.array(*[F.lit(i) for i in range(SALTS if others else 1)])
    salted = rows.withColumn("_salt", salt)
    return null_safe_join(salted, facts.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def split_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, heavy: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of rows whose keys have very uneven frequencies with a table of one row per key.

    ``weight`` of the table says which keys are frequent. The ``heavy`` heaviest, a small broadcast, mark
    rows and table; marked table rows are repeated once per shuffle partition and marked rows spread over
    them by their content, while all other keys meet in one place. NULL keys meet nothing.
    """
    keys = list(keys)
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.broadcast(table.orderBy(F.col(weight).desc(), *keys).limit(heavy).select(*keys, F.lit(True).alias("_heavy")))
    others = [c for c in rows.columns if c not in keys]
    place = F.pmod(F.xxhash64(*others), F.lit(spread)).cast("int") if others else F.lit(0)
    left = rows.join(top, keys, "left").withColumn("_place", F.when(F.col("_heavy"), place).otherwise(0)).drop("_heavy")
    places = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(top, keys, "left").withColumn("_place", F.explode(places)).drop("_heavy")
    return left.join(right, [*keys, "_place"]).drop("_place")


def nest_in_parts(rows: DataFrame, keys: Sequence[str], order: Column, tie: str, item: Column, size: int = PART_ROWS) -> DataFrame:
    """``keys, part, items``: members nested at most ``size`` to a row, every member kept.

    Counts tell which keys need several parts. Only their members are ranked, by ``order`` and ``tie``; those of all
    other keys are brought together as they are, so that neither the order nor the tie is shuffled or sorted.
    """
    keys = list(keys)
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(*keys, F.lit(True).alias("_large")))
    nested = lambda some, part: some.groupBy(*keys, *part).agg(F.collect_list("_i").alias("items"))
    # Exchanged first: nesting shrinks nothing, and below the exchange it would sort a whole split of the input.
    whole = lambda some: nested(some.select(*keys, item.alias("_i")).repartition(*keys), []).select(*keys, F.lit(0).cast("long").alias("part"), "items")
    if large.isEmpty():
        return whole(rows)
    marked = attach(rows, large, keys, "left")
    members = marked.where("_large").select(*keys, order.alias("_o"), F.col(tie).alias("_t"), item.alias("_i"))
    ranked = dense_rank_rows(members, keys, ["_o", "_t"], hash_bucket(F.col("_o")), "_k")
    parts = nested(ranked.withColumn("part", F.floor((F.col("_k") - 1) / size)), ["part"])
    return whole(marked.where("_large IS NULL")).unionByName(parts)
