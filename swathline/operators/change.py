"""Change between dates of persistently identified objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline import config as C
from swathline.operators.joins import attach
from swathline.session import cut_lineage


def id_set_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on ``keys`` -> ``status`` appeared / demolished / persisted."""
    left = before.select(*keys, F.lit(True).alias("_was"))
    right = after.select(*keys, F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "appeared").when(F.col("_is").isNull(), "demolished").otherwise("persisted")
    return left.join(right, list(keys), "full_outer").select(*keys, status.alias("status"))


def date_pairs(dates: DataFrame, group: str, time: str, max_gap: int | None = None) -> DataFrame:
    """All date pairs a < b of a group. A group has as many rows as its calendar has dates."""
    a = dates.select(group, F.col(time).alias("first")).distinct()
    b = dates.select(group, F.col(time).alias("second")).distinct()
    pairs = a.join(b, group).where(F.col("first") < F.col("second"))
    if max_gap is not None:
        pairs = pairs.where(F.col("second") - F.col("first") <= max_gap)
    return pairs


def magnitude_band(count: Column) -> Column:
    ladder = None
    for ceiling, label in C.MAGNITUDE_BANDS:
        step = count <= ceiling
        ladder = F.when(step, label) if ladder is None else ladder.when(step, label)
    return ladder.otherwise(C.MAGNITUDE_TOP)


def compass_side(n: Column, frame_n: Column, north: Column, east: Column) -> Column:
    """Compass half holding at least 65 % of ``n`` points; better axis wins, north-south on a tie."""
    ns = F.try_divide(F.greatest(north, n - north), n)
    ew = F.try_divide(F.greatest(east, n - east), n)
    ns_label = F.when(north >= n - north, "north").otherwise("south")
    ew_label = F.when(east >= n - east, "east").otherwise("west")
    enough = (n >= C.CLUSTER_MIN_POINTS) & (frame_n >= C.CLUSTER_MIN_POINTS)
    ns_ok, ew_ok = ns >= C.CLUSTER_MIN_SHARE, ew >= C.CLUSTER_MIN_SHARE
    return F.when(enough & ns_ok & (~ew_ok | (ns >= ew)), ns_label).when(enough & ew_ok, ew_label)


def presence_patterns(objects: DataFrame, calendar: DataFrame, group: str, time: str, obj: str) -> DataFrame:
    """``group, pattern, n``: how many objects of a group share a presence pattern.

    A pattern has one small number per date of the group's calendar: 0 where the object is absent, else
    1, plus 2 on the northern and 4 on the eastern side of that date's frame. Objects are counted by
    pattern map-side, before any pair of dates is formed.
    """
    presence = objects.groupBy(group, obj).agg(F.collect_set(time).alias("present"), F.min("x").alias("x"), F.min("y").alias("y"))
    dated = attach(presence, calendar, [group])
    flags = lambda d: 1 + 2 * (F.col("y") >= d["mid_y"]).cast("int") + 4 * (F.col("x") >= d["mid_x"]).cast("int")
    pattern = F.transform("days", lambda d: F.when(F.array_contains(F.col("present"), d[time]), flags(d)).otherwise(0).cast("byte"))
    return dated.select(group, pattern.alias("pattern")).groupBy(group, "pattern").agg(F.count("*").alias("n"))


def pair_statistics(objects: DataFrame, group: str, time: str, obj: str) -> DataFrame:
    """Counts for every *ordered* date pair of a group.

    Each object is shuffled once, as the set of dates it is present at (bounded by the calendar), and
    counted with those of its presence pattern; only patterns are set against pairs of dates, and
    their votes are combined map-side. The calendar goes to objects and patterns salted, so a group
    that holds most of the objects is many even pieces. Columns: ``group, first, second, total_first,
    total_second, appeared, demolished, north, east``.
    """
    frames = cut_lineage(objects.groupBy(group, time).agg(
        F.count("*").alias("total"),
        ((F.min("x") + F.max("x")) / 2).alias("mid_x"),
        ((F.min("y") + F.max("y")) / 2).alias("mid_y"),
    ))
    calendar = frames.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(time, "mid_x", "mid_y"))).alias("days"))
    patterns = attach(presence_patterns(objects, calendar, group, time, obj), calendar.select(group, F.col(f"days.{time}").alias("dates")), [group])
    there = patterns.select(group, "n", "pattern", "dates", F.posexplode("pattern").alias("_j", "_s")).where("_s > 0")
    pairs = there.select(group, "n", "dates", "_s", F.get("dates", F.col("_j")).alias("second"), F.posexplode("pattern").alias("_i", "_f")).where("_f = 0")
    votes = pairs.groupBy(group, F.get("dates", F.col("_i")).alias("first"), "second").agg(
        F.sum("n").alias("appeared"),
        F.sum(F.when(F.col("_s").bitwiseAND(2) > 0, F.col("n")).otherwise(0)).alias("north"),
        F.sum(F.when(F.col("_s").bitwiseAND(4) > 0, F.col("n")).otherwise(0)).alias("east"),
    )
    side = lambda name: frames.select(group, F.col(time).alias(name), F.col("total").alias(f"total_{name}"))
    ordered = side("first").join(side("second"), group).where(F.col("first") != F.col("second"))
    gone = votes.select(group, F.col("first").alias("second"), F.col("second").alias("first"), F.col("appeared").alias("demolished"))
    zero = {name: 0 for name in ("appeared", "north", "east", "demolished")}
    return (
        ordered.join(votes, [group, "first", "second"], "left")
        .join(gone, [group, "first", "second"], "left")
        .fillna(zero)
    )


def change_answers(stats: DataFrame) -> dict[str, Column]:
    """The eight answerable operations as columns over :func:`pair_statistics`."""
    yes_no = lambda c: F.when(c > 0, "yes").otherwise("no")
    before, after = F.col("total_first"), F.col("total_second")
    appeared, demolished = F.col("appeared"), F.col("demolished")
    return {
        "presence_appeared": yes_no(appeared),
        "presence_demolished": yes_no(demolished),
        "count_appeared": appeared.cast("string"),
        "count_demolished": demolished.cast("string"),
        "compare": F.when(after > before, "second").when(after < before, "first"),
        "direction": F.when(after > before, "increased").when(after < before, "decreased").otherwise("unchanged"),
        "magnitude": magnitude_band(appeared),
        "where": compass_side(appeared, after, F.col("north"), F.col("east")),
    }


def abstention_score(rows: DataFrame, kind: str) -> DataFrame:
    """Answered, abstained and unrouted rows, accuracy on answered and on all, per type.

    ``rows`` has ``operation`` (NULL when unrouted), ``said`` (NULL when abstained) and ``answer``.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    routed, said = F.col("operation").isNotNull(), F.col("said").isNotNull()
    right = n(routed & (F.col("said") == F.col("answer")))
    return rows.groupBy(kind).agg(
        F.count("*").alias("rows"), n(routed & said).alias("answered"), n(routed & ~said).alias("abstained"), n(~routed).alias("unrouted"),
        F.round(F.coalesce(F.try_divide(right, n(routed & said)), F.lit(0.0)), 4).alias("accuracy_answered"),
        F.round(right / F.count("*"), 4).alias("accuracy_all_rows"),
    )


def metadata_compare(subset: DataFrame, official: DataFrame) -> DataFrame:
    """Row counts and shared columns of a subset against the official table."""
    shared = ",".join(sorted(set(subset.columns) & set(official.columns)))
    counts = subset.agg(F.count("*").alias("subset_rows")).crossJoin(official.agg(F.count("*").alias("official_rows")))
    return counts.select("subset_rows", "official_rows", F.lit(shared).alias("shared_columns"), (F.col("subset_rows") == F.col("official_rows")).alias("identical_row_count"))
