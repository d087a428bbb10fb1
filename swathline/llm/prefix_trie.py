"""The trie of conversation prefixes: digests of all prefixes, minimal perfect hash tables of the nodes, sums along parent slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import sized, stored, words_of
from swathline.operators.joins import attach
from swathline.operators.ranking import running_totals

#: A prefix's digest: three sums of 40-bit hashes of its turns, 120 bits. Sums stay exact for eight million turns.
LANES = ("d1", "d2", "d3")
ABOVE = ("p1", "p2", "p3")
LANE_BITS = 40
#: Nodes that one task's tables hold, about; member ids of one piece of a node's list of ends.
SHARD_NODES, ID_BLOCK = 400_000, 4_096
#: Turns that are summed in one step of a conversation's running digests.
TURN_BLOCK = 1_024
HEAD, EVERY, HASHES = 3, 20, 4


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys onto ``0 .. n - 1``.

    Level by level, the keys that are alone at their place of a bit vector have their slot there, by its rank; the others go on
    to the next level. ``slots`` of a key that isn't a member is -1 or any slot, so a hit is to be compared with what is stored.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        done = 0
        while len(keys):
            if len(self.levels) > 64:
                raise ValueError("keys are not distinct")
            size = 2 * len(keys)
            at = self.place(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, done + np.cumsum(alone) - 1, size))
            done += int(alone.sum())
            keys = keys[~alone[at]]
        self.size = done

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, ranks, size) in enumerate(self.levels):
            at = self.place(keys[left], level, size)
            hit = alone[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def key_of(lanes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key from the three lanes of digests."""
    a, b, c = (x.astype(np.uint64) for x in lanes)
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (c << np.uint64(23)) + (c >> np.uint64(41)))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, t1, t2, words)`` of the rebuilt conversations and ``(conv_id, turns)``, their number of turns.

    A text goes no further than the scan: ``t1`` and ``t2`` are 120 bits of its and its role's SHA-256.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part(1).alias("t1"), part(16).alias("t2"), words_of(text).alias("words")
    )
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**62)))
    ranked = stored(running_totals(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "t1", "t2"], block, {"rank": F.lit(1)}))
    heads = ranked.where((F.col("rank") <= HEAD) & (F.col("conv_id") % EVERY == 0))
    heads = heads.groupBy("conv_id").agg(F.collect_list(F.struct("rank", "t1", "t2", "words")).alias("head")).withColumnRenamed("conv_id", "donor")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HASHES).alias("h")
    convs = ranked.groupBy("conv_id").agg(F.max("rank").alias("own")).select("*", taken, (F.col("conv_id") - F.col("conv_id") % EVERY).alias("donor"))
    convs = convs.join(heads, "donor", "left").withColumn("head", F.expr("filter(coalesce(head, array()), x -> x.rank <= h)"))
    convs = stored(convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("given"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    first = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("rank").alias("depth"), "t1", "t2", "words")
    rest = attach(ranked.where("rank > 0"), convs.select("conv_id", "h", "given"), ["conv_id"]).where("rank > h")
    rest = rest.select("conv_id", (F.col("rank") - F.col("h") + F.col("given")).alias("depth"), "t1", "t2", "words")
    return first.union(rest), convs.select("conv_id", "turns")


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv_id, depth, turns, t1, t2, words, d1..d3, p1..p3)``: every prefix of every conversation with its own and its parent's
    digest; depth 0 is the root, whose digest is zero.

    A turn counts by hashes of its depth and content, so prefixes' digests are running sums, which no task needs whole
    conversations for.
    """
    lane = {d: F.expr(f"xxhash64({i}, depth, t1, t2) & {2**LANE_BITS - 1}L") for i, d in enumerate(LANES)}
    block = F.floor(F.col("depth") / TURN_BLOCK)
    rows = running_totals(turns, ["conv_id"], ["depth"], block, lane)
    rows = rows.select("*", *[(F.col(d) - lane[d]).alias(p) for d, p in zip(LANES, ABOVE)])
    rows = attach(rows, sizes, ["conv_id"])
    none = [F.lit(None).cast("long").alias(c) for c in ABOVE]
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "t1", "t2", "words", *LANES)]
    root = sizes.select("conv_id", "turns", *zero, *none)
    return rows.select("conv_id", "depth", "turns", "t1", "t2", "words", *LANES, *ABOVE).unionByName(root)


def checked(column: str) -> Column:
    """The one value that a node's prefixes must have; two prefixes of one digest that differ end the job."""
    differ = ~F.min(column).eqNullSafe(F.max(column))
    return F.when(differ, F.raise_error(F.lit(f"two prefixes share a digest: {column}")).cast("long")).otherwise(F.min(column))


def digests_of_ends(rows: DataFrame) -> DataFrame:
    """``(d1..d3, ends_sha256)`` of the nodes at which conversations end: their ids are joined in blocks, and a task streams a
    node's blocks in order through one SHA-256, however many there are."""
    ids = rows.where("depth = turns").groupBy(*LANES, F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    blocks = ids.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            lanes = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for at, ids in zip(lanes, batch.column(3).to_pylist()):
                if at != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield table(out)
        if node is not None:
            yield table([(*node, state.hexdigest())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[*LANES, "ends_sha256"])

    ordered = blocks.repartition(*LANES).sortWithinPartitions(*LANES, "block").select(*LANES, "ids")
    return ordered.mapInArrow(run, "d1 long, d2 long, d3 long, ends_sha256 string")


def summed_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a shard's nodes. ``n_children``, ``n_leaves`` and ``saved`` hold what nodes below other shards add.

    Each node has a slot of a minimal perfect hash; the digests stored at the slots tell whether a parent is here. Flat arrays
    are filled by slot, and each depth, the deepest first, is added to its parents' slots.
    """
    lanes = [rows[c].to_numpy(np.int64) for c in LANES]
    keys = key_of(lanes)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two nodes share a key")
    slots = PerfectHash(keys)
    at = slots.slots(keys)
    n = len(rows)
    here = [np.empty(n, dtype=np.int64) for _ in LANES]
    for own, lane in zip(here, lanes):
        own[at] = lane
    root = rows["p1"].isna().to_numpy()
    above = [rows[c].fillna(0).to_numpy(np.int64) for c in ABOVE]
    parent = slots.slots(key_of(above))
    found = (parent >= 0) & ~root
    for own, lane in zip(here, above):
        found &= own[np.maximum(parent, 0)] == lane
    parent = np.where(found, parent, -1)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[at] = values
        return out

    children, leaves, saved, up, depth, conv = (
        scattered(x) for x in (rows["n_children"].to_numpy(), rows["n_leaves"].to_numpy(), rows["saved"].to_numpy(), parent, rows["depth"].to_numpy(), rows["conv_id"].to_numpy())
    )
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts) if n else []:
        leaves[level] += children[level] == 0
        level = level[up[level] >= 0]
        np.add.at(children, up[level], 1)
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    out = rows[[*LANES, *ABOVE, "conv_id", "depth", "n_convs"]].copy()
    out["n_children"], out["n_leaves"], out["saved"] = children[at], leaves[at], saved[at]
    inside = up[at] >= 0
    out["parent_conv_id"] = pd.array(np.where(inside, conv[np.maximum(up[at], 0)], 0), dtype="Int64")
    out.loc[~inside, "parent_conv_id"] = pd.NA
    return out


SUMMED = "d1 long, d2 long, d3 long, p1 long, p2 long, p3 long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, parent_conv_id long"


def summed(nodes: DataFrame, shard: Column) -> DataFrame:
    """Subtree sums of ``nodes`` inside their shards; written, as what is above reads them again."""
    return stored(nodes.withColumn("shard", shard).groupBy("shard").applyInPandas(summed_in_shard, SUMMED))


def passed_up(below: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``below`` with the parents that lie in ``above``, and ``above`` with the sums of those children."""
    tops = below.where("parent_conv_id IS NULL AND p1 IS NOT NULL")
    add = tops.groupBy(*ABOVE).agg(F.count("*").alias("a1"), F.sum("n_leaves").alias("a2"), F.sum("saved").alias("a3"))
    more = above.join(add.withColumnsRenamed(dict(zip(ABOVE, LANES))), list(LANES), "left")
    for name, part in (("n_children", "a1"), ("n_leaves", "a2"), ("saved", "a3")):
        more = more.withColumn(name, F.col(name) + F.coalesce(part, F.lit(0)))
    parents = above.select(*[F.col(d).alias(p) for d, p in zip(LANES, ABOVE)], F.col("conv_id").alias("_parent"))
    named = tops.drop("parent_conv_id").join(parents, list(ABOVE), "left").withColumnRenamed("_parent", "parent_conv_id")
    others = below.where("parent_conv_id IS NOT NULL OR p1 IS NULL")
    return others.unionByName(named), stored(more.select(*above.columns))


def subtree_sums(nodes: DataFrame, rows: DataFrame, shard_nodes: int) -> DataFrame:
    """``nodes`` with the sums over their subtrees and their parents' ``conv_id``.

    Nodes that more than a quarter of ``shard_nodes`` prefixes pass are the crown, a connected top part. Below it, subtrees are
    dealt whole to shards: a node's subtree is that of the first node outside the crown on the path of its smallest member.
    The crown follows, in one shard, or where it is larger in bands of depth from the deepest on, as only conversations of
    very many turns make it.
    """
    total = nodes.count()
    if total <= shard_nodes:
        return summed(nodes, F.lit(0))
    crown = stored(nodes.where(F.col("mass") > shard_nodes // 4))
    inside = sized(crown.select(*LANES, F.lit(True).alias("_crown")))
    paths = rows.join(inside, list(LANES), "left").where("_crown IS NULL").groupBy("conv_id")
    tops = paths.agg(F.min_by(F.xxhash64(*LANES), "depth").alias("top"))
    outside = attach(nodes.join(inside.select(*LANES), list(LANES), "left_anti"), tops, ["conv_id"])
    shards = max(1, -(-total // (shard_nodes // 4)))
    done = [summed(outside, F.pmod("top", F.lit(shards)))]
    below, crown = passed_up(done[0], crown)
    done = [below]
    left, deepest = crown.agg(F.count("*"), F.max("depth")).first()
    if left <= shard_nodes:
        return below.union(summed(crown, F.lit(0)))
    width = max(1, shard_nodes * (deepest + 1) // left)
    heads = rows.where(F.col("depth") % width == 0).select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.xxhash64(*LANES).alias("_top"))
    for band in range(deepest // width, -1, -1):
        mine = crown.where(F.floor(F.col("depth") / width) == band)
        rest = crown.where(F.floor(F.col("depth") / width) < band)
        tops = heads.where(F.col("_d") == band * width).select(F.col("_c").alias("conv_id"), "_top")
        part = summed(attach(mine, tops, ["conv_id"]), F.pmod("_top", F.lit(shards)))
        part, crown = passed_up(part, rest)
        done.append(part)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``conversations(conv_id, turn, role, text)``; other columns are not read. Turns are ordered by ``turn``, NULL first, turns of
    one number by a hash of role and text; repeated rows are turns of their own. NULL role and text are empty. Rows without a
    ``conv_id`` belong to no conversation. Without conversations there is no node, not even a root.
    """
    turns, sizes = rebuilt(conversations)
    rows = stored(prefixes(stored(turns), sizes))
    own = [checked(c).alias(c) for c in ("depth", "t1", "t2", "words", *ABOVE)]
    mass = F.sum(F.col("turns") - F.col("depth") + 1).alias("mass")
    nodes = rows.groupBy(*LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), mass, *own)
    zero = F.lit(0).cast("long")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    nodes = stored(nodes.select(*LANES, *ABOVE, "conv_id", "depth", "n_convs", "mass", zero.alias("n_children"), zero.alias("n_leaves"), saved))
    sums = subtree_sums(nodes, rows, shard_nodes)
    ends = digests_of_ends(rows)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return sums.join(ends, list(LANES), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
