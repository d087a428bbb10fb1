"""Near-duplicates by SimHash: BK-trees over pigeonhole shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.llm.common import sized, stored, unused
from swathline.llm.graph import components
from swathline.session import cut_lineage

WORDS, RADIUS, SEED = 3, 2, 42
#: A shard of more fingerprints is cut by further bits.
SHARD = 4096
NO_ID = 2**63 - 1


def simhash(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words. A bit is 1 if set in over half the hashes."""
    # bytes.lower and bytes.split know A-Z and the six ASCII white spaces only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(parts[i:] for i in range(words))) if len(parts) > words else [parts]
    return bits_of(np.array([digest(b" ".join(s), SEED) for s in shingles], dtype=">u8"))


def bits_of(hashes: np.ndarray) -> int:
    """Fingerprint of big-endian hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """SimHash of a text column as a signed long."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


class BKTree:
    """A tree over fingerprints: a node's children are keyed by their Hamming distance to it."""

    def __init__(self, value: int) -> None:
        self.values = [value]
        self.children: list[dict[int, int]] = [{}]

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius``; by the triangle inequality only edges within it of the distance can lead to one."""
        found, open_nodes = [], [0]
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.children[node]
            for step in range(distance - radius, distance + radius + 1):
                if step in edges:
                    open_nodes.append(edges[step])
        return found

    def add(self, value: int) -> None:
        node = 0
        while True:
            step = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(step)
            if below is None:
                self.children[node][step] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            node = below


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within ``radius`` among distinct ``values``, without those that only close a ring."""
    tree, links, root = BKTree(values[0]), [], [0]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values[1:], 1):
        root.append(i)
        for j in tree.near(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((values[j], value))
        tree.add(value)
    return links


def masks(free: int, blocks: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` out of ``blocks`` nearly equal cuts of the bits set in ``free``."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [sum(1 << b for b in part) for part in (bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks))]
    return [sum(choice) for choice in combinations(cuts, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(nodes: DataFrame, choices: list[int]) -> DataFrame:
    """One row ``(fp, mask, key)`` per fingerprint and mask; fingerprints that agree under a mask share a key."""
    options = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in choices])
    return nodes.select("fp", F.inline(options))


def shard_links(rows: DataFrame, radius: int) -> DataFrame:
    """``(u, v)`` links found by one BK-tree for each shard ``(mask, key)``; a task holds one shard at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            mask, key, fp = (batch[c].to_numpy() for c in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            held = batch.iloc[starts[-1] :]
            yield linked(fp, starts)
        if held is not None:
            yield linked(held["fp"].to_numpy(), np.array([0, len(held)]))

    def linked(fp: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(np.diff(starts) > 1):
            links += forest([x & (2**64 - 1) for x in fp[starts[i] : starts[i + 1]].tolist()], radius)
        return pd.DataFrame(np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(run, "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links that connect all distinct ``nodes(fp)`` within ``radius`` (at most 2) just as all close pairs would.

    Two fingerprints within 2 bits agree in two of four 16-bit blocks, so each goes to six shards of those that agree with it
    in two blocks. A shard of over ``shard`` fingerprints is cut anew: of its free bits, partners agree in one of three cuts.
    After two such steps at most 2^15 distinct fingerprints can share a shard, whatever the data. Shards are sized by a
    map-side count; each is one BK-tree, built where the shuffle brings it, and searched by its own members alone.
    """
    if radius > 2:
        raise ValueError("the shards hold pairs within 2 bits")
    found = []
    level = {signed(m): None for m in masks(2**64 - 1, 4, 2)}
    rows = keyed(nodes, [m & (2**64 - 1) for m in level])
    for last in (False, False, True):
        big = None if last else cut_lineage(rows.groupBy("mask", "key").count().where(F.col("count") > shard).select("mask", "key"))
        if last or big.isEmpty():
            found.append(shard_links(rows, radius))
            break
        big = sized(big)
        found.append(shard_links(rows.join(big, ["mask", "key"], "left_anti"), radius))
        rows = cut_lineage(rows.join(big, ["mask", "key"], "left_semi"))
        cuts = {m: masks(~m & (2**64 - 1), 3, 1) for m in (x & (2**64 - 1) for x in level)}
        options = None
        for m, extra in cuts.items():
            finer = F.array(*[F.lit(signed(m | e)) for e in extra])
            options = F.when(F.col("mask") == signed(m), finer) if options is None else options.when(F.col("mask") == signed(m), finer)
        level = {signed(m | e): None for m, extra in cuts.items() for e in extra}
        rows = rows.select("fp", F.explode(options).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(key, fp, component_id)`` per row of ``docs``; the component is named by its smallest key.

    Texts are read once; from then on only keys and fingerprints move. Copies of a text meet in one fingerprint before any
    search. Rows without words have fingerprint 0. A NULL key counts as larger than all others, so it names a component only
    where there is no other (as NULL). Repeated rows are repeated in the result.
    """
    marks = stored(docs.select(F.col(key).cast("long").alias("id"), fingerprint(F.col(text), words).alias("fp")))
    nodes = cut_lineage(marks.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("first")))
    roots = components(links(nodes.select("fp"), radius).select("u", "v"))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    out = marks.join(named.select("fp", "root").join(firsts, "root"), "fp")
    component = F.when(F.col("component") < NO_ID, F.col("component"))
    return out.select(F.col("id").alias(key), "fp", component.alias("component_id"), "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key; columns as they were."""
    return one_of_each(docs, near_duplicates(docs, key, text, **how), fingerprint(F.col(text), how.get("words", WORDS)), key)


def one_of_each(docs: DataFrame, marks: DataFrame, fp: Column, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of ``marks(key, fp, component_id, root)``; ``fp`` is worked out again where needed.

    The rows that go are found on keys alone and taken out by an anti-join whose side is broadcast if it is counted small.
    Rows that share a key are told apart by their fingerprints, and identical ones are reduced to one.
    """
    marks = stored(marks)
    own, lead = F.coalesce(F.col(key), F.lit(NO_ID)), F.coalesce(F.col("component_id"), F.lit(NO_ID))
    marks = marks.select(own.alias("_id"), "fp", "root", lead.alias("_lead"))
    often = cut_lineage(marks.groupBy("_id").count().where("count > 1").select("_id"))
    gone = marks.where("_id <> _lead").select("_id").union(often)
    docs_id, other = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), unused(docs, "_gone")
    left = docs.join(sized(gone.withColumnRenamed("_id", other)), docs_id == F.col(other), "left_anti")
    if often.isEmpty():
        return left
    # Keys of several rows: those rows are looked up by key and fingerprint, and the least row of a component stays.
    again = docs.join(sized(often.withColumnRenamed("_id", other)), docs_id == F.col(other), "left_semi")
    again = again.select(F.struct("*").alias("_row"), docs_id.alias("_id"), fp.alias("fp"))
    leads = marks.where("_id = _lead").join(sized(often), "_id", "left_semi").select("_id", "fp", "root").distinct()
    return left.unionByName(again.join(leads, ["_id", "fp"]).groupBy("root").agg(F.min("_row").alias("_row")).select("_row.*"))
