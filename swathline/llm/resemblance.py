"""Near-duplicates by Jaccard similarity of word shingles: candidates from SimHash fingerprints linked by BK-trees and, for pairs
beyond their radius, from MinHash bands, each confirmed on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import sized, stored, unused
from swathline.llm.graph import components
from swathline.llm.simhash import NO_ID, bits_of, links, one_of_each
from swathline.session import cut_lineage

WORDS, LEAST, SEED = 5, 0.8, 42
#: A pair at Jaccard 0.8 shares none of the bands with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-5.
BANDS, ROWS = 20, 4
#: Sets of a bucket that are compared in one place; beyond, it is dealt in blocks, and each pair of blocks is compared.
BLOCK = 4096

_draw = np.random.default_rng(SEED)
TIMES = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words where there are fewer than ``words``."""
    # bytes.lower and bytes.split know A-Z and the six ASCII white spaces only, as in SimHash.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    found = zip(*(parts[i:] for i in range(words))) if len(parts) > words else [parts]
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in found), dtype=np.uint64))


def name_of(own: np.ndarray) -> int:
    """A hash of a whole set as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def bands_of(own: np.ndarray) -> np.ndarray:
    """Hashes of the set's bands of least values, none for an empty set."""
    if not len(own):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 4096):
        np.minimum(least, (own[None, at : at + 4096] * TIMES[:, None] + PLUS[:, None]).min(axis=1), out=least)
    digests = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, dtype=np.uint64).view(np.int64)


def fingerprint_of(own: np.ndarray) -> int:
    """SimHash of a set as a signed long; 0 for an empty one."""
    return int(np.uint64(bits_of(own.astype(">u8"))).view(np.int64)) if len(own) else 0


def fingerprint_buckets(nodes: DataFrame) -> DataFrame:
    """``(name, first, band, value)``: nodes whose fingerprints are linked meet in one bucket; the band is one past MinHash's."""
    roots = components(links(nodes.select("fp").distinct()).select("u", "v")).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left")
    return joined.select("name", "first", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("value"))


def set_name(text, words: int = WORDS):
    """Name of a text column's shingle set; equal sets have equal names."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([name_of(shingles(t, words)) for t in texts], dtype="int64")

    return run(text)


def alike(names: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links of sets with a Jaccard similarity of ``least`` or more, without those that only close a ring."""
    size = np.array([len(s) for s in sets])
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(of, kind="stable")]
    ends = np.r_[0, np.cumsum(np.bincount(of))]
    found, root = [], list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(1, len(sets)):
        # Holders are in order, so those before ``a`` are the sets already read.
        lists = [holders[ends[i] : ends[i + 1]] for i in of[starts[a] : starts[a + 1]]]
        both = np.bincount(np.concatenate(lists), minlength=len(sets))[:a]
        for b in np.flatnonzero(both >= least * (size[a] + size[:a] - both) - 1e-9).tolist():
            low, high = sorted((top(a), top(b)))
            if low != high:
                root[high] = low
                found.append((names[b], names[a]))
    return found


def bucket_links(rows: DataFrame, least: float) -> DataFrame:
    """``(u, v)`` of every pair in a ``place`` that is alike; ``rows(place, name, hashes)``, a task holds one place at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, names, sets = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for at, name, hashes in zip(batch["place"], batch["name"], batch["hashes"]):
                if at != place:
                    out += alike(names, sets, least) if len(sets) > 1 else []
                    place, names, sets = at, [], []
                names.append(name)
                sets.append(np.frombuffer(hashes, dtype=np.uint64))
            yield frame(out)
        yield frame(alike(names, sets, least) if len(sets) > 1 else [])

    def frame(out: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["u", "v"])

    return rows.repartition("place").sortWithinPartitions("place", "name").mapInPandas(run, "u long, v long")


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, block: int = BLOCK
) -> DataFrame:
    """``(key, fp, component_id, root)`` per row of ``docs``: components of texts whose shingle sets are alike, named by their
    smallest key; ``fp`` names the set.

    Texts with equal sets are one node. Nodes whose SimHash fingerprints are linked meet in a bucket, as do nodes that share a
    MinHash band, as a pair at ``least`` is often beyond the fingerprints' radius; buckets of the same nodes are one. Only the
    texts of nodes that meet another are read again, for their sets, and every pair of a bucket is compared on them.
    NULL keys count as larger than all others. Texts without words are one node.
    """

    @F.pandas_udf("name long, fp long, bands array<long>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, words) for t in texts]
            made = {"name": [name_of(s) for s in sets], "fp": [fingerprint_of(s) for s in sets], "bands": [bands_of(s) for s in sets]}
            yield pd.DataFrame(made, columns=["name", "fp", "bands"])

    @F.pandas_udf("name long, hashes binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame({"name": [name_of(s) for s in sets], "hashes": [s.tobytes() for s in sets]}, columns=["name", "hashes"])

    own = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    marks = stored(docs.select(own.alias("id"), signature(F.col(text)).alias("_s")).select("id", "_s.name", "_s.fp", "_s.bands"))
    nodes = stored(marks.groupBy("name").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    met = nodes.select("name", "first", F.posexplode("bands").alias("band", "value")).unionByName(stored(fingerprint_buckets(nodes)))
    many = met.groupBy("band", "value").agg(F.count("*").alias("n"), F.bit_xor("name").alias("x"), F.bit_xor(F.xxhash64("name")).alias("y"))
    # Bands in which the same nodes meet are one bucket.
    buckets = many.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "value")).alias("b"))
    buckets = sized(stored(buckets.select("n", "b.band", "b.value")))
    members = stored(met.join(buckets, ["band", "value"]))
    # A NULL key is NO_ID here as there, so its rows are found as well; rows of one key are told apart by their names.
    wanted = sized(stored(members.select(F.col("first").alias("_first"), F.col("name").alias("_name")).distinct()))
    met_key = unused(docs, "_first")
    again = docs.join(sized(wanted.select(F.col("_first").alias(met_key)).distinct()), own == F.col(met_key), "left_semi")
    sets = again.select(whole(F.col(text)).alias("_s")).select("_s.name", "_s.hashes")
    sets = sets.join(wanted, sets["name"] == wanted["_name"], "left_semi").groupBy("name").agg(F.first("hashes").alias("hashes"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine, other = F.pmod(F.xxhash64("name"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.select("name", "band", "value", mine.alias("i"), other.alias("j"))
    place = F.concat_ws(":", "band", "value", F.least("i", "j"), F.greatest("i", "j")).alias("place")
    confirmed = cut_lineage(bucket_links(dealt.select("name", place).join(sets, "name"), least).distinct())
    roots = components(confirmed)
    named = nodes.select("name", "first").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    out = marks.select("id", "name").join(named.select("name", "root").join(firsts, "root"), "name")
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(shown("id").alias(key), F.col("name").alias("fp"), shown("component").alias("component_id"), "root")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, **how) -> DataFrame:
    """``docs`` with one row of each component of ``similar``, that of the smallest key; columns as they were."""
    return one_of_each(docs, similar(docs, key, text, words, **how), set_name(F.col(text), words), key)
