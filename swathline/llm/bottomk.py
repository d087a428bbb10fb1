"""Bottom-k sketches of documents' word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import stored

WORDS, K, SEED = 5, 128, 42
#: Rows of a bucket of neighbouring keys, about, and most buckets (16 MB of bounds); a task holds two documents at a time.
BUCKET_ROWS, BUCKETS = 5_000, 1_000_000
NO_KEY = -(2**63)


class Sketch:
    """The ``k`` smallest distinct shingle hashes of a text. Sketches of parts merge into that of the whole's shingles."""

    __slots__ = ("hashes", "k")

    def __init__(self, hashes: np.ndarray, k: int = K) -> None:
        self.hashes, self.k = hashes, k

    @classmethod
    def of(cls, text: str | None, words: int = WORDS, k: int = K) -> Sketch:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return cls(np.empty(0, dtype=np.uint64), k)
        digest = xxhash.xxh64_intdigest
        shingles = zip(*(parts[i:] for i in range(words))) if len(parts) > words else [parts]
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype=np.uint64)
        return cls(cls.least(hashes, k), k)

    @staticmethod
    def least(hashes: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` smallest distinct hashes; only as many are sorted as hold them."""
        most = 4 * k
        while len(hashes) > most:
            part = np.unique(np.partition(hashes, most)[: most + 1])
            if len(part) >= k or most >= len(hashes):
                return part[:k]
            most *= 4
        return np.unique(hashes)[:k]

    def merge(self, other: Sketch) -> Sketch:
        k = min(self.k, other.k)
        return Sketch(np.union1d(self.hashes, other.hashes)[:k], k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles: exact below ``k``, else from the largest hash kept."""
        n = len(self.hashes)
        return float(n) if n < self.k else (n - 1) / (float(self.hashes[-1]) / 2.0**64)

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard similarity: the share of the union's sketch that both hold. Two empty sketches are alike."""
        union = self.merge(other).hashes
        if not len(union):
            return 1.0
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.isin(union, both, assume_unique=True).sum()) / len(union)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that ``other`` has."""
        mine = self.distinct()
        if not mine:
            return 1.0
        shared = self.resemblance(other) * self.merge(other).distinct()
        return min(1.0, shared / mine)

    def text(self) -> str:
        return self.hashes.astype(">u8").tobytes().hex()

    @classmethod
    def read(cls, text: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64), k)


def fingerprint(text: Column, words: int = WORDS, k: int = K) -> Column:
    """The sketch of a text column as a string of ``k`` or fewer 16-digit hashes in ascending order."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([Sketch.of(t, words, k).text() for t in texts], dtype=object)

    return run(text)


def merged(fingerprints: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per ``keys`` from those of its parts.

    The hashes are reduced to distinct ones map-side, and the ``k`` least are found by a window Spark limits before the
    shuffle, so a key with a third of all parts sends ``k`` rows per task.
    """
    size = 16
    cut = F.transform(F.sequence(F.lit(0), (F.length(column) / size).cast("int") - 1), lambda i: F.substring(F.col(column), i * size + 1, F.lit(size)))
    hashes = fingerprints.where(F.length(column) > 0).select(*keys, F.explode(cut).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    kept = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_hash")), "").alias(column))


def bucketed(docs: DataFrame, key: str, text: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows ``(bucket, id, key, text, only_next)``: buckets of neighbouring keys, each with a copy of the row that follows it.

    Spark's range partitioning of the keys alone finds the buckets; their least and largest keys, at most ``BUCKETS`` pairs,
    are all that the driver sees. Texts are scanned once and one text per bucket is copied.
    """
    spark = docs.sparkSession
    ids = stored(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id")))
    parts = min(BUCKETS, max(1, -(-ids.count() // rows)))
    ends = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    ends = sorted((r["lo"], r["hi"]) for r in ends.collect())
    lows = np.array([lo for lo, _ in ends], dtype=np.int64)

    @F.pandas_udf("long")
    def bucket(id_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, id_.to_numpy(), side="right") - 1)

    # In descending order bucket b is followed by the largest key of bucket b - 1, and bucket 0 by the largest of all.
    heads = spark.createDataFrame([(hi, (b + 1) % len(ends)) for b, (_, hi) in enumerate(ends)], "head long, to long")
    row = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = row.withColumn("bucket", bucket("id")).join(F.broadcast(heads), F.col("id") == F.col("head"), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("only_next"))
    copy = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("only_next"))
    return row.select("id", "key", "text", F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """Sketches of every document, of its edited text and of the next document, and how alike they are.

    The next document is the one after it in descending key order, after the last the first; equal keys are ordered by
    descending text, a NULL key comes last. The edited text has its last ``floor(n / 2)`` code points replaced by the first as
    many of the next document (or all it has). Texts are shuffled once, to buckets of neighbouring keys; a task streams a
    bucket in order and holds two texts. A single row is its own next. NULL texts count as empty; two empty texts are alike.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # bucket, key, text and sketch of the row that waits for its next
        for batch in batches:
            out = []
            for bucket, row_key, row_text, only_next in zip(batch["bucket"], batch["key"], batch["text"], batch["only_next"]):
                sketch = Sketch.of(row_text, words, k)
                if held is not None and held[0] == bucket:
                    out.append(compared(held, row_text, sketch))
                held = None if only_next else (bucket, row_key, row_text, sketch)
            yield pd.DataFrame(out, columns=columns)

    def compared(row, next_text: str, next_sketch: Sketch):
        _, row_key, row_text, sketch = row
        n = len(row_text)
        edited = row_text[: n - n // 2] + next_text[: n // 2]
        other = Sketch.of(edited, words, k)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (row_key, n, digest, sketch.text(), other.text(), sketch.resemblance(other), sketch.resemblance(next_sketch),
                sketch.containment(other), sketch.distinct())

    schema = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double, n_shingles double"
    columns = [part.split()[0] for part in schema.split(", ")]
    rows = bucketed(docs, key, text)
    # A bucket's follower sorts after all its own rows.
    return rows.repartition("bucket").sortWithinPartitions(
        "bucket", "only_next", F.col("id").desc(), F.col("text").desc()
    ).mapInPandas(run, schema)
