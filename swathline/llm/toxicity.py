"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.llm.common import stored

#: Lengths of the n-grams, bits of their hashes, and the score from which a text is rejected.
SHORTEST, LONGEST, BITS, LIMIT = 3, 8, 20, 0.3
#: The classifier is fitted on at most so many labelled rows, chosen by the hash of their keys. Nothing else is bounded.
TRAIN_ROWS = 12_000
#: A feature needs this many training texts and this chi-squared value; its counts start at one.
LEAST_TEXTS, LEAST_CHI2 = 4, 25.0
STEPS, RATE, DECAY = 100, 0.1, 1e-3
CHUNK = 1 << 17
#: Rows of the sample that a step of the fit looks at together.
BLOCK = 1_000

OTHER = re.compile(r"\W+")
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text in pieces; words are lower-cased and parted by one space, at both ends too."""
    whole = " " + OTHER.sub(" ", (text or "").lower()) + " "
    for at in range(0, len(whole), CHUNK):
        codes = np.frombuffer(whole[at : at + CHUNK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        hashes = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, min(LONGEST, len(codes)) + 1):
            hashes = hashes[: len(codes) - n + 1] * BASE + codes[n - 1 :]
            if n >= SHORTEST:
                # A piece counts the n-grams that start in it.
                yield (((hashes[:CHUNK] ^ np.uint64(n)) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    """``place`` numbers the chosen features of all hashes (-1: not chosen); a weight already holds its log-count ratio."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and damped counts of the chosen features in a text."""
        found = [x[x >= 0] for x in (self.place[h] for h in ngrams(text))]
        which, often = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, int), np.empty(0, int))
        return which, np.log1p(often)

    def score_text(self, text: str | None) -> float:
        which, often = self.counts(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + often @ self.weights[which], -30.0, 30.0))))

    def score(self, text: Column) -> Column:
        @F.pandas_udf(T.DoubleType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([self.score_text(t) for t in texts], dtype=float)

        return run(text)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents outside the held-out part."""
    known = labels.where(~held_out(F.col(key)) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # At most ``rows`` keys, so this side has a size bound.
    return docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), F.col(key) == F.col("_id")).select("text", "label")


def feature_counts(rows: DataFrame) -> DataFrame:
    """``(feature, toxic, clean)``: labelled texts that have the feature, summed in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                counts[int(label)][np.unique(np.concatenate([np.empty(0, dtype=np.int64), *ngrams(text)]))] += 1
        feature = np.flatnonzero(counts.sum(axis=0))
        for at in range(0, len(feature), 1 << 16):
            some = feature[at : at + (1 << 16)]
            yield pd.DataFrame({"feature": some, "clean": counts[0][some], "toxic": counts[1][some]})

    partial = rows.mapInPandas(run, "feature long, clean long, toxic long")
    return partial.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit the classifier. Features are counted and chosen over the sample by Spark; the weights are fitted in one task.

    ``labels`` has ``key`` and ``toxic`` (0 or 1; NULL rows and repeated keys are merged). Without labels of both kinds the
    model has no features and scores all texts with the share of toxic labels, 0 where there are none.
    """
    picked = stored(sample(docs, labels, key, text, rows).withColumn("label", F.when(F.col("label") > 0, 1).otherwise(0)))
    toxic, n = picked.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    place = np.full(1 << BITS, -1, dtype=np.int32)
    if not 0 < toxic < n:
        return Model(place, np.empty(0), 30.0 if toxic else -30.0)
    both = F.col("toxic") + F.col("clean")
    expected = both * (toxic / n)
    gap = F.pow(F.col("toxic") - expected, 2)
    ratio = F.log(((F.col("toxic") + 1) / (toxic + 2)) / ((F.col("clean") + 1) / (n - toxic + 2)))
    chosen = feature_counts(picked).where((both >= LEAST_TEXTS) & (gap / expected + gap / (both - expected) > LEAST_CHI2))
    # At most 2^BITS rows of 16 bytes.
    table = chosen.select("feature", ratio.alias("ratio")).toPandas().sort_values("feature")
    place[table["feature"].to_numpy(dtype=np.int64)] = np.arange(len(table))
    ratios = table["ratio"].to_numpy(dtype=float)
    counter = Model(place, ratios, 0.0)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [counter.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "which": [a.astype(np.int32) for a, _ in read], "often": [b.astype(np.float32) for _, b in read]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, lengths, which, value = [], [], [], []
        for batch in batches:
            label.append(batch["label"].to_numpy(dtype=float))
            lengths += [len(x) for x in batch["which"]]
            which.append(np.concatenate(batch["which"].to_list()).astype(np.int32))
            value.append((np.concatenate(batch["often"].to_list()) * ratios[which[-1]]).astype(np.float32))
        label, which, value = (np.concatenate(x) for x in (label, which, value))
        ends = np.r_[0, np.cumsum(lengths)]
        # Blocks of rows, so that a step needs no second copy of the whole sample.
        blocks = [(at, min(at + BLOCK, len(label))) for at in range(0, len(label), BLOCK)]
        weights, bias, seen, seen_bias = np.zeros(len(ratios)), np.log(toxic / (n - toxic)), np.full(len(ratios), 1e-3), 1e-3
        for _ in range(STEPS):
            slope, slope_bias = DECAY * weights, 0.0
            for lo, hi in blocks:
                w, v = which[ends[lo] : ends[hi]], value[ends[lo] : ends[hi]]
                owner = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                z = np.bincount(owner, v * weights[w], minlength=hi - lo) + bias
                error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - label[lo:hi]) / len(label)
                slope += np.bincount(w, v * error[owner], minlength=len(weights))
                slope_bias += error.sum()
            seen += slope**2
            seen_bias += slope_bias**2
            weights -= RATE * slope / np.sqrt(seen)
            bias -= 3 * RATE * slope_bias / np.sqrt(seen_bias)
        yield pd.DataFrame({"at": np.r_[-1, np.arange(len(weights))], "weight": np.r_[bias, weights * ratios]})

    ordered = picked.mapInPandas(vectors, "label int, which array<int>, often array<float>")
    found = ordered.repartition(1).mapInPandas(fit, "at long, weight double").toPandas().sort_values("at")
    return Model(place, found["weight"].to_numpy()[1:], float(found["weight"].iloc[0]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row; the whole text counts, in pieces of bounded memory.

    NULL and empty texts get the score of a text without features. Equal texts have equal scores.
    """
    scored = docs.select(F.col(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), model.score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= LIMIT, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns as they were."""
    return docs.where(model.score(docs[text]) < LIMIT)
