"""Texts as symbols of a small alphabet, and the counts of their triples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import stored

#: Symbols: frequent words, shapes of the other words, and three of their own. There are at most SYMBOLS ** 3
#: triples (64 MB as an array), whatever the corpus.
WORDS, SHAPES = 190, 63
OTHER, SAME, EDGE = WORDS + SHAPES, WORDS + SHAPES + 1, WORDS + SHAPES + 2
SYMBOLS = EDGE + 1
CACHE = 500_000
#: Words whose weight goes to every task (below 40 MB in each), at most; the weights of all others are joined.
NEAR_WORDS = 200_000
#: Weights are whole numbers of this many parts of a nat, so sums don't depend on their order.
PARTS = 1_000_000_000

LETTERS, DIGITS, AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word's outline: a, Aa or A for its letters, 9 for digits, other characters once each; six at most."""
    letters = lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"
    return AGAIN.sub(r"\1", DIGITS.sub("9", LETTERS.sub(letters, word)))[:6]


@dataclass
class Symbols:
    """Words to symbols. ``cost`` is the log-probability of a word given its symbol, one in as many as share it, for callers that
    have no ``Weights``; ``mass`` the logarithm of how often words of a symbol occur."""

    words: dict[str, int]
    shapes: dict[str, int]
    cost: np.ndarray
    mass: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)

    def of(self, word: str) -> int:
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = self.words.get(word)
        if found is None:
            found = self.shapes.get(shape(word), OTHER)
        self.cache[word] = found
        return found

    def read(self, text: str | None) -> np.ndarray:
        """A text's symbols between edges; a word like the one before it is SAME."""
        cache, last, out = self.cache, None, [EDGE, EDGE]
        for word in (text or "").split():
            if word == last:
                out.append(SAME)
            else:
                known = cache.get(word)
                out.append(self.of(word) if known is None else known)
                last = word
        out.append(EDGE)
        return np.array(out, dtype=np.int64)

    def read_words(self, text: str | None, near: dict[str, int]) -> tuple[np.ndarray, int, list[str]]:
        """``read``, the summed weight of the words in ``near``, and the words that are neither there nor symbols of their own."""
        cache, last, out, total, far = self.cache, None, [EDGE, EDGE], 0, []
        for word in (text or "").split():
            if word == last:
                out.append(SAME)
                continue
            known = cache.get(word)
            if known is None:
                known = self.of(word)
            out.append(known)
            last = word
            if known >= WORDS:
                weight = near.get(word)
                if weight is None:
                    far.append(word)
                else:
                    total += weight
        out.append(EDGE)
        return np.array(out, dtype=np.int64), total, far


@dataclass(frozen=True)
class Weights:
    """Every word's share of its symbol: ``exp((weight - PARTS * mass) / PARTS)``. ``near`` holds the frequent words, ``far`` all
    others of the corpus; a word of neither has the weight ``unseen``."""

    near: dict[str, int]
    far: DataFrame
    unseen: int


def trigrams(symbols: np.ndarray) -> np.ndarray:
    return (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """``(word, count)`` of every word."""
    return stored(rows.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''").groupBy("word").count())


def learn(rows: DataFrame, text: str, counts: DataFrame | None = None) -> Symbols:
    """The most frequent words and, of the rest, the most frequent shapes, counted over all rows."""
    counts = word_counts(rows, text) if counts is None else counts
    top = counts.orderBy(F.desc("count"), "word").limit(WORDS)
    words = {r["word"]: i for i, r in enumerate(top.collect())}

    @F.pandas_udf("string")
    def outline(w: pd.Series) -> pd.Series:
        return w.map(shape)

    rest = counts.where(~F.col("word").isin(list(words))) if words else counts
    by_shape = rest.groupBy(outline("word").alias("shape")).agg(F.sum("count").alias("n"), F.count("*").alias("types"))
    shapes = stored(by_shape)
    most = shapes.orderBy(F.desc("n"), "shape").limit(SHAPES).collect()
    cost, often = np.zeros(SYMBOLS), np.ones(SYMBOLS)
    for i, r in enumerate(most):
        cost[WORDS + i] = -np.log(r["types"] + 1)
        often[WORDS + i] = r["n"]
    # A word of a shape never seen among the frequent ones is taken to be one of as many as there are types.
    cost[OTHER] = -np.log(counts.count() + 1)
    often[OTHER] = max((shapes.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in most), 1)
    return Symbols(words, {r["shape"]: WORDS + i for i, r in enumerate(most)}, cost, np.log(often))


def weigh(counts: DataFrame) -> Weights:
    """A word's share of its symbol is its count less a discount ``d``; what is taken off all words of the symbol goes, ``d`` each, to
    as many words that were not seen. ``d`` is half the Kneser-Ney discount, so a word seen once outweighs one not seen."""
    types = {r["count"]: r["types"] for r in counts.groupBy("count").agg(F.count("*").alias("types")).collect()}
    n1, n2 = types.get(1, 0), types.get(2, 0)
    d = float(np.clip(n1 / (n1 + 2 * n2) / 2 if n1 else 0.0, 0.05, 0.5))
    least, room = max(types, default=0) + 1, NEAR_WORDS
    for n in sorted(types, reverse=True):
        room -= types[n]
        if room < 0:
            break
        least = n
    weight = lambda n: round(float(np.log(n - d)) * PARTS)
    near = {r["word"]: weight(r["count"]) for r in counts.where(F.col("count") >= least).collect()}
    far = counts.where(F.col("count") < least).select("word", F.round(F.log(F.col("count") - d) * PARTS).cast("long").alias("weight"))
    return Weights(near, far, round(float(np.log(d)) * PARTS))


def add_far(read: DataFrame, weights: Weights, log: str) -> DataFrame:
    """``read`` without its column ``far``, the weights of whose words are added to ``log``. A row sends each of these words to
    where its weight is, and sums come back."""
    read = stored(read.withColumn("_row", F.monotonically_increasing_id()))
    words = read.select("_row", F.explode("far").alias("word"))
    found = words.join(weights.far, "word", "left").groupBy("_row").agg(F.sum(F.coalesce("weight", F.lit(weights.unseen))).alias("_far"))
    added = F.col(log) + F.coalesce("_far", F.lit(0)) / PARTS
    return read.drop("far").join(found, "_row", "left").withColumn(log, added).drop("_row", "_far")


def count_trigrams(rows: DataFrame, text: str, symbols: Symbols) -> DataFrame:
    """``(u, v, w, n)``; each task adds up its texts in one array before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, dtype=np.int32)
        for batch in batches:
            for t in batch[text]:
                found, often = np.unique(trigrams(symbols.read(t)), return_counts=True)
                total[found] += often.astype(np.int32)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen].astype(np.int64)})

    gram = F.col("gram")
    summed = rows.select(text).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    parts = {"u": F.floor(gram / SYMBOLS**2), "v": F.floor(gram / SYMBOLS) % SYMBOLS, "w": gram % SYMBOLS}
    return summed.select(*[c.cast("int").alias(n) for n, c in parts.items()], "n")
