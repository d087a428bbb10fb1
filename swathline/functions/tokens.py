"""Caption tokens and n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, order: int) -> Column:
    """Space-joined n-grams; a text shorter than ``order`` has none."""
    if order == 1:
        return words
    starts = F.when(F.size(words) >= order, F.sequence(F.lit(1), F.size(words) - (order - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, order), " "))


WORD = re.compile("[a-z0-9]+")


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Pair:
    """Two texts as words, ``p`` and ``r``, and as their words' places in the distinct ``words`` of both, ``p_at`` and ``r_at``."""

    def __init__(self, first: str | None, second: str | None) -> None:
        self.p, self.r = words_in(first), words_in(second)
        self.words = list(dict.fromkeys(self.p + self.r))
        place = dict(zip(self.words, range(len(self.words)))).__getitem__
        self.p_at, self.r_at = (np.fromiter(map(place, x), dtype=np.int64, count=len(x)) for x in (self.p, self.r))
        #: Counts of the second text's n-grams of order 2 to 4.
        self.r_grams = counted_grams(self.r, np.ones(max(0, len(self.r) - 1), dtype=bool))

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each of ``words`` occurs in the first text and in the second."""
        return np.bincount(self.p_at, minlength=len(self.words)), np.bincount(self.r_at, minlength=len(self.words))

    def squares(self) -> list[int]:
        """Per order 1 to 4: the sum of the squared counts of the first text's n-grams.

        An n-gram is a whole number, its words' places and above them its order less one; where 64 bits are too few for
        that, the numbers are Python's own.
        """
        bits = max(1, len(self.words).bit_length())
        code = self.p_at.astype(np.int64 if 4 * bits + 2 < 63 else object)
        parts = [code]
        for n in range(1, 4):
            code = (code[:-1] << bits) | parts[0][n:]
            parts.append(code | (n << 4 * bits))
        grams, counts = np.unique(np.concatenate(parts), return_counts=True)
        return np.bincount((grams >> 4 * bits).astype(np.int64), counts * counts, 4).astype(np.int64).tolist()

    def clipped(self) -> list[int]:
        """Per order 1 to 4: n-grams of the first text, each counted at most as often as the second has it."""
        code = lambda at: at[:-1] * len(self.words) + at[1:]
        own = counted_grams(self.p, among(code(self.p_at), np.sort(code(self.r_at))))
        return [int(np.minimum(*self.single()).sum()), *[sum(min(n, p[g]) for g, n in r.items() if g in p) for p, r in zip(own, self.r_grams)]]


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in ``known``, which is sorted."""
    at = np.searchsorted(known, codes)
    found = at < len(known)
    found[found] = known[at[found]] == codes[found]
    return found


def counted_grams(words: list[str], pairs: np.ndarray) -> list[Counter]:
    """Counts of the n-grams of order 2 to 4 whose neighbouring words are all marked in ``pairs``."""
    out, held = [], pairs
    for n in range(2, 5):
        out.append(Counter([" ".join(words[i : i + n]) for i in np.flatnonzero(held).tolist()]))
        held = held[:-1] & pairs[n - 1 :]
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def clipped_counts(first: pd.Series, second: pd.Series) -> pd.Series:
    """Per order 1 to 4: n-grams of the first text, each counted at most as often as the second has it."""
    return pd.Series([Pair(a, b).clipped() for a, b in zip(first, second)])


class Vocabulary:
    """Weights of n-grams. An n-gram of another order has another number of blanks, so it tells its order itself."""

    def __init__(self, idf: Mapping[str, float]) -> None:
        split = [g.split(" ") for g in idf]
        #: Every word of an n-gram has a place; ``single`` is its own weight there, NaN without one.
        self.place = {w: i for i, w in enumerate(dict.fromkeys(w for g in split for w in g))}
        self.single = np.array([idf.get(w, np.nan) for w in self.place] or [np.nan])
        #: The words that are neighbours in any n-gram.
        self.pairs = np.array(sorted({self.place[a] << 32 | self.place[b] for g in split for a, b in zip(g, g[1:])}), dtype=np.int64)
        self.idf = {g: x for g, x in idf.items() if " " in g}

    def paired(self, at: np.ndarray) -> np.ndarray:
        a, b = at[:-1], at[1:]
        return (a >= 0) & (b >= 0) & among(a << 32 | b, self.pairs)


SUMS = {"sq": T.LongType, "known_sq": T.LongType, "known2": T.DoubleType, "dot": T.DoubleType, "nr2": T.DoubleType}
#: Of two texts: their numbers of words, sums per order, clipped counts and the longest common subsequence.
FACTS_TYPE = T.StructType([
    T.StructField("np", T.IntegerType()), T.StructField("nr", T.IntegerType()), *[T.StructField(k, T.ArrayType(t())) for k, t in SUMS.items()],
    T.StructField("clip", T.ArrayType(T.LongType())), T.StructField("lcs", T.IntegerType()),
])


def weighed_sums(x: Pair, vocabulary: Vocabulary) -> tuple[list, ...]:
    """Per order 1 to 4, sums over n-grams: the first text's squared counts; of those in ``vocabulary`` the first's squared counts,
    plain and weighed, the products with the second's, clipped by them, and the second's weighed squares. Five lists side by side."""
    at = np.array([vocabulary.place.get(w, -1) for w in x.words], dtype=np.int64)
    weight = vocabulary.single[at]
    known = (at >= 0) & ~np.isnan(weight)
    (cp, cr), w = (c[known] for c in x.single()), weight[known]
    vp, vr = cp * w, cr * w
    out = [(int((cp * cp).sum()), float((vp * vp).sum()), float((np.minimum(vp, vr) * vr).sum()), float((vr * vr).sum()))]
    idf = vocabulary.idf
    for p, r in zip(counted_grams(x.p, vocabulary.paired(at[x.p_at])), x.r_grams):
        known_sq, known2, dot, nr2 = 0, 0.0, 0.0, 0.0
        for g, n in p.items():
            if (w := idf.get(g)) is not None:
                known_sq += n * n
                known2 += n * w * (n * w)
        for g, n in r.items():
            if (w := idf.get(g)) is not None:
                dot += min(p.get(g, 0) * w, n * w) * (n * w)
                nr2 += n * w * (n * w)
        out.append((known_sq, known2, dot, nr2))
    return (x.squares(), *map(list, zip(*out)))


def pair_facts(first: str | None, second: str | None, vocabulary: Vocabulary, whole: bool) -> tuple:
    """A row of ``FACTS_TYPE``; clipped counts and subsequence only if ``whole``. NULL has no number of words."""
    x = Pair(first, second)
    sizes = [None if t is None else len(w) for t, w in ((first, x.p), (second, x.r))]
    return *sizes, *weighed_sums(x, vocabulary), x.clipped() if whole else None, lcs_bits(x.p, x.r) if whole else None


def lcs_bits(first: list[str], second: list[str]) -> int:
    """Longest common subsequence length, one machine word per 64 tokens of ``second``."""
    where: dict[str, int] = {}
    for position, token in enumerate(second):
        where[token] = where.get(token, 0) | (1 << position)
    full = (1 << len(second)) - 1
    row = full
    for token in first:
        # A token that the other text lacks changes nothing.
        if (found := where.get(token)) is not None:
            hit = row & found
            row = ((row + hit) | (row - hit)) & full
    return len(second) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(first: pd.Series, second: pd.Series) -> pd.Series:
    """Arrow-batched LCS over two text columns tokenised like :func:`tokens`."""
    word = re.compile("[a-z0-9]+")
    cut = lambda s: word.findall(s.lower()) if s else []
    return pd.Series([lcs_bits(cut(a), cut(b)) for a, b in zip(first, second)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def lcs_length_whitespace(first: pd.Series, second: pd.Series) -> pd.Series:
    """Arrow-batched LCS over whitespace tokens."""
    cut = lambda s: s.lower().split() if s else []
    return pd.Series([lcs_bits(cut(a), cut(b)) for a, b in zip(first, second)], dtype="int32")
