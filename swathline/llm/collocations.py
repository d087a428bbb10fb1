"""Phrases that occur together more often than their parts would: counts by tries over all text positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import stored
from swathline.llm.word_codes import Coded, chunks, coded, kinds

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST, FIRST = 5, 100, 2000
#: Phrases of one trie; its arrays stay below 100 MB. More phrases go to more tries, each with a reading of its own.
TRIE_PHRASES = 500_000
#: Counters that travel together; words of a batch of new words.
COUNTERS, BATCH_WORDS = 8_192, 50_000


class DoubleArray:
    """A double-array trie of code sequences: the child of state ``s`` by digit ``d`` is ``t = base[s] + d`` if ``check[t] == s``.

    A code is the digits, to base 64, of its rank among the codes that occur, so a state has at most 64 children. State 0 is the
    root. ``accept[s]`` is the index of the phrase that ends in ``s``, or -1 where only a prefix does.
    """

    DIGIT = 6
    WIDE = 1 << DIGIT

    def __init__(self, phrases: list[np.ndarray]) -> None:
        """``phrases[k]`` is a matrix of the distinct phrases of ``k + 1`` codes; indices run on from matrix to matrix."""
        self.alphabet = np.unique(np.concatenate([p.ravel() for p in phrases])) if phrases else np.empty(0, dtype=np.uint64)
        self.digits = max(1, -(-len(self.alphabet).bit_length() // self.DIGIT))
        ranked = [self.spelled(np.searchsorted(self.alphabet, p)).reshape(len(p), p.shape[1] * self.digits) for p in phrases]
        # Nodes level by level, each a pair of parent and digit; a phrase's prefixes are nodes as well.
        nodes: list[tuple[np.ndarray, np.ndarray]] = []
        at = [np.zeros(len(p), dtype=np.int64) for p in ranked]
        for depth in range(len(ranked) * self.digits):
            deep = range(depth // self.digits, len(ranked))
            pairs = [at[k] * self.WIDE + ranked[k][:, depth] for k in deep]
            own, back = np.unique(np.concatenate(pairs), return_inverse=True)
            nodes.append((own // self.WIDE, own % self.WIDE))
            for k, part in zip(deep, np.split(back, np.cumsum([len(p) for p in pairs])[:-1])):
                at[k] = part
        slots = self.place(nodes)
        self.accept = np.full(len(self.base), -1, dtype=np.int32)
        self.size = 0
        for k, numbers in enumerate(at):
            self.accept[slots[(k + 1) * self.digits][numbers]] = np.arange(self.size, self.size + len(numbers), dtype=np.int32)
            self.size += len(numbers)

    def spelled(self, ranks: np.ndarray) -> np.ndarray:
        shifts = np.arange(self.digits - 1, -1, -1) * self.DIGIT
        return (ranks.astype(np.int64)[..., None] >> shifts) & (self.WIDE - 1)

    def place(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The slots of all nodes, level by level. Families of eight and more get a block of their own, smaller ones drawn places
        between, kept in rounds where all their slots are free, and single children what is left."""
        families = [np.unique(p, return_index=True, return_counts=True)[1:] for p, _ in nodes]
        of_size = lambda least, most: sum(int(c[(c >= least) & (c < most)].sum()) for _, c in families)
        blocks = sum(int((c >= 8).sum()) for _, c in families)
        room = self.WIDE * (blocks + 1) + 3 * of_size(2, 8) + of_size(1, 2)
        taken = np.zeros(room + self.WIDE, dtype=bool)
        taken[: self.WIDE] = True
        claim = np.empty(room + self.WIDE, dtype=np.int32)
        bases = [np.zeros(len(starts), dtype=np.int64) for starts, _ in families]
        draw, block = np.random.default_rng(7), 1
        for (_, digit), (starts, counts), base in zip(nodes, families, bases):
            big = np.flatnonzero(counts >= 8)
            base[big] = (block + np.arange(len(big))) * self.WIDE
            block += len(big)
            taken[np.repeat(base[big], counts[big]) + digit[members(starts[big], counts[big])]] = True
        for (_, digit), (starts, counts), base in zip(nodes, families, bases):
            left = np.flatnonzero((counts >= 2) & (counts < 8))
            while len(left):
                which = np.repeat(np.arange(len(left)), counts[left])
                drawn = draw.integers(self.WIDE, room, len(left))
                slots = drawn[which] + digit[members(starts[left], counts[left])]
                claim[slots] = which
                bad = taken[slots] | (claim[slots] != which)
                fine = np.bincount(which[bad], minlength=len(left)) == 0
                taken[slots[fine[which]]] = True
                base[left[fine]] = drawn[fine]
                left = left[~fine]
        free = np.flatnonzero(~taken)
        for (_, digit), (starts, counts), base in zip(nodes, families, bases):
            single = np.flatnonzero(counts == 1)
            base[single] = free[: len(single)] - digit[starts[single]]
            free = free[len(single) :]
        self.base = np.zeros(room + self.WIDE, dtype=np.int32)
        self.check = np.full(room + self.WIDE, -1, dtype=np.int32)
        slots = [np.zeros(1, dtype=np.int64)]
        for (parent, digit), (starts, counts), base in zip(nodes, families, bases):
            own = np.repeat(base, counts) + digit
            self.check[own] = slots[-1][parent]
            self.base[slots[-1][parent[starts]]] = base
            slots.append(own)
        return slots

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Ranks of codes, -1 for those that no phrase has."""
        if not len(self.alphabet):
            return np.full(len(codes), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, -1).astype(np.int32)

    def walk(self, codes: np.ndarray, room: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After 1, 2, ... ``depth`` words: the positions whose phrase so far is in the trie, and their states.

        All positions advance together; ``room`` is the number of words from a position to the end of its piece.
        """
        letter = self.letters(codes)
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int32)
        for k in range(depth):
            goes = room[at] > k
            at, state = at[goes], state[goes]
            goes = letter[at + k] >= 0
            at, state = at[goes], state[goes]
            for shift in range(self.DIGIT * (self.digits - 1), -1, -self.DIGIT):
                to = self.base[state] + (letter[at + k] >> shift & (self.WIDE - 1))
                goes = self.check[to] == state
                at, state = at[goes], to[goes]
            yield at, state


def members(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rows ``start, ..., start + count - 1`` of each family, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())


def room_left(words: Coded) -> np.ndarray:
    """For each word how many words its piece has from there on."""
    n = len(words.codes)
    heads = np.flatnonzero(words.breaks)
    ends = np.r_[heads[1:], n] if len(heads) else heads
    return np.repeat(ends, np.diff(np.r_[heads, n])) - np.arange(n) if n else np.empty(0, dtype=np.int64)


def read(batch: pa.RecordBatch, seed: int) -> tuple[Coded, list[str]]:
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    salts = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in set(langs)}
    salt = np.array([salts[x] for x in langs], dtype=np.uint64)
    return coded(batch.column(batch.schema.get_field_index("text")), kinds(SPACES, BREAKS), lower=True, salt=salt), langs


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, code, f)``: every word of ``texts(lang, text)`` with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, langs = read(batch, seed)
            own, where, counts = np.unique(words.codes, return_index=True, return_counts=True)
            rows = np.searchsorted(words.rows, where, side="right") - 1
            for i in range(0, len(own), BATCH_WORDS):
                part = slice(i, i + BATCH_WORDS)
                spelled = [words.word(j).decode("utf-8", "replace") for j in where[part].tolist()]
                columns = [pa.array([langs[r] for r in rows[part].tolist()], pa.string()), pa.array(spelled, pa.string())]
                yield pa.record_batch([*columns, pa.array(own[part].view(np.int64)), pa.array(counts[part].astype(np.int64))], names=["lang", "word", "code", "f"])

    return texts.mapInArrow(run, "lang string, word string, code long, f long").groupBy("lang", "word", "code").agg(F.sum("f").alias("f"))


def grown(texts: DataFrame, trie: Broadcast, k: int, alone: bool, seed: int) -> DataFrame:
    """``(phrase, code, f)``: how often each word follows each phrase of ``k`` words that the trie accepts.

    Where the trie is the only one, it knows all frequent words and phrases, and what follows is counted only if it is a
    frequent word and the phrase without its first word is frequent as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: DoubleArray = trie.value
        for batch in chunks(batches):
            words, _ = read(batch, seed)
            room = room_left(words)
            at, state = [*tree.walk(words.codes, room, k)][-1]
            phrase = tree.accept[state]
            mine = phrase >= 0
            at, phrase = at[mine], phrase[mine]
            follows = room[at] > k
            if alone:
                known = np.zeros(len(room) + 1, dtype=bool)
                known[at] = True
                follows &= known[at + 1]
            at, phrase = at[follows], phrase[follows]
            codes, back = np.unique(words.codes[at + k], return_inverse=True)
            keys, counts = np.unique(phrase.astype(np.int64) << 32 | back, return_counts=True)
            yield pa.record_batch(
                [pa.array(keys >> 32), pa.array(codes[keys & 0xFFFFFFFF].view(np.int64)), pa.array(counts.astype(np.int64))],
                names=["phrase", "code", "f"],
            )

    return texts.mapInArrow(run, "phrase long, code long, f long").groupBy("phrase", "code").agg(F.sum("f").alias("f"))


def counted(texts: DataFrame, trie: Broadcast, seed: int) -> DataFrame:
    """``(phrase, f)``: occurrences of the phrases a trie accepts. Each task counts its states in one array, which it sends in
    pieces; tasks stream the pieces of their range of states and hold one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: DoubleArray = trie.value
        total = np.zeros(tree.size, dtype=np.int64)
        for batch in chunks(batches):
            words, _ = read(batch, seed)
            for _, state in tree.walk(words.codes, room_left(words), LONGEST):
                phrase = tree.accept[state]
                total += np.bincount(phrase[phrase >= 0], minlength=tree.size)
        for i in range(0, tree.size, COUNTERS):
            part = total[i : i + COUNTERS]
            if part.any():
                yield pa.record_batch([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["first", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(counts, dtype=np.int64)
                if at != first:
                    if first is not None:
                        yield told(first, total)
                    first, total = at, np.zeros(len(counts), dtype=np.int64)
                total += counts
        if first is not None:
            yield told(first, total)

    def told(first: int, total: np.ndarray) -> pa.RecordBatch:
        seen = np.flatnonzero(total)
        return pa.record_batch([pa.array(first + seen), pa.array(total[seen])], names=["phrase", "f"])

    pieces = texts.mapInArrow(run, "first long, counts binary").repartition("first").sortWithinPartitions("first")
    return pieces.mapInArrow(add, "phrase long, f long")


def tries(phrases: DataFrame, most: int) -> Iterator[tuple[Broadcast, DataFrame, bool]]:
    """Broadcast tries of ``phrases(p array<long>, ...)``, each of at most about ``most``, with the rows ``(phrase, p)`` it
    accepts, and whether it is the only one. A phrase belongs to one trie by its hash and brings its prefixes along."""
    spark = phrases.sparkSession
    parts = max(1, -(-phrases.count() // most))
    for part in range(parts):
        mine = phrases.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).select("p").toPandas()["p"]
        by = [[p for p in mine if len(p) == k + 1] for k in range(LONGEST)]
        while by and not by[-1]:
            by.pop()
        trie = DoubleArray([np.array(p, dtype=np.int64).reshape(len(p), k + 1).view(np.uint64) for k, p in enumerate(by)])
        order = [p for group in by for p in group]
        frame = pd.DataFrame({"phrase": np.arange(len(order)), "p": [[int(c) for c in p] for p in order]})
        named = spark.createDataFrame(frame, "phrase long, p array<long>")
        shared = spark.sparkContext.broadcast(trie)
        yield shared, named, parts == 1
        shared.destroy()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words ``(lang, word, code, f)`` that occur ``least`` times, all phrases ``(p, f)`` of up to five such words that do, and
    ``(lang, n)``, all word occurrences.

    Words are 64-bit codes, salted by language; a code that two words share is found among all words, and all is coded anew.
    Level by level, a candidate is a frequent phrase followed by a word, counted where the trie of the phrases found so far
    leads; a phrase of which a part is not frequent is never one. At last every phrase is counted by the tries of them all.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for seed in range(100):
        words = stored(word_counts(texts, seed))
        if words.groupBy("code").count().where("count > 1").isEmpty():
            break
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(words.where(F.col("f") >= least))
    levels = [words.select(F.array("code").alias("p"), "f")]
    for k in range(1, LONGEST):
        known = levels[0]
        for level in levels[1:]:
            known = known.union(level)
        longer = []
        # Only phrases of k words grow; the trie holds their prefixes as well.
        for trie, named, alone in tries(levels[-1], most):
            more = grown(texts, trie, k, alone, seed).where(F.col("f") >= least)
            longer.append(stored(more.join(F.broadcast(named), "phrase").select(F.concat("p", F.array("code")).alias("p"), "f")))
        if not longer:
            break
        level = longer[0]
        for part in longer[1:]:
            level = level.union(part)
        levels.append(level)
        if level.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    totals = [stored(counted(texts, trie, seed).join(F.broadcast(named), "phrase").select("p", "f")) for trie, named, _ in tries(every, most)]
    phrases = totals[0]
    for part in totals[1:]:
        phrases = phrases.union(part)
    return words, phrases, sizes


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, most: int = TRIE_PHRASES
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases of two to five words that occur ``least``
    times or more, by ``floor(1000 a n / (l r))`` at the cut where it is least.

    A phrase inside a longer one that occurs as often is left out. Ties go by ``a`` descending, then by the phrase's bytes.
    Texts are folded (A-Z), cut into pieces at ``BREAKS`` and into words at blanks and tabs. A NULL language is ``und``; NULL,
    empty and wordless texts count no words; repeated rows count again; an empty table gives none.
    """
    words, phrases, sizes = frequent_phrases(docs, text, lang, least, most)
    whole = phrases.where(F.size("p") > 1).withColumnRenamed("f", "a")
    # A longer phrase that occurs as often: one more word before or behind is enough, as those between are as frequent.
    wider = whole.where(F.size("p") > 2).select("a", F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"))
    kept = whole.join(wider.select("p", "a").distinct(), ["p", "a"], "left_anti")
    cuts = kept.select("p", "a", F.explode(F.expr("sequence(1, size(p) - 1)")).alias("k"))
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("head"), F.expr("slice(p, k + 1, size(p) - k)").alias("tail"))
    cuts = cuts.join(phrases.select(F.col("p").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(phrases.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
    of = words.select(F.col("code").alias("c"), "lang", "word")
    cuts = cuts.join(of.select("c", "lang"), cuts["p"][0] == of["c"]).join(sizes, "lang").drop("c")
    score = F.expr("CAST((CAST(a AS DECIMAL(19, 0)) * 1000 * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS LONG)")
    best = cuts.withColumn("score", score).groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spelled = best.select("*", F.posexplode("p").alias("i", "c")).join(of.select("c", "word"), "c")
    spelled = spelled.groupBy("lang", "p", "a", "n", "b").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = spelled.select("lang", F.concat_ws(" ", F.expr("transform(w, x -> x.word)")).alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    # Spark's window limit cuts every task to the first rows of a language before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
