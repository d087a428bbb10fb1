"""Documents scored by masked pseudo-likelihood: a small network predicts every word from both of its neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import stored
from swathline.llm.symbols import PARTS, SYMBOLS, Symbols, Weights, add_far, count_trigrams, learn, trigrams, weigh, word_counts

#: Width of the hidden layer; passes over all contexts, contexts in a step, step size and seed of the training.
HIDDEN, PASSES, STEP, RATE, SEED = 32, 12, 2048, 0.01, 7


@dataclass
class Network:
    """log P(middle | left, right) = log softmax(tanh(L[left] + R[right] + b) O + c)."""

    left: np.ndarray
    right: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    prior: np.ndarray

    @classmethod
    def fresh(cls, frequency: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        small = lambda *n: rng.normal(0.0, 0.1, n).astype(np.float32)
        prior = np.log((frequency + 1.0) / (frequency.sum() + SYMBOLS)).astype(np.float32)
        return cls(small(SYMBOLS, HIDDEN), small(SYMBOLS, HIDDEN), small(HIDDEN), small(HIDDEN, SYMBOLS), prior)

    def forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(self.left[left] + self.right[right] + self.inner)
        logits = hidden @ self.outer + self.prior
        logits -= logits.max(axis=1, keepdims=True)
        return hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def slopes(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Slopes of the mean negative log-likelihood of ``counts[context, middle]`` for each parameter in order."""
        hidden, logs = self.forward(left, right)
        weight = counts.sum()
        error = (np.exp(logs) * counts.sum(axis=1, keepdims=True) - counts) / weight
        back = (error @ self.outer.T) * (1.0 - hidden**2)
        by_left, by_right = np.zeros_like(self.left), np.zeros_like(self.right)
        np.add.at(by_left, left, back)
        np.add.at(by_right, right, back)
        return [by_left, by_right, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.right, self.inner, self.outer, self.prior]

    def fit(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, at_row: np.ndarray) -> None:
        """Adam over shuffled contexts, each with all its middles at once and the weight of its count, row ``at_row``."""
        rng = np.random.default_rng(SEED)
        mean = [np.zeros_like(p) for p in self.parts()]
        square = [np.zeros_like(p) for p in self.parts()]
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(len(left))
            for at in range(0, len(order), STEP):
                some, step = order[at : at + STEP], step + 1
                for p, g, m, s in zip(self.parts(), self.slopes(left[some], right[some], counts[at_row[some]]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def table(self) -> np.ndarray:
        """What the network says of every middle in every context, as one array by left, middle and right."""
        out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS), dtype=np.float32)
        every = np.arange(SYMBOLS)
        for left in every:
            out[left] = self.forward(np.full(SYMBOLS, left), every)[1].T
        return out.reshape(-1)


def train(rows: DataFrame, text: str = "text", counts: DataFrame | None = None) -> tuple[Symbols, Network]:
    """Learn from every word of ``rows``.

    A network of one neighbour on each side needs no more than how often each triple of symbols occurs: tasks count their texts,
    Spark adds the counts, and the sums, at most SYMBOLS ** 3 for any corpus, are packed in a row for each left neighbour
    and fitted by one task. Without text the network is the untrained one.
    """
    symbols = learn(rows, text, counts)
    triples = stored(count_trigrams(rows, text, symbols))
    cells = triples.groupBy("u").agg(F.collect_list(F.struct((F.col("w") * SYMBOLS + F.col("v")).alias("cell"), "n")).alias("cells"))
    packed = cells.select("u", F.col("cells.cell").alias("cell"), F.col("cells.n").cast("array<float>").alias("n"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS), dtype=np.float32)  # left, right, middle
        for batch in batches:
            for u, cell, n in zip(batch["u"], batch["cell"], batch["n"]):
                dense[u].reshape(-1)[cell] = n
        flat = dense.reshape(-1, SYMBOLS)
        seen = np.flatnonzero(flat.any(axis=1))
        network = Network.fresh(flat.sum(axis=0, dtype=float))
        if len(seen):
            network.fit(seen // SYMBOLS, seen % SYMBOLS, flat, seen)
        yield pd.DataFrame({"part": range(5), "data": [p.astype(np.float32).tobytes() for p in network.parts()]})

    parts = sorted(packed.repartition(1).mapInPandas(fit, "part int, data binary").collect())
    network = Network.fresh(np.zeros(SYMBOLS))
    if parts:
        shapes = [p.shape for p in network.parts()]
        network = Network(*[np.frombuffer(r["data"], dtype=np.float32).reshape(s).copy() for r, s in zip(parts, shapes)])
    return symbols, network


def score(
    docs: DataFrame, symbols: Symbols, network: Network, key: str = "doc_id", text: str = "text", weights: Weights | None = None
) -> DataFrame:
    """``(key, n_words, log_likelihood, mean_log_likelihood, pseudo_perplexity)`` for every row.

    The pseudo-log-likelihood of a text is the sum over its words of the log-probability of each given both neighbours: that of
    its symbol and, with ``weights``, that of the word itself among all words of the symbol, however rare. Without them the words
    of a symbol count as equally likely. What the network says of all contexts is worked out once in a task. Texts without words,
    NULL among them, score 0 in all but a pseudo-perplexity of 1. Equal texts score alike.
    """
    given = docs.sparkSession.sparkContext.broadcast((symbols, network, weights.near if weights else None))

    @F.pandas_udf("n_words long, log_likelihood double, far array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, net, near = given.value
        table = net.table()
        for texts in batches:
            found = [pseudo(own, table, t, near) for t in texts]
            yield pd.DataFrame(found, columns=["n_words", "log_likelihood", "far"])

    out = docs.select(key, run(F.col(text)).alias("_s")).select(key, "_s.*")
    out = add_far(out, weights, "log_likelihood") if weights else out.drop("far")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).otherwise(0.0)
    return out.withColumn("mean_log_likelihood", mean).withColumn("pseudo_perplexity", F.exp(-F.col("mean_log_likelihood")))


def score_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` of every row by a model of all rows and all their words."""
    counts = word_counts(docs, text)
    return score(docs, *train(docs, text, counts), key, text, weigh(counts))


def pseudo(symbols: Symbols, table: np.ndarray, text: str | None, near: dict[str, int] | None) -> tuple[int, float, list[str]]:
    if near is None:
        read, total, far, own = symbols.read(text), 0, [], symbols.cost
    else:
        (read, total, far), own = symbols.read_words(text, near), -symbols.mass
    # One edge in front and one behind: every triple has a word in its middle.
    read = read[1:]
    if len(read) < 3:
        return 0, 0.0, []
    return len(read) - 2, float(table[trigrams(read)].sum(dtype=float) + own[read[1:-1]].sum()) + total / PARTS, far
