"""Caption metrics: n-grams are counted and weighed where a text is read, and only sums leave the task."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from swathline.functions import tokens as T
from swathline.operators import scoring as SC

TEXTS = ["", None, "a", "A b a B", "x y z x y z x", "Ther's a K of 3.5 km", "a b c d e f a b c d", "é ü", " ".join(f"w{i % 40_000}" for i in range(41_000)) + " a b c d"]


def grams(text, n):
    words = T.words_in(text)
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_facts_of_pairs_by_brute_force():
    idf = {" ".join(g): 0.5 + len(g) + i / 7 for n in range(1, 5) for t in TEXTS[3:7] for i, g in enumerate(grams(t, n))}
    vocabulary = T.Vocabulary(idf)
    for a in TEXTS:
        for b in TEXTS[:8]:
            got = T.pair_facts(a, b, vocabulary, True)
            assert got[:2] == tuple(None if t is None else len(T.words_in(t)) for t in (a, b))
            for n in range(1, 5):
                p, r = grams(a, n), grams(b, n)
                w = {g: idf[" ".join(g)] for g in {**p, **r} if " ".join(g) in idf}
                want = [
                    sum(k * k for k in p.values()), sum(k * k for g, k in p.items() if g in w), sum((k * w[g]) ** 2 for g, k in p.items() if g in w),
                    sum(min(p[g], k) * k * w[g] ** 2 for g, k in r.items() if g in w), sum((k * w[g]) ** 2 for g, k in r.items() if g in w), (p & r).total(),
                ]
                assert np.allclose([x[n - 1] for x in got[2:8]], want), (a, b, n)


def test_texts_are_read_once_and_no_gram_leaves(spark):
    rows = [(i, f"a b c{i % 5} d e f{i % 3} a b " * (1 + i % 4), f"a b c{i % 7} d e x{i % 4}") for i in range(40)]
    rows += [(40, "", "a b"), (41, None, "a b"), (42, "a b", None), (7, "a b c d", "a b c1 d"), (None, "a b d e", "d e f")]
    pairs = spark.createDataFrame(rows, "row_id long, p string, r string")
    one = SC.cider_rows(pairs, "row_id", "p", "r")
    # What is left reads the stored sums; before, n-grams came out of Python as rows, in two readings.
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "array<string>" not in T.FACTS_TYPE.simpleString()
    scores = SC.caption_scores(pairs, "row_id", "p", "r")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "regexp" not in plan
    got = scores.collect()[0].asDict()
    want = SC.corpus_bleu(pairs, "row_id", "p", "r").collect()[0].asDict()
    rouge = [r["rouge_l"] for r in SC.rouge_rows(pairs, "p", "r").collect()]
    want |= {"rouge_l": pytest.approx(sum(rouge) / len(rouge), abs=6e-5), "mean_pred_words": 16.1, "mean_ref_words": 5.8, "empty_predictions": 1}
    cider = [r["cider_d"] for r in one.collect()]
    want["cider_d"] = pytest.approx(sum(cider) / len(cider), abs=6e-5)
    sizes = [[len(T.words_in(r[i])) for r in rows if r[i] is not None] for i in (1, 2)]
    want |= {k: pytest.approx(sum(x) / len(x), abs=0.051) for k, x in zip(("mean_pred_words", "mean_ref_words"), sizes)}
    assert got == want
