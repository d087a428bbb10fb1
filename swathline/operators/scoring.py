"""Accuracy, caption metrics, gates and arm comparison."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions.answers import first_number, format_answer, strip, yes_no
from swathline.functions.tokens import FACTS_TYPE, Vocabulary, clipped_counts, lcs_length, lcs_length_whitespace, ngrams, pair_facts, tokens
from swathline.operators.stats import exact_percentiles
from swathline.session import cut_lineage, stored

# Fixed values of the published metrics.
MAX_ORDER = 4
ORDERS = range(1, MAX_ORDER + 1)
ROUGE_BETA = 1.2
CIDER_SIGMA = 6.0
NUMERIC_TOLERANCE = 0.05
FLOOR_ACCURACY = 0.10
#: n-grams of the reference vocabulary that are broadcast at once: below 100 MB.
VOCABULARY_ROWS = 500_000


def accuracy_by_type(rows: DataFrame, hit: Column, kind: str, run: Sequence[str] = ()) -> DataFrame:
    """Per type: n, correct, accuracy; plus ``overall`` rows carrying both headline numbers."""
    per_type = rows.groupBy(*run, kind).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("correct"))
    per_type = per_type.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))
    overall = per_type.groupBy(*run).agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"),
        F.round(F.avg(F.col("correct") / F.col("n")), 4).alias("average_accuracy"),
    )
    overall = overall.withColumn(kind, F.lit("overall")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))
    return per_type.unionByName(overall, allowMissingColumns=True)


def instruction_following(rows: DataFrame, matched: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col(matched).cast("double")), 4).alias("instruction_following"),
        F.sum((~F.col(matched)).cast("long")).alias("unparsable"),
    )


def all_grams(words: Column) -> Column:
    """Array of (n, gram) for every order."""
    tag = lambda n: F.transform(ngrams(words, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    return F.concat(*[tag(n) for n in ORDERS])


def corpus_bleu(pairs: DataFrame, row: str, prediction: str, reference: str) -> DataFrame:
    """Corpus BLEU with clipped counts and brevity penalty over whole texts.

    Totals follow from token counts. Clipping only concerns n-grams a row shares with its own reference, so it is
    counted inside the row; what is shuffled is a few sums.
    """
    p, r = tokens(F.col(prediction)), tokens(F.col(reference))
    return summed_bleu(pairs.select(F.size(p).alias("np"), F.size(r).alias("nr"), clipped_counts(prediction, reference).alias("clip")))


def summed_bleu(rows: DataFrame) -> DataFrame:
    """Corpus BLEU from the rows' numbers of words, ``np`` and ``nr``, and their clipped counts ``clip``."""
    joined = rows.agg(
        F.coalesce(F.sum(F.col("np").cast("long")), F.lit(0)).alias("pred_len"), F.coalesce(F.sum(F.col("nr").cast("long")), F.lit(0)).alias("ref_len"),
        *[F.sum(F.greatest(F.col("np") - (n - 1), F.lit(0)).cast("long")).alias(f"t{n}") for n in ORDERS],
        *[F.coalesce(F.sum(F.col("clip")[n - 1]), F.lit(0)).alias(f"c{n}") for n in ORDERS],
    )
    precision = [F.when(F.col(f"t{n}") > 0, F.col(f"c{n}") / F.col(f"t{n}")).otherwise(0.0) for n in ORDERS]
    smallest = F.least(*precision)
    logs = sum((F.log(F.when(p > 0, p)) for p in precision), F.lit(0.0)) / MAX_ORDER
    penalty = F.when(F.col("pred_len") > F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest("pred_len", F.lit(1))))
    return joined.select(
        *[F.round(p, 4).alias(f"bleu_{n}") for n, p in enumerate(precision, start=1)],
        F.when(smallest > 0, F.round(penalty * F.exp(logs), 4)).otherwise(0.0).alias("bleu"),
        F.when(smallest > 0, F.round(penalty, 4)).otherwise(0.0).alias("brevity_penalty"),
    )


def rouge_rows(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Sentence ROUGE-L F (beta 1.2) and plain F1 on whitespace tokens, per row."""
    sized = pairs.select(
        "*", F.size(tokens(F.col(prediction))).alias("_np"), F.size(tokens(F.col(reference))).alias("_nr"),
        lcs_length(prediction, reference).alias("lcs"),
    )
    return sized.withColumn("rouge_l", rouge_score(F.col("lcs"), F.col("_np"), F.col("_nr"))).drop("_np", "_nr")


def rouge_score(lcs: Column, np: Column, nr: Column) -> Column:
    p, r = F.try_divide(lcs, np), F.try_divide(lcs, nr)
    beta = ROUGE_BETA * ROUGE_BETA
    return F.when(lcs > 0, (1 + beta) * p * r / (r + beta * p)).otherwise(0.0)


def rouge_f1(prediction: Column, reference: Column) -> Column:
    words = lambda t: F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != ""))
    lcs = lcs_length_whitespace(prediction, reference)
    total = words(prediction) + words(reference)
    return F.coalesce(F.try_divide(2 * lcs, total), F.lit(0.0))


def idf_table(pairs: DataFrame, reference: str) -> DataFrame:
    """``n, g, idf`` of the references' n-grams; frequency is over distinct references weighted by how many rows use them."""
    docs = pairs.agg(F.log(F.greatest(F.count("*"), F.lit(1)).cast("double")).alias("log_n"))
    refs = pairs.groupBy(F.col(reference).alias("ref")).agg(F.count("*").alias("uses"))
    grams = refs.select("uses", F.explode(F.array_distinct(all_grams(tokens(F.col("ref"))))).alias("h"))
    return (
        grams.groupBy("h.n", "h.g").agg(F.sum("uses").alias("df")).crossJoin(docs)
        .select("n", "g", (F.col("log_n") - F.log(F.col("df").cast("double"))).alias("idf"))
    )


def facts_with(vocabulary: DataFrame, prediction: str, reference: str, whole: bool = False) -> Column:
    """:func:`pair_facts` with the n-grams of ``vocabulary``, which go to every task."""
    table = vocabulary.select("g", "idf").toArrow()
    given = vocabulary.sparkSession.sparkContext.broadcast(Vocabulary(dict(zip(table["g"].to_pylist(), table["idf"].to_pylist()))))

    @F.pandas_udf(FACTS_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for first, second in batches:
            made = [pair_facts(p, r, given.value, whole) for p, r in zip(first, second)]
            yield pd.DataFrame(made, columns=FACTS_TYPE.names, dtype=object)

    return run(prediction, reference)


def caption_facts(pairs: DataFrame, row: str, prediction: str, reference: str, whole: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The rows' facts, each text read once for them, and by vocabulary slice ``row, n`` and the sums over n-grams of the slice.

    The vocabulary goes to the texts, in broadcast slices of at most ``VOCABULARY_ROWS``, each with a reading of its own; a
    row's n-grams are weighed where they are counted, so none leaves its task and only five sums per order do.
    """
    vocabulary = cut_lineage(idf_table(pairs, reference))
    slices = max(1, -(-vocabulary.count() // VOCABULARY_ROWS))
    place = F.pmod(F.xxhash64("n", "g"), F.lit(slices))
    read = lambda i: pairs.select(row, facts_with(vocabulary.where(place == i), prediction, reference, whole and not i).alias("c"))
    facts = stored(read(0).select(row, "c.*"))
    rows = [facts, *[read(i).select(row, "c.*") for i in range(1, slices)]]
    return facts, [by_order(r, [row], ["known_sq", "known2", "dot", "nr2"]) for r in rows]


def by_order(rows: DataFrame, keep: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``keep``, ``n`` and one entry of each array of ``sums`` per row and order."""
    spread = rows.select(*keep, F.posexplode(F.arrays_zip(*sums)).alias("n", "h"))
    return spread.select(*keep, (F.col("n") + 1).alias("n"), *[f"h.{x}" for x in sums])


def cider_rows(pairs: DataFrame, row: str, prediction: str, reference: str) -> DataFrame:
    """CIDEr-D per row.

    An n-gram outside the reference vocabulary has idf log N, so its share of a prediction's norm follows from
    the in-row sum of squared counts.
    """
    docs = pairs.agg(F.log(F.greatest(F.count("*"), F.lit(1)).cast("double")).alias("log_n"))
    return summed_cider(*caption_facts(pairs, row, prediction, reference), docs, row)


def summed_cider(facts: DataFrame, parts: Sequence[DataFrame], docs: DataFrame, row: str) -> DataFrame:
    sums = ["known_sq", "known2", "dot", "nr2"]
    per_order = reduce(lambda a, b: a.unionByName(b), parts).groupBy(row, "n").agg(*[F.sum(c).alias(c) for c in sums])
    squares = by_order(facts, [row, "np", "nr"], ["sq"])
    scored = squares.join(per_order, [row, "n"], "left").join(F.broadcast(docs))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    np2 = (F.col("sq") - F.coalesce("known_sq", F.lit(0))) * F.col("log_n") * F.col("log_n") + zero("known2")
    cosine = F.when((np2 > 0) & (zero("nr2") > 0), zero("dot") / (F.sqrt(np2) * F.sqrt(zero("nr2")))).otherwise(0.0)
    gap = F.col("np") - F.col("nr")
    summed = scored.groupBy(row, "np", "nr").agg(F.sum(cosine).alias("total"))
    score = F.exp(-(gap * gap) / (2 * CIDER_SIGMA * CIDER_SIGMA)) * 10.0 * F.col("total") / MAX_ORDER
    return summed.select(row, F.when((F.col("np") > 0) & (F.col("nr") > 0), score).otherwise(0.0).alias("cider_d"))


def caption_scores(pairs: DataFrame, row: str, prediction: str, reference: str) -> DataFrame:
    """BLEU, ROUGE-L and CIDEr-D and lengths side by side; every input is a single row. The texts are read once for all of them."""
    facts, parts = caption_facts(pairs, row, prediction, reference, whole=True)
    docs = facts.agg(F.log(F.greatest(F.count("*"), F.lit(1)).cast("double")).alias("log_n"))
    rouge = facts.agg(F.round(F.avg(rouge_score(F.col("lcs"), F.col("np"), F.col("nr"))), 4).alias("rouge_l"))
    cider = summed_cider(facts, parts, docs, row).agg(F.round(F.avg("cider_d"), 4).alias("cider_d"))
    lengths = facts.agg(
        F.round(F.avg("np"), 1).alias("mean_pred_words"), F.round(F.avg("nr"), 1).alias("mean_ref_words"),
        F.sum((F.col("np") == 0).cast("long")).alias("empty_predictions"),
    )
    return summed_bleu(facts).crossJoin(rouge).crossJoin(cider).crossJoin(lengths)


def numeric_accuracy(rows: DataFrame, run: Sequence[str], prediction: str, reference: str, tolerance: float = NUMERIC_TOLERANCE) -> DataFrame:
    """Relative-tolerance accuracy on the first number; unparsable is wrong, the median is the upper one."""
    got, want = first_number(F.col(prediction)), first_number(F.col(reference))
    scored = rows.select(*run, got.alias("got"), want.alias("want")).withColumn(
        "error", F.abs(F.col("got") - F.col("want")) / F.when(F.col("want") != 0, F.abs("want")).otherwise(1.0)
    )
    counts = scored.groupBy(*run).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col("error") <= tolerance, F.lit(False)).cast("long")).alias("hits"),
        F.sum(F.col("got").isNull().cast("long")).alias("unparsable"),
    )
    middle = exact_percentiles(scored, run, "error", {"median_relative_error": 0.5}, nearest_rank=True).drop("n")
    return counts.join(middle, list(run), "left").select(
        *run, "n", F.round(F.col("hits") / F.col("n"), 4).alias("accuracy"), "unparsable",
        F.round("median_relative_error", 4).alias("median_relative_error"),
    )


def gate_table(scores: DataFrame, targets: Mapping[str, float], name: str, score: str) -> DataFrame:
    """Score against its target; a missing score is 'not run'."""
    literal = F.array(*[F.struct(F.lit(k).alias(name), F.lit(float(t)).alias("target")) for k, t in targets.items()])
    table = scores.sparkSession.range(1).select(F.explode(literal).alias("t")).select("t.*")
    verdict = F.when(F.col(score).isNull(), "not run").when(F.col(score) >= F.col("target"), "PASS").otherwise("FAIL")
    return table.join(scores.select(name, score), name, "left").withColumn("verdict", verdict)


def arm_comparison(rows: DataFrame, arm: str, kind: str, hit: Column, base: str) -> DataFrame:
    """Average accuracy per arm, its delta to the base arm, and no verdict at the noise floor."""
    per_type = rows.groupBy(arm, kind).agg(F.avg(hit.cast("double")).alias("a"), F.count("*").alias("n"))
    arms = per_type.groupBy(arm).agg(F.sum("n").alias("samples"), F.avg("a").alias("average"))
    reference = arms.where(F.col(arm) == base).select(F.col("average").alias("base_average"))
    delta = F.col("average") - F.col("base_average")
    verdict = (
        F.when(F.greatest("average", "base_average") < FLOOR_ACCURACY, "no verdict")
        .when(delta >= 0.02, "better").when(delta <= -0.005, "worse").otherwise("within noise")
    )
    return arms.crossJoin(reference).select(
        arm, "samples", F.round("average", 4).alias("average_accuracy"), F.round(delta, 4).alias("delta"), verdict.alias("verdict")
    )


def replay_merge(items: DataFrame, run: DataFrame, best_iou: DataFrame) -> DataFrame:
    """Pass rule by contract on replayed rows, folded back so that statuses are earned.

    ``items(sample_id, question, answer, contract, floor, status)``. A box passes by its best IoU, a caption
    if its ROUGE-L reaches the item's own floor (0 without one), yes or no by the binary reading; any other
    contract is formatted by its own rule, and without a contract the texts are compared as they are.
    Items the run did not touch keep their status, and ``scored`` items never become a verdict.
    """
    joined = items.join(run.withColumn("_ran", F.lit(True)), "sample_id", "left").join(best_iou, "sample_id", "left")
    # Only captions are worth the longest common subsequence.
    caption = lambda c: F.when(F.col("contract") == "rouge_l", c)
    joined = joined.withColumn("_rouge", rouge_f1(strip(caption(F.coalesce("prediction", F.lit("")))), strip(caption(F.col("answer")))))
    text, gold = strip(F.coalesce("prediction", F.lit(""))), F.lower(strip(F.col("answer")))
    own = format_answer(F.col("contract"), text, F.col("question"))[0]
    passed = (
        F.when(F.col("contract") == "box_iou_0.5", F.coalesce(F.col("best") >= 0.5, F.lit(False)))
        .when(F.col("contract") == "rouge_l", F.col("_rouge") >= F.coalesce("floor", F.lit(0.0)))
        .when(F.col("contract") == "yes_no", F.lower(strip(yes_no(text)[0])) == gold)
        .when(F.coalesce("contract", F.lit("")) == "", F.lower(text) == gold)
        .otherwise(F.coalesce(F.lower(strip(own)) == gold, F.lit(False)))
    )
    verdict = F.when(F.col("_ran"), passed)
    status = (
        F.when(verdict.isNull() | (F.col("status") == "scored"), F.col("status"))
        .when(verdict, "verified").otherwise("failed")
    )
    return joined.select("sample_id", "contract", verdict.alias("passed"), status.alias("status"))
