"""The text pipeline, and its queries against their SQL."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402

from swathline.llm import decontaminate, mixing, toxicity  # noqa: E402
from swathline.llm.common import words_of  # noqa: E402
from swathline.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


class Entry:
    def __init__(self, name):
        self.build, self.sql = QUERIES[name], ORACLE_SQL.get(name)

    def __call__(self, spark, folder):
        return self.build(spark, folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    status, message = compare(spark, Entry(name), FOLDER, connect(FOLDER))
    assert status in ("ok", "rows") and not message.startswith("0 rows"), f"{status} {message}"


def test_pipeline_replayed_row_by_row(spark):
    """Each stage's decisions, taken on collected rows from what the operator says of single documents."""
    from test_operators import plain_base
    from test_resemblance import plain_kept

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = [r for r in docs.orderBy("doc_id").collect() if model.score_text(r["text"]) < toxicity.LIMIT]
    stay = set(plain_kept([(r["doc_id"], r["text"]) for r in rows]))
    assert len(stay) < len(rows)
    rows = [r for r in rows if r["doc_id"] in stay]
    kept = spark.createDataFrame(rows, docs.schema)
    leaks = {r["doc_id"] for r in decontaminate.contaminated(kept, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert leaks
    rows = [r for r in rows if r["doc_id"] not in leaks]
    want = {}
    for r in rows:
        text = r["text"]
        spans = [s.split(":") for s in plain_base(text).split(",") if s]
        if spans:
            out, done = "", 0
            for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in spans), key=lambda s: (s[1], -s[2])):
                if a >= done:
                    out += text[done:a] + f"[{kind.upper()}]"
                done = max(done, b)
            text = out + text[done:]
        want[r["doc_id"]] = (text, r["lang"], r["source"], len(text))
    masked = spark.createDataFrame([(k, *v) for k, v in want.items()], docs.schema)
    plan = mixing.repetition_plan(masked, words_of(masked["text"]))
    times = {r["doc_id"]: r["copies"] for r in plan.collect()}
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter(r["doc_id"] for r in got) == Counter({k: n for k, n in times.items() if n})
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == 0
