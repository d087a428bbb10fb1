"""Notices wrapped over lines."""

from __future__ import annotations

from swathline.llm import licences


def test_hints_wrapped_over_lines_are_found(spark):
    texts = [
        "This work is dedicated to the public\ndomain.",
        "This is free and unencumbered software released into the  public\n\tdomain.",
        "All rights\nreserved",
        "All rights-reserved.",
        "A public debate. Domain names.",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["sentences"]) for r in licences.scan(df).collect()}
    assert got == {0: ("", "public-domain"), 1: ("Unlicense", "unlicense-grant"), 2: ("", "reserved"), 3: ("", "reserved"), 4: ("", ""), 5: ("", "")}


def test_every_sentence_holds_a_hint():
    assert all(any(h in s for h in licences.HINTS) for s in licences.SENTENCES)
