"""Names inside the values of other attributes hide nothing."""

from __future__ import annotations

from swathline.llm import html_text


def test_values_are_not_read_as_attributes(spark):
    shown = ["style=\"overflow: hidden\"", "title='the hidden gem'", "data-x=\" class='sidebar'\"", "alt = \"x id=footer y\" class=story", "data-u=/a/hidden"]
    gone = ["hidden", "class=\"a\"hidden", "title='x' HIDDEN=''", "aria-hidden = true", "title=\"a b\" class='x sidebar'", "id=footer", "x=\"1\" role=navigation"]
    pages = [f"<body><article {a}><p>Some text.</p></article></body>" for a in shown + gone]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = [r["text"] for r in html_text.extract(df).orderBy("page_id").collect()]
    assert got == ["Some text."] * len(shown) + [""] * len(gone)
