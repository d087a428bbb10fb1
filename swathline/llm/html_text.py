"""Main text of web pages: blocks judged by stop words, length and links, doubtful ones by their neighbours."""

from __future__ import annotations

import html as references
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is never text of the page.
UNREAD = "script|style|noscript|template|svg|math|iframe|object|canvas|select|textarea|button|title|xmp|noframes"
#: Elements that start and end a block. The second group is furniture, the third holds the main text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
MAIN = {"article", "main"}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
#: Words of class, id and role attributes that name furniture.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments"
    " commentlist consent contentinfo complementary cookie cookies copyright discussion disqus footer gdpr header login masthead"
    " menu modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination popup promo promoted"
    " promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe"
    " subscription teaser toolbar widget".split()
)
STOP_WORDS = set(
    # English, German, French, Spanish: articles, prepositions, conjunctions, pronouns and auxiliaries.
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into"
    " is it its me more my no not of on one or our out she so some than that the their them then there these they this to up us"
    " was we were what when which who will with would you your"
    " aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im"
    " in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn wie wir wird zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur leurs lui mais ne nous on ou où par pas"
    " plus pour qu que qui sa se ses son sont sur un une vous"
    " al algo como con cual cuando de del donde el ella en entre era es esta este ha hay la las le lo los más mi muy no nos o para"
    " pero por que se si sin sobre son su sus también un una y ya".split()
)
#: Thresholds: most of a block's characters that links may hold, characters of a short and of a long block, stop word densities.
LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.33, 70, 200, 0.15, 0.30

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNREAD})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: Every attribute in order, name and value, so that nothing inside a value is read as a name.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
READ = {"class", "id", "role", "hidden", "aria-hidden"}
SPACE = re.compile(r"\s+")

BLOCKS = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType())]
        + [T.StructField(x, T.IntegerType()) for x in ("chars", "linked", "words", "stops")]
        + [T.StructField(x, T.BooleanType()) for x in ("furniture", "main")]
    )
)


def is_furniture(tag: str, attributes: str, within_main: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not within_main):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name not in READ:
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        names = set(re.split(r"[\s_-]+", value)) & NAMES
        # A heading of the article itself is often called its header.
        if names - ({"header"} if within_main or tag == "article" else set()):
            return True
    return False


def read_blocks(html: str | None) -> list[dict]:
    """Blocks of a page in order, with what the rules look at. Broken markup ends where the next element starts."""
    found: list[dict] = []
    parts: list[tuple[str, bool]] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, furniture, main
    links = 0

    def flush() -> None:
        text = SPACE.sub(" ", "".join(x for x, _ in parts)).strip()
        if text:
            linked = len(SPACE.sub(" ", "".join(x for x, link in parts if link)).strip())
            words = re.findall(r"\w+", text.lower())
            furniture, main = (open_tags[-1][1], open_tags[-1][2]) if open_tags else (False, False)
            found.append({"text": text, "chars": len(text), "linked": linked, "words": len(words),
                          "stops": sum(w in STOP_WORDS for w in words), "furniture": furniture, "main": main})
        parts.clear()

    at = 0
    html = html or ""
    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append((references.unescape(html[at : m.start()]), links > 0))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = max(0, links + (-1 if m[2] else 1))
        if tag == "br":
            parts.append((" ", False))
        if m[2]:
            if tag in BLOCK:
                flush()
                links = 0
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
            continue
        if tag in BLOCK:
            flush()
            links = 0
            while open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] not in BLOCK or open_tags[-1][0] == tag == "li"):
                open_tags.pop()
        if tag in VOID:
            continue
        furniture, main = (open_tags[-1][1], open_tags[-1][2]) if open_tags else (False, False)
        own = is_furniture(tag, m[4], main)
        if tag in BLOCK or own:
            if tag in MAIN and not own and not any(x[0] in FURNITURE for x in open_tags):
                # A wrapper's class, such as "with sidebar", says nothing about the article in it.
                furniture = main and furniture
                main = True
            open_tags.append((tag, furniture or own, main))
    if at < len(html):
        parts.append((references.unescape(html[at:]), links > 0))
    flush()
    return found


@F.pandas_udf(BLOCKS)
def blocks_of(html: pd.Series) -> pd.Series:
    return html.map(read_blocks, na_action=None)


def first_pass(blocks: Column) -> Column:
    """1 good, 0 bad, 2 probably good, 3 too short or without stop words to tell; from each block alone.

    Where a page marks an article, what lies outside it isn't main text, and inside it missing stop words only leave doubt.
    """
    marked = F.exists(blocks, lambda b: b["main"] & ~b["furniture"])
    words = lambda b: F.greatest(b["words"], F.lit(1))
    return F.transform(
        blocks,
        lambda b: F.when(b["furniture"] | (marked & ~b["main"]), 0)
        .when(b["linked"] > b["chars"] * LINKS, 0)
        .when(~b["main"] & b["text"].contains("©"), 0)
        .when(b["chars"] < SHORT, F.when(~b["main"] & (b["linked"] > 0), 0).otherwise(3))
        .when(b["stops"] >= words(b) * MANY_STOPS, F.when(b["chars"] >= LONG, 1).otherwise(2))
        .when(b["stops"] >= words(b) * FEW_STOPS, 2)
        .when(b["main"], 3)
        .otherwise(0),
    )


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def second_pass(labels: pd.Series, main: pd.Series) -> pd.Series:
    """Doubtful blocks take the label of the nearest decided one. Where two equally near ones differ, the one that follows counts, as
    headings belong to what follows; blocks that are probably good, or in the article, are kept.

    The ends of the page count as decided: good for a block of the article, bad elsewhere. Furniture inside an article,
    already 0 there, is left out of the reckoning by ``main`` being false.
    """

    def one(label, inside) -> list[bool]:
        if label is None:
            return []
        n = len(label)
        left, right, last = [None] * n, [None] * n, None
        for i in range(n):
            left[i] = last
            if label[i] < 2:
                last = i
        last = None
        for i in range(n - 1, -1, -1):
            right[i] = last
            if label[i] < 2:
                last = i
        out = []
        for i in range(n):
            if label[i] < 2:
                out.append(bool(label[i] == 1))
                continue
            edge = bool(inside[i])
            sides = []
            for j, end in ((left[i], i + 1), (right[i], n - i)):
                # A decided block outside the article is that article's edge.
                known = edge if j is None or (edge and not inside[j]) else bool(label[j] == 1)
                sides.append((end if j is None else abs(i - j), known))
            (a, x), (b, y) = sides
            out.append(x if x == y or a < b else y if b < a else y or label[i] == 2 or edge)
        return out

    return pd.Series([one(a, b) for a, b in zip(labels, main)])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) for every row of ``pages``.

    A page is one row from reading to joining, so nothing is shuffled and a task holds one Arrow batch. NULL and empty pages,
    and pages without a good block, give an empty text. Character references are decoded, white space inside a block becomes
    one space, blocks are joined by two newlines; ``<br>`` is white space. Repeated rows give repeated results.
    """
    read = pages.select(*keep, blocks_of(F.col(html)).alias("_blocks"))
    judged = read.withColumn(
        "_good", second_pass(first_pass(F.col("_blocks")), F.transform("_blocks", lambda b: b["main"] & ~b["furniture"]))
    )
    kept = F.filter(F.arrays_zip(F.col("_blocks.text").alias("text"), F.col("_good").alias("good")), lambda x: x["good"])
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n")
    return judged.select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
