"""Personal data: fixed patterns give seeds, and contexts bootstrapped from them find identifiers the patterns miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.llm.common import sized, stored, unused
from swathline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: A context needs so many different seeds of one kind; the share of its occurrences that an identifier must follow; rounds of
#: scoring; the score from which a context or an identifier is believed.
SEEDS, PRECISION, ROUNDS, BELIEF = 3, 0.5, 3, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits could start at the run, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a bootstrapped identifier looks like: a word of at least four characters with a digit or an at sign.
LIKELY = re.compile(r"(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]{4,}")
TRIM = ".,;:!?()[]{}<>\"'"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, at sign, dotted domain; found from the at signs, so a long word costs its length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The spans of the four fixed patterns, by start and then by kind."""
    if not text:
        return []
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words_before(text: str, start: int) -> list[str]:
    """The last two words before ``start``, whole however long they are."""
    size = 80
    while True:
        begin = max(0, start - size)
        found = WORD.findall(text, begin, start)
        # A third word stands between the two and the place where reading began, which may be inside a word.
        if begin == 0 or len(found) > 2:
            return found[-2:]
        size *= 4


def candidates(text: str, base: list[Span]) -> list[tuple[str | None, int, int, str, str, str]]:
    """Seeds and likely identifiers ``(kind, start, end, value, word before, two words before)`` of a text."""
    found: list[tuple[str | None, int, int]] = list(base)
    at = 0
    for m in LIKELY.finditer(text):
        word = m[0]
        start = m.start() + len(word) - len(word.lstrip(TRIM))
        end = m.end() - (len(word) - len(word.rstrip(TRIM)))
        while at < len(base) and base[at][2] <= start:
            at += 1
        # Spans of different kinds may nest, so a few more are looked at.
        if end - start >= 4 and not any(a < end and start < b for _, a, b in base[max(0, at - 3) : at + 4]):
            found.append((None, start, end))
    out = []
    for kind, start, end in found:
        before = words_before(text, start)
        last = before[-1].lower() if before else ""
        out.append((kind, start, end, text[start:end], last, f"{before[0].lower()} {last}" if len(before) == 2 else ""))
    return out


ROW = (
    "id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base string,"
    " found array<struct<kind:string,start:int,stop:int,value:string,one:string,two:string>>"
)


def read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Base spans, and the candidates for bootstrapping, of every row; ``mark`` is a hash of the text and names rows with ``id``.

    Only texts with a digit or an at sign go to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row_id, mark, t in zip(batch["id"], batch["mark"], batch["text"]):
                base = base_spans(t)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((row_id, mark, *counts, written(base), candidates(t, base) if t else []))
            yield pd.DataFrame(out, columns=["id", "mark", *[f"n_{k}" for k in KINDS], "base", "found"]).astype({"id": "Int64"})

    some = F.when(F.col(text).rlike("[0-9@]"), F.col(text)).alias("text")
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), some).mapInPandas(run, ROW)


def context_counts(docs: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """``(pattern, uses)``: how often each context stands in all texts before a further word."""
    word = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
    words = docs.select(word.alias("w"))
    pairs = words.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(0))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(0))).alias("c"))))
    # A context of two words is (a, b) before c; one of one word is a before b.
    used = pairs.select(
        F.explode(F.array(F.when(F.col("b").isNotNull(), F.col("a")), F.when(F.col("c").isNotNull(), F.concat_ws(" ", "a", "b")))).alias("pattern")
    )
    return used.join(sized(contexts.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("uses"))


def discovered(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame | None:
    """``(id, mark, kind, start, stop)`` of identifiers found by context alone, or None where no context has enough seeds.

    A lexical pattern is the word or the two words before an identifier. Patterns with enough different seeds of a kind are
    counted in all texts and kept if an identifier follows often enough. Then patterns and identifiers score each other: a
    pattern by the mean score of its identifiers, an identifier that is no seed by the chance that any of its patterns is
    right; seeds score 1. The graph's edges are distinct pairs, so a common identifier or pattern moves once per partner.
    """
    cand = rows.select("id", "mark", F.inline("found"))
    pattern = F.explode(F.array(F.col("one"), F.col("two"))).alias("pattern")
    placed = cand.select("id", "mark", "kind", "start", "stop", "value", pattern).where("pattern <> ''")
    seeds = placed.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.countDistinct("value").alias("n"))
    strong = seeds.groupBy("pattern").agg(F.max(F.struct("n", "kind")).alias("m")).where(F.col("m.n") >= SEEDS)
    strong = cut_lineage(strong.select("pattern", F.col("m.kind").alias("pattern_kind")))
    if strong.isEmpty():
        return None
    strong_ = sized(strong)
    inside = stored(placed.join(strong_, "pattern"))
    uses = context_counts(docs, text, strong)
    precise = inside.groupBy("pattern").agg(F.count("*").alias("hits")).join(sized(uses), "pattern")
    precise = cut_lineage(precise.where(F.col("hits") >= F.col("uses") * PRECISION).select("pattern"))
    if precise.isEmpty():
        return None
    inside = inside.join(sized(precise), "pattern", "left_semi")
    seed = F.max(F.when(F.col("kind") == F.col("pattern_kind"), 1.0).otherwise(0.0)).alias("seed")
    edges = cut_lineage(inside.groupBy("pattern", "value").agg(seed))
    belief = edges.groupBy("value").agg(F.max("seed").alias("score"))
    for _ in range(ROUNDS):
        trust = edges.join(belief, "value").groupBy("pattern").agg(F.avg("score").alias("trust"))
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("trust"), F.lit(0.999)))))
        belief = edges.join(trust, "pattern").groupBy("value").agg(F.greatest(F.max("seed"), F.lit(1.0) - doubt).alias("score"))
        belief = cut_lineage(belief)
    trust = cut_lineage(edges.join(belief, "value").groupBy("pattern").agg(F.avg("score").alias("trust")).where(F.col("trust") >= BELIEF))
    new = inside.where("kind IS NULL").join(sized(trust.select("pattern")), "pattern", "left_semi")
    new = new.join(belief.where(F.col("score") >= BELIEF).select("value"), "value", "left_semi")
    return new.groupBy("id", "mark", "start", "stop").agg(F.min("pattern_kind").alias("kind"))


def by_row(found: DataFrame) -> DataFrame:
    """Discovered spans gathered by row; a text has no more of them than words."""
    span = F.struct("start", "stop", "kind")
    return found.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_set(span)).alias("_more"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs``.

    Counts and digest are of the base spans; ``spans`` holds these and the discovered ones as ``kind:start:end`` by start and
    kind. Texts are read in whole, once for spans and once for the use of contexts, and never shuffled. NULL and empty texts
    have no spans; repeated rows have the same.
    """
    rows = stored(read(docs, key, text))
    found = discovered(docs, rows, text)
    out = rows.select("id", "mark", *[f"n_{k}" for k in KINDS], "base")
    digest = F.sha2("base", 256).alias("base_sha256")
    if found is None:
        return out.select(F.col("id").alias(key), *[f"n_{k}" for k in KINDS], digest, F.col("base").alias("spans"))
    out = out.join(sized(by_row(found)), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    place = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), place(F.split_part(s, F.lit(":"), F.lit(1))).alias("rank"), s.alias("s")))
    more = F.transform(F.coalesce("_more", F.array().cast("array<struct<start:int,stop:int,kind:string>>")), lambda m: F.struct(
        m["start"].alias("start"), place(m["kind"]).alias("rank"), F.concat_ws(":", m["kind"], m["start"], m["stop"]).alias("s")))
    every = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x["s"]), ",")
    return out.select(F.col("id").alias(key), *[f"n_{k}" for k in KINDS], digest, F.when(F.col("_more").isNull(), F.col("base")).otherwise(every).alias("spans"))


def masked(text: Column, more: Column) -> Column:
    """``text`` with every base span and every span of ``more`` replaced by its kind in brackets; overlapping ones become one."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for t, e in zip(texts, extra):
            if not isinstance(t, str):
                out.append(None)
                continue
            own = base_spans(t) + [(s["kind"], s["start"], s["stop"]) for s in (e if e is not None else [])]
            parts, done = [], 0
            for kind, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
                if a >= done:
                    parts += [t[done:a], f"[{kind.upper()}]"]
                done = max(done, b)
            out.append("".join([*parts, t[done:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return run(text, more)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text`` and, where that column is there, ``length`` set to the new length."""
    rows = stored(read(docs, key, text))
    found = discovered(docs, rows, text)
    empty = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    names = docs.columns
    if found is not None:
        own, mark, spans = (unused(docs, n) for n in ("_id", "_mark", "_more"))
        more = by_row(found).withColumnsRenamed({"_id": own, "_mark": mark, "_more": spans})
        # A hash of the text as the second key, so rows that share an id are told apart.
        docs = docs.join(sized(more), F.col(key).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(mark)), "left")
        empty = F.coalesce(F.col(spans), empty)
    clean = F.when(F.col(text).rlike("[0-9@]"), masked(F.col(text), empty)).otherwise(F.col(text))
    made = unused(docs, "_clean")
    out = docs.withColumn(made, clean)
    return out.select(*[
        F.col(made).alias(text) if n == text
        else F.coalesce(F.length(made).cast("long"), F.col(n)).alias(n) if n == length
        else F.col(n)
        for n in names
    ])
