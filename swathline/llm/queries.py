"""The registered queries of the text operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm import bottomk, collocations, decontaminate, html_text, kneser_ney, licences, masked_lm, mixing, pii, prefix_trie, simhash, substrings, toxicity
from swathline.llm.common import table, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return wrap


@register(
    "op8_mix_sources",
    r"""
    WITH sizes AS (
      SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    per AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS cap,
        1.5::DOUBLE * SUM(source_size) OVER () AS total FROM per),
    weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM ranked),
    trial AS (
      SELECT a.place, (a.total - COALESCE(SUM(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight
          OR (b.cap / b.weight = a.cap / a.weight AND b.place < a.place)), 0))
        / SUM(b.weight) FILTER (b.cap / b.weight > a.cap / a.weight
          OR (b.cap / b.weight = a.cap / a.weight AND b.place >= a.place)) AS level
      FROM weighed a CROSS JOIN weighed b GROUP BY a.place, a.total, a.cap, a.weight),
    chosen AS (SELECT MAX(t.level) AS level FROM trial t JOIN weighed w USING (place) WHERE t.level * w.weight <= w.cap),
    targets AS (
      SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE LEAST(cap, level * weight) END AS target
      FROM weighed CROSS JOIN chosen),
    rated AS (
      SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || COALESCE(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS share
      FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      ((floor(rate) + CASE WHEN share < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM rated
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.repetition_plan(table(spark, sf_dir, "documents"), words_of(F.col("text")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def licence_sql() -> str:
    """The scan as joins of exploded sentences with the tables of sentences and rules."""
    rules = licences.RULES
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda items: ", ".join("(" + ", ".join(map(str, i)) + ")" for i in items)
    said = lambda ids: ";" + "(?:[^;]*;)*?".join(f"{x}@[^;]*;" for x in ids)
    wider = [(i, j) for i, (_, a) in enumerate(rules) for j, (_, b) in enumerate(rules[:i]) if set(a) <= set(b)] or [(-1, -1)]
    whole = lambda t: rf"regexp_replace(regexp_replace({t}, '\b([vV])\.[ \t]+([0-9])', '\1.\2', 'g'), '(License-Identifier):[ \t]*', '\1-', 'g')"
    cut = lambda t: rf"string_split(regexp_replace({whole(t)}, '([.!?;:])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10))"
    running = f"regexp_replace(regexp_replace(text, '{licences.EMPTY_LINE}', '.' || chr(10), 'g'), '{licences.LINE_BREAK}', ' ', 'g')"
    return rf"""
    WITH known(sentence, id) AS (VALUES {rows((text(s), text(i)) for s, i in licences.SENTENCES.items())}),
    rules(rule, name, pattern, version_at) AS (VALUES {rows((i, text(n), text(said(x)), text(licences.version_place(x))) for i, (n, x) in enumerate(rules))}),
    wider(rule, other) AS (VALUES {rows(wider)}),
    numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    readings AS (
      SELECT rid, 0 AS reading, {cut("text")} AS parts FROM numbered
      UNION ALL SELECT rid, 1, {cut(running)} FROM numbered),
    sentences AS (SELECT rid, reading, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM readings),
    plain AS (
      SELECT rid, reading, place, trim(regexp_replace(regexp_replace(regexp_replace(
        lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g'), '(^| )\.+', '\1', 'g')) AS s FROM sentences),
    marked AS (
      SELECT p.rid, p.reading, p.place, k.id, regexp_extract(p.s, '\b([0-9]+(\.[0-9]+)*)\b', 1) AS version
      FROM plain p JOIN known k ON k.sentence = regexp_replace(p.s, '\b[0-9]+(\.[0-9]+)*\b', '*', 'g')),
    sequences AS (
      SELECT rid, reading, ';' || string_agg(id || '@' || version, ';' ORDER BY place) || ';' AS seq,
        string_agg(id, ' ' ORDER BY place) AS ids, COUNT(*) AS n FROM marked GROUP BY rid, reading),
    hits AS (SELECT q.rid, q.reading, q.seq, r.* FROM sequences q JOIN rules r ON regexp_matches(q.seq, r.pattern)),
    lead AS (
      SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM wider w JOIN hits o ON o.rule = w.other
        WHERE w.rule = h.rule AND o.rid = h.rid AND o.reading = h.reading)),
    versions AS (SELECT rid, name, unnest(regexp_extract_all(seq, version_at, 1)) AS version FROM lead),
    named AS (
      SELECT DISTINCT rid, CASE WHEN NOT contains(name, '*') THEN name
        ELSE rtrim(split_part(name, '*', 1) || version, '-') || split_part(name, '*', 2) END AS licence FROM versions),
    found AS (
      SELECT rid, string_agg(licence, ',' ORDER BY licence) AS licences FROM named n
      WHERE NOT EXISTS (SELECT 1 FROM named m WHERE m.rid = n.rid AND starts_with(m.licence, n.licence || '-') AND regexp_matches(substr(m.licence, len(n.licence) + 2, 1), '[0-9]'))
      GROUP BY rid),
    best AS (SELECT rid, arg_max(ids, n * 2 - reading) AS ids, MAX(n) AS n FROM sequences GROUP BY rid)
    SELECT d.doc_id, COALESCE(f.licences, '') AS licences, COALESCE(b.ids, '') AS sentences, COALESCE(b.n, 0)::BIGINT AS n_sentences
    FROM numbered d LEFT JOIN found f USING (rid) LEFT JOIN best b USING (rid)
    """


@register("op10_licence_scan", licence_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@register("op9_bottomk_sketch")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.compare_edited(table(spark, sf_dir, "documents"))


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


@register("op5_masked_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_words(table(spark, sf_dir, "documents"))


COLLOCATION_SQL = r"""
    WITH folded AS (
      SELECT COALESCE(lang, 'und') AS lang,
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM folded),
    words AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
    sizes AS (SELECT lang, SUM(len(w))::BIGINT AS n FROM words GROUP BY lang),
    spans AS (
      SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    grams AS (
      SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans, (VALUES (1), (2), (3), (4), (5)) AS lengths(k) WHERE i + k - 1 <= len(w)),
    counts AS (SELECT lang, k, phrase, COUNT(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING COUNT(*) >= 100),
    kept AS (
      SELECT c.lang, c.k, c.phrase, c.f AS a FROM counts c
      WHERE c.k > 1 AND NOT EXISTS (
        SELECT 1 FROM counts o WHERE o.lang = c.lang AND o.k > c.k AND o.f >= c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (
      SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM kept),
    scored AS (
      SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, s.n, c.cut,
        (1000::HUGEINT * c.a * s.n) // (h.f::HUGEINT * t.f) AS score
      FROM cuts c JOIN sizes s USING (lang)
      JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
      JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
    least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
      phrase, a, l, r, n, score::BIGINT AS score
    FROM least QUALIFY rank <= 2000
    """


@register("op11_collocations", COLLOCATION_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
    later AS (
      SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM later),
    spelled AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
    kept AS (
      SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.at) AS kept, COUNT(*) AS n
      FROM spelled s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.at = s.at WHERE g.at IS NULL GROUP BY s.doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - COALESCE(k.n, 0))::BIGINT AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256
    FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
    """


@register("op12_substring_dedup", SUBSTRING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


TRIE_SQL = r"""
    WITH turns AS (
      SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r
      FROM conversations WHERE conv_id IS NOT NULL),
    whole AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY r) AS t FROM turns GROUP BY conv_id),
    hashed AS (
      SELECT conv_id, t, conv_id - conv_id % 20 AS donor,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
      FROM whole),
    rebuilt AS (
      SELECT c.conv_id, list_concat(COALESCE(d.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM hashed c LEFT JOIN whole d ON d.conv_id = c.donor),
    prefixes AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
    nodes AS (
      SELECT t[1:depth] AS path, depth, MIN(conv_id) AS conv_id, COUNT(*)::BIGINT AS n_convs,
        COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = depth), '') AS ends
      FROM prefixes GROUP BY ALL),
    sized AS (
      SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
        path[1:depth - 1] AS above FROM nodes),
    children AS (SELECT above AS path, depth - 1 AS depth, COUNT(*)::BIGINT AS n FROM sized WHERE depth > 0 GROUP BY ALL),
    full_nodes AS (SELECT s.*, COALESCE(c.n, 0) AS n_children FROM sized s LEFT JOIN children c ON c.path = s.path AND c.depth = s.depth),
    lifted AS (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS lvl FROM full_nodes),
    sums AS (
      SELECT path[1:lvl] AS path, lvl AS depth, SUM(saved)::BIGINT AS saved_tokens, COUNT(*) FILTER (n_children = 0)::BIGINT AS n_leaves
      FROM lifted GROUP BY ALL)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
    FROM full_nodes n JOIN sums s ON s.path = n.path AND s.depth = n.depth
    LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.above
    """


@register("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
