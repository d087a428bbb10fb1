"""The text operators against brute force and on odd rows: NULLs, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from swathline.llm import bottomk, decontaminate, graph, html_text, kneser_ney, licences, masked_lm, mixing, pii, resemblance, simhash, symbols, toxicity
from swathline.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (2, None, None, None, None), (3, "", "en", "s2", 0),
        (None, "x y z", "de", "s1", 5), (4, LONG, "en", "s1", len(LONG)), (5, " \n\t", "fr", None, 3), (6, "naïve 🙂 text", "xx", "s2", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "root", "component_id", "score", "label", "copies", "rate", "window", "id", "mark", "base", "_id", "u", "v"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- HTML ---------------------------------------------------------------------------------------------------------------


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "u", h, "mine") for i, h in enumerate(htmls)], "page_id long, url string, html string, text string")


def texts(spark, *htmls):
    return [r["text"] for r in html_text.extract(pages(spark, *htmls)).orderBy("page_id").collect()]


def test_article_without_furniture(spark):
    page = (
        "<html><head><title>No</title><style>p{}</style></head><body class='with-sidebar'><header>Site name</header>"
        "<nav><a href=a>Home</a></nav><div class='cookie notice'>We use cookies</div><div class='page with-sidebar'><article>"
        "<h1>Tea &amp; bread</h1><p>One  two\n three<br>four<p>Unclosed &lt;b&gt; <b>bold</b></p><script>var x='</p>'</script>"
        "<form><p>Sign up</p></form><ul><li>first<li>second</ul><section class='comments'><p>Reader says</p></section><p>End.</p></article>"
        "</div><aside><p>Related</p></aside><footer>&copy; us</footer></body>"
    )
    assert texts(spark, page) == ["Tea & bread\n\nOne two three four\n\nUnclosed <b> bold\n\nfirst\n\nsecond\n\nEnd."]


def test_unmarked_page_goes_by_stop_words_and_neighbours(spark):
    prose = "<p>" + "it was the best of the times and it was the worst of all " * 5 + "</p>"
    links = "<div>" + "<a href=x>section of links</a> " * 6 + "</div>"
    got = texts(spark, f"{links}<p>Menu</p>{links}<h2>A heading</h2>{prose}<p>Short.</p>{prose}{links}<p>Imprint</p>{links}")[0].split("\n\n")
    assert [g[:9] for g in got] == ["A heading", "it was th", "Short.", "it was th"]


def test_equally_near_neighbours(spark):
    """The second pass on labels alone: 1 good, 0 bad, 2 probably good, 3 unknown."""
    df = spark.createDataFrame([([1, 3, 0, 2, 1, 3, 3, 0, 3], [False] * 9), ([3, 0, 3], [True] * 3), ([], [])], "l array<int>, m array<boolean>")
    got = [r[0] for r in df.select(html_text.second_pass("l", "m")).collect()]
    assert got[0] == [True, False, False, True, True, True, False, False, False]  # the second is as near to 1 as to 0
    assert got[1] == [True, False, True] and got[2] == []


def test_odd_pages(spark):
    assert texts(spark, None, "", "<", "&#x41;&eacute;&nbsp;x", "<article>" * 50 + "deep" + "</p>" * 9) == ["", "", "", "", "deep"]
    many = "<article>" + "<p>line of it</p>" * 5_000 + "</article>"
    row = html_text.extract(pages(spark, many)).first()
    assert row["text"].count("\n\n") == 4_999 and row["n_chars"] == len(row["text"])
    assert html_text.extract(pages(spark, "x").limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    """On the supplied pages the article's blocks, cut out by hand, are the text."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", article)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


# --- SimHash ------------------------------------------------------------------------------------------------------------


def plain_simhash(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int]) -> list[int]:
    """For each value the least index that close pairs lead to."""
    root = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 2:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_duplicates_of_the_tables(spark, real):
    rows = real.orderBy("doc_id").collect()
    prints = [plain_simhash(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, plain_components(prints))}
    found = simhash.near_duplicates(real).select("doc_id", simhash.hex_of(F.col("fp")).alias("fp"), "component_id").collect()
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in found} == want
    stay = sorted(r["doc_id"] for r in simhash.first_of_each(real).collect())
    assert stay == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("shard", [4096, 8, 2])
def test_links_lose_no_pair_at_any_shard_size(spark, shard):
    """Crowded fingerprints: chains of 1 and 2 bits, and many that share most of their bits."""
    rng = np.random.default_rng(5)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    centre = 0x0123456789ABCDEF
    for _ in range(120):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)))
    step = 2**63
    for i in range(0, 20, 2):
        step ^= 3 << i
        values.add(step)
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.links(nodes, 2, shard).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {v: v for v in values}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    assert [values.index(root[v]) for v in values] == plain_components(values)


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()
    assert len(rows) == 8
    assert sum(r["fp"] == 0 for r in rows) == 3 and {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    left = simhash.first_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "6", "None"]
    assert simhash.first_of_each(empty).count() == 0


def test_rows_that_share_a_key_keep_one_of_each_component(spark):
    df = spark.createDataFrame([(1, "one two three four"), (1, "quite other words here"), (1, "one two three four"), (2, "quite other words here")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.first_of_each(df).collect()) == ["one two three four", "quite other words here"]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 300), (None, 4)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == 300
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- Toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    test = [r for r in scored if r["held_out"]]
    bad, good = (np.array([r["score"] for r in test if r["toxic"] == x]) for x in (1, 0))
    area = (bad[:, None] > good[None, :]).mean()
    assert area > 0.97 and (bad >= 0.3).mean() > 0.9 and (good >= 0.3).mean() < 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_held_out_labels_are_never_read(spark, real):
    ids = [r["doc_id"] for r in real.select("doc_id").collect()]
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, int(i % 3 == 0)) for i in ids if i not in held]
    one = spark.createDataFrame([*rows, *[(i, 0) for i in held]], "doc_id long, toxic int")
    two = spark.createDataFrame([*rows, *[(i, 1) for i in held]], "doc_id long, toxic int")
    a, b = (toxicity.train(real, x) for x in (one, two))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights) and np.array_equal(a.place, b.place)


def test_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Some words, éé and more " * 30
    whole = np.sort(np.concatenate(list(toxicity.ngrams(text))))
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.array_equal(np.sort(np.concatenate(list(toxicity.ngrams(text)))), whole)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (1, None, "x"), (4, 0, "x"), (None, 1, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(odd, given)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == 8 and all(0.0 <= r["score"] <= 1.0 for r in rows)
        assert toxicity.accepted(odd, model).columns == odd.columns
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


# --- Decontamination ----------------------------------------------------------------------------------------------------


def test_leaks_of_the_tables(spark):
    """A document is reported for an item if it holds enough of the item's five-word windows."""
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", t.lower())
    items = {r["item_id"]: [tuple(words(r["text"])[i : i + 5]) for i in range(len(words(r["text"])) - 4)] for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(r["doc_id"], k) for k, grams in items.items() if grams and sum(g in mine for g in grams) >= len(grams) * decontaminate.COVER}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and got == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


ITEM = "A farmer named Alice sells 12 apples for 3 dollars and walks 5 km to meet Bob, then Alice sells 12 more and Bob pays 3 dollars."


def test_changed_parameters_are_caught_and_inconsistent_ones_not(spark):
    docs = spark.createDataFrame(
        [
            (1, "Intro text. " + ITEM + " More text."),
            (2, ITEM.upper()),
            (3, ITEM.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dan").replace("3", "7.5").replace("5 km", "9 miles")),
            (4, "A farmer named Ann sells 1 apples for 2 dollars and walks 3 km to meet Ben, then Cid sells 4 more and Dee pays 5 dollars."),
            (5, "A farmer sells apples and walks to meet somebody else, who then sells some more of the pears and pays."),
        ],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (7, ITEM)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert sorted(found) == [1, 2, 3] and {r["item_id"] for r in found.values()} == {7}
    assert found[1]["changed_slots"] == 0 and found[3]["changed_slots"] > 3


def test_template_keeps_the_number_of_tokens(spark, real):
    pairs = real.select(decontaminate.tokens(F.col("text")).alias("a"), decontaminate.template(F.col("text")).alias("b")).collect()
    assert all(len(r["a"].split(" ")) == len(r["b"].split(" ")) for r in pairs)
    for t in ("1.5 km, 3.x x.5 1.,2 a1.5b", "", "...", "Mr Smith's 3 Kg", "x ٣ y"):
        r = spark.createDataFrame([(t,)], "t string").select(decontaminate.tokens(F.col("t")), decontaminate.template(F.col("t"))).first()
        assert len(r[0].split(" ")) == len(r[1].split(" ")), (t, r)


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f", "z"), (None, "x y z", "z"), (3, "", "z")], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(odd, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == [(1, 1, 1.0)]
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns and left.count() == 6
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == 8


# --- Language models ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def network(real):
    return masked_lm.train(real)


def test_pseudo_likelihood_is_the_sum_over_masked_words(spark, real, network):
    read, net = network
    for r in masked_lm.score(real, read, net).join(real, "doc_id").limit(20).collect():
        row = read.read(r["text"])[1:]
        total = 0.0
        for left, middle, right in zip(row[:-2], row[1:-1], row[2:]):
            hidden = np.tanh(net.left[left] + net.right[right] + net.inner)
            logits = (hidden @ net.outer + net.prior).astype(float)
            total += logits[middle] - np.log(np.exp(logits).sum()) + read.cost[middle]
        assert r["log_likelihood"] == pytest.approx(total, rel=1e-4) and r["n_words"] == len(r["text"].split())


def test_both_sides_tell_more_than_frequency(spark, real, network):
    read, net = network
    counts = symbols.count_trigrams(real, "text", read).toPandas()
    logs = net.table()[((counts["u"] * symbols.SYMBOLS + counts["v"]) * symbols.SYMBOLS + counts["w"]).to_numpy()]
    often = counts.groupby("v")["n"].sum()
    plain = np.log(often / often.sum())[counts["v"]].to_numpy()
    assert (counts["n"] * logs).sum() > (counts["n"] * plain).sum() + 0.05 * counts["n"].sum()


def test_slopes_of_the_network():
    rng = np.random.default_rng(1)
    net = masked_lm.Network.fresh(rng.integers(0, 9, symbols.SYMBOLS).astype(float))
    for name in ("left", "right", "inner", "outer", "prior"):
        setattr(net, name, getattr(net, name).astype(float))
    left, right = np.array([1, 2, 3]), np.array([4, 4, 5])
    counts = rng.integers(0, 4, (3, symbols.SYMBOLS)).astype(float)
    loss = lambda: -(counts * net.forward(left, right)[1]).sum() / counts.sum()
    for part, slope in zip(net.parts(), net.slopes(left, right, counts)):
        flat = part.reshape(-1)
        at = int(np.abs(slope).argmax())
        flat[at] += 1e-5
        up = loss()
        flat[at] -= 2e-5
        assert slope.reshape(-1)[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3)
        flat[at] += 1e-5


def test_masked_lm_of_odd_rows(spark, odd, empty):
    given = masked_lm.train(odd)
    rows = masked_lm.score(odd, *given).collect()
    assert len(rows) == 8 and all(np.isfinite(r["log_likelihood"]) for r in rows)
    assert sorted(r["n_words"] for r in rows) == [0, 0, 0, 3, 3, 6, 6, 60_000]
    assert masked_lm.score(empty, *masked_lm.train(empty)).count() == 0


def plain_weights(texts):
    """A word's part of its log-probability, by dictionaries: every word has its own."""
    from collections import Counter

    often = Counter(w for t in texts for w in (t or "").split())
    types = Counter(often.values())
    d = min(max(types[1] / (types[1] + 2 * types[2]) / 2, 0.05), 0.5)
    return lambda w: np.log(often[w] - d if often[w] else d)


def plain_words(own, texts, text):
    """Summed log-probability of a text's words among the words of their symbols."""
    weight, words = plain_weights(texts), (text or "").split()
    told = [w for last, w in zip([None, *words], words) if w != last and w not in own.words]
    return sum(weight(w) - own.mass[own.of(w)] for w in told)


def test_masked_lm_tells_words_of_one_outline_apart(spark, real, monkeypatch):
    monkeypatch.setattr(symbols, "NEAR_WORDS", 1000)
    texts = [r["text"] for r in real.collect()]
    own, net = masked_lm.train(real)
    words = masked_lm.score_words(real).join(real, "doc_id").limit(40).collect()
    alike = {r["doc_id"]: r for r in masked_lm.score(real, own, net).collect()}
    for r in words:
        plain = alike[r["doc_id"]]["log_likelihood"] - own.cost[own.read(r["text"])[2:-1]].sum()
        assert r["log_likelihood"] == pytest.approx(plain + plain_words(own, texts, r["text"]), rel=1e-6)
    often = symbols.word_counts(real, "text")
    weights = symbols.weigh(often)
    assert 500 < len(weights.near) <= 1000 and weights.far.count() + len(weights.near) == often.count() > 10_000
    rare, common = "zzqx", next(w for w in weights.near if w not in own.words and symbols.shape(w) == "a")
    pair = spark.createDataFrame([(1, f"the {common} of"), (2, f"the {rare} of"), (2, f"the {rare} of"), (None, None)], "doc_id long, text string")
    a, b, c = sorted((r["log_likelihood"] for r in masked_lm.score(pair, own, net, weights=weights).where("doc_id > 0").collect()), reverse=True)
    assert a > b + 2 and b == c


def test_quality_by_every_word(spark, real, monkeypatch):
    monkeypatch.setattr(symbols, "NEAR_WORDS", 1000)
    labels = real.where("doc_id % 2 = 0").selectExpr("doc_id", "1 AS quality")
    texts = [r["text"] for r in real.where("doc_id % 2 = 0").collect()]
    model = kneser_ney.train(real.where("doc_id % 2 = 0"))
    table = model.table()
    for r in kneser_ney.judge(real, labels).join(real.drop("lang"), "doc_id").limit(40).collect():
        row = model.symbols.read(r["text"])
        plain = table[symbols.trigrams(row)].sum(dtype=float) + plain_words(model.symbols, texts, r["text"])
        assert r["nll"] == pytest.approx(-plain / (len(row) - 2), rel=1e-6) and r["n_words"] == len(row) - 2


def plain_kneser_ney(texts, read):
    """Interpolated modified Kneser-Ney by dictionaries."""
    from collections import Counter

    three = Counter()
    for t in texts:
        row = read.read(t).tolist()
        three.update(zip(row, row[1:], row[2:]))

    def cuts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2])
        return lambda c: min(max({1: 1 - 2 * y * n[2] / n[1], 2: 2 - 3 * y * n[3] / n[2]}.get(c, 3 - 4 * y * n[4] / n[3]), 0), min(c, 3))

    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    d3, d2 = cuts(three.values()), cuts(two.values())
    all3, spare3, all2, spare2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, w), n in three.items():
        all3[u, v] += n
        spare3[u, v] += d3(n)
    for (v, w), n in two.items():
        all2[v] += n
        spare2[v] += d2(n)

    def p(u, v, w):
        low = (one[w] + 0.5) / (len(two) + 0.5 * symbols.SYMBOLS)
        low = (two[v, w] - (d2(two[v, w]) if two[v, w] else 0) + spare2[v] * low) / all2[v] if all2[v] else low
        return (three[u, v, w] - (d3(three[u, v, w]) if three[u, v, w] else 0) + spare3[u, v] * low) / all3[u, v] if all3[u, v] else low

    return p


def test_kneser_ney_against_dictionaries(spark, real):
    trusted = real.where("doc_id % 2 = 0")
    model = kneser_ney.train(trusted)
    p = plain_kneser_ney([r["text"] for r in trusted.collect()], model.symbols)
    table = model.table().reshape((symbols.SYMBOLS,) * 3)
    for r in real.where("doc_id < 25").collect():
        row = model.symbols.read(r["text"]).tolist()
        for u, v, w in list(zip(row, row[1:], row[2:]))[:150]:
            assert np.exp(table[u, v, w]) == pytest.approx(p(u, v, w), rel=1e-3)
    some = np.exp(table[[symbols.EDGE, 0, 1, 5], [0, 1, 2, symbols.OTHER]].astype(float)).sum(axis=1)
    assert some == pytest.approx(np.ones(4), rel=1e-3)


def test_quality_keeps_prose_and_rejects_junk(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = kneser_ney.judge(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    junk = lambda t: t.count(" | ") > 9 or t.count("!!") > 9 or t.count("###") > 5 or re.search(r"(\S+)( \1){9}", t)
    bad, good = ([r["keep"] for r in rows if bool(junk(r["text"])) == x] for x in (True, False))
    assert len(rows) == 10_000 and np.mean(bad) < 0.05 and np.mean(good) > 0.99


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        rows = kneser_ney.judge(odd, given).collect()
        assert len(rows) == 8 and all(np.isfinite(r["nll"]) and r["keep"] in (0, 1) for r in rows)
    assert {r["keep"] for r in kneser_ney.judge(odd, labels.limit(0)).collect()} == {1}
    assert kneser_ney.judge(empty, labels).count() == 0


# --- Personal data ------------------------------------------------------------------------------------------------------


def plain_base(text: str) -> str:
    def luhn(x):
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m)]
    return ",".join(s for _, _, s in sorted(found))


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(2)
    for alphabet in ("12a@.+- (b9c", "4@.-x", "0123456789 -+.", "1.25 "):
        for _ in range(4_000):
            text = "".join(rng.choice(list(alphabet), rng.integers(1, 45)))
            assert pii.written(pii.base_spans(text)) == plain_base(text), text
    assert pii.written(pii.base_spans("a" * 300_000 + "1" * 300_000)) == ""


def test_personal_data_of_the_tables(spark, real):
    for r in pii.spans(real).join(real, "doc_id").collect():
        base = plain_base(r["text"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(k) for k in pii.KINDS]


def test_contexts_find_identifiers_that_no_pattern_has(spark):
    known = [(i, f"filler number {i} please write to user{i}@host{i}.org thanks the 4{i}00 end") for i in range(6)]
    docs = spark.createDataFrame([*known, (9, "please write to user9(at)host.org thanks"), (10, "see the 4900 end"), (11, "😀 write to me_77@local thanks")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert got[9]["spans"] == "email:16:33" and got[9]["n_email"] == 0 and got[11]["spans"] == "email:11:22"
    assert got[10]["spans"] == "" and got[0]["spans"] == plain_base(known[0][1])
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[9] == "please write to [EMAIL] thanks" and clean[10] == "see the 4900 end" and clean[0].startswith("filler number 0 please write to [EMAIL] thanks")


def test_columns_named_like_inner_ones_stay(spark):
    """Every name that an operator makes inside, as columns of the input, on the branches that join them."""
    known = [(i, f"filler number {i} please write to user{i}@host{i}.org thanks the 4{i}00 end") for i in range(6)]
    docs = spark.createDataFrame([*known, (9, "please write to user9(at)host.org thanks"), (9, "other words"), (9, "other words")], "doc_id long, text string")
    for name in ("_id", "_more", "_mark", "_clean", "_gone", "_often", "_first", "_name", "_lead", "_row", "_s", "fp", "root", "name", "id"):
        docs = docs.withColumn(name, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    for got in (pii.redacted(docs), simhash.first_of_each(docs), resemblance.first_of_each(docs)):
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(r[c] == f"mine {r['doc_id']}" for r in rows for c in docs.columns[2:])
        assert sorted({r["doc_id"] for r in rows}) == [*range(6), 9] and len(rows) in (8, 9)
    assert "please write to [EMAIL] thanks" in {r["text"] for r in pii.redacted(docs).collect()}


def test_context_words_are_whole():
    long = "x" * 500
    text = f"{long} {long} a@b.cd"
    assert pii.words_before(text, 1002) == [long, long] and pii.words_before("one", 3) == ["one"] and pii.words_before("", 0) == []


def test_personal_data_of_odd_rows(spark, odd, empty):
    more = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("a@b.cd and 1.2.3.4, +49 (30) 1234567")}))
    rows = pii.spans(more).collect()
    assert len(rows) == 9 and sorted(r["spans"] for r in rows)[-1] == "email:0:6,ip:11:18,phone:20:36"
    clean = pii.redacted(more)
    assert clean.columns == more.columns
    masked = clean.where(F.col("text").contains("[")).first()
    assert masked["text"] == "[EMAIL] and [IP], [PHONE]" and masked["n_chars"] == 25
    assert pii.spans(empty).count() == 0 and pii.redacted(empty).count() == 0


# --- Mixing -------------------------------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    """Share, stop what is above, share the excess again, until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"b": 100, "a": 50, None: 7}, {"x": 1000, "y": 1, "z": 1, "w": 0}, {"a": 0}, {f"s{i}": i * i for i in range(25)}])
def test_targets_against_repeated_sharing(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = plain_targets(sizes)
    assert {r["source"] for r in rows} == set(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])


def test_mix_of_rows(spark, odd, empty):
    plan = mixing.repetition_plan(odd, words_of(F.col("text"))).collect()
    assert len(plan) == 8 and all(0 <= r["copies"] <= 2 for r in plan)
    mixed = mixing.mix(odd, words_of(F.col("text")))
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(empty, words_of(F.col("text"))).count() == 0


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (F.col("id") % 91 + 1).alias("n"))
    plan = mixing.repetition_plan(docs, F.col("n"))
    for r in plan.groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)
    again = mixing.repetition_plan(docs.repartition(5), F.col("n"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, again.collect()))


# --- Sketches -----------------------------------------------------------------------------------------------------------


def grams(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sketches_against_sets():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    parts = [text(800) for _ in range(4)]
    a, b = parts[0] + " " + parts[1], parts[0] + " " + parts[2]
    one, two = bottomk.Sketch.of(a), bottomk.Sketch.of(b)
    x, y = grams(a), grams(b)
    assert one.resemblance(two) == pytest.approx(len(x & y) / len(x | y), abs=0.12)
    assert one.containment(two) == pytest.approx(len(x & y) / len(x), abs=0.15)
    assert one.distinct() == pytest.approx(len(x), rel=0.3)
    assert bottomk.Sketch.of("a b").distinct() == 1.0 and bottomk.Sketch.of(None).resemblance(bottomk.Sketch.of("")) == 1.0
    assert np.array_equal(bottomk.Sketch.read(one.text()).hashes, one.hashes)
    hashes = sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in x})[: bottomk.K]
    assert one.hashes.tolist() == hashes
    assert one.merge(two).hashes.tolist() == sorted({*one.hashes.tolist(), *two.hashes.tolist()})[: bottomk.K]


def test_merged_sketches_in_spark(spark):
    rows = [(i % 2, f"{' '.join(f'v{i}x{j}' for j in range(60))}") for i in range(12)] + [(5, "")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("fingerprint", bottomk.fingerprint(F.col("text")))
    for r in bottomk.merged(df, ["k"]).collect():
        want = bottomk.Sketch.of("")
        for k, t in rows:
            if k == r["k"]:
                want = want.merge(bottomk.Sketch.of(t))
        assert r["fingerprint"] == want.text()


@pytest.mark.parametrize("bucket", [1, 7, 5_000])
def test_edited_texts_cross_bucket_bounds(spark, monkeypatch, bucket):
    monkeypatch.setattr(bottomk.bucketed, "__defaults__", (bucket,))
    rows = [(i * 3, f"t{i} " * (i % 9)) for i in range(40)] + [(7, "tie a"), (7, "tie b"), (None, "none é"), (60, None)]
    got = bottomk.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for i, (key, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        sketch, other, following = (bottomk.Sketch.of(s) for s in (t, edited, after))
        want.append((str(key), len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), other.text(), sketch.resemblance(other), sketch.resemblance(following)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)


def test_sketches_of_odd_rows(spark, odd, empty):
    assert bottomk.compare_edited(odd).count() == 8 and bottomk.compare_edited(empty).count() == 0
    assert bottomk.compare_edited(odd.where("doc_id = 6")).first()["near_next"] == 1.0


# --- Licences -----------------------------------------------------------------------------------------------------------


def scanned(spark, *docs):
    rows = licences.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r["licences"] for r in rows]


def test_licences_of_texts(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the "
        "documentation\nand/or other materials provided with the distribution.\n"
    )
    three = bsd + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    swapped = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. " + bsd.split("\n1.")[0]
    got = scanned(
        spark, three, bsd, "Text.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
        "a license of some kind", swapped, "This work is licensed under the GNU General Public License, version 3.", "The MIT License (MIT)\nAll rights reserved.",
    )
    assert got == ["BSD-3-Clause", "BSD-2-Clause", "MIT", "Apache-2.0,CC-BY-NC-4.0", "", "", "GPL-3", ""]


NOTICES = {
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2.0 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def wrapped(text, sign):
    import textwrap

    lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, 58) or [""])]
    return "\n".join(f"{sign} {line}".rstrip() if sign else line for line in lines)


@pytest.mark.parametrize("sign", [None, "", " *", "//", "#"])
def test_published_notices(spark, sign):
    """Plain, wrapped, and wrapped behind the signs of comments."""
    texts = [f"Some code.\n\n{t if sign is None else wrapped(t, sign)}\n" for t in NOTICES.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs).collect()}
    assert got == dict(enumerate(NOTICES))


def test_spdx_lines_and_notices_side_by_side(spark):
    texts = [f"{sign} SPDX-License-Identifier: {x}\nimport os" for sign, x in itertools.product(("#", "//", " *"), licences.SPDX)]
    texts += ["/* SPDX-License-Identifier: MIT */", NOTICES["GPL-2.0-or-later"] + "\n" + NOTICES["LGPL-2.1-or-later"], "# SPDX-License-Identifier: nothing-known"]
    got = [r["licences"] for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [*licences.SPDX * 3, "MIT", "GPL-2.0-or-later,LGPL-2.1-or-later", ""]


def test_licences_of_odd_rows(spark, odd, empty):
    assert {r["licences"] for r in licences.scan(odd).collect()} == {""} and licences.scan(odd).count() == 8
    assert licences.scan(empty).count() == 0
    assert scanned(spark, LONG + ". Licensed under the Apache License, Version 2.0. " + LONG) == ["Apache-2.0"]
