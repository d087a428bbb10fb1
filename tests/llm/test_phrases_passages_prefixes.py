"""Collocations, repeated passages and conversation prefixes against brute force, at several shard sizes, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathline.llm import collocations, prefix_trie, substrings, word_codes
from swathline.llm.fm_index import FmIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (2, None, None, None, None), (3, "", "en", "s2", 0),
        (None, "x y z", "de", "s1", 5), (4, LONG, "en", "s1", len(LONG)), (5, " \n\t", "fr", None, 3), (6, "naïve 🙂 text", "xx", "s2", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("doc", "form", "key", "met", "spans", "code", "word", "f", "p", "anchor", "name", "start", "n", "shard", "first"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- Codes of words -----------------------------------------------------------------------------------------------------


def test_codes_tell_words_apart_wherever_they_lie():
    texts = ["a b", "", "  b a\tb", "B;a", "é x b", "b"]
    got = word_codes.coded(pa.array(texts), word_codes.kinds(b" \t", b";"), lower=True)
    words = [re.findall(r"[^ \t;]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    flat = [w for row in words for w in row]
    assert [got.word(i).decode() for i in range(len(flat))] == flat
    assert got.rows.tolist() == [0, *np.cumsum([len(r) for r in words]).tolist()]
    assert all((got.codes[i] == got.codes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert got.breaks.tolist() == [True, False, True, False, False, True, True, True, False, True]
    salted = word_codes.coded(pa.array(["b", "b"]), word_codes.kinds(b" "), salt=np.array([1, 2], dtype=np.uint64))
    assert salted.codes[0] != salted.codes[1]


def test_chunks_keep_every_row_in_order():
    texts = ["x" * n for n in (5, 0, 40, 3, 3, 3, 100, 1)] + [None]
    batches = [pa.record_batch([pa.array(texts[:4]), pa.array(range(4))], names=["text", "i"]), pa.record_batch([pa.array(texts[4:]), pa.array(range(4, 9))], names=["text", "i"])]
    got = list(word_codes.chunks(iter(batches), most=10))
    assert [i for b in got for i in b.column(1).to_pylist()] == list(range(9))
    assert [t for b in got for t in b.column(0).to_pylist()] == [t or "" for t in texts]
    assert all(sum(map(len, b.column(0).to_pylist()[:-1])) < 10 for b in got)


# --- Collocations -------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, first):
    grams, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                grams[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in grams.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            inside = (q for q, b in often.items() if len(q) > len(p) and b >= a)
            if any(p == q[i : i + len(p)] for q in inside for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * sizes[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], sizes[lang], score))
        out += [(lang, i + 1, *row[3:]) for i, row in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.mark.parametrize(("most", "first"), [(500_000, 2000), (60, 5)])
def test_collocations_at_any_trie_size(spark, most, first):
    draw = random.Random(4)
    rows = []
    for i in range(160):
        words = [draw.choice("the of a Tea red Éa ¿x big".split()) if draw.random() < 0.8 else f"w{draw.randrange(50)}" for _ in range(draw.randrange(0, 60))]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", ", ", ".\n", " ; "]) for w in words) + (" one Two three four\tfive six" if i % 3 else "")
        rows.append((i, text if i % 17 else None, draw.choice(["en", "de", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=6, first=first, most=most).collect())
    want = plain_collocations([(lang, text) for _, text, lang in rows], 6, first)
    assert len({w[0] for w in want}) == 3 and got == want
    assert any(len(w[2].split()) == 5 for w in want) or first == 5


def test_trie_of_drawn_phrases():
    """Wide families, narrow ones and single children; phrases that are prefixes of others, and prefixes that are none."""
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    wide = np.stack([np.full(3000, codes[0]), codes[:3000]], axis=1)
    three = np.unique(np.stack([codes[draw.integers(0, 60, 4000)] for _ in range(3)], axis=1), axis=0)
    tree = collocations.DoubleArray([codes[10:30, None], wide, three])
    want = {(c,): i for i, c in enumerate(codes[10:30].tolist())}
    for phrase in [*map(tuple, wide.tolist()), *map(tuple, three.tolist())]:
        want[phrase] = len(want)
    text = np.concatenate([wide[::100].ravel(), three[::7].ravel(), draw.integers(0, 2**63, 50).astype(np.uint64), codes[10:25]])
    room = np.minimum(np.arange(len(text), 0, -1), 3)
    got = {}
    for k, (at, state) in enumerate(tree.walk(text, room, 3)):
        got |= {(int(i), k + 1): int(p) for i, p in zip(at, tree.accept[state]) if p >= 0}
    plain = {(i, k): want[p] for i in range(len(text)) for k in (1, 2, 3) if (p := tuple(text[i : i + k].tolist())) in want and i + k <= len(text)}
    assert got == plain and len(plain) > 600


def test_collocations_of_odd_rows(spark, odd, empty):
    got = {r["phrase"]: r["a"] for r in collocations.collocations(odd, least=2).collect() if r["lang"] == "en"}
    # Of a word repeated on and on, a shorter phrase occurs once more than a longer one, so none hides another; "a b c d e"
    # and "b c d e f" hide all that lies in them.
    want = {" ".join(["word"] * k): 60_001 - k for k in (2, 3, 4, 5)} | {"a b c d e": 2, "b c d e f": 2}
    assert got == want
    assert collocations.collocations(empty).count() == 0


# --- Repeated passages --------------------------------------------------------------------------------------------------


def plain_without_repeats(rows, window=20):
    first, out = {}, {}
    for key, text in sorted(rows):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), (key, i)) != (key, i):
                gone |= set(range(i, i + window))
        out[key] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


@pytest.mark.parametrize("how", [{}, {"hot": 2, "shard_words": 500}, {"filter_bits": 1 << 10, "hot": 6, "shard_words": 3000}])
def test_repeats_at_any_shard_size(spark, how):
    draw = random.Random(8)
    fresh = lambda n: [draw.choice("a b c the of é".split()) if draw.random() < 0.3 else f"w{draw.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (19, 20, 21, 35, 80, 300)]
    rows = []
    for i in range(150):
        words: list[str] = []
        for _ in range(draw.randrange(0, 4)):
            words += draw.choice(shared) if draw.random() < 0.5 else fresh(draw.randrange(0, 50))
            if draw.random() < 0.3 and words:
                words += words[-draw.randrange(1, 40) :] * 2
        rows.append((i * 7 % 151, draw.choice([" ", "\n ", "\t"]).join(words)))
    rows += [(1000, "x " * 500), (1001, "x y " * 200), (1002, rows[3][1]), (1003, "x " * 45)]
    # One word group with many continuations on both sides.
    rows += [(2000 + i, " ".join([*fresh(15), *"zz yy xx ww".split(), *fresh(15)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(docs, **how).collect()}
    want = plain_without_repeats(rows)
    assert sum(w[1] > 0 for w in want.values()) > 60 and got == want


def test_index_against_plain_search():
    draw = np.random.default_rng(6)
    sequences = [draw.integers(0, 3, int(n)).astype(np.uint64) * np.uint64(77) for n in draw.integers(18, 33, 300)]
    sequences += [sequences[5], sequences[5][:19], np.full(30, 9, dtype=np.uint64), draw.integers(0, 2**63, 40).astype(np.uint64)]
    lengths = np.array([len(s) for s in sequences])
    index = FmIndex(np.concatenate(sequences), lengths, 18)
    grams = Counter(tuple(s[i : i + 18].tolist()) for s in sequences for i in range(len(s) - 17))
    which, offset, group = index.statistics()
    sizes = np.diff(index.group_starts)
    assert len(which) == sum(grams.values())
    got = {}
    for s, o, g in zip(which.tolist(), offset.tolist(), group.tolist()):
        gram = tuple(sequences[s][o : o + 18].tolist())
        assert sizes[g] == grams[gram] and got.setdefault(gram, g) == g
    symbols = np.searchsorted(index.alphabet, sequences[7][-5:]) + 1
    low, high = np.zeros(1, dtype=np.int64), np.full(1, len(index.text))
    for symbol in symbols[::-1]:
        low, high = index.backward(np.array([symbol]), low, high)
    text = " ".join(map(str, index.text.tolist()))
    assert high - low == len(re.findall(rf"(?<!\d)(?={' '.join(map(str, symbols.tolist()))}(?!\d))", text))


def test_repeats_of_odd_rows(spark, odd, empty):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(odd).collect())
    assert len(got) == 8 and got[0] == got[1] == ("1", 6, 0, "a b c d e f")
    assert [g[1:3] for g in got if g[0] == "4"] == [(60_000, 59_999)] and [g[3] for g in got if g[0] == "4"] == ["word"]
    assert [g[1:] for g in got if g[0] in ("2", "3", "5")] == [(0, 0, "")] * 3
    assert substrings.without_repeats(empty).count() == 0
    # A NULL key is the smallest; rows of one key are ordered by a hash of their texts; equal rows are one.
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (7, words), (7, words), (8, words + " more"), (8, words + " end")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in got) == [("7", 30, ""), ("7", 30, ""), ("8", 30, "end"), ("8", 30, "more"), ("None", 0, words)]


# --- Conversation prefixes ----------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(own, key=lambda t: t[0])] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    nodes = defaultdict(set)
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes[own[:d]].add(c)
    children = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, convs in nodes.items():
        spare = (len(convs) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += spare
            leaves[path[:d]] += path not in children
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def collected(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in frame.collect())


@pytest.mark.parametrize("shard", [400_000, 200, 24])
def test_trie_at_any_shard_size(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "TURN_BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 8)
    draw = random.Random(2)
    rows = []
    for c in [*range(0, 130), 1000, 1003, 1019, 5000]:
        for t in range(draw.randrange(1, 8)):
            rows.append((c, t if t or c % 3 else None, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "a b  c", None, ""])))
    rows += [(40, t, "user", f"line {t // 2}") for t in range(100, 190)]  # a conversation of many turns, and a copy of it
    rows += [(6000, t, r, x) for c, t, r, x in rows if c == 40]
    rows += [(c, t, "system", "same start of many") for c in range(7000, 7060) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("mine")).withColumn("rank", F.lit("mine"))
    assert collected(prefix_trie.trie(df, shard)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (25, 0, "user", "word " * 50_000), (26, 7, "user", ""), (26, 7, "user", "")]
    assert collected(prefix_trie.trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    table = prefix_trie.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert table.slots(np.array([1, 2], dtype=np.uint64)).max() < len(keys)
    with pytest.raises(ValueError, match="distinct"):
        prefix_trie.PerfectHash(np.array([5, 5], dtype=np.uint64))
