"""The near-dedup stage of the pipeline against all pairs by brute force."""

from __future__ import annotations

import itertools
import os
import random
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from swathline.llm import resemblance  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def plain_kept(rows):
    """The least key of each component of texts with Jaccard similarity 0.8, counted over all pairs that share a shingle."""
    rows = sorted(rows)
    sets, holders = [plain_set(t) for _, t in rows], defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return sorted(k for i, (k, _) in enumerate(rows) if top(i) == i)


def test_stage_takes_every_near_copy_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, folder).select("doc_id").collect()) == want


@pytest.mark.parametrize("block", [4096, 16])
def test_crowded_near_copies(spark, block):
    """A group whose members lie on both sides of 0.8 of each other, short texts, texts without words, NULL and repeated keys."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, "One two"), (1001, "one  TWO"), (1002, "one two three"), (1003, None), (1004, " ")]
    for i in range(150):
        words = list(base)
        for at in draw.sample(range(120), draw.randrange(1, 9)):
            words[at] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = resemblance.first_of_each(docs, block=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)
    odd = spark.createDataFrame([(1, "a b c d e f g"), (1, "other words"), (1, "a b c d e f g"), (None, "A b c d e f g"), (None, "x y")], docs.schema)
    assert sorted(r["text"] for r in resemblance.first_of_each(odd).collect()) == ["a b c d e f g", "other words", "x y"]


def test_linked_fingerprints_share_a_bucket(spark):
    """Fingerprints two bits apart meet, over a chain as well; others do not, whatever their bands."""
    rows = [(1, 10, 0b0), (2, 11, 0b11), (3, 12, 0b1111), (4, 13, 0b11111111 << 20), (5, 14, 0b11111111 << 20)]
    nodes = spark.createDataFrame(rows, "name long, first long, fp long")
    found = {r["name"]: (r["band"], r["value"]) for r in resemblance.fingerprint_buckets(nodes).collect()}
    assert found[1] == found[2] == found[3] and found[4] == found[5] != found[1] and len(found) == 5
    assert found[1][0] == resemblance.BANDS
    assert resemblance.fingerprint_of(resemblance.shingles("")) == 0


def test_fingerprints_differ_little_where_texts_do():
    words = [f"w{i}" for i in range(400)]
    near = resemblance.shingles(" ".join(words[:200] + ["other"] + words[201:]))
    apart = resemblance.fingerprint_of(resemblance.shingles(" ".join(words))) ^ resemblance.fingerprint_of(near)
    far = resemblance.fingerprint_of(resemblance.shingles(" ".join(words))) ^ resemblance.fingerprint_of(resemblance.shingles(" ".join(f"v{i}" for i in range(400))))
    assert (apart & (2**64 - 1)).bit_count() < 10 < (far & (2**64 - 1)).bit_count()
