"""Ranked lexical search against the plain formula."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import ranking as rk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text) rows."""
    held = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, words in held:
            m = 100 - 25 + (25 * len(words) * n_docs) // max(n_terms, 1)
            score = 0
            for w in cut(text):
                tf = words.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["Über", "日本", "naïve", "don't", "A-b"]
    text = lambda n: " ".join(rnd.choice(words[: rnd.choice([6, 30, 125])]) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(150)]
    docs += [(150 + i, docs[7][1]) for i in range(70)]  # a third are copies
    items = [(i, text(rnd.randrange(1, 15))) for i in range(12)] + [(90, "w1 w1 w1 W1"), (91, None), (92, "--"), (93, "absent")]
    return docs, items


@pytest.mark.parametrize("owners,shard_postings,block", [(4, 1_000_000, 4096), (3, 200, 4096), (1, 500, 4096), (5, 300, 6)])
def test_against_formula(spark, monkeypatch, corpus, owners, shard_postings, block):
    monkeypatch.setattr(rk, "BLOCK_ITEMS", block)
    docs, items = corpus
    got = rk.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                    spark.createDataFrame(items, "item_id long, text string"), 5, owners=owners, shard_postings=shard_postings)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items, 5))


def test_pruning_drops_documents_but_no_result(corpus):
    docs, _ = corpus
    words = [cut(t) for _, t in docs]
    df = np.array([sum("w1" in w for w in words)])
    assert rk.owners_of(np.array([1, 1, 2, 4, 8]), 2).tolist() == [0, 0, 0, 0, 1] and df[0] > 0
    import pyarrow as pa
    packed = [np.array([[0], [100 + i]], np.int32).tobytes() for i in range(10)]
    held = rk.Postings(pa.table({"id": list(range(10)), "row": list(range(10)), "p": pa.array(packed, pa.binary())}))
    terms = np.array([[0], [0], [1]], np.int64).tobytes()
    at, total = rk.advance(held, 0, terms, 2, b"", b"", 3)
    assert at.tolist() == [5, 6, 7, 8, 9] and total.tolist() == [105, 106, 107, 108, 109]  # 105 + 2 ties with the third


def test_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "same text"), (None, "same text"), (1, "same text"), (2, ""), (3, "one 日本語")],
                                  "item_id long, text string").select("*", F.lit(1).alias("item"), F.lit(1).alias("block"), F.lit(2).alias("id"))
    got = [tuple(r) for r in rk.search(edge, items, 4).collect()]
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()], 4)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert rk.search(none, items, 4).collect() == []
    assert rk.search(edge, items.limit(0), 4).collect() == []
