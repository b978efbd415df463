import hashlib
import random
import re
from collections import Counter

import numpy as np

from sitelens.llm import benchmark as B


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = slow_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).update(() if item is None else (str(item),))
    out = []
    for doc, text in docs:
        w, hit, found = slow_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def run(docs, items):
    got = B.contamination(docs, items).drop("spans").collect()
    return Counter(tuple(r) for r in got)


def test_index_counts_and_locates_every_phrase():
    rng = random.Random(3)
    symbols = np.array([0] + [rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(600)] + [0], np.int64)
    index = B.ShardIndex(symbols, 5)
    text = symbols.tolist()
    for size in (1, 2, 3, 6):
        phrases = {tuple(text[i:i + size]) for i in range(len(text) - size) if 0 not in text[i:i + size]}
        phrases = sorted(phrases | {tuple([5] * size)})
        lo, hi = index.search(np.array(phrases, np.int64))
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text)) if tuple(text[i:i + size]) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_planted_passages_against_brute_force(spark, edge, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(50_000, "One Two three"), (50_001, None), (50_002, ""), (None, "a b c"), (None, "unnamed passage"), (50_003, "one two THREE"),
             (50_004, "repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat")]
    items = bench.union(spark.createDataFrame(extra, "item_id long, text string"))
    first = bench.filter("item_id = 3").first().text
    planted = [(1, "one, two; three one two three"), (2, f"x {first} y"), (3, "repeat " * 25), (4, first[20:]), (5, None), (6, "an unnamed passage")]
    docs = docs.union(edge.select("doc_id", "text")).union(spark.createDataFrame(planted, "doc_id long, text string"))
    want = Counter(slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert run(docs, items) == want
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)  # several blocks, several shards
    monkeypatch.setattr(B, "SHARD_WORDS", 50)
    assert run(docs, items) == want


def test_removal_leaves_no_hit_and_clean_texts_alone(spark, edge):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "same text here")], "item_id long, text string")
    docs = edge.union(edge.limit(1).selectExpr("7L", "'Before, ALPHA beta-gamma; delta. After'", *edge.columns[2:]))
    out = B.remove_contamination(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = out.collect()
    assert [r.text for r in rows if r.doc_id == 7] == ["Before, . After"]
    assert [r.n_chars for r in rows if r.text == ", twice."] == [8] * 5
    before = {r.doc_id: r.text for r in docs.collect() if r.doc_id in (1000, 1001, 1006, 1007)}
    assert before == {r.doc_id: r.text for r in rows if r.doc_id in before}
    assert B.contamination(out, bench).filter("contaminated").count() == 0


def test_empty_tables(spark, none, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert B.contamination(none, empty).collect() == []
    assert B.contamination(docs, empty).filter("contaminated").count() == 0
    assert B.remove_contamination(docs, empty).exceptAll(docs).count() == 0


def test_odd_columns_pass_through(spark):
    """Stages keep maps, dotted names and an n_chars that is no number."""
    from pyspark.sql import functions as F
    from sitelens.llm import secrets, simhash
    rows = [(i, "alpha beta gamma delta epsilon", "five") for i in (1, 1, 2)] + [(3, "other words are here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string") \
        .select("*", F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.lit(1).alias("my.col"))
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    for out in (simhash.keep_one(docs), B.remove_contamination(docs, bench), secrets.mask_secrets(docs)):
        assert out.columns == docs.columns
        assert {r.n_chars for r in out.collect()} == {"five", None}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
