import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitelens.llm import suffixes as S


def slow(rows):
    """(id, n_bytes, n_removed, n_spans, sha) of each (id, text) by counting every 200-byte string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + 200] for _, d in data for k in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if count[d[k:k + 200]] > 1:
                gone[k:k + 200] = 1
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int(np.sum(np.diff(np.concatenate(([0], gone))) == 1))
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def made():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 230, 420)]
    rows = [(i, word(rng.randint(0, 300)) + rng.choice(shared) + word(rng.randint(0, 300))) for i in range(30)]
    rows += [(100, "ab" * 300), (101, "q" * 700), (102, "q" * 199), (103, shared[4] + "X" + shared[4][:210]),
             (104, shared[4][100:] + "é" * 120), (105, "é" * 130)]
    return rows + [(200 + k, rows[5][1][:150] + "~" + rows[5][1][150:]) for k in range(3)]


@pytest.mark.parametrize("bucket_rows", [5000, 4, 1])
def test_removed_bytes_against_counting_every_string(spark, edge, bucket_rows):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + made()
    df = edge.select("doc_id", "text").union(spark.createDataFrame(made(), "doc_id long, text string"))
    got = S.dedup(df, bucket_rows=bucket_rows).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == slow(rows)


def test_documents(docs, texts):
    part = docs.filter("doc_id < 60")
    got = S.dedup(part).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == slow([(i, t) for i, t in texts.items() if i < 60])


def test_blocks_of_long_texts_share_every_window(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(2000))
    whole = S.anchors(np.frombuffer(data, np.uint8))
    monkeypatch.setattr(S, "CHUNK_BYTES", 300)
    owner = {}
    for a, b in S._blocks(len(data)):
        pos, lo, hi, _ = S.anchors(np.frombuffer(data[a:b], np.uint8))
        for p, x, y in zip(pos, lo, hi):
            for s in range(x, y + 1):
                assert owner.setdefault(a + s, a + p) == a + p
    want = {s: p for p, x, y in zip(*whole[:3]) for s in range(x, y + 1)}
    assert owner == want


@pytest.mark.parametrize("alphabet,size", [(b"a", 900), (b"ab", 3000), (b"abcdef", 3000), (bytes(range(256)), 700)])
def test_pointers_order_the_strings(alphabet, size):
    rng = random.Random(size)
    part = bytes(rng.choice(alphabet) for _ in range(size // 3))
    data = part + bytes(rng.choice(alphabet) for _ in range(size - 2 * len(part))) + part
    got = S.bucket_pointers(np.frombuffer(data, np.uint8))
    strings = [data[k:k + 200] for k in range(len(data) - 199)]
    assert len(got) == len(strings)
    order = sorted(range(len(strings)), key=strings.__getitem__)
    for a, b in zip(order, order[1:]):
        assert got[a] < got[b] if strings[a] < strings[b] else got[a] == got[b]
    assert len(S.bucket_pointers(np.frombuffer(data[:199], np.uint8))) == 0


def test_offset_classes_are_halves():
    for level in range(9):
        places = [o for c in range(1 << level) for o in range(S.offset_class(level, c)[0], S.offset_class(level, c)[1] + 1)]
        assert places == list(range(137))
    for c in range(1 << 7):
        halves = S.offset_class(8, 2 * c), S.offset_class(8, 2 * c + 1)
        assert (halves[0][0], halves[1][1]) == S.offset_class(7, c)


def test_passage_of_many_documents_in_split_buckets(spark):
    """One passage in documents that differ right before and after it: every run of its grams is another one."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(260)
    rows = [(i, word(150) + passage + word(150)) for i in range(40)] + [(90, word(150) + passage[30:] + word(20))]
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=3).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == slow(rows)


def test_empty(none):
    assert S.dedup(none).collect() == []
