import random
import re

import xxhash

from sitelens.llm import simhash
from sitelens.operators.components import components
from tests.llm.conftest import union_find


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check(df, columns=("doc_id", "text")):
    rows = df.select(*columns).collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp = union_find(len(fps), pairs)
    least = {}
    for r, c in zip(rows, comp):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least.get(c))) for r, f, c in zip(rows, fps, comp))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want
    return comp


def test_documents_against_all_pairs(docs):
    check(docs)


def test_edge_rows(edge, none):
    check(edge)
    assert simhash.near_duplicates(none).collect() == []


def test_links_with_refined_and_dealt_keys(spark):
    rng = random.Random(5)
    fps = {0, 2 ** 64 - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(6):  # chains of one to three changed bits
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = union_find(len(fps), pairs)
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for key_rows in (10_000, 3):
        links = simhash.links(df, 2, key_rows)
        root = {r.node: r.root for r in components(links).collect()}
        got = [root.get(s, s) for s in signed]
        groups = {}
        for w, g in zip(want, got):
            assert groups.setdefault(w, g) == g
        assert len(set(groups.values())) == len(groups)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len(got) == 301 and len({got[i] for i in range(201)}) == 1
    assert len({got[1000 + i] for i in range(100)}) == 1 and got[0] != got[1000]


def test_one_row_of_each_group_stays(edge, docs):
    for df in (edge, docs.limit(60)):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        comp = check(df)
        assert kept.count() == len(set(comp))
    ids = {r.doc_id for r in simhash.keep_one(edge).collect()}
    assert 1004 in ids and 1005 not in ids
