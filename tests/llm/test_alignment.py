"""Cross-tokenizer alignment against both libraries' own encoders and the plain definition."""

import hashlib
import random

import numpy as np
import pytest

from sitelens.llm import alignment as al

SEP = " \n\t  "


@pytest.fixture(scope="module")
def models():
    return al.load()


@pytest.fixture(scope="module")
def encoders(models):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(al.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.PIECE_MODEL)


def by_definition(text, models, encoders):
    """(a, b, groups, links) of one text, straight from the definition."""
    if not text:
        return [], [], "", []
    a = encoders[0].encode(" " + text, add_special_tokens=False).ids
    b = encoders[1].encode(text)
    want = (" " + text).encode()
    if b"".join(models.bytes_a[i] for i in a) != want or b"".join(models.bytes_b[i] for i in b) != want:
        return [], [], "", []

    def spans(ids, table):
        at = 0
        for i in ids:
            yield at, at + len(table[i])
            at += len(table[i])

    sa, sb = list(spans(a, models.bytes_a)), list(spans(b, models.bytes_b))
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, low = [], 0
    for cut in cuts:
        inside = lambda ss, ids: ",".join(str(i) for (s, e), i in zip(ss, ids) if low <= s and e <= cut)  # noqa: B023,E731
        groups.append(inside(sa, a) + "|" + inside(sb, b))
        low = cut
    links = [(i, j) for (s, e), i in zip(sa, a) for (u, v), j in zip(sb, b) if s < v and u < e]
    return a, b, ";".join(groups), links


def expected(texts, models, encoders):
    """Result rows of all texts, with corpus-wide pair counts."""
    each = [by_definition(t, models, encoders) for t in texts]
    count, most = {}, {}
    for *_, links in each:
        for p in links:
            count[p] = count.get(p, 0) + 1
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
             sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "") for a, b, groups, links in each]


def random_texts(n):
    rnd = random.Random(5)
    words = ["the", "naïve", "日本語", "don't", "12,345", "<s>", "<|endoftext|>", "x" * 40, "…", " ", "é́", "a\u0085b",
             "\U0001f600", "ção", "\x00", "\x1c", "</s>", "=>", "'ll", "　z", "\r\n", "▁"]
    return ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  ", "\n", " \n", "\t "]) for _ in range(rnd.randrange(1, 30)))
            for _ in range(n)]


def test_chunks_encode_like_whole_texts(models, encoders):
    texts = random_texts(400) + [" ", "  ", "a ", " a", "\n", "a\n", "a \n b", "x  y", "\n  y"]
    ours = al.Encoders(models)
    for _ in range(2):  # the second time from memory
        (a, off_a), (b, off_b) = ours.encode([" " + t for t in texts])
        for k, t in enumerate(texts):
            assert a[off_a[k]:off_a[k + 1]].tolist() == encoders[0].encode(" " + t, add_special_tokens=False).ids
            assert b[off_b[k]:off_b[k + 1]].tolist() == encoders[1].encode(t)


def test_gallop_finds_first_place():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        long = np.sort(rnd.choice(500, rnd.integers(1, 80), replace=False))
        short = np.sort(rnd.integers(0, long[-1] + 1, rnd.integers(1, 40)))
        n = len(short)
        guess = rnd.integers(0, len(long), n)
        found = al.gallop(short, long, guess, np.zeros(n, np.int64), np.full(n, len(long) - 1))
        assert (found == np.searchsorted(long, short)).all()


def test_pairs_round_trip():
    doc = np.array([0, 0, 0, 2, 2])
    codes = np.array([7, 1 << 40, 7, 3, 9])
    first, none, last = al.pack_pairs(doc, codes, 3)
    assert [x.tolist() for x in al.unpack_pairs(first)] == [[7, 1 << 40], [2, 1]]
    assert len(al.unpack_pairs(none)[0]) == 0 and len(al.unpack_pairs(None)[0]) == 0
    assert [x.tolist() for x in al.unpack_pairs(last)] == [[3, 9], [1, 1]]


@pytest.mark.parametrize("most", [al.MAX_BROADCAST_PAIRS, 0])
def test_links_against_definition(spark, models, encoders, texts, most):
    sample = [None, "", *random_texts(60), *[texts[i] for i in sorted(texts)[:60] if texts[i] and len(texts[i]) < 1500]]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string").repartition(3)
    rows = sorted(al.link_counts(df, digest=True, max_broadcast_pairs=most).collect())
    want = expected(sample, models, encoders)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows] == want
    assert sum(w[0] > 0 for w in want) > 60 and sum(w[3] > w[0] for w in want) > 10


def test_edges(spark, edge, none):
    rows = al.align(edge).collect()
    assert len(rows) == edge.count()
    empty = [r for r in rows if r.n_a == 0]
    assert {r.doc_id for r in empty} == {None, 1000, 1001, 1007} and all(r.groups == "" for r in empty)
    assert len({r.groups for r in rows if r.doc_id == 1004}) == 2
    assert al.link_counts(none).collect() == []
    assert al.align(none).collect() == []


def test_long_text_in_one_row(models):
    text = ("Some words, repeated often. " * 9000 + "x" * 50_000).encode()
    one = al.Aligner(models).block([text])[0]
    assert one["n_a"] > 50_000 and one["groups"].count(b";") + 1 == one["n_groups"]
