import random
from functools import lru_cache

import pytest

from sitelens.llm import pieces as P

TEXTS = ["Hello  world", " a", "", " ", "  a  b ", "a\nb\t\tc\r\n", "日本語 テスト é\x00", "▁x ▁▁y", "𝄞𝄞 ok", "x" * 200 + "é" * 70]


def toy(pairs):
    table = [("<unk>", 0.0, "other"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]]
    return P.Pieces.of(table + [(p, s, "normal") for p, s in pairs])


def slow_best(chunk, pieces, score):
    """Best sum over all segmentations of a chunk of characters."""
    text = chunk.decode()

    @lru_cache(None)
    def best(i):
        if i == len(text):
            return 0.0
        options = [score[text[i:j]] + best(j) for j in range(i + 1, len(text) + 1) if text[i:j] in score]
        if text[i] not in score:
            options.append(pieces.unknown + best(i + 1))
        return max(options)

    return best(0)


@pytest.fixture(scope="module")
def public():
    return P.load()


def test_viterbi_against_all_segmentations():
    rng = random.Random(1)
    for _ in range(20):
        names = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        score = {p: -rng.uniform(1, 9) for p in names | {"a"}} | {" a": -2.0, "  ": -4.0}
        table = toy([(p.replace(" ", P.MARKER), s) for p, s in score.items()])
        ids = {p: 257 + k for k, p in enumerate(score)}
        by_id = {v: score[k] for k, v in ids.items()}
        for _ in range(20):
            chunk = (" " + "".join(rng.choice("aabéz") for _ in range(rng.randint(1, 12)))).encode()
            got = P.segment([chunk, b" a"], table)[0]
            assert got == P.segment_long(chunk, table)
            unknown = [c for c in P.decode_ids(__import__("numpy").array(got), table).decode()]  # decodes
            assert unknown is not None
            total = sum(by_id.get(i, 0.0) for i in got)
            # each character without a piece is written as its bytes and costs ``unknown``
            written = bytes(i - 1 for i in got if i <= 256).decode()
            assert total + len(written) * table.unknown == pytest.approx(slow_best(chunk, table, score))


def test_trie_holds_its_keys_and_nothing_else(public):
    rng = random.Random(2)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))): k for k in range(500)}
    trie = P.DoubleArray(keys)

    def look(key):
        state = 0
        for c in key:
            nxt = trie.base[state] + c + 1
            if trie.check[nxt] != state:
                return -1
            state = nxt
        return trie.value[state]

    assert all(look(k) == v for k, v in keys.items())
    for _ in range(2000):
        key = bytes(rng.randrange(256) for _ in range(rng.randint(1, 6)))
        assert look(key) == keys.get(key, -1)


def test_ids_equal_the_library_s_unigram_model(public, texts):
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(P.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces as a unigram model
    for piece in model.pieces:  # the library adds in single precision: scores it can add exactly
        piece.score = max(piece.score, -32000.0)
    kinds = {1: "normal", 6: "byte"}
    public = P.Pieces.of([(p.piece, p.score, kinds.get(p.type, "other")) for p in model.pieces])
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    encoder = P.Encoder(public)
    words = sorted({w for t in texts.values() for w in t.split()})[::7]
    for word in words:
        mine = encoder.encode([word.encode()])[0].tolist()
        assert mine == library.encode(word), word


def test_round_trip_of_bytes_spaces_and_markers(public):
    encoder = P.Encoder(public)
    for text, ids in zip(TEXTS, encoder.encode([t.encode() for t in TEXTS])):
        assert P.decode_ids(ids, public).decode() == text
    assert encoder.encode([None, b""])[0] is None and len(encoder.encode([b""])[0]) == 0


def test_tables(spark, edge, none, docs):
    for df in (edge, docs.limit(40)):
        rows = {(r.doc_id, str(r.text)) for r in df.collect()}
        coded = P.encode(df)
        got = coded.collect()
        assert len(got) == df.count() and all(r.round_trip is not False for r in got)
        assert all((r.ids is None) == (r.n_tokens is None) for r in got)
        assert {(r.doc_id, str(r.text)) for r in P.decode(coded).collect()} == rows
    assert P.encode(none).collect() == []


def test_frequent_chunks_stay_remembered(public, monkeypatch):
    """Chunks met in every block are segmented once, however many others pass by; those met once go."""
    monkeypatch.setattr(P, "CACHE", 40)
    seen = []
    segment = P.segment
    monkeypatch.setattr(P, "segment", lambda chunks, pieces: seen.extend(chunks) or segment(chunks, pieces))
    encoder, fresh = P.Encoder(public), P.Encoder(public)
    for block in range(30):
        text = ("often again " + " ".join(f"w{block}x{i}" for i in range(15))).encode()
        assert encoder.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()
        assert len(encoder.known) + len(encoder.before) <= 2 * 40
        fresh = P.Encoder(public)
    assert seen.count(b" often") <= 1 + 30 and sum(c == b" w3x1" for c in seen) >= 1
    seen.clear()
    encoder.encode([b"often again"])
    assert seen == []
