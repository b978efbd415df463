import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import language as L
from sitelens.llm.common import bounded_sample, id_crc

SF001 = "/root/testdata/sf0.01"


def test_collapsed_weights_equal_the_kernel_machine():
    rows = [("aa", "abra cadabra"), ("aa", "bar abra kad"), ("bb", "xyz zzyx xy"), ("bb", "yyz xzz yx")]
    model = L.fit(rows)
    texts = ["abra xyz", "zzz", "cad ab", "!?"]

    def grams(text):
        codes = [int(model.letters[ord(c)]) for c in text.lower()] + [0, 0]
        size = len(codes) - 2
        out = set()
        for n in range(1, 4):
            for i in range(size):
                gram = 0
                for c in codes[i:i + n]:
                    gram = gram << 7 | c
                slot = model.slots[n - 1][gram]
                if slot < model.n_grams:
                    out.add(int(slot))
        return out

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    marks = [grams(t) for _, t in rows]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > L.EIGEN_FLOOR * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = k_mm @ whiten
    target = np.array([[1, -1], [1, -1], [-1, 1], [-1, 1]])
    beta = np.linalg.solve(mapped.T @ mapped + L.RIDGE * np.eye(mapped.shape[1]), mapped.T @ target)
    k_nm = np.array([[kernel(grams(t), m) for m in marks] for t in texts])
    found = L.presence(texts, model.letters, model.slots, model.n_grams)
    got = found @ model.weights / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
    assert np.allclose(got[:3], (k_nm @ whiten @ beta)[:3], atol=1e-6)


def test_long_texts_in_pieces_have_the_same_n_grams(monkeypatch):
    model = L.fit([("aa", "abcdefgh abc"), ("bb", "xyz uvw xyzw")])
    texts = ["abc def xyz " * 30, "a", "uvwxyz" * 50]
    whole = L.presence(texts, model.letters, model.slots, model.n_grams)
    monkeypatch.setattr(L, "CHUNK_CHARS", 7)
    assert (L.presence(texts, model.letters, model.slots, model.n_grams) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs, id_crc("doc_id") % 3 != 1).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_samples_count_different_texts(spark):
    rows = spark.range(20_000).selectExpr("'few' as lang", "concat('text ', id % 50) as text") \
        .union(spark.range(6_000).selectExpr("'many'", "concat('other ', id % 2000)"))
    taken = bounded_sample(rows, 400, ["text"], strata="lang")
    sizes = {r.lang: r["count"] for r in taken.groupBy("lang").count().collect()}
    assert sizes["few"] == 50 and 300 <= sizes["many"] <= 500 and taken.distinct().count() == taken.count()
    assert bounded_sample(rows.filter("lang = 'few'"), 400, ["text"]).count() == 50


def test_copied_and_long_languages_are_learned(spark):
    from itertools import permutations
    words = ["".join(p) for p in permutations("kopa")]
    rows = [(i, f"{words[i % 10]} {words[i % 10 + 3]} kopa", "copied") for i in range(5_000)]
    rows += [(10_000 + i, f"{'tirel unsit ' * 3_000}{i}", "long") for i in range(5)]
    rows += [(20_000 + i, f"vemy wexu byg {'y' * (i % 7)}", "short") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = L.identify(docs, F.lit(True)).join(docs, "doc_id").groupBy("lang", "lang_pred").count().collect()
    assert {(r[0], r[1]) for r in found} == {(x, x) for x in ("copied", "long", "short")}
    piece = docs.filter("lang = 'long'").select(L.excerpt("text")).first()[0]
    assert len(piece) == L.SAMPLE_CHARS + L.PIECES - 1 and piece[-1].isdigit()


def test_near_copies_do_not_fill_landmarks_and_n_grams(spark, monkeypatch):
    rows = [(i, f"abba cab {'abc'[i % 3]} {'d' * i}", "aa") for i in range(100)]
    rows += [(1000 + i, f"zorp quux {'z' * i}", "aa") for i in range(100)] + [(2000, "mnemm nim", "bb")]
    seen, fit = [], L.fit
    monkeypatch.setattr(L, "fit", lambda rows: seen.extend(rows) or fit(rows))
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    marks = [t for lang, t in seen if lang == "aa"][:L.LANDMARKS_PER_LANG]
    assert 15 < sum(t.startswith("zorp") for t in marks) < 45
    late = [f"zorp late {c}" for c in "ж"] + ["abba"] * 100
    model = fit([("aa", t) for t in reversed(late)])
    assert model.letters[ord("ж")] not in (0, 127)


def test_scripts_of_many_letters_beside_small_alphabets():
    rng = np.random.default_rng(5)

    def texts(first, size, n_words, count):
        letters = [chr(first + i) for i in range(size)]
        words = ["".join(rng.choice(letters, rng.integers(2, 5))) for _ in range(400)]
        return [" ".join(rng.choice(words, n_words)) for _ in range(count)]

    # four languages of 600 letters each, short texts; eight of 20 letters, long texts
    made = {f"wide{k}": texts(0x4E00 + 600 * k, 600, 40, 60) for k in range(4)}
    made |= {f"small{k}": texts(0x0430 + k, 20, 400, 60) for k in range(8)}
    model = L.fit([(lang, t) for lang, own in made.items() for t in own[:40]])
    assert all(model.letters[0x4E00 + 600 * k] > 0 for k in range(4)) and model.slots[0].letter_bits == 12
    for lang, own in made.items():
        found, _ = L.predict(own[40:], model)
        assert found.count(lang) >= 0.95 * len(found), lang


def test_hash_table_tells_all_codes_apart():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 62, 5_000))
    slots = L.Slots(codes, np.arange(len(codes)), -1, 20)
    assert (slots[codes] == np.arange(len(codes))).all() and slots[int(codes[7])] == 7
    others = np.setdiff1d(codes + 1, codes)
    assert (slots[others] == -1).all() and slots[np.zeros(0, np.int64)].size == 0
    assert (L.Slots(codes[:0], codes[:0], 3, 7)[codes[:5]] == 3).all()


def test_edges(spark, edge, none, docs):
    both = docs.select("doc_id", "text", "lang").union(edge.select("doc_id", "text", "lang"))
    rows = [r for r in L.identify(both, id_crc("doc_id") % 3 != 1).collect() if r.doc_id is None or r.doc_id >= 1000]
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {None, 1000, 1001, 1002, 1003} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert L.identify(none, F.lit(True)).collect() == []
    assert {r.lang_pred for r in L.identify(edge, F.lit(False)).collect()} == {"und"}
