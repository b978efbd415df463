"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character
n-grams (n = 1 to 3) both hold, divided by the root of the product of their
own counts.  A bounded sample of labelled rows gives Nystroem landmarks; the
kernel against the landmarks, whitened by the landmarks' own kernel matrix,
feeds one kernel ridge regression per language (one versus rest).  For
scoring, landmark matrix, whitening and weights multiply into one matrix, so
a batch of documents is one product of its 0/1 n-gram matrix.

Every letter of the sample has a symbol of its own, whatever the script or the
number of letters; letters the sample lacks share one.  Each language brings
its own most frequent n-grams (``GRAMS_PER_LANG``), so none is crowded out by
languages with longer texts.  n-grams are found through a hash table that
compares the whole code, so different n-grams never share a column.  Whole
texts are scored; scoring is a map without shuffle, and memory is
bounded by ``CHUNK_CHARS`` whatever the length of a text.

Defined results: a null text or one without a letter is ``und`` with score 0;
with no labelled row (empty table) every text is; ties go to the language
first in text order; repeated rows are predicted alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bounded_sample, map_arrow

#: Bounds of the training sample: different texts of each language, of them landmarks, and characters learned of a text.
SAMPLE_PER_LANG, LANDMARKS_PER_LANG, SAMPLE_CHARS = 400, 60, 20_000
PIECES = 20  # evenly spread pieces that stand for a text of more than SAMPLE_CHARS characters
GRAMS_PER_LANG, MAX_N = 3_000, 3
#: Bounds of the model: with more languages than fill them, each brings fewer n-grams and landmarks (1 at least).
MODEL_GRAMS, MODEL_LANDMARKS = 32_000, 1_200
MIN_BITS = 7  # bits of a symbol in an n-gram code (more for more letters)
HASH = np.uint64(0x9E3779B97F4A7C15)
RIDGE, EIGEN_FLOOR = 0.1, 1e-6
CHUNK_CHARS, CHUNK_DOCS = 1_000_000, 256
UNDETERMINED = "und"


class Slots:
    """Column of each n-gram code (``missing`` for all other codes): a hash table looked at ``reach`` places on."""

    def __init__(self, codes: np.ndarray, columns: np.ndarray, missing: int, letter_bits: int) -> None:
        self.missing, self.letter_bits = missing, letter_bits
        bits = max(10, (16 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        home = self._home(codes)
        order = np.argsort(home, kind="stable")
        step = np.arange(len(codes))
        place = np.maximum.accumulate(home[order] - step) + step if len(codes) else home
        self.reach = int((place - home[order]).max()) + 1 if len(codes) else 1
        self.keys = np.full((1 << bits) + len(codes) + self.reach, -1, np.int64)
        self.columns = np.full(len(self.keys), missing, np.int32)
        self.keys[place], self.columns[place] = codes[order], columns[order]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * HASH) >> self.shift).astype(np.int64)

    def __getitem__(self, codes: np.ndarray | int) -> np.ndarray:
        codes = np.asarray(codes, np.int64)
        flat = codes.reshape(-1)
        home = self._home(flat)
        out = np.where(self.keys[home] == flat, self.columns[home], self.missing)
        for k in range(1, self.reach):
            out = np.where(self.keys[home + k] == flat, self.columns[home + k], out)
        return out.reshape(codes.shape)[()]


@dataclass
class Model:
    letters: np.ndarray  # code point -> symbol (0: no letter)
    slots: list[Slots]  # for n = 1..3: n-gram code -> column (last column: not among the n-grams)
    n_grams: int
    weights: np.ndarray  # n-gram x language
    languages: list[str]


def _codes(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by three zeros, and the row of each symbol (-1 on the zeros between)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\0\0\0".join([*lowered, ""])).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in lowered])
    ends = np.cumsum([len(t) + 3 for t in lowered])
    for k in (1, 2, 3):
        rows[ends - k] = -1
    return letters[points], rows


def _grams(codes: np.ndarray, letter_bits: int):
    """n-gram codes for n = 1, 2, 3 at every position that has one."""
    code = codes.astype(np.int64)
    yield code
    code = (code[:-1] << letter_bits) | codes[1:]
    yield code
    yield (code[:-1] << letter_bits) | codes[2:]


def presence(texts: list[str], letters: np.ndarray, slots: list[Slots], n_grams: int) -> np.ndarray:
    """0/1 matrix of the texts' n-grams (float32)."""
    out = np.zeros((len(texts) + 1, n_grams + 1), np.uint8)
    flat = out.reshape(-1)

    def add(part: list[str], first: int, own: int | None = None) -> None:
        codes, rows = _codes(part, letters)
        if own is not None:
            rows[own:] = -1
        base = np.where(rows < 0, len(texts), rows + first) * (n_grams + 1)
        for slot, code in zip(slots, _grams(codes, slots[0].letter_bits)):
            flat[base[:len(code)] + slot[code]] = 1

    start, size = 0, 0
    for i, text in enumerate(texts):
        if len(text) > CHUNK_CHARS:  # a piece ends with the two characters its last n-grams need
            if start < i:
                add(texts[start:i], start)
            low = text.lower()
            for k in range(0, len(low), CHUNK_CHARS):
                more = k + CHUNK_CHARS < len(low)
                add([low[k:k + CHUNK_CHARS + MAX_N - 1]], i, CHUNK_CHARS if more else None)
            start, size = i + 1, 0
            continue
        size += len(text)
        if size >= CHUNK_CHARS:
            add(texts[start:i + 1], start)
            start, size = i + 1, 0
    if start < len(texts):
        add(texts[start:], start)
    return out[:-1, :-1].astype(np.float32)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def letter_table(texts: list[str]) -> tuple[np.ndarray, int]:
    """Symbol of every code point (0: no letter) and the bits a symbol takes: each letter of the
    texts has its own, the most frequent first; all other letters share the last symbol."""
    chars: Counter[str] = Counter()
    for text in texts:
        chars.update(text.lower())
    known = sorted((c for c in chars if c.isalpha()), key=lambda c: (-chars[c], c))
    bits = max(MIN_BITS, (len(known) + 1).bit_length())
    letters = np.zeros(0x110000, np.int32)
    for block in range(0, 0x110000, 0x1000):
        if block not in range(0xD000, 0xE000):
            letters[block:block + 0x1000] = [((1 << bits) - 1) * chr(c).isalpha() for c in range(block, block + 0x1000)]
    letters[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
    return letters, bits


def frequent_grams(texts: list[str], letters: np.ndarray, letter_bits: int, limit: int) -> set[tuple[int, int]]:
    """(n - 1, code) of the ``limit`` n-grams that most of the texts hold; ties by n, then code."""
    held: list[list[np.ndarray]] = [[] for _ in range(MAX_N)]
    for text in texts:
        codes, _ = _codes([text], letters)
        for n, code in enumerate(_grams(codes[:len(codes) - 2], letter_bits)):
            held[n].append(np.unique(code))
    counted = [np.unique(np.concatenate(h), return_counts=True) for h in held]
    grams = np.concatenate([g for g, _ in counted])
    sizes = np.repeat(np.arange(MAX_N), [len(g) for g, _ in counted])
    best = np.lexsort((grams, sizes, -np.concatenate([c for _, c in counted])))[:limit]
    return set(zip(sizes[best].tolist(), grams[best].tolist()))


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Model of (language, text) rows, at most SAMPLE_PER_LANG of each language; the first of each are landmarks."""
    rows = [(lang, text) for lang, text in rows if _has_letter(text)]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    n_marks = max(1, min(LANDMARKS_PER_LANG, MODEL_LANDMARKS // len(languages)))
    seen: Counter[str] = Counter()
    is_landmark = []
    for lang, _ in rows:
        is_landmark.append(seen[lang] < n_marks)
        seen[lang] += 1
    letters, bits = letter_table([text for _, text in rows])
    quota = max(1, min(GRAMS_PER_LANG, MODEL_GRAMS // len(languages)))
    best = sorted(set().union(*(frequent_grams([t for x, t in rows if x == lang], letters, bits, quota) for lang in languages)))
    slots = []
    for n in range(MAX_N):
        own = [(gram, column) for column, (size, gram) in enumerate(best) if size == n]
        codes, columns = np.array(own, np.int64).reshape(-1, 2).T
        slots.append(Slots(codes, columns, len(best), bits))

    def features(part: list[tuple[str, str]]) -> np.ndarray:
        found = presence([t for _, t in part], letters, slots, len(best)).astype(np.float64)
        return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1.0))

    marks = features([row for row, own in zip(rows, is_landmark) if own])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > EIGEN_FLOOR * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([features(rows[k:k + CHUNK_DOCS]) @ marks.T for k in range(0, len(rows), CHUNK_DOCS)]) @ whiten
    target = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in rows])
    beta = np.linalg.solve(mapped.T @ mapped + RIDGE * np.eye(mapped.shape[1]), mapped.T @ target)
    return Model(letters, slots, len(best), marks.T @ (whiten @ beta), languages)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model is not None and _has_letter(t)]
    for k in range(0, len(known), CHUNK_DOCS):
        part = known[k:k + CHUNK_DOCS]
        found = presence([texts[i] for i in part], model.letters, model.slots, model.n_grams)
        norm = np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1.0))
        margin = (found @ model.weights.astype(np.float32)) / norm
        best = margin.argmax(axis=1)
        score[part] = np.clip((margin[np.arange(len(part)), best] + 1) / 2, 0, 1)
        for i, b in zip(part, best):
            lang[i] = model.languages[b]
    return lang, score


def excerpt(text: str) -> Column:
    """The text, or of a longer one ``PIECES`` pieces from its start to its end, SAMPLE_CHARS characters in all."""
    size = SAMPLE_CHARS // PIECES
    pieces = (f"array_join(transform(sequence(0, {PIECES - 1}), i -> substring({text}, "
              f"cast(1 + i * cast(length({text}) - {size} as bigint) div {PIECES - 1} as int), {size})), ' ')")
    return F.expr(f"if(length({text}) <= {SAMPLE_CHARS}, {text}, {pieces})")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of each language of ``labelled``, in the order of a content hash (landmarks come first)."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(rows, SAMPLE_PER_LANG, ["text"], strata="lang").select("lang", excerpt("text").alias("text"))
    order = lambda row: (row[0], hashlib.blake2b(row[1].encode("utf-8", "replace")).digest())
    return fit(sorted(((r.lang, r.text) for r in sample.collect()), key=order))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out (not ``learn``), lang_pred, score.  Learns from rows where ``learn`` holds."""
    model = train(docs.filter(learn), text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(batch.column(2).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)],
                                          ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (~learn).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
