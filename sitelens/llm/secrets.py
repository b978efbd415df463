"""Secret scans: fixed patterns plus a log-likelihood ratio of two character Markov models.

One model is trained on random strings (what the fixed patterns mark), the
other on ordinary identifiers (all other runs of token characters) of a
bounded sample of documents.  Of every run of token characters in every whole
text, what pattern spans leave of it is scored by log P(random) -
log P(ordinary) over its character transitions.  A piece of at least
``MIN_RATIO`` nats becomes a span of kind ``random``; of any other piece the
stretches of ``MIN_TOKEN`` or more characters with at least ``MIN_RATIO`` nats
do (the set of stretches with the largest sum), widened to whole words.

Training sends counts, not texts, to the driver: at most 2 x 97 x 96 cells.
Scanning is a map over the documents without shuffle.

Defined results: a null text counts as empty and has no spans; offsets are
code points, end exclusive; repeated documents are scanned each on its own;
with no sample (empty table) both models are uniform and add no spans.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bounded_sample, map_arrow, map_batches

#: Bound on the documents the two models are trained on.
SAMPLE_DOCS = 20_000
MIN_TOKEN = 16
MIN_RATIO = 6.0
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Span kinds in their order at equal starts.
KINDS = ("assign", "access", "hex", "random")
MASK = "<secret>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs of token characters; every access and hex match lies inside one of the long runs.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(MIN_TOKEN, MIN_ACCESS, MIN_HEX))
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

BACK_OFF = 50.0
SYMBOLS = 96  # printable ASCII and one symbol for the rest
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[str], list[tuple[int, str]]]:
    """Pattern spans, the matched secret values, and the long token runs as (start, run)."""
    spans: list[Span] = []
    values: list[str] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= MIN_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append(m.group(2))
    runs = [(m.start(), m.group()) for m in TOKEN.finditer(text)]
    for start, run in runs:
        if "AKIA" in run:
            for m in ACCESS.finditer(run):
                if m.end() - m.start() >= MIN_ACCESS:
                    spans.append((start + m.start(), 1, start + m.end()))
                    values.append(m.group())
        if len(run) >= MIN_HEX:
            for m in HEX.finditer(run):
                if m.end() - m.start() >= MIN_HEX:
                    spans.append((start + m.start(), 2, start + m.end()))
                    values.append(m.group())
    return sorted(spans), values, runs


def covered(start: int, end: int, spans: list[Span]) -> bool:
    return any(s < end and start < e for s, _, e in spans)


def symbol_codes(tokens: list[str]) -> np.ndarray:
    """Symbols 1..96 of all tokens, each token preceded by the start symbol 0."""
    data = np.frombuffer(("\n" + "\n".join(tokens)).encode("ascii", "replace"), np.uint8)
    return np.where(data == 10, 0, np.clip(data.astype(np.int64) - 31, 1, SYMBOLS)).astype(np.int64)


def transition_counts(tokens: list[str]) -> np.ndarray:
    counts = np.zeros((SYMBOLS + 1, SYMBOLS + 1), np.int64)
    if tokens:
        codes = symbol_codes(tokens)
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
        counts[:, 0] = 0
    return counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Table of log-likelihood ratios by (previous symbol, symbol); 0 is the start of a run."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    sample = bounded_sample(rows, sample_docs, ["id", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS + 1, SYMBOLS + 1), np.int64)
        for batch in batches:
            secret, ordinary = [], []
            for text in batch.column("text").to_pylist():
                spans, values, _ = base_spans(text)
                secret += values
                ordinary += [m.group() for m in ORDINARY.finditer(text)
                             if not spans or not covered(m.start(), m.end(), spans)]
            total[0] += transition_counts(secret)
            total[1] += transition_counts(ordinary)
        kind, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(total[kind, a, b])],
                                         ["kind", "a", "b", "n"])

    cells = map_batches(sample.select("text"), count, "kind long, a long, b long, n long") \
        .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SYMBOLS + 1, SYMBOLS + 1))
    for r in cells:
        counts[r.kind, r.a, r.b] += r.n
    # Transitions backed off to the symbols' own frequencies, those to a uniform count.
    alone = counts.sum(axis=1, keepdims=True) + 1.0
    alone[:, :, 0] = 0
    alone /= alone.sum(axis=2, keepdims=True)
    probability = (counts + BACK_OFF * alone) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    ratio = np.zeros((SYMBOLS + 1, SYMBOLS + 1))
    ratio[:, 1:] = np.log(probability[0, :, 1:]) - np.log(probability[1, :, 1:])
    return ratio


def steps(tokens: list[str], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios of the characters of all tokens, one 0 after each token, and where each token starts."""
    codes = symbol_codes(tokens)
    return np.concatenate((ratio[codes[:-1], codes[1:]], [0.0])), np.flatnonzero(codes == 0)


def stretches(gains: list[float], min_ratio: float) -> list[tuple[int, int]]:
    """Disjoint stretches of MIN_TOKEN or more characters with the largest sum, each worth ``min_ratio`` more than nothing."""
    n = len(gains)
    total = [0.0, *itertools.accumulate(gains)]
    best, begin = [0.0] * (n + 1), [-1] * (n + 1)  # of the first k characters; start of the stretch that ends at k
    top, at = -math.inf, 0
    for k in range(1, n + 1):
        best[k] = best[k - 1]
        i = k - MIN_TOKEN
        if i >= 0:
            if best[i] - total[i] > top:
                top, at = best[i] - total[i], i
            if top + total[k] - min_ratio >= best[k]:
                best[k], begin[k] = top + total[k] - min_ratio, at
    out, k = [], n
    while k > 0:
        if begin[k] >= 0:
            out.append((begin[k], k))
            k = begin[k]
        else:
            k -= 1
    return out[::-1]


def random_parts(tokens: list[str], ratio: np.ndarray, min_ratio: float = MIN_RATIO) -> dict[str, list[tuple[int, int]]]:
    """The random parts [start, end) of each token that has any."""
    found: dict[str, list[tuple[int, int]]] = {}
    tokens = list(dict.fromkeys(tokens))
    if not tokens:
        return found
    gains, starts = steps(tokens, ratio)
    whole, most = np.add.reduceat(gains, starts), np.add.reduceat(np.maximum(gains, 0.0), starts)
    for k in np.flatnonzero(most >= min_ratio):
        token, first = tokens[k], starts[k]
        if whole[k] >= min_ratio:
            found[token] = [(0, len(token))]
            continue
        parts: list[tuple[int, int]] = []
        for a, b in stretches(gains[first:first + len(token)].tolist(), min_ratio):
            while a > 0 and token[a].isalnum() and token[a - 1].isalnum():
                a -= 1
            while b < len(token) and token[b - 1].isalnum() and token[b].isalnum():
                b += 1
            if parts and a <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(b, parts[-1][1]))
            else:
                parts.append((a, b))
        if parts:
            found[token] = parts
    return found


def left_over(start: int, run: str, spans: list[Span]) -> list[tuple[int, str]]:
    """The pieces of MIN_TOKEN or more characters that ``spans`` (by start) leave of a run, as (start, piece)."""
    out, at, end = [], start, start + len(run)
    for s, _, e in spans:
        if e > at and s < end:
            out.append((at, max(at, s)))
            at = e
    out.append((at, end))
    return [(a, run[a - start:b - start]) for a, b in out if b - a >= MIN_TOKEN]


def find_spans(texts: list[str | None], ratio: np.ndarray, min_ratio: float = MIN_RATIO) -> list[list[Span]]:
    """All spans of each text, by start, then kind."""
    found = []
    for t in texts:
        spans, _, runs = base_spans(t or "")
        found.append((spans, [p for s, run in runs for p in (left_over(s, run, spans) if spans else [(s, run)])]))
    parts = random_parts([p for _, pieces in found for _, p in pieces if len(p) >= MIN_TOKEN], ratio, min_ratio)
    out = []
    for spans, pieces in found:
        extra = [(s + a, 3, s + b) for s, p in pieces for a, b in parts.get(p, ())]
        out.append(sorted(spans + extra) if extra else spans)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: np.ndarray | None = None) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    ratio = train(docs, id_col, text_col) if ratio is None else ratio
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, spans = [], [], []
        for found in find_spans(batch.column(1).to_pylist(), shared.value):
            kinds = [k for _, k, _ in found]
            counts.append([kinds.count(k) for k in range(4)])
            base.append(hashlib.sha256(written([s for s in found if s[1] < 3]).encode()).hexdigest())
            spans.append(written(found))
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(base), pa.array(spans)],
                                          ["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, n_assign long, n_access long, n_hex long, n_random long, "
                                "base_sha256 string, spans string").withColumnRenamed("id", id_col)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every maximal run of span characters replaced by MASK."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with secrets masked; other columns, clean texts and rows unchanged (a whole-number ``n_chars`` follows)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        new = [mask(t, s) if s else t for t, s in zip(texts, find_spans(texts, shared.value))]
        out = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))
        if "n_chars" in out.schema.names and pa.types.is_integer(out.schema.field("n_chars").type):
            size = [o if a is b else len(b) for a, b, o in zip(texts, new, batch.column("n_chars").to_pylist())]
            out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars",
                                 pa.array(size, out.schema.field("n_chars").type))
        return out

    return map_arrow(docs, run, docs.schema)
