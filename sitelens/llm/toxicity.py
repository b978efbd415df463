"""Toxicity by a linear-chain conditional random field over words.

Token labels come from the document labels: over the labelled training rows
(at most ``LABELLED_DOCS`` of each label, chosen by hash) the job counts, for
every word and every word prefix of 3 to 7 letters, the toxic and the clean
documents that hold it.  Features in at least ``MIN_DOCS`` toxic documents
that are ``MIN_LIFT`` times as frequent there as in clean ones (smoothed, so
the test does not depend on the size of the table), counted again only where
no stronger feature explains the document, are the lexicon; a word of a toxic document is labelled toxic if it
has a lexicon feature.  On windows around such words and on clean
windows of a bounded sample of documents a two-state chain (clean, toxic) is
trained by its conditional likelihood: feature weights, a bias and the four
transitions.

Scoring runs forward-backward over every whole text.  Words without a
feature all have the same potentials, so a run of k of them is one power of a
2 x 2 matrix, in closed form; the recursion steps from feature word to
feature word and is exact.  A document's score is the largest marginal of the
toxic state among its words; words with a marginal of 0.5 or more give the
offending spans.  Scoring is a map without shuffle.

Defined results: null, empty and wordless texts score 0 with no spans;
repeated rows score alike; conflicting labels of one id count as toxic if any
is; with no toxic training row (empty tables) every score is the chain's
marginal without features, below 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bounded_sample, map_batches

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
#: Lexicon tests and its size bound.
MIN_DOCS, MIN_LIFT, MAX_FEATURES = 3, 10.0, 5_000
#: Bound on the label rows of each label that the lexicon is counted on (broadcast; texts are not shuffled).
LABELLED_DOCS = 20_000
#: Bounds of the chain's training sample: documents of each label, windows of a document, words around a feature.
SAMPLE_DOCS, WINDOWS, CONTEXT = 2_000, 4, 8
STEPS, RATE, DECAY = 200, 0.1, 1e-4
FLUSH, CACHE = 400_000, 300_000
BIAS = 0  # index of the feature every word has


def features(word: str) -> list[str]:
    """The word itself (marked by ``=``) and its prefixes, lower case."""
    low = word.lower()
    return ["=" + low, *(low[:k] for k in PREFIXES if k <= len(low))]


@dataclass
class Model:
    """Log potentials: feature weights for the toxic state, transitions [from][to], start [state]."""
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def found(self, word: str) -> list[int]:
        return [self.index[f] for f in features(word) if f in self.index]


class Emissions(dict):
    """Word -> log potential of the toxic state; words are remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.bias = model, float(model.weights[BIAS])

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self.bias + float(self.model.weights[self.model.found(word)].sum())
        self[word] = value
        return value


class Chain:
    """Exact marginals of the toxic state at the words whose potentials differ from the plain word's."""

    def __init__(self, model: Model):
        self.start, self.plain = np.exp(model.start), math.exp(model.weights[BIAS])
        self.step = np.exp(model.moves)
        run = self.step * np.array([1.0, self.plain])  # one plain word further
        half, det = (run[0, 0] + run[1, 1]) / 2, run[0, 0] * run[1, 1] - run[0, 1] * run[1, 0]
        root = math.sqrt(max(half * half - det, 0.0)) or 1e-300
        big, small = half + root, half - root
        self.big_part = (run - small * np.eye(2)) / (big - small)
        self.small_part = np.eye(2) - self.big_part
        self.ratio = small / big
        self.first_plain = self.start * np.array([1.0, self.plain])

    def power(self, k: int) -> np.ndarray:
        """The matrix of k plain words, up to a positive factor."""
        return self.big_part + self.ratio ** k * self.small_part

    def marginals(self, emissions: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Toxic marginals at ``active`` words of a text whose log potentials are ``emissions``."""
        n, own = len(emissions), np.exp(np.minimum(emissions[active], 500.0))
        forward = np.empty((len(active), 2))
        for t, at in enumerate(active):
            if t == 0:
                v = self.start if at == 0 else self.first_plain @ self.power(int(at) - 1) @ self.step
            else:
                v = forward[t - 1] @ self.power(int(at - active[t - 1]) - 1) @ self.step
            v = v * np.array([1.0, own[t]])
            forward[t] = v / v.sum()
        out = np.empty(len(active))
        back = self.power(n - 1 - int(active[-1])) @ np.ones(2)
        for t in range(len(active) - 1, -1, -1):
            both = forward[t] * back
            out[t] = both[1] / both.sum()
            if t:
                gap = self.power(int(active[t] - active[t - 1]) - 1)
                back = gap @ (self.step @ (back * np.array([1.0, own[t]])))
                back = back / back.sum()
        return out

    def plain_marginal(self, n: int) -> float:
        """Toxic marginal in the middle of a text of n plain words."""
        left = self.first_plain @ self.power(n // 2)
        both = left * (self.power(n - 1 - n // 2) @ np.ones(2))
        return float(both[1] / both.sum())


def score_text(text: str | None, emissions: Emissions, chain: Chain) -> tuple[float, list[int], np.ndarray]:
    """Document score, word indexes with a feature, and their marginals."""
    words = WORD.findall(text) if text else []
    if not words:
        return 0.0, [], np.zeros(0)
    values = np.fromiter(map(emissions.__getitem__, words), np.float64, len(words))
    active = np.flatnonzero(values != emissions.bias)
    if not len(active):
        return min(chain.plain_marginal(len(words)), 1.0), [], np.zeros(0)
    found = chain.marginals(values, active)
    return float(min(found.max(), 1.0)), active.tolist(), found


def spans(text: str, active: list[int], marginals: np.ndarray, at_least: float = 0.5) -> list[tuple[int, int]]:
    """Code point spans [start, end) of offending words; neighbours share a span."""
    wanted = [k for k, m in zip(active, marginals) if m >= at_least]
    if not wanted:
        return []
    out: list[tuple[int, int]] = []
    last, chosen = -2, set(wanted)
    for k, m in enumerate(WORD.finditer(text)):
        if k in chosen:
            if k == last + 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = k
    return out


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each label that hold the feature, from rows (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(total: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()),
                 pa.array([v[1] for v in total.values()], pa.int64())], ["feature", "clean", "toxic"])

        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held: set[str] = set()
                for word in set(WORD.findall(text)):
                    held.update(features(word))
                for f in held:
                    total[f][toxic] += 1
                if len(total) > FLUSH:
                    yield rows(total)
                    total.clear()
        if total:
            yield rows(total)

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    return map_batches(rows, count, "feature string, clean long, toxic long") \
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(labelled: DataFrame) -> list[str]:
    """The features that mark toxic documents, at most MAX_FEATURES, strongest first."""
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    rate = n_toxic / (n_toxic + n_clean)
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = a + c
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, n * rate) + part(c, n * (1 - rate)))
    lift = lambda toxic, clean: ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    best = feature_counts(labelled).filter((a >= MIN_DOCS) & (lift(a, c) >= MIN_LIFT)) \
        .select("feature", "clean", g.alias("g")).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
    credit = credits(labelled.filter("toxic = 1"), {r.feature: r.g for r in best})
    own = [(r.feature, credit.get(r.feature, 0), r.clean) for r in best]
    return [f for f, toxic, clean in own if toxic >= MIN_DOCS and lift(toxic, clean) >= MIN_LIFT]


def credits(toxic: DataFrame, strength: dict[str, float]) -> dict[str, int]:
    """Toxic documents in which a feature is among the strong ones (at least half the strongest there).

    Words that only keep company with stronger features, as all words of a
    much copied toxic document do, get no credit.
    """
    shared = toxic.sparkSession.sparkContext.broadcast(strength)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held = {f for word in set(WORD.findall(text)) for f in features(word) if f in known}
                top = max((known[f] for f in held), default=0.0)
                total.update(f for f in held if known[f] >= top / 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         ["feature", "n"])

    rows = map_batches(toxic.select("text"), count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return {r.feature: r.n for r in rows.collect()}


def windows(sample: DataFrame, index: dict[str, int]) -> list[tuple[list[list[int]], list[int]]]:
    """Training windows as (features of each word, label of each word) from rows (text, toxic)."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = [model.found(w) for w in WORD.findall(text)]
                if not found:
                    continue
                marked = [i for i, f in enumerate(found) if f]
                centres = marked[::max(1, len(marked) // (WINDOWS - 1))][:WINDOWS - 1] + [len(found) // 2]
                for i in sorted(set(centres)):
                    part = found[max(0, i - CONTEXT):i + CONTEXT + 1]
                    out.append({"words": part, "labels": [int(bool(f) and toxic == 1) for f in part]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([o["words"] for o in out], pa.list_(pa.list_(pa.int32()))),
                 pa.array([o["labels"] for o in out], pa.list_(pa.int32()))], ["words", "labels"])

    rows = map_batches(sample.select("text", F.col("toxic").cast("int").alias("toxic")), cut,
                       "words array<array<int>>, labels array<int>")
    return sorted((r.words, r.labels) for r in rows.collect())


def fit(sequences: list[tuple[list[list[int]], list[int]]], index: dict[str, int]) -> Model:
    """Maximise the windows' conditional log likelihood by gradient steps (Adam)."""
    size, model = len(index) + 1, Model(index)
    if not index or not sequences:
        return model
    length = max(len(w) for w, _ in sequences)
    count = len(sequences)
    labels, real = np.zeros((count, length), np.int64), np.zeros((count, length), bool)
    at, which = [], []
    for s, (words, marks) in enumerate(sequences):
        real[s, :len(words)], labels[s, :len(words)] = True, marks
        for t, found in enumerate(words):
            for f in (BIAS, *found):
                at.append(s * length + t)
                which.append(f)
    at, which = np.array(at), np.array(which)
    both = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    seen_start = np.bincount(labels[:, 0], minlength=2).astype(float)
    theta = np.concatenate(([-2.0], np.zeros(size - 1), np.zeros(4), np.zeros(2)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat = labels.reshape(-1)
    seen_f = np.bincount(which, flat[at], size)
    for step in range(1, STEPS + 1):
        w, moves, start = theta[:size], theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        emit = np.zeros((count, length, 2))
        emit[:, :, 1] = np.bincount(at, w[which], count * length).reshape(count, length)
        forward, back = np.zeros((count, length, 2)), np.zeros((count, length, 2))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], nxt, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(length - 2, -1, -1):
            after = emit[:, t + 1] + back[:, t + 1]
            nxt = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
            back[:, t] = np.where(real[:, t + 1, None], nxt, 0.0)
        marginal = np.exp(forward + back - total[:, None, None]) * real[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + moves + (emit + back)[:, 1:, None, :] - total[:, None, None, None])
        expected = (pair * both[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.concatenate((
            seen_f - np.bincount(which, marginal[:, :, 1].reshape(-1)[at], size),
            (seen - expected).reshape(-1), seen_start - marginal[:, 0].sum(axis=0))) / count - DECAY * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        theta = theta + RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Model(index, theta[:size], theta[size:size + 4].reshape(2, 2), theta[size + 4:])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Fit lexicon and chain on the documents that ``labels`` marks 0 or 1."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")) \
        .filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    marks = F.broadcast(bounded_sample(marks, LABELLED_DOCS, ["id"], strata="toxic"))
    labelled = rows.join(marks, "id").select("text", "toxic")
    index = {f: k + 1 for k, f in enumerate(lexicon(labelled))}
    sample = bounded_sample(labelled, SAMPLE_DOCS, ["text"], strata="toxic") if index else labelled.limit(0)
    return fit(windows(sample, index), index)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """One row per document: id, score, predicted, spans (offending code point ranges); ``extra`` rides along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions, chain = Emissions(shared.value), Chain(shared.value)
        for batch in batches:
            scores, places = [], []
            for text in batch.column("text").to_pylist():
                s, active, marginals = score_text(text, emissions, chain)
                scores.append(s)
                places.append([{"start": a, "end": b} for a, b in spans(text, active, marginals)] if s >= 0.5 else [])
            value = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)),
                 pa.array(places, span)], ["id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), (F.lit(False) if extra is None else extra).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, held_out boolean, score double, predicted int, "
                                "spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The documents that score under ``below``; columns unchanged.  A map without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions, chain = Emissions(shared.value), Chain(shared.value)
        for batch in batches:
            stays = [score_text(t, emissions, chain)[0] < below for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, run, docs.schema)
