"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of one Spark partition (about ``SHARD_WORDS``
words; a document is never cut).  Its words become symbols of the test
phrases' vocabulary, every other word a separator no phrase contains; runs of
vocabulary words too short to hold any phrase are left out, since nothing can
match there.  On these symbols the shard builds a suffix order, the
Burrows-Wheeler transform in a wavelet tree, and suffix positions sampled
along each run.  All test phrases are searched backwards at once, their
occurrences located by walking to the next sampled position, and the words
they cover merged into removal spans.

The only broadcast data are the test phrases.  They are processed in blocks
of at most about ``BLOCK_BYTES`` of benchmark text (whose index takes many times
that memory), each block one more pass inside the same scan: the driver makes
one block after the other, but a task has a Python worker for each.  Documents
are read once and never shuffled.

Defined results: a null or wordless text has no words and no hits; a null or
wordless benchmark item has no windows; windows of items with a null id hit
words like others, but name no item; rows sharing an item_id count as one item; repeated documents are judged each
on its own.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, map_batches, utf8

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 32_000_000
SAMPLE_STEP = 8

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xFF] into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
WORD_RE = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WaveletTree:
    """Rank queries over a symbol sequence: one packed bit row per level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols).bit_length())
        self.zeros, self.bits, self.before = [], [], []
        seq = symbols.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            padded = np.zeros((len(seq) // 64 + 1) * 64, np.uint8)
            padded[:len(seq)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(counts)[:-1])))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, left = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << left) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs among the first ``i`` entries."""
        lo, hi = np.zeros_like(i), i.copy()
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros_like(i)
        for k in range(self.levels):
            one = ((self.bits[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(k, i)
            value = (value << 1) | one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return value


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in suffix order by prefix doubling; every 0 is a separator of its own, smaller than all symbols."""
    n = len(symbols)
    separators = symbols == 0
    rank = np.where(separators, np.cumsum(separators) - 1, symbols + int(separators.sum())).astype(np.int64)
    step = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[:n - step] = rank[step:]
        nxt[separators] = -1
        key = rank * (int(rank.max()) + n + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class ShardIndex:
    """FM-index of one shard.  ``symbols`` starts and ends with a separator 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.tree = WaveletTree(last, n_symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))))
        starts = np.flatnonzero(symbols[:-1] == 0) + 1
        at = np.arange(len(symbols))
        run_start = np.zeros(len(symbols), np.int64)
        run_start[starts] = starts
        offset = at - np.maximum.accumulate(run_start)
        sampled = (offset % SAMPLE_STEP == 0) | (symbols == 0)
        self.marked = sampled[order]
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.positions = order[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-order interval of each phrase (rows of equal length), by backward search."""
        symbol = phrases[:, -1]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            symbol = phrases[live, j]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix-order row, walking back to a sampled one."""
        found = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.marked[rows]
            found[todo[done]] = self.positions[self.mark_rank[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                symbol = self.tree.access(rows)
                rows = self.first[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return found


class Phrases:
    """One block of test phrases: the windows of its items as symbol rows by length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners[tuple(ids[i:i + size])].update(() if item is None else (item,))
        by_size: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_size[len(phrase)].append(phrase)
        self.groups = [(np.array(v, np.int64), [sorted(owners[p]) for p in v]) for k, v in sorted(by_size.items())]
        self.shortest = min(by_size, default=0)

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[str]]]:
        """(first word positions, phrase length, items) of each phrase that occurs in ``ids`` (0: no phrase word)."""
        if not self.groups:
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        sizes = ends - starts + 1  # each run is followed by a separator
        shift = np.concatenate(([1], np.cumsum(sizes)[:-1] + 1))
        origin = np.repeat(starts - shift, sizes) + np.arange(1, int(sizes.sum()) + 1)
        symbols = np.zeros(len(origin) + 1, np.int64)
        keep = origin < np.repeat(ends, sizes)
        symbols[1:][keep] = ids[origin[keep]]
        origin = np.concatenate(([0], origin))
        index = ShardIndex(symbols, len(self.vocabulary))
        for phrases, owners in self.groups:
            lo, hi = index.search(phrases)
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            count = (hi - lo)[hit]
            rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            places = origin[index.locate(rows)]
            for k, at in zip(hit, np.split(places, np.cumsum(count)[:-1])):
                yield at, phrases.shape[1], owners[k]


def judge(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, np.ndarray, set[str]]]:
    """Per document of one shard: word count, merged hit spans as (n, 2) word indexes, items."""
    get, rows, sizes = phrases.vocabulary.get, [], []
    for text in texts:
        w = words(text)
        row = np.zeros(len(w) + 1, np.int64)
        row[:-1] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        rows.append(row)
        sizes.append(len(row))
    ids = np.concatenate(rows)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    cover = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for at, size, owners in phrases.find(ids):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        for d in np.unique(np.searchsorted(begin, at, side="right") - 1):
            items[int(d)].update(owners)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).view(np.int8), [0]))))
    spans = edge.reshape(-1, 2)
    owner = np.searchsorted(begin, spans[:, 0], side="right") - 1
    out = []
    for d, size in enumerate(sizes):
        a, b = np.searchsorted(owner, [d, d + 1])
        out.append((size - 1, spans[a:b] - begin[d], items.get(d, set())))
    return out


def shards(batch: pa.RecordBatch, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about SHARD_WORDS words (6 bytes to a word); a document is never cut."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= SHARD_WORDS * 6:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of sorted or unsorted [start, end) rows; touching spans join."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate(([True], spans[1:, 0] > top[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(spans) - 1]))
    return np.column_stack((spans[fresh, 0], top[last]))


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark's phrases, a bounded block of items at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")) \
        .filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct()
        yield Phrases([(r.i, r.t.encode()) for r in part.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (id, n_words, spans, items): merged hit spans as word indexes [start, end), and the items found."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"),
                        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
                        F.lit(None).cast("array<string>").alias("items"))
    for block in phrase_blocks(benchmark, item_col, item_text, window):
        shared = spark.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                texts = utf8(batch.column("text"))
                for a, b in shards(batch, texts):
                    part = batch.slice(a, b - a)
                    n_words, spans, items = [], [], []
                    for (n, new, found), old, known in zip(judge(texts[a:b], phrases), part.column("spans").to_pylist(),
                                                           part.column("items").to_pylist()):
                        if old:
                            new = merge_spans(np.concatenate((new, [(s["start"], s["end"]) for s in old])))
                        n_words.append(n)
                        spans.append([{"start": int(s), "end": int(e)} for s, e in new])
                        items.append(sorted(found | set(known or ())))
                    cols = [part.column("id"), part.column("text"), pa.array(n_words, pa.int64()),
                            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "text", "n_words", "spans", "items"])

        state = map_batches(state, mark, f"id {id_type}, text string, n_words long, "
                                       "spans array<struct<start:long,end:long>>, items array<string>")
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_contamination(docs, benchmark, id_col=id_col, **kw)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "spans")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the word ranges ``spans`` (from the first word's first to the last word's last character)."""
    data = text.encode()
    places = [m.span() for m in WORD_RE.finditer(data.translate(WORD_BYTES))]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The documents with all hit spans cut from their text; other columns and clean texts unchanged.

    ``n_chars``, where the table has it as a whole number, follows the new text.
    """
    spark = docs.sparkSession
    out, place = docs, fresh(docs, "_spans")
    for block in phrase_blocks(benchmark, kw.get("item_col", "item_id"), kw.get("item_text", "text"),
                               kw.get("window", WINDOW)):
        shared = spark.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                texts = utf8(batch.column(text_col))
                for a, b in shards(batch, texts):
                    part = batch.slice(a, b - a)
                    spans = [[{"start": int(s), "end": int(e)} for s, e in new]
                             for _, new, _ in judge(texts[a:b], phrases)]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    seen = part.column(place).to_pylist()
                    spans = [[*(old or ()), *new] for old, new in zip(seen, spans)]
                    yield part.set_column(part.schema.get_field_index(place), place, pa.array(spans, kind))

        if place not in out.columns:
            out = out.withColumn(place, F.lit(None).cast("array<struct<start:long,end:long>>"))
        out = map_batches(out, mark, out.schema)

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = batch.column(text_col).to_pylist()
            new = list(texts)
            for i, spans in enumerate(batch.column(place).to_pylist()):
                if spans:
                    rows = merge_spans(np.array([(s["start"], s["end"]) for s in spans], np.int64))
                    new[i] = cut_words(texts[i], rows.tolist())
            result = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))
            if "n_chars" in result.schema.names and pa.types.is_integer(result.schema.field("n_chars").type):
                kind = result.schema.field("n_chars").type
                old = batch.column("n_chars").to_pylist()
                size = [o if a is b or b is None else len(b) for a, b, o in zip(texts, new, old)]
                result = result.set_column(result.schema.get_field_index("n_chars"), "n_chars", pa.array(size, kind))
            yield result.drop_columns([place])

    return map_batches(out, cut, docs.schema)
