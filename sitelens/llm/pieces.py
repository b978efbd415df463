"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The piece table of a public model file (pieces with log scores) is read, never
trained.  A text gets a leading space; the marker of white space is the space
byte itself inside this module, so a literal U+2581 in a text is no marker:
it is written as bytes and survives the round trip.  The best segmentation
maximises the sum of scores; a character no single piece covers costs the
smallest score minus 10 and is written as its bytes (byte fallback).  Equal
sums keep the path with the longer last piece, as SentencePiece does.

No piece has a space after another character, and a byte that occurs in no
piece is always on its own, so a text falls into independent chunks (a run of
spaces and the word after it).  Different chunks of a batch are segmented
together, one vectorised trie step at a time, and remembered up to a bound;
chunks longer than ``LONG`` bytes are segmented one by one.  Encoding and
decoding are maps without shuffle.

Defined results: a null text encodes to null, an empty one to no ids; null
ids decode to null; repeated rows encode alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import map_batches, utf8

MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
LONG, CACHE = 48, 400_000


class DoubleArray:
    """Byte trie in two arrays: child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = 2 * len(children) + 1024
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[:260] = True  # any byte's offset fits below the first free place
        state, queue, free = {0: 0}, [0], 260
        for node in queue:  # breadth first; grows while it is read
            at = state[node]
            self.value[at] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while used[free]:
                free += 1
            offsets = np.array(codes, np.int64) + 1
            base = free - int(offsets[0])
            while True:  # first fit, 64 bases at a time
                if base + 64 + 258 >= len(used):
                    grow = len(used)
                    self.base = np.concatenate((self.base, np.zeros(grow, np.int32)))
                    self.check = np.concatenate((self.check, np.full(grow, -1, np.int32)))
                    self.value = np.concatenate((self.value, np.full(grow, -1, np.int32)))
                    used = np.concatenate((used, np.zeros(grow, bool)))
                taken = used[(base + np.arange(64))[:, None] + offsets].any(axis=1)
                if not taken.all():
                    base += int(np.argmin(taken))
                    break
                base += 64
            self.base[at] = base
            for c, t in zip(codes, (base + offsets).tolist()):
                used[t] = True
                self.check[t] = at
                state[children[node][c]] = t
                queue.append(children[node][c])
        # A leaf's children would start at base 0; the padding makes any step from it miss.
        pad = 258
        self.base = np.concatenate((self.base, np.zeros(pad, np.int32)))
        self.check = np.concatenate((self.check, np.full(pad, -1, np.int32)))
        self.value = np.concatenate((self.value, np.full(pad, -1, np.int32)))


@dataclass
class Pieces:
    """A piece table ready for coding."""
    trie: DoubleArray
    scores: np.ndarray
    unknown: float  # score of a character without a piece
    byte_ids: np.ndarray  # byte -> id of its byte piece
    text: bytes  # the pieces' bytes, one after the other
    starts: np.ndarray
    chunk: re.Pattern[bytes]

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> "Pieces":
        """From (piece, score, kind) by id; kind is ``normal``, ``byte`` or ``other`` (never produced)."""
        keys: dict[bytes, int] = {}
        byte_ids = np.full(256, -1, np.int32)
        parts: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            data = b""
            if kind == "byte":
                data = bytes([int(piece[3:5], 16)])
                byte_ids[data[0]] = i
            elif kind == "normal":
                data = piece.encode().replace(MARKER.encode(), b" ")
                if b" " in data.lstrip(b" "):
                    raise ValueError(f"piece {piece!r} has white space inside")
                keys[data] = i
            parts.append(data)
        if (byte_ids < 0).any():
            raise ValueError("byte fallback needs a piece for every byte")
        scores = np.array([s for _, s, _ in pieces], np.float64)
        normal = [s for _, s, kind in pieces if kind == "normal"]
        held = {c for key in keys for c in key}
        alone = bytes(c for c in range(0x80) if c not in held and c != 0x20)
        cls_alone = b"".join(b"\\x%02x" % c for c in alone)
        pattern = (b"[" + cls_alone + b"]|" if alone else b"") + b" *[^ " + cls_alone + b"]+| +"
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return cls(DoubleArray(keys), scores, min(normal) - UNKNOWN_PENALTY, byte_ids, b"".join(parts), starts,
                   re.compile(pattern))


def load(path: str = MODEL) -> Pieces:
    """Read the piece table of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        if model.is_byte(i):
            return "byte"
        return "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"

    return Pieces.of([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])


def _char_len(first: np.ndarray) -> np.ndarray:
    return np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))


def segment(chunks: list[bytes], pieces: Pieces) -> list[tuple[int, ...]]:
    """Best ids of each chunk, all chunks together: one step per start byte and piece byte."""
    n, width = len(chunks), max(map(len, chunks))
    size = np.array([len(c) for c in chunks])
    data = np.frombuffer(b"".join([c.ljust(width + 5, b"\0") for c in chunks]), np.uint8).reshape(n, width + 5)
    trie, scores = pieces.trie, pieces.scores
    best = np.full((n, width + 5), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((n, width + 5), np.int32)  # start of the last piece
    piece = np.full((n, width + 5), -1, np.int32)
    for s in range(width):
        rows = np.flatnonzero((best[:, s] > -np.inf) & (size > s))
        if not len(rows):
            continue
        length = _char_len(data[rows, s])
        single = np.zeros(n, bool)
        char_end = np.zeros(n, np.int64)
        char_end[rows] = s + length
        live, state, k = rows, np.zeros(len(rows), np.int64), s
        while len(live):
            nxt = trie.base[state] + data[live, k].astype(np.int64) + 1
            ok = (trie.check[nxt] == state) & (k < size[live])
            live, state = live[ok], nxt[ok]
            k += 1
            found = trie.value[state]
            has = found >= 0
            at, ids = live[has], found[has]
            single[at[char_end[at] == k]] = True
            total = best[at, s] + scores[ids]
            better = total > best[at, k]
            at, ids = at[better], ids[better]
            best[at, k], came[at, k], piece[at, k] = total[better], s, ids
        rest = rows[~single[rows]]
        end = char_end[rest]
        total = best[rest, s] + pieces.unknown
        better = total > best[rest, end]
        rest, end = rest[better], end[better]
        best[rest, end], came[rest, end], piece[rest, end] = total[better], s, -1
    out = []
    came_rows, piece_rows = came.tolist(), piece.tolist()
    byte_ids = pieces.byte_ids.tolist()
    for i, c in enumerate(chunks):
        ids: list[int] = []
        end = len(c)
        while end:
            start, p = came_rows[i][end], piece_rows[i][end]
            if p >= 0:
                ids.append(p)
            else:
                ids.extend(byte_ids[b] for b in reversed(c[start:end]))
            end = start
        out.append(tuple(reversed(ids)))
    return out


def segment_long(chunk: bytes, pieces: Pieces) -> tuple[int, ...]:
    """Best ids of one long chunk, byte by byte."""
    base, check, value, scores = (x.tolist() for x in (pieces.trie.base, pieces.trie.check, pieces.trie.value, pieces.scores))
    n = len(chunk)
    best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        here, state, single = best[s], 0, False
        if here == -np.inf:
            continue
        first = chunk[s]
        end = s + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
        for k in range(s, n):
            nxt = base[state] + chunk[k] + 1
            if check[nxt] != state:
                break
            state = nxt
            p = value[state]
            if p >= 0:
                single |= k + 1 == end
                if here + scores[p] > best[k + 1]:
                    best[k + 1], came[k + 1], piece[k + 1] = here + scores[p], s, p
        if not single and here + pieces.unknown > best[end]:
            best[end], came[end], piece[end] = here + pieces.unknown, s, -1
    ids: list[int] = []
    end = n
    while end:
        if piece[end] >= 0:
            ids.append(piece[end])
        else:
            ids.extend(int(pieces.byte_ids[b]) for b in reversed(chunk[came[end]:end]))
        end = came[end]
    return tuple(reversed(ids))


class Encoder:
    """Encodes batches of texts; remembers the segmentation of about CACHE chunks.

    Half of them are the latest, the other half those before: a chunk met again moves to the latest, so frequent
    chunks stay while those met once go."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.before = pieces, {}, {}

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        split = self.pieces.chunk.findall
        out: list[np.ndarray | None] = []
        block: list[list[bytes] | None] = []
        size = 0
        for k, text in enumerate(texts):
            block.append(None if text is None else split(b" " + text) if text else [])
            size += len(text or b"")
            if size > 4_000_000 or k == len(texts) - 1:
                out += self._block(block)
                block, size = [], 0
        return out

    def _block(self, block: list[list[bytes] | None]) -> list[np.ndarray | None]:
        if len(self.known) > CACHE // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = set(chain.from_iterable(filter(None, block))).difference(known)
        known.update([(c, before[c]) for c in new if c in before])
        new = sorted(new.difference(before), key=len)
        cut = next((i for i, c in enumerate(new) if len(c) > LONG), len(new))
        for i in range(0, cut, 20_000):
            part = new[i:min(cut, i + 20_000)]
            known.update(zip(part, segment(part, self.pieces)))
        for c in new[cut:]:
            known[c] = segment_long(c, self.pieces)
        get = known.__getitem__
        return [None if chunks is None else np.fromiter(chain.from_iterable(map(get, chunks)), np.int32)
                for chunks in block]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text of ids: pieces joined, byte pieces as bytes, without the leading space."""
    if not len(ids):
        return b""
    starts, ends = pieces.starts[ids], pieces.starts[ids + 1]
    size = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    joined = np.frombuffer(pieces.text, np.uint8)[at].tobytes()
    return joined[1:] if joined[:1] == b" " else joined


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: id, ids, n_tokens, n_byte_tokens, round_trip (the ids decode to the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        encoder = Encoder(pieces)
        is_byte = np.zeros(len(pieces.scores), bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            texts = utf8(batch.column("text"))
            ids = encoder.encode(texts)
            trip = [None if i is None else decode_ids(i, pieces) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                 pa.array([None if i is None else int(is_byte[i].sum()) for i in ids], pa.int64()),
                 pa.array(trip, pa.bool_())], ["id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean") \
        .withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of encoded rows.  Ids outside the table are an error; bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [None if ids is None else decode_ids(np.array(ids, np.int64), pieces).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    coded = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = coded.schema["id"].dataType.simpleString()
    return map_batches(coded, run, f"id {kind}, text string").withColumnRenamed("id", id_col)
