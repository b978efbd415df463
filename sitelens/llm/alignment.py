"""Cross-tokenizer alignment by galloping intersection of token end offsets.

A text is encoded twice, with a byte-level BPE (A, on a space and the text) and
a SentencePiece BPE (B, which adds that space itself).  Tokens are runs of the
same bytes, so each encoding is an ascending list of end offsets.  The shorter
list of a document drives the search: every end starts at its proportional
place in the longer list, doubles its step until it is bracketed and finishes
by binary search.  Ends found in both lists cut the tokens into groups;
differences of neighbouring ranks are the ranges of tokens that overlap.  All
documents of a block are searched together in numpy.

Words repeat, so both encoders see each different chunk of a task once.  A
chunk begins at a space after a character that is no white space: neither the
splitting pattern of A nor a piece of B reaches over that point (pieces are
checked for it; a vocabulary with such a piece is given whole texts).

Link counts of id pairs are added within a task first, then by Spark.  They
come back to the documents by a broadcast of at most ``MAX_BROADCAST_PAIRS``
pairs; beyond that by a shuffle join on the pair, where pairs with more than
1/``HOT_SHARE`` of all links (fewer than ``HOT_SHARE``) are joined apart.

Defined results: a text that is null or empty, or that either encoding does
not give back byte for byte, has no tokens, no groups and zero counts; every
row gives one row, repeated rows and null ids too; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import map_batches, stored

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes that a worker aligns at once, new chunks encoded as one text, bytes of remembered chunks.
BLOCK_BYTES = 2_000_000
JOINED = 2_000
CACHE_BYTES = 24_000_000
MAX_BROADCAST_PAIRS = 2_000_000
HOT_SHARE = 2000
#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for a space in the pieces of B, so a text that holds it is never given back.
MARK = "▁"
CHUNK = re.compile(r"(?<=\S)(?= )")
#: White space before a space: then not every space begins a chunk.
UNEVEN = re.compile(r"\s ")


@dataclass(frozen=True)
class Models:
    """Both vocabularies: ranks and bytes of A, model file and bytes of B."""
    ranks: dict[bytes, int]
    bytes_a: list[bytes]
    proto: bytes
    bytes_b: list[bytes]
    chunked: bool

    @property
    def shift(self) -> int:
        """Bits of a B id in a pair code; codes of two small vocabularies fit 32 bits."""
        return 16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else 32


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def load(byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Models:
    """Read both files on the driver; executors get them by broadcast."""
    import sentencepiece
    spec = json.load(open(byte_model, encoding="utf-8"))
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    bytes_a = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if token not in special:
            bytes_a[i] = bytes(alphabet[c] for c in token)
    ranks = {b: i for i, b in enumerate(bytes_a) if b}
    proto = open(piece_model, "rb").read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    bytes_b, chunked = [], True
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            bytes_b.append(b"")
        elif model.is_byte(i):
            bytes_b.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        else:
            piece = model.id_to_piece(i).replace(MARK, " ")
            chunked &= not re.search(r"\S ", piece)
            bytes_b.append(piece.encode())
    return Models(ranks, bytes_a, proto, bytes_b, chunked)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Encoders:
    """Both encoders, with the ids of the chunks seen so far in two flat arrays."""

    def __init__(self, models: Models):
        import sentencepiece
        import tiktoken
        self.models = models
        self.a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=models.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models.proto)
        self.space = self.b.piece_to_id(MARK)
        self.sizes = [np.array([len(b) for b in bs], np.int64) for bs in (models.bytes_a, models.bytes_b)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, given without their first space.  Those that end in white space or hold
        the mark of B go one by one; all others many to a text, whose tokens end where a chunk ends."""
        together = [self.models.chunked and c != "" and not c[-1].isspace() and MARK not in c for c in chunks]
        joined = [c for c, yes in zip(chunks, together) if yes]
        apart = [c for c, yes in zip(chunks, together) if not yes]
        first = len(self.known)
        self.known.update(zip([*joined, *apart], range(first, first + len(chunks))))
        self.size += sum(map(len, chunks))
        stops = np.cumsum([len(c.encode()) + 1 for c in joined], dtype=np.int64)
        parts = [" ".join(joined[i:i + JOINED]) for i in range(0, len(joined), JOINED)]
        for k, encode in enumerate((self.ids_a, self.ids_b)):
            ids = np.concatenate([np.empty(0, np.int32), *map(encode, parts)])
            ends = np.searchsorted(np.cumsum(self.sizes[k][ids]), stops) + 1
            rest = [encode(c) for c in apart]
            done = self.at[k][-1]
            self.flat[k] = np.concatenate([self.flat[k], ids, *rest])
            self.at[k] = np.concatenate([self.at[k], done + ends,
                                         done + len(ids) + np.cumsum([len(r) for r in rest], dtype=np.int64)])

    def ids_a(self, chunk: str) -> np.ndarray:
        return np.array(self.a.encode_ordinary(" " + chunk), np.int32)

    def ids_b(self, chunk: str) -> np.ndarray:
        return np.array(self.b.encode(chunk) if chunk else [self.space], np.int32)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text that begins with a space, each without its first space."""
        if not self.models.chunked or MARK in text:
            return [text[1:]]
        if UNEVEN.search(text):
            return [c[1:] for c in CHUNK.split(text)]
        return text[1:].split(" ")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets of the texts) of A and of B."""
        split = [self.chunks(t) for t in texts]
        if self.size > CACHE_BYTES:
            self.forget()
        known = self.known
        self.learn([c for c in dict.fromkeys(chain.from_iterable(split)) if c not in known])
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        out = []
        for flat, at in zip(self.flat, self.at):
            n = at[index + 1] - at[index]
            offsets = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
            out.append((flat[ranges(at[index], n)], offsets))
        return out


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place in ``long`` (ascending) whose value is at least each value of ``short``.

    The place lies in [low, high] and ``long[high]`` is at least the value.
    From ``guess`` the step doubles, upwards or downwards, until the place is
    bracketed; the bracket is then halved.
    """
    over = long[guess] >= short
    top = np.where(over, guess, high)
    bottom = np.where(over, low - 1, guess)
    for up in (True, False):
        active = np.flatnonzero(over != up)
        step = 1
        while len(active):
            if up:
                probe = np.minimum(guess[active] + step, top[active])
                reached = long[probe] >= short[active]
                top[active[reached]] = probe[reached]
                bottom[active[~reached]] = probe[~reached]
                active = active[~reached]
            else:
                probe = np.maximum(guess[active] - step, bottom[active])
                inside = probe > bottom[active]
                reached = ~inside | (long[np.maximum(probe, 0)] < short[active])
                bottom[active[reached]] = probe[reached]
                top[active[~reached]] = probe[~reached]
                active = active[~reached]
            step *= 2
    active = np.flatnonzero(top - bottom > 1)
    while len(active):
        middle = (top[active] + bottom[active]) // 2
        reached = long[middle] >= short[active]
        top[active[reached]] = middle[reached]
        bottom[active[~reached]] = middle[~reached]
        active = active[top[active] - bottom[active] > 1]
    return top


@dataclass
class Alignment:
    """Groups and links of a block of documents whose tokens lie one after the other."""
    last_a: np.ndarray      # last A token and last B token of every group
    last_b: np.ndarray
    link_a: np.ndarray      # A token, B token and document of every link
    link_b: np.ndarray
    link_doc: np.ndarray
    group_doc: np.ndarray


def intersect(ends_a: np.ndarray, off_a: np.ndarray, ends_b: np.ndarray, off_b: np.ndarray) -> Alignment:
    """Align documents given the ascending end offsets of their tokens over the whole block."""
    n_a, n_b = np.diff(off_a), np.diff(off_b)
    swap = n_b < n_a
    both = np.concatenate([ends_a, ends_b])
    start_a, start_b = off_a[:-1], off_b[:-1] + len(ends_a)
    n_short, n_long = np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
    at_short = ranges(np.where(swap, start_b, start_a), n_short)
    at_long = ranges(np.where(swap, start_a, start_b), n_long)
    short, long = both[at_short], both[at_long]
    doc = np.repeat(np.arange(len(n_short)), n_short)
    first = np.cumsum(n_long) - n_long
    local = np.arange(len(short)) - (np.cumsum(n_short) - n_short)[doc]
    place = gallop(short, long, first[doc] + local * n_long[doc] // np.maximum(n_short[doc], 1),
                   first[doc], (first + n_long - 1)[doc])
    common = long[place] == short
    rank = np.concatenate([[0], (place + common)[:-1]]) if len(place) else place
    width = place - rank + 1
    one, other = np.repeat(at_short, width), at_long[ranges(rank, width)]
    link_doc = np.repeat(doc, width)
    flip = swap[link_doc]
    hit = np.flatnonzero(common)
    hit_short, hit_long, hit_flip = at_short[hit], at_long[place[hit]], swap[doc[hit]]
    return Alignment(np.where(hit_flip, hit_long, hit_short), np.where(hit_flip, hit_short, hit_long) - len(ends_a),
                     np.where(flip, other, one), np.where(flip, one, other) - len(ends_a), link_doc, doc[hit])


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Aligner:
    """Aligns batches of texts in a worker."""

    def __init__(self, models: Models):
        self.models, self.encoders = models, Encoders(models)
        self.bytes = [_objects(models.bytes_a), _objects(models.bytes_b)]
        self.sizes = self.encoders.sizes
        n = max(len(models.bytes_a), len(models.bytes_b))
        self.comma, self.bar, self.semicolon, self.plain = (
            _objects([f"{i}{sep}".encode() for i in range(n)]) for sep in (",", "|", ";", ""))

    def block(self, texts: list[bytes]) -> list[dict]:
        spaced = [b" " + t for t in texts]
        coded = self.encoders.encode([t.decode() for t in spaced])
        same = np.ones(len(texts), bool)
        for (ids, off), table in zip(coded, self.bytes):
            pieces = table[ids].tolist()
            same &= [b"".join(pieces[off[k]:off[k + 1]]) == spaced[k] for k in range(len(texts))]
        kept = np.flatnonzero(same)
        (a, off_a), (b, off_b) = [
            (ids[ranges(off[kept], np.diff(off)[kept])], np.concatenate([[0], np.cumsum(np.diff(off)[kept])]))
            for ids, off in coded]
        found = intersect(np.cumsum(self.sizes[0][a]), off_a, np.cumsum(self.sizes[1][b]), off_b)
        groups = self.write(a, b, off_a + off_b, found)
        codes = (a[found.link_a].astype(np.int64) << self.models.shift) | b[found.link_b]
        pairs = pack_pairs(found.link_doc, codes, len(kept))
        n_groups = np.bincount(found.group_doc, minlength=len(kept))
        n_links = np.bincount(found.link_doc, minlength=len(kept))
        out: list[dict] = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": b"", "pairs": b""} for _ in texts]
        for i, k in enumerate(kept):
            out[k] = {"n_a": int(off_a[i + 1] - off_a[i]), "n_b": int(off_b[i + 1] - off_b[i]),
                      "n_groups": int(n_groups[i]), "n_links": int(n_links[i]), "groups": groups[i], "pairs": pairs[i]}
        return out

    def write(self, a: np.ndarray, b: np.ndarray, off: np.ndarray, found: Alignment) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[found.last_a[:-1] + 1] = 1
        group_b[found.last_b[:-1] + 1] = 1
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        parts = np.empty(len(a) + len(b), object)
        name_a, name_b = self.comma[a], self.comma[b]
        name_a[found.last_a] = self.bar[a[found.last_a]]
        name_b[found.last_b] = self.semicolon[b[found.last_b]]
        parts[np.arange(len(a)) + np.concatenate([[0], found.last_b + 1])[group_a]] = name_a
        parts[np.arange(len(b)) + (found.last_a + 1)[group_b]] = name_b
        listed = parts.tolist()
        return [b"".join(listed[s:e])[:-1] for s, e in zip(off[:-1], off[1:])]


def pack_pairs(doc: np.ndarray, codes: np.ndarray, n_docs: int) -> list[bytes]:
    """Different pair codes of every document, ascending, as differences, then their numbers."""
    order = np.lexsort((codes, doc))
    doc, codes = doc[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    number = np.diff(np.concatenate([at, [len(codes)]]))
    doc, codes = doc[at], codes[at]
    step = codes.copy()
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    step[inner] -= codes[inner - 1]
    wide = "<u8" if len(codes) and codes.max() >> 32 else "<u4"
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    return [bytes([int(wide[2])]) + step[s:e].astype(wide).tobytes() + number[s:e].astype("<u4").tobytes()
            for s, e in zip(bounds[:-1], bounds[1:])]


def unpack_pairs(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers) of ``pack_pairs``."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = data[0]
    n = (len(data) - 1) // (wide + 4)
    steps = np.frombuffer(data, f"<u{wide}", n, 1).astype(np.int64)
    return np.cumsum(steps), np.frombuffer(data, "<u4", n, 1 + wide * n).astype(np.int64)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str = BYTE_MODEL,
          piece_model: str = PIECE_MODEL, digest: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, pairs.

    ``groups`` is the written alignment, or with ``digest`` its SHA-256 in hex
    (empty without tokens); ``pairs`` packs the id pairs of the links.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(byte_model, piece_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(shared.value)
            texts = batch.column("text").cast(pa.binary())
            ids, at = batch.column("id"), 0
            while at < len(texts):
                end, size, block = at, 0, []
                while end < len(texts) and (end == at or size < BLOCK_BYTES):
                    block.append(texts[end].as_py())
                    size += len(block[-1] or b"")
                    end += 1
                full = [t for t in block if t]
                made = iter(aligner.block(full) if full else [])
                rows = [next(made) if t else {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": b"", "pairs": b""}
                        for t in block]
                groups = [r["groups"].decode() if not digest else hashlib.sha256(r["groups"]).hexdigest() if r["groups"] else ""
                          for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), *[pa.array([r[c] for r in rows], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(groups, pa.string()), pa.array([r["pairs"] for r in rows], pa.binary())],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])
                at = end

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary") \
        .withColumnRenamed("id", id_col)


def _add_up(codes: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, inverse, np.concatenate(numbers))
    return code, total


def pair_counts(aligned: DataFrame, shift: int) -> DataFrame:
    """(code, n, best): links of every id pair, and whether no pair of its B id has more."""
    limit = 4_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        size = merged = 0

        def flush() -> pa.RecordBatch:
            code, total = _add_up(codes, numbers)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], ["code", "n"])

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                code, number = unpack_pairs(data)
                if len(code):
                    codes.append(code)
                    numbers.append(number)
                    size += len(code)
                if size > merged + limit:
                    code, number = _add_up(codes, numbers)
                    codes, numbers, size = [code], [number], len(code)
                    merged = size
                    if merged > limit:
                        yield flush()
                        codes, numbers, size, merged = [], [], 0, 0
        if codes:
            yield flush()

    counts = stored(map_batches(aligned.select("pairs"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")),
                    "pair-counts")
    b_id = F.col("code").bitwiseAND(F.lit((1 << shift) - 1))
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b_id).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str = BYTE_MODEL,
                piece_model: str = PIECE_MODEL, digest: bool = False,
                max_broadcast_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """``align`` with n_best (links whose pair is the commonest of its B id) and count_sum (pair counts over the links)."""
    shift = load(byte_model, piece_model).shift
    aligned = stored(align(docs, id_col, text_col, byte_model, piece_model, digest).withColumnRenamed(id_col, "id")
                     .withColumn("row", F.monotonically_increasing_id()), "alignment", compression="zstd")
    counts = stored(pair_counts(aligned, shift), "pair-totals")
    shown = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    if counts.count() <= max_broadcast_pairs:
        out = _sum_by_broadcast(aligned, counts, shown)
    else:
        out = _sum_by_join(aligned, counts, shown)
    return out.withColumnRenamed("id", id_col)


def _sum_by_broadcast(aligned: DataFrame, counts: DataFrame, shown: list[str]) -> DataFrame:
    pairs = counts.toPandas().sort_values("code")
    shared = aligned.sparkSession.sparkContext.broadcast(
        (pairs["code"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64), pairs["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            n_best, total = [], []
            for data in batch.column("pairs").to_pylist():
                codes, numbers = unpack_pairs(data)
                at = np.searchsorted(code, codes)
                n_best.append(int(numbers[best[at]].sum()))
                total.append(int((numbers * n[at]).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in shown], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                                             [*shown, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in shown)
    return map_batches(aligned.select(*shown, "pairs"), run, f"{kinds}, n_best long, count_sum long")


def _sum_by_join(aligned: DataFrame, counts: DataFrame, shown: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist()):
                codes, numbers = unpack_pairs(data)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row)), pa.array(codes), pa.array(numbers)],
                                                     ["row", "code", "links"])

    links = map_batches(aligned.select("row", "pairs"), run, "row long, code long, links long")
    limit = counts.agg(F.sum("n")).first()[0] / HOT_SHARE
    hot = F.col("n") > F.lit(limit)
    by_hot = links.join(F.broadcast(counts.filter(hot)), "code")
    by_rest = links.join(F.broadcast(counts.filter(hot).select("code")), "code", "left_anti").join(counts.filter(~hot), "code")
    sums = by_hot.unionByName(by_rest).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    return aligned.select("row", *shown).join(sums, "row", "left").select(
        *shown, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
