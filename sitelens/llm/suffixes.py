"""Suffix-array dedup by bucket-pointer refinement: bytes of repeated 200-byte strings are removed.

Positions are sorted by their first ``length`` bytes, and only as far as
needed to tell which strings occur twice:

1. Initial buckets hold equal q-grams (q = 64).  Not every position takes
   part: in every ``length``-byte window the q-gram with the smallest hash is
   its anchor (the rightmost of equal ones), so equal windows have equal
   anchors at equal offsets, and about one position in 70 is an anchor.  Each
   window belongs to its own anchor; an anchor's windows are a run.
2. A bucket of one position is final: none of its windows occurs twice.  In
   larger buckets positions whose whole run of windows spans equal bytes
   (128-bit digest) are final too: all their windows are repeated.  One of
   them, with their number, stays in the bucket for the others.
3. Buckets of up to ``BUCKET_ROWS`` different runs are refined in one task.
   All positions of their runs start in buckets of 8 equal bytes; a bucket's
   pointer is its place in the sorted order.  Each round sorts the members of
   the open buckets (more than one position) by the pointer at a later offset
   - 8, 16, 32, 64, then 72 bytes on - and writes the pointers of the smaller
   buckets back, where the next round reads them at its own offset.  After
   five rounds windows share a pointer exactly if their 200 bytes are equal;
   the bytes decide there, no hash does.
4. A larger bucket is refined in Spark first: its windows are split into the
   earlier and the later half of their offsets from the anchor, and each half
   into buckets of equal longer grams, the bytes that all its windows cover.
   Pieces with equal bytes are final as in 2, counted by partial aggregation;
   buckets now small enough go to 3, the others are halved again.  After eight
   rounds a bucket has one offset, its gram is the whole window.

Anchors, runs and pieces are dealt by hash of their gram, which only places
them; only intervals go back to the documents.

Defined results: a null text counts as empty; a text shorter than 200 bytes
loses nothing; repeated rows are different documents, so all their windows
are repeated; rows equal in id and text get one joint result each; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.benchmark import merge_spans
from sitelens.llm.common import map_arrow, map_batches, stored

LENGTH, GRAM = 200, 64
BUCKET_ROWS = 5_000
CHUNK_BYTES = 4_000_000

#: Odd multipliers that mix two identifiers into the next (any fixed odd numbers serve).
_LEFT = np.uint64(0x9E3779B97F4A7C15)
_RIGHT = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _LEFT + (b ^ (b >> np.uint64(29))) * _RIGHT
    return x ^ (x >> np.uint64(32))


def identifiers(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit identifiers of the ``size`` (a power of two, 8 or more) bytes from every position that has them."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    ids = np.zeros(len(data), np.uint64)
    for k in range(8):
        ids |= padded[k:k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    ids = ids[:max(0, len(data) - 7)]
    step = 8
    ids = _mix(ids, ids >> np.uint64(7))
    while step < size:
        ids = _mix(ids[:-step], ids[step:])
        step *= 2
    return ids


def bucket_pointers(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Pointers of the positions with ``length`` (8 or more) bytes: equal exactly where the bytes are, in their order."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(8):
        gram = (gram << np.uint64(8)) | data[k:k + n]
    order = np.argsort(gram, kind="stable")
    places, pointer = n, np.empty(n, np.int64)
    pointer[order] = _places(gram[order])
    depth = 8
    while depth < length:
        offset = min(depth, length - depth)
        n -= offset
        if n <= 0:
            return np.zeros(0, np.int64)
        later = pointer[offset:]
        pointer = pointer[:n].copy()
        open_ = np.flatnonzero(np.bincount(pointer)[pointer] > 1)
        key = pointer[open_] * places + later[open_]
        order = np.argsort(key, kind="stable")
        member = open_[order]
        bucket = pointer[member]
        # A smaller bucket points to its first place: that of the old bucket and the members before it there.
        pointer[member] = bucket + _places(key[order]) - _places(bucket)
        depth += offset
    return pointer


def _places(ordered: np.ndarray) -> np.ndarray:
    """Index of the first of the equal entries, for each entry of a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    return np.maximum.accumulate(np.where(head, np.arange(len(ordered)), 0))


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, q-gram identifier) of the anchors of one text."""
    ids = identifiers(data, GRAM)
    width = length - GRAM + 1
    # Sliding minimum by doubling, carrying the rightmost place of the minimum.
    low, place = ids, np.arange(len(ids), dtype=np.int64)
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b <= a
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, b, a)
        span += step
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    ends = np.concatenate((starts[1:] - 1, [len(place) - 1]))
    at = place[starts]
    return at, starts, ends, ids[at]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("data"))


def _blocks(size: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """Byte ranges of a long text that share all windows between them."""
    at = 0
    while True:
        yield at, min(size, at + CHUNK_BYTES + length - 1)
        at += CHUNK_BYTES
        if at + length > size:
            return


def _digests(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns of longs."""
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(halves[:, k].copy()) for k in (0, 1)]


def anchor_table(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text_hash, pos, lo, hi, gram, run, run_b): anchors, their window runs, and the digest of the run's bytes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, cols, runs = [], [], []
        for i, text in enumerate(batch.column("data").to_pylist()):
            if len(text) < length:
                continue
            for a, b in _blocks(len(text), length):
                part = text[a:b]
                pos, lo, hi, gram = anchors(np.frombuffer(part, np.uint8), length)
                index.append(np.full(len(pos), i))
                cols.append(np.column_stack((pos + a, lo + a, hi + a, gram.view(np.int64))))
                runs += [xxhash.xxh3_128_digest(part[s:e + length], o)
                         for s, e, o in zip(lo.tolist(), hi.tolist(), (pos - lo).tolist())]
        if not index:
            return None
        rows_at = pa.array(np.concatenate(index))
        table = np.concatenate(cols)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows_at), batch.column("text_hash").take(rows_at),
             *[pa.array(table[:, k].astype(np.int32)) for k in range(3)], pa.array(table[:, 3].copy()), *_digests(runs)],
            ["id", "text_hash", "pos", "lo", "hi", "gram", "run", "run_b"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, text_hash long, pos int, lo int, hi int, gram long, run long, run_b long")


def refine(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Repeated windows of whole buckets: rows (id, text_hash, start, end) of runs (lo, n, data) not final yet.

    ``n`` is the number of positions with the bytes of a run.
    """
    data = table.column("data").to_pylist()
    pointer = bucket_pointers(np.frombuffer(b"".join(data), np.uint8), length)
    sizes = np.array([len(d) for d in data])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows = sizes - length + 1
    row = np.repeat(np.arange(len(data)), windows)
    k = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    lo = table.column("lo").to_numpy()
    # Equal windows have the same anchor, so all of them are in this bucket.
    bucket = pointer[begin[row] + k]
    twice = np.bincount(bucket)[bucket] > 1
    todo = twice & (table.column("n").to_numpy()[row] == 1)
    spans_row, start = row[todo], lo[row[todo]] + k[todo]
    fresh = np.concatenate(([True], (spans_row[1:] != spans_row[:-1]) | (start[1:] != start[:-1] + 1))) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:] - 1, [len(start) - 1])) if len(first) else first
    take = pa.array(spans_row[first])
    return pa.table({"id": table.column("id").take(take), "text_hash": table.column("text_hash").take(take),
                     "start": pa.array(start[first].astype(np.int32)), "end": pa.array((start[last] + length).astype(np.int32))})


def _refined(runs: DataFrame, length: int) -> DataFrame:
    """Repeated intervals of buckets small enough to meet in one task; ``runs`` are clustered and sorted by gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            gram = table.column("gram").to_numpy()
            others = np.flatnonzero(gram != gram[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield from refine(table.slice(0, cut).combine_chunks(), length).to_batches()
            held = table.slice(cut).combine_chunks()  # the last bucket may go on; it has a bounded size
        if held is not None and held.num_rows:
            yield from refine(held, length).to_batches()

    kind = runs.schema["id"].dataType.simpleString()
    return map_batches(runs, run, f"id {kind}, text_hash long, start int, end int")


def offset_class(level: int, number: int, length: int = LENGTH) -> tuple[int, int]:
    """First and last offset of a window from its anchor in class ``number`` of the 2 ** ``level`` classes."""
    offsets = length - GRAM + 1
    return (number * offsets) >> level, (((number + 1) * offsets) >> level) - 1


def _halved(runs: DataFrame, level: int, length: int) -> DataFrame:
    """Runs (or pieces of them) cut into the offset classes of ``level``, each piece in the bucket of its common bytes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index, los, grams, pieces, digests = [], [], [], [], []
        rows = zip(batch.column("pos").to_pylist(), batch.column("lo").to_pylist(), batch.column("data").to_pylist())
        for i, (pos, lo, data) in enumerate(rows):
            hi = lo + len(data) - length
            for number in range(1 << level):
                near, far = offset_class(level, number, length)
                first, last = max(lo, pos - far), min(hi, pos - near)
                if near > far or first > last:
                    continue
                piece = data[first - lo:last - lo + length]
                index.append(i)
                los.append(first)
                # All windows of the class cover these bytes.
                grams.append(xxhash.xxh3_64_intdigest(data[pos - near - lo:pos - far + length - lo], number))
                pieces.append(piece)
                digests.append(xxhash.xxh3_128_digest(piece, pos - first))
        if not index:
            return None
        take = pa.array(index)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(take) for c in ("id", "text_hash", "pos", "n")], pa.array(los, pa.int32()),
             pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(pieces, pa.binary()), *_digests(digests)],
            ["id", "text_hash", "pos", "n", "lo", "gram", "data", "run", "run_b"])

    kind = runs.schema["id"].dataType.simpleString()
    return map_arrow(runs, run, f"id {kind}, text_hash long, pos int, n long, lo int, gram long, data binary, "
                                "run long, run_b long")


def _split(runs: DataFrame, level: int, length: int) -> tuple[DataFrame, DataFrame]:
    """(final intervals, different pieces with n and n_runs) of large buckets after one round of halving."""
    key = ["gram", "run", "run_b"]
    pieces = stored(_halved(runs, level, length), f"suffix-pieces-{level}")
    kept = F.struct("id", "text_hash", "pos", "lo", "data")
    # Equal pieces meet after partial aggregation, so a hot one is a row per task.
    different = stored(pieces.groupBy(*key).agg(F.sum("n").alias("n"), F.min(kept).alias("kept")), f"suffix-different-{level}")
    final = pieces.filter("n = 1").drop("n").join(different.filter("n > 1").select(*key), key, "left_semi") \
        .select("id", "text_hash", F.col("lo").alias("start"), (F.col("lo") + F.octet_length("data")).alias("end"))
    sizes = different.groupBy("gram").agg(F.count(F.lit(1)).alias("n_runs")).filter("n_runs > 1")
    return final, different.join(sizes, "gram").select("kept.*", "gram", "n", "n_runs")


def repeated_spans(rows: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, text_hash, start, end): byte intervals whose union is every byte of a repeated ``length``-byte string."""
    by_gram, by_run = Window.partitionBy("gram"), Window.partitionBy("gram", "run", "run_b")
    first = F.row_number().over(by_run.orderBy("id", "text_hash", "pos"))
    found = anchor_table(rows, length).withColumn("n", F.count(F.lit(1)).over(by_run)).withColumn("rank", first) \
        .withColumn("n_gram", F.count(F.lit(1)).over(by_gram)) \
        .withColumn("n_runs", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(by_gram)) \
        .filter("n_gram > 1")
    buckets = stored(found.drop("n_gram", "run", "run_b"), "suffix-buckets")
    spans = buckets.filter("n > 1").select("id", "text_hash", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

    wanted = buckets.filter("n_runs > 1 and rank = 1") \
        .select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "pos", "lo", "hi", "gram", "n", "n_runs")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    cut = F.expr(f"substring(data, lo + 1, hi - lo + {length})")

    def with_bytes(part: DataFrame) -> DataFrame:
        # Rows equal in id and text match one run several times; one is enough, its count is in n.
        return rows.join(part, same).select("id", "text_hash", "pos", "lo", "gram", "n", "n_runs", cut.alias("data"))

    runs = with_bytes(wanted.filter(F.col("n_runs") <= bucket_rows))
    large = wanted.filter(F.col("n_runs") > bucket_rows)
    if not large.isEmpty():
        large = with_bytes(large)
        last = (length - GRAM).bit_length()
        for level in range(1, last + 1):
            final, pieces = _split(large, level, length)
            spans = spans.unionByName(final)
            small = F.lit(True) if level == last else F.col("n_runs") <= bucket_rows
            runs = runs.unionByName(pieces.filter(small))
            large = pieces.filter(~small)
            if large.isEmpty():
                break
    runs = runs.drop("n_runs").repartition("gram").sortWithinPartitions("gram", "id", "text_hash", "pos")
    return spans.unionByName(_refined(runs, length))


def remove_bytes(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for start, end in spans.tolist():
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (``start:end,...`` in bytes)."""
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, bucket_rows) \
        .groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")) \
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left") \
        .select("id", "data", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = batch.column("spans")
        offsets = places.offsets.to_numpy()
        flat = places.values
        start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        cols: list[list] = [[], [], [], [], []]
        for i, data in enumerate(batch.column("data").to_pylist()):
            a, b = offsets[i], offsets[i + 1]
            merged = merge_spans(np.column_stack((start[a:b], end[a:b])))
            kept = remove_bytes(data, merged)
            for col, value in zip(cols, (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                                         ",".join(f"{s}:{e}" for s, e in merged.tolist()))):
                col.append(value)
        return pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, cols)],
                                          ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(joined, run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string") \
        .withColumnRenamed("id", id_col)
