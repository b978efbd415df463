"""SimHash near-duplicates with pigeonring filtering.

Fingerprints differing in at most two bits are linked.  The 64 bits form a
ring of three segments (22, 21, 21 bits).  By the pigeonring principle two
linked fingerprints have a segment from which every chain of l consecutive
segments differs in at most floor(2 l / 3) bits: 0 in the first segment, at
most 1 in the first two, at most 2 in all.  The first two bounds give the
candidate keys: the first segment and one of the two halves of the second are
equal (at most one bit differs, so one half is untouched): six keys of about
32 bits for each different fingerprint.  Inside a key the chain is checked
first, the full distance after it, and each connected group gives one link
per member (a spanning forest) in place of all pairs.

A key with more than ``KEY_ROWS`` fingerprints is refined: of the other bits,
cut in three, one part must be equal too.  What is still larger is dealt out
as pairs of blocks over several tasks.  No candidate is dropped.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; equal fingerprints are one node, so groups of copies of any
size cost one row each; repeated ids keep their rows; ids that are null get
the smallest non-null id of their group (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import checkpoint, fresh, map_arrow, map_batches, utf8
from sitelens.operators.components import components

SHINGLE_WORDS = 3
SEED = 42
KEY_ROWS = 10_000

#: (first bit, width) of the ring's segments.
RING = ((0, 22), (22, 21), (43, 21))


def _mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _key_masks() -> list[tuple[int, int, int]]:
    """(mask of the equal bits, mask of the first segment, mask of the first two) for each of the six keys."""
    out = []
    for i in range(3):
        head, (first, width) = _mask(*RING[i]), RING[(i + 1) % 3]
        half = width // 2
        for part in (_mask(first, half), _mask(first + half, width - half)):
            out.append((head | part, head, head | _mask(first, width)))
    return out


KEYS = _key_masks()


def _rest_masks(mask: int) -> list[int]:
    """The bits outside ``mask`` in three parts, one of which is equal in any linked pair of the key."""
    bits = [b for b in range(64) if not mask >> b & 1]
    third = -(-len(bits) // 3)
    return [sum(1 << b for b in bits[k:k + third]) for k in range(0, len(bits), third)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        block = hashes[k:k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of every whole text as a signed long."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def forest(fps: np.ndarray, key: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest) between the rows of equal ``group`` that pass the chain and the full check.

    Rows are sorted by group; row t meets row t + d for d = 1, 2, ... while any group is that long.
    """
    heads = np.array([k[1] for k in KEYS], np.uint64)[key]
    pairs = np.array([k[2] for k in KEYS], np.uint64)[key]
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    d, live = 1, np.arange(len(fps) - 1)
    while len(live):
        live = live[live + d < len(fps)]
        live = live[group[live] == group[live + d]]
        diff = fps[live] ^ fps[live + d]
        chain = (np.bitwise_count(diff & heads[live]) == 0) & (np.bitwise_count(diff & pairs[live]) <= 1)
        near = live[chain][np.bitwise_count(diff[chain]) <= max_bits]
        for i in near:
            x, y = find(i), find(i + d)
            if x != y:
                root[max(x, y)] = min(x, y)
        d += 1
    top = np.array([find(i) for i in np.flatnonzero(root != np.arange(len(fps)))], np.int64)
    low = np.flatnonzero(root != np.arange(len(fps)))
    return fps[low], fps[top]


def _group_links(rows: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    """Links inside each group of ``rows`` (key, fp, by...), which are clustered and sorted by ``by``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(c).to_numpy() for c in by]
            fresh = np.zeros(table.num_rows, bool)
            for c in cols:
                fresh[1:] |= c[1:] != c[:-1]
            fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            a, b = forest(fps, table.column("key").to_numpy(), np.cumsum(fresh), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            last = [table.column(c)[table.num_rows - 1].as_py() for c in by]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(by, last):
                same &= table.column(c).to_numpy() == v
            cut = int(np.argmax(same))  # the last group may go on in the next batch; it has a bounded size
            if cut:
                yield links(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows > 1:
            yield links(held.combine_chunks())

    return map_batches(rows, run, "a long, b long")


def links(fps: DataFrame, max_bits: int = 2, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp``, enough to connect all pairs within ``max_bits`` (0 to 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the ring of three segments serves distances of at most two bits")
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m[0]))).alias("value"))
        for k, m in enumerate(KEYS)])).alias("s")).select("s.key", "s.value", "fp")
    group = Window.partitionBy("key", "value")
    counted = keyed.withColumn("n", F.count(F.lit(1)).over(group)).filter("n > 1")
    few = _group_links(counted.filter(F.col("n") <= key_rows).select("key", "value", "fp"), ["key", "value"], max_bits)

    rest = None
    for k, m in enumerate(KEYS):
        parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m[0] | r))).alias("fine"))
                          for p, r in enumerate(_rest_masks(m[0]))])
        rest = F.when(F.col("key") == k, parts) if rest is None else rest.when(F.col("key") == k, parts)
    fine = counted.filter(F.col("n") > key_rows).select("key", "fp", F.explode(rest).alias("s")) \
        .select("key", "s.part", "s.fine", "fp")
    sub = Window.partitionBy("key", "part", "fine")
    fine = fine.withColumn("n", F.count(F.lit(1)).over(sub)).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(float(key_rows))).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    dealt = fine.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))) \
        .select("key", "part", "fine", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    by = ["key", "part", "fine", "x", "y"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)
    return few.union(_group_links(dealt, by, max_bits))


def rooted(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, least, root): each different fingerprint, its smallest id, and the fingerprint naming its group."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE_WORDS, max_bits: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id of its group)."""
    fps = checkpoint(fingerprints(docs, id_col, text_col, size))
    nodes = rooted(fps, max_bits)
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             size: int = SHINGLE_WORDS, max_bits: int = 2) -> DataFrame:
    """The documents without all but one of each near-duplicate group; columns unchanged.

    The row with the smallest non-null id stays (of equal ids the one with the
    smallest text hash, of rows equal in both the first by its columns as JSON).  Rows are told apart by id and
    text, so nulls and repeated ids are safe.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, size))
    rows = fps.join(rooted(fps, max_bits).select("fp", "root"), "fp") \
        .groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    me = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    best = rows.groupBy("root").agg(F.min(me).alias("best"))
    id_, hash_, row_ = (fresh(docs, c) for c in ("_id", "_hash", "_row"))
    judged = rows.join(best, "root").select(
        F.col("id").alias(id_), F.col("text_hash").alias(hash_), "n", me.eqNullSafe(F.col("best")).alias("stays"))
    marked = checkpoint(judged.filter("not stays or n > 1"))
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_))
    repeated = docs.join(marked.filter("stays").select(id_, hash_), same, "left_semi")
    row = F.row_number().over(Window.partitionBy(id_col, text_hash).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    once = repeated.withColumn(row_, row).filter(F.col(row_) == 1).drop(row_)
    return docs.join(marked.select(id_, hash_), same, "left_anti").unionByName(once)
