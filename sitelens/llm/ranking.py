"""Ranked lexical search by pipelined term partitioning.

Items (queries) are searched in blocks of bounded vocabulary.  The terms of a
block are cut by rising document frequency into ``OWNERS`` runs of about equal
numbers of postings; each run has a term owner.  Documents are dealt to shards
of about ``SHARD_POSTINGS`` postings.  For every shard an item bundle - the
item's terms and a sparse accumulator (document slots and integer scores) -
passes the owners one after the other, rare terms first: at each stage
``cogroup`` brings the bundles of a shard to the postings that the stage's
owner holds of it, the owner adds its integer contributions, and the bundle
travels on.  The last owner selects the best documents of the shard, Spark
those of all shards.

Exact pruning keeps accumulators sparse: every bundle knows the most that the
terms of later owners can add (from the largest contribution of every term
anywhere).  A document whose score so far plus that is below the k-th best
score of its shard so far can be in no result and leaves the accumulator;
equal bounds stay, so ties are whole.

Documents are read once a block: a text becomes its length and the postings of
the block's terms.  Statistics (N, L, document frequencies) cover all
documents.

Defined results: a null text or item has no terms; documents without a score
above 0 are not listed, so an item without terms gives no rows; items are
rows, a repeated item is ranked twice; repeated documents are documents; null
document ids rank last among ties; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import map_batches, ship_package, stored, utf8

OWNERS = 4
SHARD_POSTINGS = 1_000_000
#: Items, and UTF-8 bytes of their texts, that are searched together.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4_000_000
#: Bytes that belong to no term become spaces, A-Z become a-z; all bytes of other scripts stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
SCALE = 1_000_000_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text: its runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(TERM_BYTES).split() if text else []


def weight(n: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m)."""
    return SCALE * tf // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + ((25 n N) div L)."""
    return 75 + 25 * n * n_docs // max(n_terms, 1)


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """Numbered items (``item, item_id, text, block``), written once, and the numbers of the blocks.

    Items fall by hash into enough blocks that a block holds about half of
    BLOCK_ITEMS and of BLOCK_BYTES, so its vocabulary is bounded; only block
    numbers reach the driver.
    """
    rows = stored(items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
                  .withColumn("item", F.monotonically_increasing_id()), "items")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    if blocks > 1:
        blocks *= 2
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), list(range(blocks))


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``row, id, n, p``: a document's number of terms and its (term number, occurrences) pairs of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, packed = [], []
            for text in utf8(batch.column("text")):
                words = terms(text)
                sizes.append(len(words))
                held = Counter(map(number.get, words))
                held.pop(None, None)
                packed.append(np.array([list(held), list(held.values())], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                ["row", "id", "n", "p"])

    kind = rows.schema["id"].dataType.simpleString()
    return stored(map_batches(rows, run, f"row long, id {kind}, n long, p binary"), "postings", compression="zstd")


def unpack(data: bytes) -> np.ndarray:
    """Two rows: term numbers and occurrences."""
    return np.frombuffer(data, np.int32).reshape(2, -1).astype(np.int64)


def term_statistics(held: DataFrame, n_docs: int, n_terms: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document frequency and largest gain of every term of the vocabulary, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            norms = length_norm(np.asarray(batch.column("n")), n_docs, n_terms)
            for data, m in zip(batch.column("p").to_pylist(), norms):
                term, tf = unpack(data)
                df[term] += 1
                most[term] = np.maximum(most[term], gain(tf, m))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(most[at])], ["term", "df", "most"])

    df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    found = map_batches(held.select("n", "p"), run, "term long, df long, most long") \
        .groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    for r in found.collect():  # one row a term of the block's bounded vocabulary
        df[r["term"]], most[r["term"]] = r["df"], r["most"]
    return df, most


def owners_of(df: np.ndarray, owners: int) -> np.ndarray:
    """Owner of every term: runs of rising document frequency with about equal numbers of postings."""
    order = np.lexsort((np.arange(len(df)), df))
    before = np.cumsum(df[order]) - df[order]
    out = np.zeros(len(df), np.int64)
    out[order] = np.minimum(before * owners // max(1, int(df.sum())), owners - 1)
    return out


def bundles(items: DataFrame, shards: int, vocabulary: list[bytes], weights: np.ndarray, most: np.ndarray,
            owner: np.ndarray, owners: int) -> DataFrame:
    """``shard, item, item_id, terms, rest, slots, scores``: one empty bundle of every item for every shard.

    ``terms`` packs (owner, term number, weight times occurrences in the item);
    ``rest`` the most that can be added after each owner.
    """
    shared = items.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(vocabulary)}, weights, most, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights, most, owner = shared.value
        for batch in batches:
            packed, rest = [], []
            for text in utf8(batch.column("text")):
                held = Counter(number[t] for t in terms(text))
                term = np.fromiter(held, np.int64, len(held))
                term = term[weights[term] * most[term] > 0]
                value = weights[term] * np.array([held[int(t)] for t in term], np.int64)
                packed.append(np.array([owner[term], term, value]).tobytes())
                left = np.zeros(owners + 1, np.int64)
                np.add.at(left, owner[term], value * most[term])
                rest.append((left[::-1].cumsum()[::-1])[1:].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(packed, pa.binary()),
                                              pa.array(rest, pa.binary())], ["item", "item_id", "terms", "rest"])

    kind = items.schema["item_id"].dataType.simpleString()
    made = map_batches(items.select("item", "item_id", "text"), run, f"item long, item_id {kind}, terms binary, rest binary")
    # Items without a term of any document go no further: they have no results.
    return made.filter(F.octet_length("terms") > 0).withColumn("slots", F.lit(b"")).withColumn("scores", F.lit(b"")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) \
        .select("shard", "item", "item_id", "terms", "rest", "slots", "scores")


def owned(held: DataFrame, shards: int, n_docs: int, n_terms: int, owner: np.ndarray) -> DataFrame:
    """``shard, owner, row, id, p``: for each shard and owner, every document that holds a term, with the
    (term, gain) pairs the owner holds of it."""
    shared = held.sparkSession.sparkContext.broadcast(owner)
    count = int(owner.max()) + 1 if len(owner) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = shared.value
        for batch in batches:
            norms = length_norm(np.asarray(batch.column("n")), n_docs, n_terms)
            index, stage, packed = [], [], []
            for k, (data, m) in enumerate(zip(batch.column("p").to_pylist(), norms)):
                term, tf = unpack(data)
                if not len(term):
                    continue
                part, value = owner[term], gain(tf, m)
                for o in range(count):
                    mine = part == o
                    index.append(k)
                    stage.append(o)
                    packed.append(np.array([term[mine], value[mine]], np.int32).tobytes())
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("id").take(at),
                                              pa.array(stage, pa.int32()), pa.array(packed, pa.binary())],
                                             ["row", "id", "owner", "p"])

    kind = held.schema["id"].dataType.simpleString()
    return map_batches(held, run, f"row long, id {kind}, owner int, p binary") \
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))


class Postings:
    """What one owner holds of one shard: for each term the slots and gains of its documents."""

    def __init__(self, table: pa.Table):
        # Slots are places in tie order, the same for every owner, as each has a row for every document.
        self.docs = table.select(["id", "row", "p"]).sort_by([("id", "ascending"), ("row", "ascending")])
        lists = [unpack(p) for p in self.docs.column("p").to_pylist()]
        slot = np.repeat(np.arange(len(lists)), [one.shape[1] for one in lists])
        term, value = np.concatenate(lists, axis=1) if lists else np.empty((2, 0), np.int64)
        order = np.argsort(term, kind="stable")
        self.slot, self.value = slot[order], value[order]
        self.term, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def add(self, total: np.ndarray, term: int, value: int) -> None:
        at = np.searchsorted(self.term, term)
        if at < len(self.term) and self.term[at] == term:
            part = slice(self.first[at], self.last[at])
            total[self.slot[part]] += value * self.value[part]


def advance(held: Postings, stage: int, packed: bytes, rest: int, slots: bytes, scores: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The accumulator of one bundle after this owner: slots and scores of the documents that can still be in the result."""
    owner, term, value = np.frombuffer(packed, np.int64).reshape(3, -1)
    total = np.zeros(held.docs.num_rows, np.int64)
    total[np.frombuffer(slots, np.int32)] = np.frombuffer(scores, np.int64)
    for t, v in zip(term[owner == stage].tolist(), value[owner == stage].tolist()):
        held.add(total, t, v)
    at = np.flatnonzero(total)
    if len(at) > k:
        kth = np.partition(total[at], len(at) - k)[len(at) - k]
        at = at[total[at] + rest >= kth]
    return at, total[at]


def one_stage(travelling: DataFrame, postings_of: DataFrame, stage: int, k: int, last: bool) -> DataFrame:
    """Bundles after the owner of ``stage``; the last owner gives the ``k`` best documents of the shard instead."""
    kinds = {f.name: f.dataType.simpleString() for f in [*travelling.schema.fields, *postings_of.schema.fields]}
    bundle = {"shard": "int", "item": "long", "item_id": kinds["item_id"], "terms": "binary", "rest": "binary",
              "slots": "binary", "scores": "binary"}
    result = {"item": "long", "item_id": kinds["item_id"], "id": kinds["id"], "row": "long", "score": "long"}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Postings(right)
        slots, scores = [], []
        places, taken, values = [], [], []
        for i, (packed, rest, before, sums) in enumerate(zip(*(left.column(c).to_pylist() for c in ("terms", "rest", "slots", "scores")))):
            at, total = advance(held, stage, packed, int(np.frombuffer(rest, np.int64)[stage]), before, sums, k)
            if last:
                best = np.lexsort((at, -total))[:k]
                places += [i] * len(best)
                taken.append(at[best])
                values.append(total[best])
            else:
                slots.append(at.astype(np.int32).tobytes())
                scores.append(total.tobytes())
        if not last:
            return pa.table({**{c: left.column(c) for c in ("shard", "item", "item_id", "terms", "rest")},
                             "slots": pa.array(slots, pa.binary()), "scores": pa.array(scores, pa.binary())})
        index = pa.array(places, pa.int64())
        docs = pa.array(np.concatenate(taken) if taken else np.empty(0, np.int64))
        return pa.table({"item": left.column("item").take(index), "item_id": left.column("item_id").take(index),
                         "id": held.docs.column("id").take(docs), "row": held.docs.column("row").take(docs),
                         "score": pa.array(np.concatenate(values) if values else np.empty(0, np.int64))})

    schema = ", ".join(f"{c} {t}" for c, t in (result if last else bundle).items())
    return travelling.groupBy("shard").cogroup(postings_of.filter(F.col("owner") == stage).groupBy("shard")).applyInArrow(run, schema)


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, owners: int, shard_postings: int) -> DataFrame | None:
    words = map_batches(items.select("text"), _terms_of, "term binary").distinct()
    vocabulary = sorted(bytes(r[0]) for r in words.collect())  # bounded by the block's text
    if not vocabulary:
        return None
    held = postings(docs, vocabulary, id_col, text_col)
    n_docs, n_terms, size = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)),
                                     F.coalesce(F.sum(F.octet_length("p") / 8), F.lit(0))).first()
    if not size:
        return None
    df, most = term_statistics(held, n_docs, n_terms, len(vocabulary))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    owner = owners_of(df, owners)
    shards = max(1, math.ceil(size / shard_postings))
    parts = stored(owned(held, shards, n_docs, n_terms, owner).repartition("shard", "owner"), "owned", compression="zstd")
    travelling = bundles(items, shards, vocabulary, weights, most, owner, owners)
    last = int(owner.max())
    for stage in range(last + 1):
        travelling = one_stage(travelling, parts, stage, k, last=stage == last)
    return travelling


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = sorted({t for text in utf8(batch.column("text")) for t in terms(text)})
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["term"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", owners: int = OWNERS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``<item_col>, rank, <id_col>, score``: the ``k`` best documents of every item, ties to the smaller id."""
    ship_package(docs.sparkSession)
    rows, blocks = item_blocks(items, item_col, text_col)
    found = None
    for block in blocks:
        part = _search_block(docs, rows.filter(F.col("block") == block), k, id_col, text_col, owners, shard_postings)
        if part is not None:
            part = stored(part, "ranked")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.limit(0).select(F.col("item_id").alias(item_col), F.lit(1).alias("rank"),
                                    F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
