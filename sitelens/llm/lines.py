"""Substring dedup by line or paragraph hashing.

Every text is cut into units (lines; paragraphs with ``separator="\\n\\n"``),
each unit normalised (A-Z to lower case, runs of white space to one space,
ends trimmed) and hashed to 128 bits.  Of all units with one digest the
earliest ranked one stays - smallest id, then text hash, then offset - and the
others are removed; code point offsets of removed units refer to the original
text.

The earliest unit of a digest is a minimum with partial aggregation, so a unit
that a third of all documents share is one row per task.  Digests above
1/2000 of all units are fewer than 2000 and joined by broadcast; all others
are joined by shuffle, no key of which holds more than that share.

Texts are cut and joined again by built-in functions only: the last stage, which
sorts texts to meet their removed units, holds no text in Python.

Defined results: a null text has no units and stays null; blank units are
never counted or removed; of rows equal in id and text one keeps its units and
the others lose all of theirs; ids that are null rank last; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import map_arrow, stored

HOT_SHARE = 2000


def cut(text: str, separator: str) -> list[tuple[int, int, int, bytes]]:
    """(number, start, end, normalised unit) of every unit that is not blank."""
    out, at = [], 0
    for number, unit in enumerate(text.split(separator)):
        norm = b" ".join(unit.encode().lower().split())
        if norm:
            out.append((number, at, at + len(unit), norm))
        at += len(unit) + len(separator)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(id, text_hash, unit, start, end, d1, d2): every unit's number, place and 128-bit digest."""
    rows = _keyed(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, numbers, starts, ends, digests = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = cut(text, separator) if text else []
            sizes.append(len(found))
            for number, start, end, norm in found:
                numbers.append(number)
                starts.append(start)
                ends.append(end)
                digests.append(xxhash.xxh3_128_digest(norm))
        index = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(index), batch.column("text_hash").take(index), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
             pa.array(ends, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
            ["id", "text_hash", "unit", "start", "end", "d1", "d2"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, text_hash long, unit int, start long, end long, d1 long, d2 long")


def repeated_units(found: DataFrame) -> DataFrame:
    """(id, text_hash, unit, start, end) of the units that are not the earliest of their digest."""
    rank: Column = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "start")
    total = found.count()
    first = stored(found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
                   .filter("n > 1"), "units-first")
    limit = total / HOT_SHARE
    hot = F.broadcast(first.filter(F.col("n") > limit).drop("n"))
    by_hot = found.join(hot, ["d1", "d2"])
    by_rest = found.join(F.broadcast(first.filter(F.col("n") > limit).select("d1", "d2")), ["d1", "d2"], "left_anti") \
        .join(first.filter(F.col("n") <= limit).drop("n"), ["d1", "d2"])
    return by_hot.unionByName(by_rest).filter(~rank.eqNullSafe(F.col("first"))) \
        .select("id", "text_hash", "unit", "start", "end").distinct()


def _listed(df: DataFrame, places: str, numbers: str) -> DataFrame:
    """``_id, _hash``, the places of a document's units in order and their numbers."""
    return df.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias(places), F.collect_set("unit").alias(numbers))


def _meet(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    out = rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), how)
    return out.drop("_id", "_hash")


def _written(rows: DataFrame, separator: str) -> DataFrame:
    """The result columns of documents that lose the units ``numbers`` at ``places``."""
    pieces = F.split("text", "\\Q" + separator + "\\E", -1)
    worded = F.filter(pieces, lambda u: u.rlike("[^\\t-\\r ]"))
    rest = F.filter(pieces, lambda u, i: ~F.array_contains(F.col("numbers"), i))
    whole = F.col("numbers").isNull()
    return rows.select(
        "id", F.when(F.col("text").isNull(), 0).otherwise(F.size(worded)).cast("long").alias("n_units"),
        F.when(whole, 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
        F.coalesce(F.concat_ws(",", F.transform("places", lambda x: F.concat_ws(":", x["start"], x["end"]))), F.lit("")).alias("spans"),
        F.when(whole, F.col("text")).otherwise(F.array_join(rest, separator)).alias("kept_text"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """One row per document: id, n_units, n_removed, spans (``start:end,...`` of removed units), kept_text."""
    found = stored(units(docs, id_col, text_col, separator), "units")
    spans = _listed(repeated_units(found), "places", "numbers")
    rows = _keyed(docs, id_col, text_col)
    # Rows equal in id and text: few, if any, so they take a way of their own.
    again = stored(rows.filter(F.col("text").isNotNull()).groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
                   .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated-rows")
    if again.isEmpty():
        out = _written(_meet(rows, spans, "left"), separator)
    else:
        single = _meet(_meet(rows, again, "left_anti"), spans, "left")
        every = _listed(_meet(found, again, "left_semi"), "every_place", "every_number")
        # One of the copies, then a row for each: the first keeps what is not removed anyway.
        one = _meet(_meet(_meet(rows, again, "inner").dropDuplicates(["id", "text_hash"]), spans, "left"), every, "left")
        copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) \
            .withColumn("places", F.when(F.col("copy") == 1, F.col("places")).otherwise(F.col("every_place"))) \
            .withColumn("numbers", F.when(F.col("copy") == 1, F.col("numbers")).otherwise(F.col("every_number")))
        out = _written(single, separator).unionByName(_written(copies, separator))
    return out.withColumnRenamed("id", id_col)
