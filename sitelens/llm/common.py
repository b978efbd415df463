"""Helpers shared by the training-data operators.

Every operator takes the names of its id and text columns and reads no other
column, so extra columns of any name never clash.  Row-wise Python runs in
``mapInArrow`` over bounded Arrow batches (``spark.sql.execution.arrow.
maxBytesPerBatch``); nothing is grouped whole in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sitelens.session import ensure_checkpoint_dir, ship_package

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back (compact, and cuts the lineage)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch.  Spark's default suits narrow rows; ten thousand texts would fill
#: tens of megabytes in the JVM and again in Python, for every running task.
BATCH_ROWS = 1_000
_ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors and batches of bounded size.

    Spark reads the batch size from the session when the job runs, so it is
    set there, unless the application has chosen a smaller one.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = int(spark.conf.get(_ROWS_PER_BATCH, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_ROWS_PER_BATCH, str(BATCH_ROWS))
    plain = {c: fresh(df, f"_column_{i}") for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if not plain:
        return df.mapInArrow(fn, schema)
    # mapInArrow reads such names as paths; the columns travel under other names.
    given = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    inner = StructType([StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in given.fields])
    return df.toDF(*[plain.get(c, c) for c in df.columns]).mapInArrow(fn, inner).toDF(*given.names)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply ``fn`` to every non-empty Arrow batch; ``None`` means no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
    return map_batches(df, run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes (no decoding)."""
    return column.cast(pa.binary()).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(id_col: str) -> Column:
    """Unsigned CRC-32 of the id written as text (null: of the empty string)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def bounded_sample(df: DataFrame, limit: int, keys: list[str], strata: str | None = None) -> DataFrame:
    """About ``limit`` different rows (of each stratum), all of them when there are fewer.

    Rows are taken by the hash of ``keys`` against a threshold from the number
    of different hashes, so the choice depends on content alone and the scan
    stays parallel.  Only hashes are shuffled for that number, copies combined
    before.  Equal rows count once: they neither widen nor narrow the sample.
    A final limit of four times the bound (per stratum count) makes the bound
    hard.  Used only to fit models, never on rows that are scored.
    """
    h = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << 40))
    hashed = df.withColumn("_h", h)
    if strata is None:
        n = hashed.select("_h").distinct().count()
        kept = hashed if n <= limit else hashed.filter(F.col("_h") < int((1 << 40) * limit / n))
        return kept.dropDuplicates(["_h"]).drop("_h").limit(4 * limit)
    counts = {r[0]: r[1] for r in hashed.select(strata, "_h").distinct().groupBy(strata).count().collect()}
    rule = F.lit(False)
    for value, n in counts.items():
        rule = rule | ((F.col(strata) == F.lit(value)) & (F.col("_h") < int((1 << 40) * min(1.0, limit / n))))
    return (hashed.filter(rule).dropDuplicates(["_h", strata]).drop("_h")
            .limit(4 * limit * max(1, len(counts))))
