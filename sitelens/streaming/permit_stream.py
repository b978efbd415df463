"""Permit files as a stream: new CSV files dropped in a folder are cleaned
and appended to the store table exactly once (file-source offsets and the
sink's commit log live in the checkpoint folder).

The original loader re-ran over the whole folder and appended duplicates on
every run; the file source remembers which files it has processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitelens.sources.permits import CORRUPT, ENCODING, clean_permits, permit_rows, reject_rows, with_reasons


def judged_stream(spark: SparkSession, folder: str, columns: list[str], sep: str = ",",
                  encoding: str = ENCODING) -> DataFrame:
    """Streaming permit lines of one layout (``columns`` = header of the
    files) with the reason of each reject (see ``permits.permit_rows``)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(CORRUPT, T.StringType())])
    raw = (spark.readStream.schema(schema).option("header", True).option("sep", sep)
           .option("encoding", encoding).option("escape", '"').option("columnPruning", False)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(folder))
    return with_reasons(permit_rows(raw, sep, len(columns)))


def permit_stream(spark: SparkSession, folder: str, columns: list[str], sep: str = ",",
                  encoding: str = ENCODING) -> DataFrame:
    """Streaming DataFrame of cleaned stores; the other lines are in ``reject_stream``."""
    judged = judged_stream(spark, folder, columns, sep, encoding)
    return clean_permits(judged.filter("reason is null"), number_copies=False)


def reject_stream(spark: SparkSession, folder: str, columns: list[str], sep: str = ",",
                  encoding: str = ENCODING) -> DataFrame:
    """Streaming rejects: ``source_file, store_name, reason, raw_line``."""
    return reject_rows(judged_stream(spark, folder, columns, sep, encoding))


def _started(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = (stream.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_permit_ingest(spark: SparkSession, folder: str, columns: list[str], table_path: str,
                        checkpoint: str, sep: str = ",", available_now: bool = True) -> StreamingQuery:
    """Append cleaned stores to ``table_path`` (parquet).  ``checkpoint``
    must be on the shared file system; with ``available_now`` the query
    processes what is there and stops (a scheduled incremental load)."""
    return _started(permit_stream(spark, folder, columns, sep), table_path, checkpoint, available_now)


def start_reject_ingest(spark: SparkSession, folder: str, columns: list[str], table_path: str,
                        checkpoint: str, sep: str = ",", available_now: bool = True) -> StreamingQuery:
    """Append the rejected lines to the reject table at ``table_path``
    (parquet), with a checkpoint folder of its own."""
    return _started(reject_stream(spark, folder, columns, sep), table_path, checkpoint, available_now)
