"""Permit CSV ingest.

Raw permit files: CP949 text with a header row, ``,`` as separator (``;``
when the file name contains ``2019``), extra columns allowed, fields quoted
with ``"`` (a quote inside is written twice; one inside an unquoted field is
plain text; quoted fields may hold line breaks, see ``csv_records``).  Output:

* ``stores``   -- cleaned rows in the store schema (coordinates still NULL);
* ``rejects``  -- records with too many fields, lines of a quoted field that
                  never closes, and rows without a name or an address (the
                  original dropped them silently);
* ``missing``  -- files lacking a required column (skipped, as before).

The given paths are literal file names (no glob patterns).  Only the first
line of each file is read for its header, files are grouped by identical
header and each group is read once; everything is read as text and cast
explicitly (no schema inference).
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.dates import parse_permit_date
from sitelens.sources.csv_records import csv_records, n_fields, opens

# Required permit columns and their store names.
REQUIRED_COLUMNS = ["업소명", "업종명", "소재지도로명", "허가신고일", "폐업일자"]
COLUMN_NAMES = {
    "업소명": "store_name",
    "업종명": "sector",
    "소재지도로명": "address",
    "허가신고일": "open_date",
    "폐업일자": "close_date",
}
ENCODING = "cp949"
HEADER_BYTES = 65_536
CORRUPT = "_corrupt_record"


@dataclass
class PermitBatch:
    stores: DataFrame
    rejects: DataFrame
    missing: DataFrame


def literal_path(path: str) -> str:
    """The path with glob characters escaped, so that ``[a].csv`` is that file."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def open_value(value: Column) -> Column:
    """True for a parsed value that starts with a quote and holds an odd number: its field goes on in the next line."""
    return value.startswith('"') & (F.length(F.regexp_replace(value, '[^"]', "")) % 2 == 1)


def first_line(spark: SparkSession, path: str, encoding: str = ENCODING) -> str:
    """The first line of a file, from its first ``HEADER_BYTES`` (any Hadoop path)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        head = bytes(stream.readNBytes(HEADER_BYTES))
    finally:
        stream.close()
    lines = head.decode(encoding, "ignore").lstrip("\ufeff").splitlines()
    return lines[0] if lines else ""


def delimiter_for(path: str) -> str:
    return ";" if "2019" in path.rsplit("/", 1)[-1] else ","


def file_headers(spark: SparkSession, paths: list[str], encoding: str = ENCODING) -> list[tuple[str, str, list[str]]]:
    """(path, separator, columns) of each given file; one bounded read per file of the caller's list."""
    out = []
    for path in paths:
        sep = delimiter_for(path)
        fields = next(csv.reader([first_line(spark, path, encoding)], delimiter=sep), [])
        out.append((path, sep, [f.strip() for f in fields]))
    return out


def missing_columns(headers: list[tuple[str, str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Files lacking a required column, with the missing names."""
    lacking = [(path, [c for c in REQUIRED_COLUMNS if c not in columns]) for path, _, columns in headers]
    return [(path, names) for path, names in lacking if names]


def _read_group(spark: SparkSession, paths: list[str], sep: str, columns: list[str], encoding: str) -> DataFrame:
    records = csv_records(spark, [literal_path(p) for p in paths], sep, encoding)
    names = [f"f{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in [*names, CORRUPT])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    fields = records.withColumn("v", F.from_csv("record", schema, options))
    too_many = F.when(n_fields(F.col("record"), sep) > len(columns), "TOO_MANY_FIELDS")
    return fields.select("source_file", *[F.col(f"v.{names[columns.index(k)]}").alias(v) for k, v in COLUMN_NAMES.items()],
                         F.coalesce("reason", too_many).alias("reason"), F.col("record").alias("raw_line"))


def permit_rows(df: DataFrame, sep: str, n_columns: int) -> DataFrame:
    """The five permit columns with ``source_file``, ``raw_line`` and ``reason``
    (NULL, ``TOO_MANY_FIELDS`` or ``OPEN_QUOTE``) of lines parsed one by one
    (a stream): a field over several lines is not put together there."""
    unclosed = opens(F.col(CORRUPT), sep)
    for k in COLUMN_NAMES:
        unclosed = F.coalesce(unclosed, F.lit(False)) | F.coalesce(open_value(F.col(f"`{k}`")), F.lit(False))
    reason = F.when(unclosed, "OPEN_QUOTE") \
        .when(F.col(CORRUPT).isNotNull() & (n_fields(F.col(CORRUPT), sep) > n_columns), "TOO_MANY_FIELDS")
    return df.select(F.col("_metadata.file_path").alias("source_file"),
                     *[F.col(f"`{k}`").alias(v) for k, v in COLUMN_NAMES.items()],
                     reason.alias("reason"), F.col(CORRUPT).alias("raw_line"))


def read_permits(spark: SparkSession, paths: list[str], encoding: str = ENCODING) -> PermitBatch:
    """S1-S5 + P1-P5: read, check, clean."""
    headers = file_headers(spark, paths, encoding)
    lacking = missing_columns(headers)
    missing = spark.createDataFrame(lacking, "path string, missing array<string>")
    skipped = {path for path, _ in lacking}
    layouts: dict[tuple, list[str]] = {}
    for path, sep, columns in headers:
        if path not in skipped:
            layouts.setdefault((sep, tuple(columns)), []).append(path)
    raw = None
    for (sep, columns), part_paths in layouts.items():  # one read per layout
        part = _read_group(spark, part_paths, sep, list(columns), encoding)
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        empty = spark.createDataFrame([], "source_file string, store_name string, reason string, raw_line string")
        return PermitBatch(clean_permits(spark.createDataFrame([], _RAW_SCHEMA)), empty, missing)
    judged = with_reasons(raw)
    return PermitBatch(clean_permits(judged.filter("reason is null")), reject_rows(judged), missing)


def with_reasons(raw: DataFrame) -> DataFrame:
    """``permit_rows`` with a reason also for rows without a name or an address."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = F.coalesce("reason", F.when(blank("store_name"), "NAME_MISSING").when(blank("address"), "ADDRESS_MISSING"))
    return raw.withColumn("reason", reason)


def reject_rows(judged: DataFrame) -> DataFrame:
    """``source_file, store_name, reason, raw_line`` of the rejected rows."""
    fields = F.concat_ws(",", *[F.coalesce(F.col(v), F.lit("")) for v in COLUMN_NAMES.values()])
    return judged.filter("reason is not null").select("source_file", "store_name", "reason",
                                                      F.coalesce("raw_line", fields).alias("raw_line"))


_RAW_SCHEMA = "source_file string, store_name string, sector string, address string, open_date string, close_date string"


def clean_permits(raw: DataFrame, number_copies: bool = True) -> DataFrame:
    """Store schema, dates parsed (bad -> NULL), coordinates NULL.
    ``id`` is a hash of the source file, the raw fields (a missing field
    differs from an empty or shifted one) and the number of the row among the
    equal rows of its file; stable across runs.  A stream cannot number
    copies (``number_copies=False``): equal lines of one file share an id."""
    fields = ["source_file", "store_name", "sector", "address", "open_date", "close_date"]
    copy = F.lit(1).cast("long")
    if number_copies:
        counted = raw.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies"))
        raw = counted.select(*fields, F.explode(F.sequence(copy, "copies")).alias("copy"))
        copy = F.col("copy")
    rid = F.xxhash64(F.to_json(F.array(*[F.col(c) for c in fields])), copy)
    return raw.select(rid.alias("id"), "store_name", "sector", "address",
                      parse_permit_date(F.col("open_date")).alias("open_date"),
                      parse_permit_date(F.col("close_date")).alias("close_date"),
                      F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))


def append_stores(stores: DataFrame, path: str, dedupe: bool = False) -> None:
    """K1: append to the store table (parquet).  ``dedupe`` drops rows
    already equal on (name, address, opening date) within this batch."""
    out = stores.dropDuplicates(["store_name", "address", "open_date"]) if dedupe else stores
    out.write.mode("append").parquet(path)


def clean_columns(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P1-P5 on any frame carrying the permit's own (Korean) column names as
    text: rename and keep the five columns, drop rows without a name or an
    address (NULL or blank), parse both dates, add empty coordinates."""
    r = raw.select(*keep, *[F.col(f"`{k}`").cast("string").alias(v) for k, v in COLUMN_NAMES.items()])
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    r = r.filter(has("store_name") & has("address"))
    return r.select(*keep, "store_name", "sector", "address",
                    parse_permit_date(F.col("open_date")).alias("open_date"),
                    parse_permit_date(F.col("close_date")).alias("close_date"),
                    F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
