"""Records of quoted CSV files whose fields may hold line breaks, found in parallel.

A field is quoted when it *starts* with a quote; quotes elsewhere are plain
text (``5" pizza``).  Whether a line begins inside a quoted field depends on
all lines before it, yet each line is only one of four functions of that one
bit (open, close, keep, flip).  So every split composes the functions of its
lines, the few splits of a file are composed in turn, and each line then knows
its record -- no task reads more than a split, whatever the size of a file.

Only records of several lines are gathered (their lines, joined by ``\\n``).
The lines of a quoted field that never closes, or of one that runs over more
than ``RECORD_LINES`` lines, come back one by one as ``OPEN_QUOTE``: none is
lost, none becomes a record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir

RECORD_LINES = 10_000
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def opens(line: Column, sep: str) -> Column:
    """True when the last field of a line that begins outside quotes is quoted and does not close."""
    s = re.escape(sep)
    field = rf'(?:{QUOTED}"[^{s}]*+|(?!")[^{s}]*+)'
    return line.rlike(rf"^(?s)(?:{field}{s})*+{QUOTED}$")


def n_fields(record: Column, sep: str) -> Column:
    """Number of fields of a closed record."""
    s = re.escape(sep)
    return F.size(F.split(F.regexp_replace(record, rf'(?s)(^|{s}){QUOTED}"', "$1"), s, -1))


def _running(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """Adds ``after`` and ``before``: the composed function of all rows up to each row, and up to the one before.

    A row maps "begins inside quotes" to "ends inside": false to ``o``, true to ``i``.  A composed function is
    the last fixed answer (``known``, null without one) and whether an odd number of rows flipped it since.
    """
    in_order = Window.partitionBy(*part).orderBy(order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("o") == F.col("i")
    out = rows.withColumn("_flips", F.sum((F.col("o") & ~F.col("i")).cast("long")).over(so_far)) \
        .withColumn("_known", F.last(F.when(fixed, F.col("o")), True).over(so_far)) \
        .withColumn("_base", F.last(F.when(fixed, F.col("_flips")), True).over(so_far))
    odd = (F.col("_flips") - F.coalesce("_base", F.lit(0))) % 2 == 1
    return out.withColumn("after", F.struct(F.col("_known").alias("known"), odd.alias("odd"))) \
        .withColumn("before", F.lag("after").over(in_order)).drop("_flips", "_known", "_base")


def _applied(function: str, inside: Column) -> Column:
    """The answer of a composed function (null: of no rows)."""
    return F.coalesce(F.col(f"{function}.known"), inside) != F.coalesce(F.col(f"{function}.odd"), F.lit(False))


def marked_lines(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """``source_file, block, no, line`` with ``inside`` (begins in a quoted field), ``rec`` (the
    ``no`` of its record's first line) and ``cut`` (its file ends within that record)."""
    ensure_checkpoint_dir(spark)
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    lines = raw.withColumn("o", opens(F.col("line"), sep)).withColumn("i", opens(F.concat(F.lit('"'), "line"), sep)).checkpoint()
    split = ["source_file", "block"]
    lines = _running(lines, split, "no")
    blocks = lines.groupBy(*split).agg(F.max_by("after", "no").alias("f"))
    blocks = _running(blocks.select(*split, _applied("f", F.lit(False)).alias("o"), _applied("f", F.lit(True)).alias("i")),
                      ["source_file"], "block")
    begins = blocks.select(*split, _applied("before", F.lit(False)).alias("block_inside"))
    lines = lines.join(begins, split).withColumn("inside", _applied("before", F.col("block_inside")))
    first = F.when(~F.col("inside"), F.col("no"))
    to_here = Window.partitionBy(*split).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.select(*split, "no", "line", "inside", F.last(first, True).over(to_here).alias("own"))
    # A split whose first lines go on with a record of an earlier split; the record in which a file ends open.
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lines.groupBy(*split).agg(F.max("own").alias("last_own")).join(blocks, split) \
        .select(*split, F.last("last_own", True).over(earlier).alias("carried"), F.last("last_own", True).over(whole).alias("final"),
                F.last(_applied("after", F.lit(False))).over(whole).alias("open_end"))
    rec = F.coalesce("own", "carried")
    return lines.join(lasts, split).select(*split, "no", "line", "inside", rec.alias("rec"),
                                           (F.col("open_end") & (rec == F.col("final"))).alias("cut"))


def csv_records(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """``source_file, record, reason`` of all records after each file's header (its first record);
    ``reason`` is null or ``OPEN_QUOTE``.  Blank lines between records are no records."""
    lines = marked_lines(spark, paths, sep, encoding).checkpoint()
    rows = lines.filter("inside").groupBy("source_file", "rec").agg((F.count(F.lit(1)) + 1).alias("n"))
    headers = lines.filter("block = 0").groupBy("source_file").agg(F.min("no").alias("header"))
    lines = lines.join(rows, ["source_file", "rec"], "left").join(headers, "source_file").filter("rec <> header")
    broken = F.col("cut") | (F.coalesce("n", F.lit(1)) > RECORD_LINES)
    single = lines.filter(broken | F.col("n").isNull()).filter(F.trim("line") != "") \
        .select("source_file", F.col("line").alias("record"), F.when(broken, "OPEN_QUOTE").alias("reason"))
    many = lines.filter(~broken & F.col("n").isNotNull()).groupBy("source_file", "rec") \
        .agg(F.array_sort(F.collect_list(F.struct("block", "no", "line"))).alias("parts")) \
        .select("source_file", F.array_join("parts.line", "\n").alias("record"), F.lit(None).cast("string").alias("reason"))
    return single.union(many)
