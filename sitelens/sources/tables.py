"""Parquet table access and size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table.  Selecting the columns here keeps the parquet
    ``ReadSchema`` narrow even before Catalyst prunes."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.  A plain count: one
    partial sum per scan task, never rows gathered in one task."""
    return df.count() <= max_rows


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row of ``df``.

    The aggregate becomes a scalar subquery (``DataFrame.scalar()``): Spark
    runs it once and hands the value to every task -- no join at all.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_row")).scalar()
    return df.select("*", *[packed.getField(c).alias(c) for c in cols])
