"""Helpers of this subpackage: reading tables, whole texts, and the shared ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.common import release, shared_folder, ship_package, written  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that helper columns beside it can't clash with them."""
    return df.select(F.struct(*(named(c) for c in df.columns)).alias("row"))


def field(column: str) -> Column:
    """A column of a packed table."""
    return F.col("row").getField(column)


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The columns of ``row`` in their order, then ``added``, which replaces columns of its names."""
    kept = [c for c in df.schema["row"].dataType.names if c not in added]
    return df.select(*(field(c).alias(c) for c in kept), *(value.alias(c) for c, value in added.items()))


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as the empty string."""
    return F.coalesce(named(column) if isinstance(column, str) else column, F.lit(""))
