"""Parquet and CSV scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import union_all


def read_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Many part files as one table; siblings with another suffix are skipped.

    Paths may live in any file system Spark is configured for (``s3a://…``).
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; several paths are one table."""
    return spark.read.schema(schema).option("header", header).csv([path] if isinstance(path, str) else list(path))


def read_text_columns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Dirty CSV family: every column text, files united by column name, bad rows dropped.

    Columns a file lacks are NULL. Casting is left to ``try_cast``.
    """
    def one(path: str) -> DataFrame:
        names = spark.read.option("header", True).csv(path).limit(0).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)

    return union_all([one(p) for p in paths], missing=True)


def optional_column(df: DataFrame, name: str, kind: str) -> Column:
    """The column if the table has it, else a typed NULL."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def optional_parquet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table if its path exists, else a typed empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def many(frames: Sequence[DataFrame]) -> DataFrame:
    """Seasons or years of one source as a single table."""
    return union_all(list(frames), missing=True)


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> Mapping[str, DataFrame]:
    """Lazy table per name of a folder holding ``<name>.parquet``."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
