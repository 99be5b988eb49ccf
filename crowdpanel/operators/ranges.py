"""Scans over sorted rows without one task per key: range partitions, local scans, carried states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable_table

RANGE = "_range"


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with the number of the range partition each row fell in, written to the shared folder.

    Ranges are ordered by ``order`` (nulls first) and about equally large, however the rows are spread over keys; rows equal in all
    of ``order`` share a range. The number is stored with the row, so that a task that runs again sees the same ranges.
    """
    return durable_table(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def carried(parts: DataFrame, keys: Sequence[str], state: Column, name: str) -> DataFrame:
    """(keys, range, name): ``state``, an aggregate of a key's earlier ranges, where a key goes on from an earlier range.

    ``parts`` has one row per key and range. As ranges follow the order of keys, at most one key of each range
    began in an earlier one: the result has fewer rows than there are ranges, which is the bound of its broadcast.
    """
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, state.over(earlier)).filter(F.col(name).isNotNull()).select(*keys, RANGE, name)


def attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the carried state of their key and range; null where there is none. Keys may be null."""
    other = carry.withColumnsRenamed({c: f"_c{c}" for c in [*keys, RANGE]})
    on = F.col(RANGE) == F.col(f"_c{RANGE}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    return rows.join(F.broadcast(other), on, "left").drop(*[f"_c{c}" for c in [*keys, RANGE]])


def rows_before(parts: DataFrame) -> DataFrame:
    """(range, rows of all earlier ranges) from (range, rows): one small row holds all ranges, whose number is that of partitions."""
    every = parts.agg(F.collect_list(F.struct(RANGE, "_n")).alias("_all"))
    each = every.select("_all", F.explode("_all").alias("_p"))
    earlier = F.filter("_all", lambda e: e[RANGE] < F.col(f"_p.{RANGE}"))
    return each.select(F.col(f"_p.{RANGE}").alias(RANGE), F.aggregate(earlier, F.lit(0).cast("long"), lambda acc, e: acc + e["_n"]).alias("_before"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the 1-based row number of each row inside its keys (or overall, without keys).

    Rows are counted per key and range, counts are added up over ranges, and rows are numbered inside a range, so a
    key with any share of the rows, or a table without keys, is ranked by all tasks.
    """
    rows = in_ranges(df, [*keys, *order])
    parts = rows.groupBy(*keys, RANGE).agg(F.count("*").alias("_n"))
    carry = carried(parts, keys, F.sum("_n"), "_before") if keys else rows_before(parts)
    local = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))
    out = attach(rows.withColumn("_local", local), carry, keys, "_before")
    return out.withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)
