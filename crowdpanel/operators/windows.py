"""Ranked, trailing and whole-partition operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranked


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest order tuple per key.

    A ``max_by`` aggregate combines on the map side, so a hot key costs no sort.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps k rows per key and task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def mutual_top_k(edges: DataFrame, score: Column, k: int) -> DataFrame:
    """Edges (src, dst) ranked k or better at either end; ties by the other id.

    An edge competes at its src with the edges of that src, and at its dst with
    those of that dst. Both rankings run in one pass over (end, node) groups.
    """
    ends = F.explode(F.array(
        F.struct(F.lit("s").alias("end"), F.col("src").alias("node"), F.col("dst").alias("peer")),
        F.struct(F.lit("d").alias("end"), F.col("dst").alias("node"), F.col("src").alias("peer"))))
    flat = edges.withColumn("_e", ends)
    kept = top_k(flat, ["_e.end", "_e.node"], [score.desc(), F.col("_e.peer")], k, "_rank")
    return kept.select(*edges.columns).dropDuplicates(["src", "dst"])


def trailing_rows(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int, name: str) -> DataFrame:
    """Mean of the current and the previous k-1 rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), Window.currentRow)
    return df.withColumn(name, F.avg(value).over(w))


def trailing_days(df: DataFrame, keys: Sequence[str], date: str, value: str, days: int,
                  name: str, count: str) -> DataFrame:
    """Mean and count over the last ``days`` days including the current date."""
    number = F.unix_date(F.col(date))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, 0)
    return df.withColumn(name, F.avg(value).over(w)).withColumn(count, F.count(value).over(w))


def change_ratio(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Value over the previous row's value, minus one."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, F.try_divide(F.col(value), prev) - 1)


def tercile_labels(events: DataFrame, value: str, date: str = "date",
                   labels: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """(date, tercile) over the distinct event dates (a calendar-sized table)."""
    distinct = events.select(date, value).distinct()
    third = F.ntile(len(labels)).over(Window.orderBy(value, date))
    return distinct.select(date, F.element_at(F.array(*map(F.lit, labels)), third).alias("tercile"))


def share_of_total(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over its group's sum; the sums are aggregated first, not windowed."""
    total = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    out = df.join(total, list(group))
    return out.withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def demean(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns minus their group mean, added as ``<column>_net``."""
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    out = df.join(means, list(group))
    net = [(F.col(c) - F.col(f"_mean_{c}")).alias(f"{c}_net") for c in columns]
    return out.select(*df.columns, *net)


def category_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """(value, code): 1-based rank of the sorted distinct values, null first.

    The distinct values are range-partitioned, counted per range and numbered inside
    their range behind the sum of the ranges before, so no task sees all of them.
    """
    return ranked(df.select(column).distinct(), [], [column], code)


def running_min(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.min(value).over(w))
