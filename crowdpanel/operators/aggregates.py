"""Aggregations beyond one built-in call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, in_ranges


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of groups of any size, one column per name; nulls and NaN are left out.

    Built-in ``percentile`` keeps all distinct values of a group in one task. Here equal
    values are counted first and dealt out by ranges of (keys, value), cut at sampled splitters so
    that a task's share does not depend on how the values are spread. Exact counts per range
    tell which ranges hold a wanted rank, and only their values are ranked.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    rows = in_ranges(counts, [*keys, "_v"])
    totals = rows.groupBy(*keys, RANGE).agg(F.sum("_n").alias("_rn"))
    all_ranges = F.sort_array(F.collect_list(F.struct(RANGE, "_rn")))  # as many as there are partitions
    per_key = totals.groupBy(*keys).agg(all_ranges.alias("_all"), F.sum("_rn").alias("_size")).withColumn("_p", F.explode("_all"))
    start = F.aggregate(F.filter("_all", lambda e: e[RANGE] < F.col(f"_p.{RANGE}")), F.lit(0).cast("long"), lambda acc, e: acc + e["_rn"])
    placed = per_key.select(*keys, F.col(f"_p.{RANGE}").alias(RANGE), start.alias("_start"), F.col("_p._rn").alias("_rn"), "_size")
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_size") - 1) * p).alias("pos"))
                      for name, p in probs.items()])
    wanted = (placed.withColumn("_w", F.explode(ranks))
              .select(*keys, RANGE, "_start", F.col("_w.name").alias("_name"), (F.col("_start") + F.col("_rn")).alias("_end"),
                      F.floor("_w.pos").alias("_lo"), (F.col("_w.pos") - F.floor("_w.pos")).alias("_frac"))
              .filter((F.col("_start") <= F.col("_lo") + 1) & (F.col("_end") > F.col("_lo"))))
    asked = wanted.groupBy(*keys, RANGE).agg(F.first("_start").alias("_start"), F.collect_list(F.struct("_name", "_lo", "_frac")).alias("_ranks"))
    asked = asked.withColumnsRenamed({c: f"_a{c}" for c in [*keys, RANGE]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_a{c}")) for c in [*keys, RANGE]])
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, RANGE).orderBy("_v"))
    hit = rows.join(asked, same).withColumn("_upto", upto).withColumn("_w", F.explode("_ranks"))
    hit = hit.select(*keys, "_v", "_n", "_upto", F.col("_w._name").alias("_name"), F.col("_w._lo").alias("_lo"), F.col("_w._frac").alias("_frac"))
    from_rank, to_rank = F.col("_upto") - F.col("_n"), F.col("_upto")
    low = F.max(F.when((from_rank <= F.col("_lo")) & (to_rank > F.col("_lo")), F.col("_v")))
    high = F.max(F.when((from_rank <= F.col("_lo") + 1) & (to_rank > F.col("_lo") + 1), F.col("_v")))
    long = (hit.groupBy(*keys, "_name").agg(low.alias("_a"), high.alias("_b"), F.max("_frac").alias("_f"))
            .withColumn("_q", F.col("_a") + F.when(F.col("_f") > 0, (F.col("_b") - F.col("_a")) * F.col("_f"))
                        .otherwise(F.lit(0.0))))
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs])


def distinct_listing(df: DataFrame, keys: Sequence[str], text: Column, name: str, sep: str = "; ") -> DataFrame:
    """Sorted distinct texts of a group joined to one string."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(text)), sep).alias(name))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) for every column from one pass."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "n_null")


def linear_histogram(df: DataFrame, value: str, lo: float, width: float, bins: int) -> DataFrame:
    """(bin, n) of equal widths from lo; the top edge belongs to the last bin."""
    i = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("long")
    inside = df.filter(F.col(value).between(lo, lo + width * bins))
    return inside.groupBy(i.alias("bin")).agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    """(bin, n) of the positive values in equal steps of log10."""
    i = F.floor(F.log10(value) * per_decade).cast("long")
    return df.filter(F.col(value) > 0).groupBy(i.alias("bin")).agg(F.count("*").alias("n"))


def shape_row(df: DataFrame, value: str) -> DataFrame:
    """n, zeros, zero rate, mean, max and population skewness in one row."""
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.count(F.when(v == 0, 1)).alias("zeros"),
                  F.avg((v == 0).cast("double")).alias("zero_rate"), F.avg(v).alias("mean"),
                  F.max(v).alias("max"), F.skewness(v).alias("skew"),
                  F.avg(F.log1p(v)).alias("log_mean"), F.skewness(F.log1p(v)).alias("log_skew"))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys and their difference."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"),
                       (F.sum("_n") - F.count("*")).alias("n_duplicates"))


def group_means(df: DataFrame, label: Column, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Mean and count per derived label."""
    return df.groupBy(*extra, label.alias("group")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
