"""Unions, pivots, slices, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, measure, value) from one scan."""
    as_double = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return as_double.unpivot(list(keys), list(measures), "measure", "value")


def to_wide(df: DataFrame, keys: Sequence[str], on: str, values: Sequence, value: str, prefix: str) -> DataFrame:
    """One column per listed value of ``on``."""
    cells = [F.max(F.when(F.col(on) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*cells)


def slice_fan_out(df: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """Each row once under 'all' and once per non-NULL slice column."""
    labels = [F.lit("all"), *slices.values()]
    return df.withColumn("slice", F.explode(F.filter(F.array(*labels), lambda s: s.isNotNull())))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), repeatable: the n smallest MD5 hashes of seed and key, by key where hashes are equal.

    The bound that holds n rows is found from counts per hash range: 4096 ranges a
    pass, then those inside the range where the n-th row lies, until that range is small. The sample is one filter
    of the table; only rows of a hash that the bound cuts are sorted. ``key`` should tell rows apart.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])))
    prefix, need = "", n
    while len(prefix) < 32:
        inside = hashed.filter(F.col("_h").startswith(prefix)) if prefix else hashed
        counts = inside.groupBy(F.substring("_h", len(prefix) + 1, 3).alias("p")).count().collect()  # 4096 rows at most
        before = 0
        for part, size in sorted(tuple(r) for r in counts):
            if before + size >= need:
                break
            before += size
        else:
            if not prefix:
                return df  # fewer than n rows
        prefix, need = prefix + part, need - before
        if size == need:
            break
    whole = hashed.filter(F.substring("_h", 1, len(prefix)) <= prefix)
    if size == need:
        return whole.drop("_h")
    tied = hashed.filter(F.col("_h") == prefix).orderBy(*key).limit(need)
    return hashed.filter(F.col("_h") < prefix).unionByName(tied).drop("_h")


def pick_extremes(df: DataFrame, strata: Mapping[str, Column], order: Sequence[Column], n: int) -> DataFrame:
    """Up to n rows per stratum; a row is in a stratum when its condition holds."""
    names = F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in strata.items()]), lambda s: s.isNotNull())
    tagged = df.withColumn("stratum", F.explode(names))
    w = Window.partitionBy("stratum").orderBy(*order)
    return tagged.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)
