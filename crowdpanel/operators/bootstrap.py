"""Day-clustered bootstraps and placebos as joins on a table of draws.

Draw indices are hashes of (seed, side, stratum, draw, slot), so results repeat
on any cluster. All inputs are day-level: their size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_sides(dayband: DataFrame, treated: Column, control: Column, strata: Sequence[str] = ()) -> DataFrame:
    """Distinct (date, side, strata); a date is treated, control or left out."""
    side = F.when(treated, F.lit("t")).when(control, F.lit("c"))
    return dayband.select("date", *strata, side.alias("side")).filter(F.col("side").isNotNull()).distinct()


def draw_days(days: DataFrame, n_draws: int, seed: int = 0, strata: Sequence[str] = ()) -> DataFrame:
    """(draw, date, side, strata) with as many rows per draw as there are days.

    Days are drawn with replacement within each side (and stratum); a day drawn
    twice is two rows, which the later join keeps.
    """
    group = ["side", *strata]
    w = Window.partitionBy(*group)
    numbered = days.withColumn("slot", F.row_number().over(w.orderBy("date")) - 1).withColumn(
        "n", F.count("*").over(w))
    draws = numbered.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    pick = F.pmod(F.xxhash64(F.lit(seed), *group, "draw", "slot"), F.col("n")).cast("int")
    picked = draws.select(*group, "draw", pick.alias("slot"))
    return picked.join(numbered.select(*group, "slot", "date"), [*group, "slot"]).drop("slot")


def take_draws(draws: DataFrame, frame: DataFrame) -> DataFrame:
    """Rows of the frame once per time their date was drawn."""
    return draws.join(frame, "date")


def did_draws(dayband: DataFrame, draws: DataFrame, key: str = "band", value: str = "resid") -> DataFrame:
    """(draw, key, did): treated mean minus control mean of each draw."""
    rows = take_draws(draws.select("draw", "date", "side"), dayband.select("date", key, value))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col(value)))
    return rows.groupBy("draw", key).agg((mean("t") - mean("c")).alias("did")).filter(F.col("did").isNotNull())


def interval(draws: DataFrame, key: str = "band", value: str = "did") -> DataFrame:
    """Percentile interval and two-sided p per key (a group holds n_draws rows)."""
    v = F.col(value)
    p = 2 * F.least(F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double")))
    return draws.groupBy(key).agg(F.percentile(v, 0.025).alias("lo"), F.percentile(v, 0.975).alias("hi"),
                                  p.alias("p"), F.count("*").alias("n_draws"))


def bootstrap_did(dayband: DataFrame, treated: Column, control: Column, n_draws: int = 2000, seed: int = 0,
                  key: str = "band") -> DataFrame:
    """Interval of the pooled difference per key."""
    draws = draw_days(day_sides(dayband, treated, control), n_draws, seed)
    return interval(did_draws(dayband, draws, key), key)


def matched_draws(frame: DataFrame, draws: DataFrame, strata: Sequence[str], key: str = "band",
                  value: str = "resid") -> DataFrame:
    """(draw, key, did) of the stratum-weighted difference of each draw."""
    rows = take_draws(draws, frame.select("date", key, value))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col(value)))
    by_stratum = rows.groupBy("draw", key, *strata).agg(mean("t").alias("g"), mean("c").alias("c")).filter(
        F.col("g").isNotNull() & F.col("c").isNotNull())
    weight = draws.filter(F.col("side") == "t").groupBy("draw", *strata).agg(F.count("*").alias("n_g"))
    joined = by_stratum.join(weight, ["draw", *strata])
    return joined.groupBy("draw", key).agg(
        (F.sum((F.col("g") - F.col("c")) * F.col("n_g")) / F.sum("n_g")).alias("did"))


def bootstrap_matched(frame: DataFrame, treated: Column, control: Column, strata: Sequence[str],
                      n_draws: int = 1000, seed: int = 0, key: str = "band") -> DataFrame:
    """Interval of the matched difference; days are resampled inside their stratum."""
    draws = draw_days(day_sides(frame, treated, control, strata), n_draws, seed, strata)
    return interval(matched_draws(frame, draws, strata, key), key)


def placebo(dayband: DataFrame, treated: Column, control: Column, n_draws: int = 200, seed: int = 0,
            key: str = "band") -> DataFrame:
    """Mean and population sd of differences when control days stand in for treated ones.

    Each draw marks as many control days as there are treated days, without
    replacement, and compares them with the remaining controls.
    """
    sides = day_sides(dayband, treated, control)
    m = sides.agg(F.count(F.when(F.col("side") == "t", 1)).alias("m"))
    pool = sides.filter(F.col("side") == "c").select("date").withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    order = Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "date"), "date")
    fake = pool.withColumn("r", F.row_number().over(order)).join(F.broadcast(m)).select(
        "draw", "date", F.when(F.col("r") <= F.col("m"), "t").otherwise("c").alias("side"))
    dids = did_draws(dayband, fake, key)
    return dids.groupBy(key).agg(F.avg("did").alias("placebo_mean"), F.stddev_pop("did").alias("placebo_sd"),
                                 F.count("*").alias("n_draws"))
