"""Matched controls, lifts, event studies and distance decay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.dates import hour_stamp
from ..functions.stats import std_error, t_statistic
from .joins import around, only_in
from .reshape import slice_fan_out, to_long
from .windows import tercile_labels, top_k

# Matching depth, reach and minimum, and the hourly window.
MATCH_K = 8
MATCH_MAX_DAYS = 120
MIN_CONTROLS = 5
RELATIVE_HOURS = (-6, 8)


def same_weekday_dates(date: str, max_days: int) -> Column:
    """Every date of the same weekday within ±max_days (the banded join as equality)."""
    weeks = max_days // 7
    steps = F.sequence(F.lit(-weeks * 7), F.lit(weeks * 7), F.lit(7))
    return F.transform(steps, lambda d: F.date_add(F.col(date), d))


def game_effects(panel: DataFrame, measures: Sequence[str], unit: str = "ring_id", game: str = "game_day",
                 control: str = "clean_control", k: int = MATCH_K, max_days: int = MATCH_MAX_DAYS,
                 min_n: int = MIN_CONTROLS, covariates: Sequence[str] = ()) -> DataFrame:
    """Observed, matched baseline and lift per event date, unit and measure.

    Same weekday within 120 days means one of at most 35 dates, so the banded
    match is an equi-join on (unit, measure, date) after exploding those dates.
    Events without any control keep their row with a NULL baseline.
    """
    covs = list(covariates)
    long = to_long(panel, [unit, "date", game, control, *covs], measures)
    treated = long.filter(F.col(game)).select(unit, "measure", F.col("date").alias("event_date"),
                                              F.col("value").alias("observed"), *covs)
    pool = long.filter(F.col(control) & F.col("value").isNotNull()).select(unit, "measure", "date", "value")
    wide = treated.withColumn("date", F.explode(same_weekday_dates("event_date", max_days)))
    pairs = wide.join(pool, [unit, "measure", "date"], "left")
    gap = F.abs(F.datediff("date", "event_date"))
    keys = [unit, "measure", "event_date"]
    near = top_k(pairs, keys, [F.col("value").isNull(), gap, F.col("date")], k)
    per_event = near.groupBy(*keys).agg(
        F.any_value("observed").alias("observed"), F.avg("value").alias("_base"),
        F.stddev_samp("value").alias("baseline_sd"), F.count("value").alias("baseline_n"),
        *[F.any_value(c).alias(c) for c in covs])
    base = F.when(F.col("baseline_n") >= min_n, F.col("_base"))
    return (per_event.withColumn("baseline", base).withColumn("lift", F.col("observed") - F.col("baseline"))
            .withColumn("lift_pct", F.try_divide(100.0 * F.col("lift"), F.nullif(F.col("baseline"), F.lit(0.0))))
            .drop("_base").withColumnRenamed("event_date", "date"))


def event_study(effects: DataFrame, unit: str = "ring_id") -> DataFrame:
    """Mean and SE of lifts per unit, measure and slice (all, day/night, attendance third)."""
    third = tercile_labels(effects, "attendance")
    labelled = effects.join(F.broadcast(third), "date", "left")
    sliced = slice_fan_out(labelled, {"day_night": F.col("day_night"), "tercile": F.concat(F.lit("attendance_"), "tercile")})
    return sliced.groupBy(unit, "measure", "slice").agg(
        F.count("lift").alias("n_games"), F.round(F.avg("lift"), 1).alias("mean_lift"),
        F.round(std_error(F.col("lift")), 1).alias("se_lift"), F.round(F.avg("lift_pct"), 2).alias("mean_lift_pct"),
        F.round(std_error(F.col("lift_pct")), 2).alias("se_lift_pct"))


def distance_decay(study: DataFrame, midpoints: Sequence[float] = geo.RING_MIDPOINTS_M,
                   unit: str = "ring_id") -> DataFrame:
    """All-events rows with the ring midpoint in metres."""
    mid = F.element_at(F.array(*[F.lit(float(m)) for m in midpoints]), F.col(unit).cast("int"))
    return study.filter(F.col("slice") == "all").withColumn("ring_mid_m", mid).drop("slice")


def decay_fit(decay: DataFrame) -> DataFrame:
    """Log-linear fit of the positive percent lifts on distance in km, per measure."""
    x, y = F.col("ring_mid_m") / 1000.0, F.log("mean_lift_pct")
    return decay.filter(F.col("mean_lift_pct") > 0).groupBy("measure").agg(
        F.regr_slope(y, x).alias("log_slope_per_km"), F.regr_intercept(y, x).alias("log_intercept"),
        F.count("*").alias("rings_used"))


def _event_windows(hours: DataFrame, calendar: DataFrame, span: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Single-game events with their start, and the long fact rows around them."""
    starts = calendar.filter(F.col("game_day") & (F.col("n_games") == 1) & F.col("first_hour").isNotNull()).select(
        F.col("date").alias("game_date"), "day_night", "first_hour",
        hour_stamp(F.col("date"), F.col("first_hour")).alias("start_ts"))
    return starts, around(starts, hours, "start_ts", "ts", *span)


def hourly_lifts(hourly: DataFrame, calendar: DataFrame, measures: Sequence[str], unit: str = "ring_id",
                 span: tuple[int, int] = RELATIVE_HOURS, k: int = MATCH_K, max_days: int = MATCH_MAX_DAYS,
                 pool: DataFrame | None = None) -> DataFrame:
    """Per event, unit, measure and relative hour: value, baseline and number of controls.

    Controls are read at the same offset from midnight of a clean anchor date, so
    hours after midnight come from the day after the anchor. The (event, anchor,
    hour) table is calendar-sized and is joined to the fact by timestamp.
    ``pool`` (date) replaces the clean dates.
    """
    stamped = hourly.withColumn("ts", hour_stamp(F.col("date"), F.col("hour")))
    long = to_long(stamped, [unit, "ts"], measures)
    starts, windows = _event_windows(long, calendar, span)
    treated = windows.select(unit, "measure", "game_date", "day_night", "relative_hour", "value")

    clean = pool if pool is not None else calendar.filter("clean_control").select("date")
    anchors = starts.withColumn("date", F.explode(same_weekday_dates("game_date", max_days))).join(
        clean.select("date"), "date")
    reads = anchors.withColumn("relative_hour", F.explode(F.sequence(F.lit(span[0]), F.lit(span[1])))).select(
        "game_date", F.col("date").alias("anchor"), "relative_hour",
        (hour_stamp(F.col("date"), F.col("first_hour")) + F.make_dt_interval(F.lit(0), F.col("relative_hour"))).alias("ts"))
    control = long.filter(F.col("value").isNotNull()).join(reads, "ts")
    keys = [unit, "measure", "game_date", "relative_hour"]
    gap = F.abs(F.datediff("anchor", "game_date"))
    near = top_k(control, keys, [gap, F.col("anchor")], k)
    base = near.groupBy(*keys).agg(F.avg("value").alias("baseline"), F.stddev_samp("value").alias("baseline_sd"),
                                   F.count("value").alias("baseline_n"))
    return treated.join(base, keys, "left").withColumn("baseline_n", F.coalesce("baseline_n", F.lit(0).cast("long")))


def hourly_event_study(lifts: DataFrame, unit: str = "ring_id", min_n: int = MIN_CONTROLS) -> DataFrame:
    """Effect, SE and t per unit, measure, relative hour and slice."""
    kept = lifts.filter(F.col("baseline_n") >= min_n).withColumn("lift", F.col("value") - F.col("baseline"))
    sliced = slice_fan_out(kept, {"day_night": F.col("day_night")})
    lift = F.col("lift")
    return sliced.groupBy(unit, "measure", "relative_hour", "slice").agg(
        F.avg(lift).alias("effect"), std_error(lift).alias("se"), t_statistic(lift).alias("t"),
        F.count("*").alias("n_games"))


def thin_cells(lifts: DataFrame, unit: str = "ring_id", min_n: int = MIN_CONTROLS) -> DataFrame:
    """One row: event cells with fewer controls than needed."""
    thin = lifts.filter(F.col("baseline_n") < min_n).select(unit, "measure", "game_date", "relative_hour").distinct()
    return thin.agg(F.count("*").alias("n_thin"))


def control_sensitivity(hourly: DataFrame, calendar: DataFrame, exclude: DataFrame, unit_value: int,
                        measure: str, unit: str = "ring_id", min_n: int = MIN_CONTROLS,
                        span: tuple[int, int] = RELATIVE_HOURS) -> DataFrame:
    """Peak effect of one unit with the shipped pool and with ``exclude`` dates removed."""
    one = hourly.filter(F.col(unit) == unit_value)
    clean = calendar.filter("clean_control").select("date")
    lift = F.col("value") - F.col("baseline")

    def curve(pool: DataFrame, name: str) -> DataFrame:
        rows = hourly_lifts(one, calendar, [measure], unit, span, pool=pool)
        return rows.filter(F.col("baseline_n") >= min_n).groupBy("relative_hour").agg(F.avg(lift).alias(name))

    shipped, strict = curve(clean, "shipped"), curve(only_in(clean, exclude, ["date"]), "strict")
    both = shipped.join(strict, "relative_hour", "left")
    peak = both.agg(F.max_by(F.struct("relative_hour", "shipped", "strict"),
                             F.struct("shipped", (-F.col("relative_hour")))).alias("p")).select("p.*")
    return peak.withColumn("change_pct", 100.0 * F.try_divide(F.col("strict") - F.col("shipped"), F.col("shipped")))


def peak_row(study: DataFrame, where: Column, by: str = "effect") -> DataFrame:
    """The single row with the largest value (ties: earliest hour)."""
    cols = study.columns
    order = F.struct(F.col(by), (-F.col("relative_hour")))
    return study.filter(where).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*")
