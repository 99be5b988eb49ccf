"""Station uplift, capture and velocity calibration, shares and dollars."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.stats import ratio_of_sums, share_if, student_p_value, student_quantile
from .panel import EVENING
from .windows import share_of_total

# Percent effect with interval per published distance band.
BAND_EFFECTS = {
    "0-500m": (37.3, 32.4, 42.2),
    "500-1000m": (14.3, 11.1, 17.5),
    "1000-2000m": (3.0, 1.7, 4.4),
    "2000-4000m": (1.1, 0.1, 2.1),
    ">4000m": (0.0, 0.0, 0.0),
}


def arrival_uplift(od: DataFrame, schedule: DataFrame, station: str, pre: int = 2,
                   night_only: bool = True) -> DataFrame:
    """Arrivals in [start-pre, start] of each game minus the same weekday-hour means.

    Means run over non-game dates with rows; with ``night_only`` day games count
    as non-game. Missing hours and missing means count 0. A game's means are added in the order
    of their hours: the sum of doubles, and so its rounding where it lies on a tie, depends on no shuffle.
    """
    hourly = od.filter(F.col("destination") == station).groupBy("date", "hour").agg(
        F.sum("trip_count").alias("arrivals"))
    games = schedule.filter(F.col("day_night") == "night") if night_only else schedule
    quiet = hourly.join(games.select("date").distinct(), "date", "left_anti")
    means = quiet.groupBy(dates.iso_weekday(F.col("date")).alias("dow"), "hour").agg(F.avg("arrivals").alias("mean"))
    wanted = games.withColumn("hour", F.explode(F.sequence(F.col("first_hour") - pre, F.col("first_hour")))).withColumn(
        "dow", dates.iso_weekday(F.col("date")))
    filled = wanted.join(hourly, ["date", "hour"], "left").join(means, ["dow", "hour"], "left")
    zero = F.lit(0)
    per_hour = F.array_sort(F.collect_list(F.struct("hour", F.coalesce("mean", F.lit(0.0)).alias("mean"))))  # pre + 1 hours
    per_game = filled.groupBy("date", "opponent", "first_hour").agg(
        F.sum(F.coalesce("arrivals", zero)).alias("game_arrivals"), F.aggregate(per_hour, F.lit(0.0), lambda acc, h: acc + h["mean"]).alias("_base"))
    return per_game.select("date", "opponent", "first_hour", "game_arrivals", F.round("_base", 1).alias("baseline_arrivals"),
                           F.round(F.col("game_arrivals") - F.col("_base"), 1).alias("uplift"))


def uplift_summary(per_game: DataFrame) -> DataFrame:
    """n, mean, sd, SE, t and percent positive in one row."""
    u = F.col("uplift")
    raw = per_game.agg(F.count(u).alias("n_games"), F.avg(u).alias("m"), F.stddev_samp(u).alias("s"),
                       share_if(u > 0).alias("pos"))
    se = F.col("s") / F.sqrt("n_games")
    return raw.select("n_games", F.round("m", 1).alias("mean_uplift"), F.round("s", 1).alias("std_uplift"),
                      F.round(se, 1).alias("se"), F.round(F.try_divide(F.col("m"), F.nullif(se, F.lit(0.0))), 2).alias("t_stat"),
                      F.round(100 * F.col("pos"), 1).alias("pct_positive"))


def calibrate_capture(per_game: DataFrame, attendance: DataFrame) -> DataFrame:
    """Uplift against attendance: correlation, slope per 1000, intercept, capture shares.

    One row per game, so the median runs over a calendar-sized group.
    """
    both = per_game.join(attendance.select("date", "attendance"), "date").filter(F.col("attendance") > 0)
    u, a = F.col("uplift"), F.col("attendance")
    capture = 100.0 * u / a
    return both.agg(F.count("*").alias("n_games"), F.corr(u, a).alias("r"), (1000 * F.regr_slope(u, a)).alias("per_1000"),
                    F.regr_intercept(u, a).alias("intercept"), F.avg(capture).alias("mean_capture_pct"),
                    F.median(capture).alias("median_capture_pct"))


def calibrate_velocity(spend: DataFrame, attendance: DataFrame, level: float = 0.95) -> DataFrame:
    """OLS of the daily spend index on attendance per 10k with weekday, month and year effects.

    Dates without an event have attendance 0. Returns one row: coefficient in
    percentage points, SE, t, interval, p value and counts. Sums and products are aggregated per
    (weekday, month, year), at most 84 rows a year however many days there are; the
    effects are absorbed from those, and what is left gives the coefficient (Frisch, Waugh, Lovell).
    """
    days = spend.join(attendance.select("date", "attendance"), "date", "left").select(
        (100.0 * F.col("spend_idx")).alias("y"), (F.coalesce("attendance", F.lit(0)) / 10000.0).alias("a"),
        F.dayofweek("date").alias("dow"), F.month("date").alias("month"), F.year("date").alias("year"))
    sums = {"sy": F.sum("y"), "sa": F.sum("a"), "yy": F.sum(F.col("y") * F.col("y")), "ay": F.sum(F.col("a") * F.col("y")), "aa": F.sum(F.col("a") * F.col("a"))}
    cells = days.dropna().groupBy("dow", "month", "year").agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()]).toPandas()
    effects = np.concatenate([(cells[c].to_numpy()[:, None] == np.unique(cells[c])) for c in ("dow", "month", "year")], axis=1).astype(float)
    n, sy, sa = (cells[c].to_numpy(float) for c in ("n", "sy", "sa"))
    gram = effects.T @ (n[:, None] * effects)  # days by pairs of effects
    inverse, rank = np.linalg.pinv(gram, hermitian=True), int(np.linalg.matrix_rank(gram, hermitian=True))
    left = lambda u, v, uv: float(cells[uv].sum() - (effects.T @ u) @ inverse @ (effects.T @ v))
    aa, ay, yy = left(sa, sa, "aa"), left(sa, sy, "ay"), left(sy, sy, "yy")
    df = int(n.sum()) - rank - 1
    coef = ay / aa
    se = math.sqrt((yy - coef * ay) / df / aa)
    half = student_quantile(0.5 + level / 2, df) * se
    row = (coef, se, coef / se, coef - half, coef + half, student_p_value(coef / se, df), int(n.sum()))
    return spend.sparkSession.createDataFrame(
        [row], "pp_per_10k double, se double, t double, lo double, hi double, p_value double, n_days long")


def dollarize(events: DataFrame, base_dollars: float, pp_per_10k: str = "pp_per_10k") -> DataFrame:
    """Percent lift, dollars and dollars per attendee of an attendance."""
    pct = F.col(pp_per_10k) * F.col("attendance") / 10000.0
    dollars = pct / 100.0 * base_dollars
    return (events.withColumn("lift_pct", pct).withColumn("dollars", dollars)
            .withColumn("dollars_per_head", F.try_divide(dollars, F.col("attendance"))))


def evening_share(hourly: DataFrame, poi: DataFrame, food_prefix: str = "722") -> DataFrame:
    """One row: share of food-place hours that fall in the evening."""
    food = hourly.join(poi.filter(F.col("category").startswith(food_prefix)).select("poi_id"), "poi_id", "left_semi")
    evening = F.when(F.col("hour").between(*EVENING), F.col("visitor_hours")).otherwise(0)
    return food.agg(ratio_of_sums(evening, F.col("visitor_hours")).alias("evening_share"))


def band_day_shares(daily: DataFrame, poi: DataFrame, venue: Sequence[float] = geo.VENUE,
                    food_prefix: str = "722") -> DataFrame:
    """Each band's share of food visits per day."""
    band = geo.band_upto(geo.flat_distance("lat", "lon", *venue))
    food = poi.filter(F.col("category").startswith(food_prefix)).select("poi_id", band.alias("band"))
    visits = daily.join(food, "poi_id").groupBy("date", "band").agg(F.sum("visits").alias("visits"))
    return share_of_total(visits, ["date"], "visits", "share")


def event_dollars(shares: DataFrame, daily_dollars: DataFrame, games: DataFrame, evening: DataFrame,
                  effects: Mapping[str, Sequence[float]] = BAND_EFFECTS) -> DataFrame:
    """Per band: games, evening dollars and the event's part of them with bounds.

    Observed = counterfactual x (1+e), so the attributable part is e/(1+e).
    """
    table = F.create_map(*[x for b, (e, lo, hi) in effects.items() for x in (
        F.lit(b), F.array(*[F.lit(v / 100 / (1 + v / 100)) for v in (e, lo, hi)]))])
    rows = (shares.join(daily_dollars.select("date", "value_daily"), "date")
            .join(games.select("date").distinct(), "date", "left_semi").join(F.broadcast(evening)))
    dollars = F.col("value_daily") * F.col("share") * F.col("evening_share")
    part = lambda i: F.avg(dollars * F.element_at(table, F.col("band"))[i])
    return rows.groupBy("band").agg(F.countDistinct("date").alias("games"), F.avg(dollars).alias("evening_dollars"),
                                    part(0).alias("incremental"), part(1).alias("lo"), part(2).alias("hi"))


def event_dollar_totals(per_band: DataFrame, games: DataFrame) -> DataFrame:
    """One row: per event, window and season totals."""
    seasons = games.agg(F.countDistinct(F.year("date")).alias("n_seasons"))
    total = per_band.agg(F.sum("incremental").alias("per_event"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"),
                         F.max("games").alias("n_games")).join(F.broadcast(seasons))
    window = F.col("per_event") * F.col("n_games")
    return total.withColumn("window_total", window).withColumn("per_season", window / F.col("n_seasons"))
