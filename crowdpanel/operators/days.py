"""Event calendars: one row per date with treatment and confounder columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, dates, flags
from ..functions.stats import count_if
from .aggregates import distinct_listing
from .joins import fold_left
from .reshape import union_all

# Event-hour window around a start, and the default without one.
EVENT_PRE_HOURS = 2
EVENT_POST_HOURS = 3
EVENT_DEFAULT_HOURS = (19, 23)
CONVENTION_VENUE = "%moscone%"


def date_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per date of the window."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(span).alias("date"))


def span_of(df: DataFrame, column: str = "date") -> DataFrame:
    """Every date between the first and the last date of a table."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("date"))


def games_by_date(games: DataFrame) -> DataFrame:
    """Treatment games folded per date: a doubleheader is one treated day."""
    played = games.filter(flags.is_treatment_game(F.col("game_type")))
    listing = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return played.groupBy("date").agg(
        F.count("*").alias("n_games"), F.sum("attendance").alias("attendance"),
        F.when(F.max((F.col("day_night") == "night").cast("int")) == 1, "night").otherwise("day").alias("day_night"),
        F.min("first_hour").alias("first_hour"),
        listing("game_type").alias("game_types"), listing("opponent").alias("opponents"))


def event_details(events: DataFrame, name: str, column: str) -> DataFrame:
    """(date, column): sorted distinct event texts per date."""
    return distinct_listing(events, ["date"], F.col(name), column)


def explode_spans(events: DataFrame, start: str, end: str) -> DataFrame:
    """Multi-day events to one row per date; no end means one day."""
    return events.withColumn("date", F.explode(arrays.date_span(F.col(start), F.col(end))))


def split_conventions(spans: DataFrame, pattern: str = CONVENTION_VENUE) -> tuple[DataFrame, DataFrame]:
    """(convention, citywide) details by venue text."""
    by_day = explode_spans(spans, "start_date", "end_date")
    here = F.col("venue").ilike(pattern)
    return (event_details(by_day.filter(here), "event", "convention_event"),
            event_details(by_day.filter(~here), "event", "citywide_event"))


def calendar_day(spine: DataFrame, games: DataFrame, details: Sequence[DataFrame]) -> DataFrame:
    """Window dates with folded games, detail columns, flags and the control rules.

    ``details`` are (date, *_event) tables named venue_event, rival_event,
    convention_event, citywide_event and fair_event.
    """
    cal = fold_left(spine, [games_by_date(games), *details], ["date"])
    cal = (cal.withColumn("game_day", F.col("n_games").isNotNull())
           .withColumn("n_games", F.coalesce("n_games", F.lit(0)))
           .withColumn("dow", dates.iso_weekday(F.col("date")))
           .withColumn("holiday", dates.is_federal_holiday(F.col("date"))))
    for tier in ("venue", "rival", "convention", "citywide", "fair"):
        cal = cal.withColumn(f"{tier}_day", F.col(f"{tier}_event").isNotNull())
    return (cal.withColumn("clean_control", flags.clean_control())
            .withColumn("clean_control_strict", flags.clean_control(strict=True)))


def confounded_calendar(spine: DataFrame, games: DataFrame, details: Sequence[DataFrame],
                        columns: Sequence[str], status: Sequence[str] = ("Final",)) -> DataFrame:
    """Second calendar form: played games only, one confounder flag over all tiers."""
    final = games.filter(F.col("status").isin(*status) & flags.is_treatment_game(F.col("game_type")))
    treated = final.select("date", F.lit(True).alias("game_day")).distinct()
    cal = fold_left(spine, [treated, *details], ["date"]).withColumn(
        "game_day", F.coalesce("game_day", F.lit(False)))
    cal = cal.withColumn("any_confounder", flags.any_confounder(columns))
    return (cal.withColumn("clean_control", ~F.col("game_day") & ~F.col("any_confounder"))
            .withColumn("confounded_treatment", F.col("game_day") & F.col("any_confounder")))


def reclassified_by_tier(calendar: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: non-game dates with a confounder, in total and per tier."""
    off = ~F.col("game_day")
    return calendar.agg(count_if(off).alias("n_off"), count_if(off & F.col("any_confounder")).alias("n_reclassified"),
                        *[count_if(off & F.col(c).isNotNull()).alias(f"n_{c}") for c in columns])


def event_hours(events: DataFrame, pre: int = EVENT_PRE_HOURS, post: int = EVENT_POST_HOURS,
                default: tuple[int, int] = EVENT_DEFAULT_HOURS) -> DataFrame:
    """Sparse (date, hour) rows inside the window of any event, details listed."""
    known = F.col("start_hour").isNotNull()
    lo = F.when(known, F.col("start_hour") - pre).otherwise(default[0])
    hi = F.when(known, F.col("start_hour") + post).otherwise(default[1])
    hours = events.withColumn("hour", F.explode(arrays.hour_span(lo, hi)))
    text = F.concat("kind", F.lit(": "), "detail")
    return distinct_listing(hours, ["date", "hour"], text, "detail").withColumn("event_hour", F.lit(True))


def event_schedule(games: DataFrame, status: Sequence[str] = ("Final", "Scheduled")) -> DataFrame:
    """One row per date: earliest start wins, attendance is the maximum, DH marked."""
    rows = games.filter(F.col("status").isin(*status) & flags.is_treatment_game(F.col("game_type")))
    order = F.struct(F.coalesce("first_hour", F.lit(99)), F.col("opponent"))
    folded = rows.groupBy("date").agg(
        F.min_by(F.struct("day_night", "first_hour", "opponent"), order).alias("g"),
        F.max("attendance").alias("attendance"), F.count("*").alias("n"))
    return folded.select("date", "g.day_night", "g.first_hour", "g.opponent",
                         F.when(F.col("attendance") > 0, F.col("attendance")).alias("attendance"),
                         F.when(F.col("n") > 1, "DH").otherwise("R").alias("kind"))


def attendance_prior(games: DataFrame, ref_year: int) -> DataFrame:
    """Attendance for games without one: the reference season's day/night median.

    The medians run over one season's games, a calendar-sized group.
    """
    ok = F.col("attendance").isNotNull() & (F.col("attendance") > 0)
    played = games.filter(flags.is_treatment_game(F.col("game_type")) & ok)
    ref = played.filter(F.year("date") == ref_year)
    by_kind = ref.groupBy("day_night").agg(F.median("attendance").alias("_kind"))
    overall = ref.agg(F.median("attendance").alias("_all"))
    todo = games.filter(flags.is_treatment_game(F.col("game_type")) & ~F.coalesce(ok, F.lit(False)))
    return (todo.join(by_kind, "day_night", "left").join(F.broadcast(overall))
            .withColumn("attendance_prior", F.coalesce("_kind", "_all")).drop("_kind", "_all"))


def yearly_repeat(events: DataFrame, days: int = 364) -> DataFrame:
    """Annual events carried forward by whole weeks, so the weekday is kept."""
    return events.select(F.date_add("date", days).alias("date")).distinct()


def time_spine(calendar: DataFrame, weather: DataFrame, event_hour: DataFrame,
               splits: Mapping[str, Sequence[str]] = dates.SPLITS) -> DataFrame:
    """Date x hour covariates with split, relative hour, event flags and weather."""
    grid = calendar.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    joined = fold_left(grid, [weather, event_hour.select("date", "hour", "event_hour")], ["date", "hour"])
    rel = F.when((F.col("n_games") == 1), F.col("hour") - F.col("first_hour"))
    return (joined.withColumn("event_hour", F.coalesce("event_hour", F.lit(False)))
            .withColumn("month", F.month("date")).withColumn("relative_hour", rel)
            .withColumn("split", dates.split_label(F.col("date"), splits)))


def extend_spine(history: DataFrame, extension: DataFrame, observed_to: DataFrame, epoch: str) -> DataFrame:
    """Historic rows as they are plus extension rows with NULL split.

    ``observed_to`` is one row (last_date): the last date the fact table holds.
    """
    both = union_all([history, extension.withColumn("split", F.lit(None).cast("string"))], missing=True)
    return (both.join(F.broadcast(observed_to)).withColumn("observed", F.col("date") <= F.col("last_date"))
            .drop("last_date").withColumn("clean_control_strict", flags.clean_control(strict=True))
            .withColumn("t_index", dates.trend_index(F.col("date"), epoch)))
