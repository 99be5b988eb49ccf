"""Daily and hourly weather, climatology for dates not observed yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.stats import sum_if
from .joins import prefer

HOURLY_REPORT = "FM-15"


def weather_day(obs: DataFrame, primary: str, fallback: str, columns: Sequence[str]) -> DataFrame:
    """Per date and column the primary station's mean, else the fallback's."""
    def mean_at(station: str, c: str):
        return F.avg(F.when(F.col("station") == station, F.col(c)))

    return obs.groupBy("date").agg(*[F.coalesce(mean_at(primary, c), mean_at(fallback, c)).alias(c) for c in columns])


def weather_hour(obs: DataFrame, zone: str, utc_offset: int = -8, report: str = HOURLY_REPORT, window: tuple[str, str] | None = None) -> DataFrame:
    """Routine reports of all-text sensor rows to wall-clock hours in US units; ``window`` keeps the local dates from first to last."""
    rows = obs.filter(F.trim("report_type") == report)
    local = dates.standard_to_wall_clock(F.col("ts_text").try_cast("timestamp_ntz"), utc_offset, zone)
    parsed = rows.select(
        local.alias("local_ts"), text.sensor_number(F.col("temp_text"), text.SIGNED_NUMBER, trace=None).alias("temp"),
        text.sensor_number(F.col("prcp_text")).alias("prcp"),
        text.sensor_number(F.col("wind_text"), trace=None).alias("wind"))
    if window:
        parsed = parsed.filter(F.to_date("local_ts").between(*[F.lit(day).cast("date") for day in window]))
    return parsed.groupBy(F.to_date("local_ts").alias("date"), F.hour("local_ts").alias("hour")).agg(
        text.celsius_to_f(F.avg("temp")).alias("temp_hr"), text.mm_to_inches(F.max("prcp")).alias("prcp_hr"),
        text.mps_to_mph(F.avg("wind")).alias("wind_hr"))


def climatology(obs: DataFrame, grid: DataFrame, years: Sequence[int], columns: Sequence[str], days: int = 7) -> DataFrame:
    """Mean of the same hour within ±days of the day of year over listed years.

    Observations shrink to sums per (day of year, hour) first, each of which is
    then spread to its 2*days+1 neighbours; day numbers do not wrap at New Year.
    """
    base = obs.filter(F.year("date").isin(*years)).groupBy(F.dayofyear("date").alias("_doy"), "hour").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])
    spread = base.withColumn("_doy", F.explode(F.sequence(F.col("_doy") - days, F.col("_doy") + days)))
    normal = spread.groupBy("_doy", "hour").agg(
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c) for c in columns])
    wanted = grid.withColumn("_doy", F.dayofyear("date"))
    return wanted.join(normal, ["_doy", "hour"]).select("date", "hour", *columns)


def extend_weather(obs: DataFrame, grid: DataFrame, years: Sequence[int], columns: Sequence[str],
                   days: int = 7) -> DataFrame:
    """Observed hours, else climatology; the tag is decided by the first column."""
    normal = climatology(obs, grid, years, columns, days)
    return prefer(grid, obs, normal, ["date", "hour"], columns, columns[0], ("observed", "climatology"))


def transit_day(exits: DataFrame, od: DataFrame, stations: Sequence[str], hours: tuple[int, int] = (16, 18),
                core: Sequence[str] = ()) -> DataFrame:
    """Station exits full-joined with OD arrivals: two core stations, window, all listed."""
    at = F.col("destination")
    in_window = F.col("hour").between(*hours)
    arrivals = od.groupBy("date").agg(
        sum_if(at.isin(*core), F.col("trip_count")).alias("core_arrivals"),
        sum_if(at.isin(*core) & in_window, F.col("trip_count")).alias("core_window_arrivals"),
        sum_if(at.isin(*stations), F.col("trip_count")).alias("area_arrivals"))
    return exits.join(arrivals, ["date"], "full")
