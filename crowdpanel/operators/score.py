"""Batch scoring of (date, place) requests and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stats import count_if
from .effects import band_totals, compose, effect_log
from .panel import EVENING

# Snap radius, served area and known request fields.
SNAP_M = 400.0
PLACE_LAT = (37.6, 37.9)
PLACE_LON = (-122.6, -122.3)
REQUEST_FIELDS = ("schema", "date", "lat", "lon", "hours", "include_cells", "attendance", "day_night", "bands_m",
                  "focus_cell_id")

BODY_SCHEMA = "date string, lat string, lon string, hours string, attendance string, day_night string"


def validate_requests(raw: DataFrame, first: str, last: str, text: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): JSON text rows checked field by field; first reason wins."""
    # Parsed behind a generator: filters on the fields cannot be pushed below it,
    # which would repeat the parsing for every mention of a field.
    once = raw.select("*", F.explode(F.array(F.struct(F.json_object_keys(text).alias("keys"), F.from_json(text, BODY_SCHEMA).alias("b")))).alias("_p"))
    parsed = once.select(
        *raw.columns, F.col("_p.keys").alias("_keys"), F.col("_p.b").alias("_b"),
        F.when(F.col("_p.b.date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("_p.b.date")).try_cast("date").alias("date"),
        F.col("_p.b.lat").try_cast("double").alias("lat"), F.col("_p.b.lon").try_cast("double").alias("lon"))
    field = lambda k: F.col(f"_b.{k}")
    keys, date, lat, lon = F.col("_keys"), F.col("date"), F.col("lat"), F.col("lon")
    unknown = F.size(F.filter(keys, lambda k: ~k.isin(*REQUEST_FIELDS))) > 0
    evening = F.regexp_replace(field("hours"), " ", "") == f"[{EVENING[0]},{EVENING[1]}]"
    reason = (F.when(keys.isNull(), "body is not a JSON object")
              .when(unknown, "unknown fields")
              .when(field("date").isNull() | (field("date") == ""), "date is required")
              .when(field("lat").isNull(), "lat is required").when(lat.isNull(), "lat must be a number")
              .when(field("lon").isNull(), "lon is required").when(lon.isNull(), "lon must be a number")
              .when(date.isNull(), "date must be YYYY-MM-DD")
              .when(~date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), "date outside the served window")
              .when(~lat.between(*PLACE_LAT) | ~lon.between(*PLACE_LON), "place outside the served area")
              .when(field("hours").isNotNull() & ~evening, "hours must be the evening window"))
    checked = parsed.select(*raw.columns, "date", "lat", "lon", field("attendance").try_cast("double").alias("attendance"),
                            field("day_night").alias("day_night"), reason.alias("reason"))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull()).select(
        *raw.columns, "reason")


def resolve_focus(points: DataFrame, units: DataFrame, step: Sequence[float] = geo.GRID_STEP,
                  snap_m: float = SNAP_M) -> DataFrame:
    """Distinct (lat, lon) with their unit: own cell, else nearest centroid within the snap.

    Candidates come from the cells the snap circle can touch, by an equi-join.
    """
    spots = points.select("lat", "lon").distinct().withColumn(
        "gi", geo.grid_index(F.col("lat"), step[0])).withColumn("gj", geo.grid_index(F.col("lon"), step[1]))
    ri = int(snap_m / (step[0] * geo.METRES_PER_DEGREE)) + 1
    rj = int(snap_m / (step[1] * geo.METRES_PER_DEGREE * 0.5)) + 1  # safe below 60 degrees
    di, dj = F.sequence(F.lit(-ri), F.lit(ri)), F.sequence(F.lit(-rj), F.lit(rj))
    cells = F.flatten(F.transform(di, lambda a: F.transform(dj, lambda b: F.struct(
        (F.col("gi") + a).alias("gi"), (F.col("gj") + b).alias("gj")))))
    asked = spots.withColumn("c", F.explode(cells))
    there = units.select(F.struct("gi", "gj").alias("c"), "unit_id", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    exact = (F.col("c.gi") == F.col("gi")) & (F.col("c.gj") == F.col("gj"))
    d = geo.flat_distance(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))
    hits = asked.join(there, "c").withColumn("exact", exact).withColumn("d", d).filter(F.col("exact") | (F.col("d") <= snap_m))
    best = hits.groupBy("lat", "lon").agg(F.min_by(F.struct("unit_id", "exact"), F.struct(
        (~F.col("exact")).cast("int"), "d", "unit_id")).alias("f"))
    return best.select("lat", "lon", F.col("f.unit_id").alias("unit_id"), (~F.col("f.exact")).alias("snapped"))


def served_units(cf: DataFrame, days: DataFrame, effects: dict[str, DataFrame],
                 uppers: Sequence[float] = geo.CANONICAL_BANDS_M) -> DataFrame:
    """Evening sums per date and unit: counterfactual, event and extra levels.

    ``cf``: (date, hour, unit_id, dist_m, cf_log); ``days``: (date, game_day,
    attendance, day_night). Missing attendance means the response centre; dates
    without an event get no effect.
    """
    center = effects["center"]
    dated = days.join(F.broadcast(center.select(F.col("center").alias("_c"))))
    games = dated.filter("game_day").select("date", F.coalesce("attendance", "_c").alias("attendance"),
                                            (F.col("day_night") == "night").cast("double").alias("is_night"))
    totals = band_totals(games, effects["bands"], effects["response"], center)
    rows = cf.filter(F.col("hour").between(*EVENING)).withColumn("band", geo.band_below(F.col("dist_m"), uppers))
    composed = compose(effect_log(rows, totals, effects["decay"]))
    return composed.groupBy("date", "unit_id").agg(
        F.max("band").alias("band"), F.max("dist_m").alias("dist_m"), F.sum("cf_level").alias("cf"),
        F.sum("game_level").alias("game"), F.sum("extra_level").alias("extra"))


def lift_of(game: Column, cf: Column) -> Column:
    """game / cf - 1; 0 when there is no counterfactual level."""
    return F.when(cf > 0, game / cf - 1).otherwise(0.0)


def band_response(served: DataFrame) -> DataFrame:
    """Per date and band: levels, lift and units."""
    by = served.groupBy("date", "band").agg(F.sum("cf").alias("cf"), F.sum("game").alias("game"), F.sum("extra").alias("extra"),
                                            F.count("*").alias("n_units"))
    return by.withColumn("lift_pct", F.round(100 * lift_of(F.col("game"), F.col("cf")), 3))


def score_requests(requests: DataFrame, served: DataFrame, units: DataFrame, step: Sequence[float] = geo.GRID_STEP,
                   within: Sequence[str] = ("b1", "b2", "b3", "b4"), hero: Sequence[str] = ("b1", "b2")) -> DataFrame:
    """One answer per request: focus unit levels, total within 2.5 km and hero lift.

    All sums are made once per date; a request only looks up its date and unit. A
    request whose date the table does not serve stays, with levels 0, without
    ``extra_within`` and with the reason.
    """
    bands = band_response(served)
    inner, top = F.col("band").isin(*within), F.col("band").isin(*hero)
    headline = bands.groupBy("date").agg(
        F.round(F.sum(F.when(inner, F.col("extra")).otherwise(0.0)), 2).alias("extra_within"),
        F.round(100 * F.try_divide(F.sum(F.when(top, F.col("extra"))), F.nullif(F.sum(F.when(top, F.col("cf"))), F.lit(0.0))), 3)
        .alias("hero_lift_pct"))
    focus = resolve_focus(requests, units, step)
    unit = served.select("date", "unit_id", F.round("cf", 2).alias("cf"), F.round("extra", 2).alias("extra"),
                         F.round(100 * lift_of(F.col("game"), F.col("cf")), 3).alias("lift_pct"))
    answered = requests.join(focus, ["lat", "lon"], "left").join(headline.withColumn("_served", F.lit(True)), "date", "left").join(
        unit, ["date", "unit_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return answered.select(*[F.col(c) for c in requests.columns], "unit_id", F.coalesce("snapped", F.lit(False)).alias("snapped"),
                           F.col("unit_id").isNull().alias("outside"), zero("cf"), zero("extra"), zero("lift_pct"),
                           "extra_within", zero("hero_lift_pct"), F.when(F.col("_served").isNull(), "date not served").alias("reason"))


def next_events(requests: DataFrame, schedule: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The next n event dates after each distinct requested date.

    Both sides are calendars. Events carry their position, a request the position
    of the last event not after it, so the following n are an equi-join.
    """
    dates = schedule.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    asked = requests.select(F.col(date).alias("asked")).distinct()
    both = asked.select("asked", F.col("asked").alias("date"), F.lit(None).cast("int").alias("pos")).unionByName(
        dates.select(F.lit(None).cast("date").alias("asked"), "date", "pos"))
    upto = Window.orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("done", F.coalesce(F.max("pos").over(upto), F.lit(0))).filter(F.col("asked").isNotNull())
    wanted = seen.select("asked", "done", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank")).withColumn(
        "pos", F.col("done") + F.col("rank"))
    return wanted.join(dates, "pos").select("asked", F.col("date").alias("event_date"), "rank")


def check_response(served: DataFrame, bands: DataFrame) -> DataFrame:
    """One row: band totals that differ from the sum of their units."""
    sums = served.groupBy("date", "band").agg(F.sum("extra").alias("s"))
    both = bands.join(sums, ["date", "band"], "full")
    off = F.abs(F.coalesce("extra", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))) > 1e-6 * (1 + F.abs(F.coalesce("s", F.lit(0.0))))
    return both.agg(F.count("*").alias("n_bands"), count_if(off).alias("n_off"))
