"""Ring, unit and station panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, flags, geo
from ..functions.stats import count_if, sum_if
from .joins import fold_left
from .reshape import to_long, union_all

# Fixed value: hours of the evening window.
EVENING = (16, 23)


def dense_hours(fact: DataFrame, units: DataFrame, keys: Sequence[str], first: str, last: str,
                sums: Mapping[str, Column], hours: tuple[int, int] = (0, 23)) -> DataFrame:
    """Keys x date x hour panel, zero-filled.

    The spine is exploded from the unit table and appended as zero rows, so one
    aggregation both sums the fact and fills its holes: no join of a dense spine
    and a single shuffle, to which the fact contributes map-side sums. The fact
    holds only keys of ``units``.
    """
    keys = list(keys)
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    spine = units.select(*keys).withColumn("date", F.explode(days)).withColumn(
        "hour", F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[1]))))
    known = fact.filter(dates.between_dates(F.col("date"), first, last) & F.col("hour").between(*hours))
    measured = known.select(*keys, "date", F.col("hour").cast("int").alias("hour"),
                            *[c.cast("long").alias(n) for n, c in sums.items()])
    zeros = spine.select(*keys, "date", "hour", *[F.lit(0).cast("long").alias(n) for n in sums])
    return union_all([measured, zeros]).groupBy(*keys, "date", "hour").agg(
        *[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in sums])


def visits_ring_day(daily: DataFrame, rings: DataFrame, total_weeks: DataFrame, venue_name: str,
                    food_prefix: str = "722") -> DataFrame:
    """Ring x day visits: all, without the venue, food only, balanced, place count."""
    rows = daily.join(rings.select("poi_id", "ring_id", "poi_name", "category", "weeks_present"), "poi_id").join(
        F.broadcast(total_weeks.select(F.col("total_weeks").alias("_w"))))
    v = F.col("visits")
    return rows.groupBy("ring_id", "date").agg(
        F.sum(v).alias("visits"),
        sum_if(flags.differs(F.col("poi_name"), F.lit(venue_name)), v).alias("visits_ex_venue"),
        sum_if(F.col("category").startswith(food_prefix), v).alias("visits_food"),
        sum_if(F.col("weeks_present") == F.col("_w"), v).alias("visits_balanced"),
        F.countDistinct("poi_id").alias("poi_count"))


def occupancy_ring_hour(hourly: DataFrame, coverage: DataFrame, rings: DataFrame, balanced: DataFrame,
                        first: str, last: str, venue_name: str, food_prefix: str = "722") -> DataFrame:
    """Dense ring x date x hour occupancy with weekly coverage of the ring's places."""
    attrs = rings.select("poi_id", "ring_id", "poi_name", "category")
    rows = hourly.join(attrs, "poi_id").join(
        balanced.select("poi_id", F.lit(True).alias("_bal")), "poi_id", "left")
    v = F.col("visitor_hours")
    measures = {
        "visitor_hours": v,
        "visitor_hours_ex_venue": F.when(flags.differs(F.col("poi_name"), F.lit(venue_name)), v),
        "visitor_hours_food": F.when(F.col("category").startswith(food_prefix), v),
        "visitor_hours_balanced": F.when(F.col("_bal"), v),
    }
    dense = dense_hours(rows, rings.select("ring_id").distinct(), ["ring_id"], first, last, measures)
    # Coverage is a place-week property: fold to ring x week, then spread over 7 days.
    weekly = coverage.join(attrs.select("poi_id", "ring_id"), "poi_id").groupBy("ring_id", "week_start").agg(
        count_if(F.col("has_hourly")).alias("poi_covered"), F.count("*").alias("poi_total"),
        sum_if(F.col("has_hourly"), F.col("visit_counts")).alias("_cov"), F.sum("visit_counts").alias("_all"))
    daily = weekly.withColumn("date", F.explode(F.sequence("week_start", F.date_add("week_start", 6)))).select(
        "ring_id", "date", "poi_covered", "poi_total",
        F.try_divide(F.col("_cov").cast("double"), F.nullif(F.col("_all"), F.lit(0))).alias("visit_share_covered"))
    out = dense.join(daily, ["ring_id", "date"], "left")
    return out.withColumn("poi_covered", F.coalesce("poi_covered", F.lit(0))).withColumn(
        "poi_total", F.coalesce("poi_total", F.lit(0)))


def trips_ring_day(trips: DataFrame, venue: Sequence[float] = geo.VENUE,
                   edges: Sequence[float] = geo.RING_EDGES_M) -> DataFrame:
    """Trip starts and ends per ring x date, each by its own place and date.

    One scan: a trip becomes a start row and an end row, then one aggregation.
    """
    legs = F.explode(F.array(
        F.struct(F.lit("s").alias("leg"), F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng"),
                 F.to_date("started_at").alias("date")),
        F.struct(F.lit("e").alias("leg"), F.col("end_lat").alias("lat"), F.col("end_lng").alias("lng"),
                 F.to_date("ended_at").alias("date"))))
    flat = trips.select(legs.alias("x")).select("x.*").filter(F.col("lat").isNotNull() & F.col("date").isNotNull())
    ringed = flat.withColumn("ring_id", geo.ring_id(geo.haversine("lat", "lng", *venue), edges)).filter(
        F.col("ring_id").isNotNull())
    n = lambda leg: F.nullif(count_if(F.col("leg") == leg), F.lit(0).cast("long"))
    return ringed.groupBy("ring_id", "date").agg(n("s").alias("bike_starts"), n("e").alias("bike_ends"))


def panel_ring_day(calendar: DataFrame, ring_tables: Sequence[DataFrame], date_tables: Sequence[DataFrame],
                   n_rings: int = 5) -> DataFrame:
    """Calendar x rings spine with ring tables and date tables left-joined."""
    spine = calendar.withColumn("ring_id", F.explode(F.sequence(F.lit(1), F.lit(n_rings))))
    return fold_left(fold_left(spine, ring_tables, ["ring_id", "date"]), date_tables, ["date"])


def cell_hour(hourly: DataFrame, poi_cell: DataFrame, first: str, last: str,
              hours: tuple[int, int] = (0, 23)) -> DataFrame:
    """Dense unit x date x hour person-hours and number of reporting places.

    ``hourly`` holds one row per place, date and hour.
    """
    rows = hourly.join(poi_cell, "poi_id")
    units = poi_cell.select("unit_id").distinct()
    return dense_hours(rows, units, ["unit_id"], first, last,
                       {"person_hours": F.col("visitor_hours"), "n_poi_reporting": F.lit(1)}, hours)


def week_coverage(hourly: DataFrame, poi_cell: DataFrame) -> DataFrame:
    """Live places per unit and week, dated one week later so it cannot leak."""
    week = F.date_add(dates.week_start(F.col("date")), 7)
    live = hourly.filter(F.col("visitor_hours") > 0).select("poi_id", week.alias("week_start")).distinct()
    return live.join(poi_cell, "poi_id").groupBy("unit_id", "week_start").agg(F.count("*").alias("n_poi_live"))


def cell_day(daily: DataFrame, hourly: DataFrame, poi_cell: DataFrame) -> DataFrame:
    """Unit x date visits with person-hours beside them and both place counts."""
    d = daily.groupBy("poi_id", "date").agg(F.sum("visits").alias("visits")).withColumn("_d", F.lit(1))
    h = hourly.groupBy("poi_id", "date").agg(F.sum("visitor_hours").alias("person_hours")).withColumn("_h", F.lit(1))
    both = union_all([d, h], missing=True).join(poi_cell, "poi_id")
    zero = F.lit(0).cast("long")
    out = both.groupBy("unit_id", "date").agg(
        F.sum("visits").alias("visits"), F.count("_d").alias("n_poi_visits"),
        F.coalesce(F.sum("person_hours"), zero).alias("person_hours"), F.count("_h").alias("n_poi_hourly"))
    return out.filter(F.col("n_poi_visits") > 0)


def model_hour(cells: DataFrame, cell_dim: DataFrame, spine: DataFrame, epoch: str = "2023-01-02") -> DataFrame:
    """Unit panel with unit statics and hourly covariates, both control flags, trend."""
    return (cells.join(cell_dim, "unit_id").join(spine, ["date", "hour"])
            .withColumn("clean_control", flags.clean_control())
            .withColumn("clean_control_strict", flags.clean_control(strict=True))
            .withColumn("t_index", dates.trend_index(F.col("date"), epoch)))


def control_pool_summary(calendar: DataFrame) -> DataFrame:
    """Day counts of the pools. The strict count here ignores venue events, unlike
    the strict flag; both are kept visible."""
    nearby = F.col("rival_day") | F.col("convention_day") | F.col("citywide_day") | F.col("fair_day")
    return calendar.agg(F.countDistinct("date").alias("all_days"),
                        F.countDistinct(F.when(F.col("game_day"), F.col("date"))).alias("treated_days"),
                        F.countDistinct(F.when(F.col("clean_control"), F.col("date"))).alias("shipped_control"),
                        F.countDistinct(F.when(~F.col("game_day") & ~nearby, F.col("date"))).alias("strict_no_venue"),
                        F.countDistinct(F.when(F.col("clean_control_strict"), F.col("date"))).alias("strict_control"))


def model_frame(panel: DataFrame, coverage: DataFrame, baseline: DataFrame, codes: DataFrame,
                control: str) -> DataFrame:
    """Panel with live coverage, baselines, unit code, log target and the chosen control."""
    keyed = panel.withColumn("week_start", dates.week_start(F.col("date")))
    out = keyed.join(coverage, ["unit_id", "week_start"], "left").join(
        baseline, ["unit_id", "date", "hour"], "left").join(codes, "unit_id")
    return (out.withColumn("n_poi_live", F.coalesce("n_poi_live", F.lit(0)))
            .withColumn("y", F.log1p("person_hours")).withColumn("is_control", F.col(control)))


def graph_contract(rings: DataFrame, occupancy: DataFrame, coverage: DataFrame, effects: DataFrame,
                   max_ring: int = 4) -> dict[str, DataFrame]:
    """Node, sparse target, node-week coverage and label tables up to a ring."""
    nodes = rings.filter(F.col("ring_id") <= max_ring)
    ids = nodes.select("poi_id")
    return {"nodes": nodes.select("poi_id", "ring_id", "lat", "lon", "category", "dist_m"),
            "target": occupancy.join(ids, "poi_id", "left_semi"),
            "coverage": coverage.join(ids, "poi_id", "left_semi").select("poi_id", "week_start", "has_hourly"),
            "labels": effects.filter((F.col("ring_id") <= max_ring) & F.col("lift").isNotNull())}


def daily_arrivals(od: DataFrame, stations: Sequence[str]) -> DataFrame:
    """Daily arrivals at a set of stations."""
    return od.filter(F.col("destination").isin(*stations)).groupBy("date").agg(
        F.sum("trip_count").alias("arrivals"))


def event_day_panel(signals: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Long (date, geography, signal, value, unit) rows; absent stays absent.

    Each entry: name -> (table with date, geography and the column, column, unit).
    """
    parts = []
    for name, (table, column, unit) in signals.items():
        long = to_long(table, ["date", "geography"], [column]).filter(F.col("value").isNotNull())
        parts.append(long.select("date", "geography", F.lit(name).alias("signal"), "value", F.lit(unit).alias("unit")))
    return union_all(parts)
