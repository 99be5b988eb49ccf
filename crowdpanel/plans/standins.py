"""Domain roles played by the shared test tables, in Spark and in SQL.

Places are customers, hourly activity is events (January 2024) or orders by
region and nation (1995-2001), stations and hourly weather come from lineitem.
Each stand-in reads its whole tables. ``CTES`` states the same tables in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..operators import days as cal
from ..operators import model, panel, spatial, unpack
from ..session import durable_table

# The wider grid gives test-sized data cells with ten places.
STEP = (0.0225, 0.0284)
BOX = (37.60, 37.90, -122.60, -122.30)
JAN = ("2024-01-01", "2024-01-31")
# Wider rings, so that the few test places fill all of them.
EDGES = (0, 1000, 2500, 5000, 8000, 16000)
YEARS = ("1995-01-01", "2001-08-01")
SPLITS = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
EPOCH = "1995-01-01"
TIERS = ("venue_event", "rival_event", "convention_event", "citywide_event", "fair_event")
CONTROL = "is_control"


class Tables:
    """The shared tables of one folder and the stand-ins built on them.

    Stand-ins that a pipeline would land as tables (weekly patterns, games,
    calendar, hourly panel, residuals) are written once per session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- places and January activity ------------------------------------------

    @cached_property
    def poi(self) -> DataFrame:
        c = self.table("customer")
        code = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "722511").when(F.col("c_mktsegment") == "FURNITURE", "442110")
                .when(F.col("c_mktsegment") == "MACHINERY", "721110").when(F.col("c_mktsegment") == "BUILDING", "452319")
                .otherwise("999999"))
        return c.select(
            F.col("c_custkey").alias("poi_id"), F.col("c_name").alias("poi_name"), code.alias("category"),
            (F.lit(37.70) + (F.col("c_custkey") * 7919 % 1400) / F.lit(10000.0)).alias("lat"),
            (F.lit(-122.52) + (F.col("c_custkey") * 104729 % 1700) / F.lit(10000.0)).alias("lon"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit(" King Street")).alias("address"),
            (F.col("c_acctbal") >= 0).alias("has_hourly"))

    @cached_property
    def hour_fact(self) -> DataFrame:
        """(poi_id, date, hour, visitor_hours): one row per place, date and hour."""
        return self.table("events").groupBy(F.col("user_id").alias("poi_id"), F.to_date("ts").alias("date"),
                                            F.hour("ts").alias("hour")).agg(F.count("*").alias("visitor_hours"))

    @cached_property
    def day_fact(self) -> DataFrame:
        return self.table("events").groupBy(F.col("user_id").alias("poi_id"), F.to_date("ts").alias("date")).agg(
            F.count("*").alias("visits"))

    @cached_property
    def patterns(self) -> DataFrame:
        """Weekly rows with packed day and hour arrays; places in debt lack the hourly one."""
        hours = unpack.pack_weeks(self.hour_fact, 168).withColumnRenamed("packed", "all_hours")
        week = self.day_fact.groupBy("poi_id", dates.week_start(F.col("date")).alias("week_start")).agg(
            F.sum("visits").alias("visit_counts"))
        daily = unpack.pack_weeks(self.day_fact.withColumn("hour", F.lit(0)), 7, "visits").withColumnRenamed("packed", "packed_days")
        rows = hours.join(daily, ["poi_id", "week_start"]).join(week, ["poi_id", "week_start"]).join(self.poi, "poi_id")
        return durable_table(rows.withColumn("packed_hours", F.when(F.col("has_hourly"), F.col("all_hours"))))

    @cached_property
    def ringed(self) -> DataFrame:
        return durable_table(spatial.poi_rings(self.patterns, *JAN, edges=EDGES))

    @cached_property
    def assigned(self) -> DataFrame:
        return spatial.assign_cells(self.poi, STEP, BOX)

    @cached_property
    def units(self) -> DataFrame:
        return spatial.grid_units(self.assigned, 10)

    @cached_property
    def poi_cell(self) -> DataFrame:
        return spatial.poi_cell(self.assigned, self.units)

    # -- orders: regions as rings, nations as units -----------------------------

    @cached_property
    def sales(self) -> DataFrame:
        """Orders with their nation, ring, date, hour and cents."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        return (o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
                .join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("n_nationkey").cast("long").alias("unit_id"), (F.col("n_regionkey") + 1).alias("ring_id"),
                        F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 24).cast("int").alias("hour"),
                        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")))

    @cached_property
    def ring_day(self) -> DataFrame:
        return self.sales.groupBy("ring_id", "date").agg(F.count("*").alias("visits"), F.sum("cents").alias("cents"))

    @cached_property
    def rings(self) -> DataFrame:
        return self.table("region").select((F.col("r_regionkey") + 1).alias("ring_id"))

    @cached_property
    def nations(self) -> DataFrame:
        """Unit dimension: nations on a line south of the venue."""
        lat = F.lit(geo.VENUE[0]) - F.col("n_nationkey") * F.lit(0.002)
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("unit_id"), lat.alias("lat"),
                                        F.lit(geo.VENUE[1]).alias("lon"))
        return n.withColumn("dist_m", geo.flat_distance("lat", "lon", *geo.VENUE))

    @property
    def ring_hour_plan(self) -> DataFrame:
        """Dense ring x date x hour panel of orders."""
        return panel.dense_hours(self.sales, self.rings, ["ring_id"], *YEARS,
                                 {"visitor_hours": F.lit(1), "cents": F.col("cents")})

    @cached_property
    def ring_hour(self) -> DataFrame:
        return durable_table(self.ring_hour_plan)

    # -- calendar -----------------------------------------------------------------

    @cached_property
    def day_counts(self) -> DataFrame:
        return durable_table(self.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n")))

    @cached_property
    def games(self) -> DataFrame:
        """Events on every fifth day of the year, two of them on every 45th."""
        o = self.table("orders").withColumn("date", F.to_date("o_orderdate")).withColumn("doy", F.dayofyear("o_orderdate"))
        second = (F.col("doy") % 45 == 0) & (F.col("o_custkey") % 2 == 1)
        g = o.filter(F.col("doy") % 5 == 0).groupBy("date", "doy", F.when(second, 2).otherwise(1).alias("game_no")).agg(
            F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
            F.min("o_orderpriority").alias("opponent"))
        month, hour = F.month("date"), (F.lit(12) + F.col("n") % 8)
        unplayed = (F.year("date") == 2001) & (month >= 6)
        return durable_table(g.select(
            "date", "game_no", F.when(month == 2, "S").when(month == 10, "D").otherwise("R").alias("game_type"),
            F.when(F.col("doy") % 35 == 0, "Postponed").otherwise("Final").alias("status"),
            F.when(~unplayed, F.col("cents") % 40000).alias("attendance"), hour.cast("int").alias("first_hour"),
            F.when(hour >= 17, "night").otherwise("day").alias("day_night"), "opponent"))

    def _every(self, n: int) -> DataFrame:
        return self.day_counts.filter(F.dayofyear("date") % n == 0)

    @cached_property
    def rival_events(self) -> DataFrame:
        start = F.when(F.col("n") % 2 == 1, 12 + F.col("n") % 11)
        return self._every(13).select("date", F.lit("match").alias("kind"), F.concat(F.lit("r"), (F.col("n") % 3).cast("string")).alias("detail"),
                                      start.cast("int").alias("start_hour"))

    @cached_property
    def conventions(self) -> DataFrame:
        m = F.month("date")
        return self._every(60).select(F.col("date").alias("start_date"), F.when(m != 6, F.date_add("date", 2)).alias("end_date"),
                                      F.concat(F.lit("expo "), F.year("date").cast("string")).alias("event"),
                                      F.when(m % 2 == 0, "West Hall").otherwise("Civic Square").alias("venue"))

    @cached_property
    def details(self) -> list[DataFrame]:
        named = lambda n, word: self._every(n).select("date", F.concat(F.lit(word), (F.col("n") % 3).cast("string")).alias("event"))
        conv, city = cal.split_conventions(self.conventions, "%hall%")
        return [cal.event_details(named(11, "concert "), "event", "venue_event"),
                cal.event_details(self.rival_events, "detail", "rival_event"), conv, city,
                cal.event_details(named(50, "fair "), "event", "fair_event")]

    @property
    def calendar_plan(self) -> DataFrame:
        return cal.calendar_day(cal.date_spine(self.spark, *YEARS), self.games, self.details)

    @cached_property
    def calendar(self) -> DataFrame:
        return durable_table(self.calendar_plan)

    @cached_property
    def ring_panel(self) -> DataFrame:
        """Calendar x rings with orders and cents; days without orders stay NULL."""
        return panel.panel_ring_day(self.calendar, [self.ring_day], [])

    @cached_property
    def hour_weather(self) -> DataFrame:
        i = self.table("lineitem")
        return i.groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") % 24).cast("int").alias("hour")).agg(
            F.avg("l_quantity").alias("temp_hr"), F.max("l_discount").alias("prcp_hr"), F.max("l_tax").alias("wind_hr"))

    @cached_property
    def spine(self) -> DataFrame:
        return cal.time_spine(self.calendar, self.hour_weather, cal.event_hours(self.rival_events), SPLITS)

    @cached_property
    def od(self) -> DataFrame:
        """Origin-destination trips: eight stations from the suppliers of each line."""
        i = self.table("lineitem")
        return i.select(F.to_date("l_shipdate").alias("date"), (F.col("l_linenumber") + 13).cast("int").alias("hour"),
                        F.col("l_returnflag").alias("origin"), F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("destination"),
                        F.col("l_quantity").cast("long").alias("trip_count"))

    # -- residual frame -------------------------------------------------------------

    @cached_property
    def unit_evening(self) -> DataFrame:
        return durable_table(self.unit_evening_plan)

    @property
    def unit_evening_plan(self) -> DataFrame:
        """Dense nation x date x evening hour with flags, y and distance."""
        dense = panel.dense_hours(self.sales, self.nations.select("unit_id"), ["unit_id"], *YEARS,
                                  {"person_hours": F.lit(1)}, panel.EVENING)
        flags = self.calendar.select("date", "dow", "game_day", "rival_day", "day_night", "attendance",
                                     F.col("clean_control_strict").alias(CONTROL))
        out = dense.join(F.broadcast(flags), "date").join(self.nations, "unit_id")
        return out.withColumn("y", F.log1p("person_hours")).withColumn("split", dates.split_label(F.col("date"), SPLITS))

    @cached_property
    def resid(self) -> DataFrame:
        """Evening rows with the control hour-of-week mean as counterfactual."""
        rows = self.unit_evening
        out = model.how_baselines(rows.filter(CONTROL), rows).withColumnRenamed("how_unit", "cf_log")
        return durable_table(out.withColumn("resid", F.col("y") - F.col("cf_log")))

    # -- quarterly totals and their daily indicator -----------------------------------

    @cached_property
    def quarter_totals(self) -> DataFrame:
        q = self.sales.select(F.format_string("R%d", "ring_id").alias("series"), "date", "cents")
        return q.groupBy("series", F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string")).alias("period")).agg(
            (F.sum("cents") / 100.0).alias("total"))

    @cached_property
    def indicator(self) -> DataFrame:
        """Shipped quantity per region and day plus one, so every day is positive."""
        i, s, n = self.table("lineitem"), self.table("supplier"), self.table("nation")
        qty = (i.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
               .join(n.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
               .groupBy("n_regionkey", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("q")))
        spine = self.table("region").select("r_regionkey").withColumn("date", F.explode(F.sequence(
            F.lit("1995-01-01").cast("date"), F.lit("2001-11-04").cast("date"))))
        both = spine.join(qty, (F.col("r_regionkey") == F.col("n_regionkey")) & (spine["date"] == qty["date"]), "left")
        return both.select(F.format_string("R%d", F.col("r_regionkey") + 1).alias("series"), spine["date"],
                           (F.coalesce("q", F.lit(0.0)) + 1.0).alias("ind"))

    @cached_property
    def basket(self) -> DataFrame:
        """Sparse vectors: quantity of each part per customer."""
        o, i = self.table("orders"), self.table("lineitem")
        return i.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
            F.col("o_custkey").alias("node_id"), F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("w"))

    @cached_property
    def place_index(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_name").alias("name"), F.concat("p_size", F.lit(" "), "p_brand", F.lit(" Street")).alias("address")).distinct()

    @cached_property
    def place_queries(self) -> DataFrame:
        p = self.table("part")
        start = F.substring(F.get(F.split("p_name", " "), F.lit(1)), 1, 4)
        return p.select(F.concat(start, F.lit(" "), "p_size", F.lit(" street San Francisco CA")).alias("query")).distinct()


CTES = {
    "poi": """SELECT c_custkey AS poi_id, c_name AS poi_name,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '722511' WHEN 'FURNITURE' THEN '442110' WHEN 'MACHINERY' THEN '721110'
             WHEN 'BUILDING' THEN '452319' ELSE '999999' END AS category,
        CAST(37.70 AS DOUBLE) + (c_custkey * 7919 % 1400) / CAST(10000 AS DOUBLE) AS lat,
        CAST(-122.52 AS DOUBLE) + (c_custkey * 104729 % 1700) / CAST(10000 AS DOUBLE) AS lon,
        CAST(c_nationkey AS VARCHAR) || ' King Street' AS address, c_acctbal >= 0 AS has_hourly FROM customer""",
    "hour_fact": """SELECT user_id AS poi_id, CAST(ts AS DATE) AS date, hour(ts) AS hour, COUNT(*) AS visitor_hours
        FROM events GROUP BY ALL""",
    "day_fact": "SELECT user_id AS poi_id, CAST(ts AS DATE) AS date, COUNT(*) AS visits FROM events GROUP BY ALL",
    "poi_week": """SELECT d.poi_id, CAST(date_trunc('week', d.date) AS DATE) AS week_start, SUM(d.visits) AS visit_counts,
        any_value(p.has_hourly) AS has_hourly FROM day_fact d JOIN poi p USING (poi_id) GROUP BY ALL""",
    "cells": f"""SELECT *, 'c' || CAST(gi AS VARCHAR) || '_' || CAST(gj AS VARCHAR) AS unit_id FROM (SELECT *,
        CAST(floor(lat / CAST({STEP[0]} AS DOUBLE)) AS BIGINT) AS gi, CAST(floor(lon / CAST({STEP[1]} AS DOUBLE)) AS BIGINT) AS gj
        FROM poi WHERE lat BETWEEN {BOX[0]} AND {BOX[1]} AND lon BETWEEN {BOX[2]} AND {BOX[3]})""",
    "kept": "SELECT unit_id, COUNT(*) AS n_poi FROM cells GROUP BY 1 HAVING COUNT(*) >= 10",
    "unit_stats": """SELECT c.unit_id, c.gi, c.gj, COUNT(*) AS n_poi, AVG(lat) AS lat, AVG(lon) AS lon,
        COUNT(*) FILTER (category LIKE '722%') AS n_food,
        COUNT(*) FILTER (category LIKE '44%' OR category LIKE '45%') AS n_retail,
        COUNT(*) FILTER (category LIKE '721%') AS n_lodging FROM cells c SEMI JOIN kept USING (unit_id) GROUP BY ALL""",
    "poi_units": "SELECT poi_id, unit_id FROM cells SEMI JOIN kept USING (unit_id)",
    "sales": """SELECT CAST(n_nationkey AS BIGINT) AS unit_id, n_regionkey + 1 AS ring_id, CAST(o_orderdate AS DATE) AS date,
        CAST(o_orderkey % 24 AS INT) AS hour, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "ring_day": "SELECT ring_id, date, COUNT(*) AS visits, CAST(SUM(cents) AS BIGINT) AS cents FROM sales GROUP BY ALL",
    "all_days": f"SELECT CAST(unnest(generate_series(DATE '{YEARS[0]}', DATE '{YEARS[1]}', INTERVAL 1 DAY)) AS DATE) AS date",
    "all_hours": "SELECT unnest(generate_series(0, 23)) AS hour",
    "ring_hour": """SELECT s.ring_id, s.date, s.hour, COALESCE(f.n, 0) AS visitor_hours, COALESCE(f.cents, 0) AS cents
        FROM (SELECT r_regionkey + 1 AS ring_id, date, hour FROM region, all_days, all_hours) s
        LEFT JOIN (SELECT ring_id, date, hour, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS cents FROM sales GROUP BY ALL) f
        USING (ring_id, date, hour)""",
    "day_counts": "SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY 1",
    "games": """SELECT date, game_no, CASE WHEN month(date) = 2 THEN 'S' WHEN month(date) = 10 THEN 'D' ELSE 'R' END AS game_type,
        CASE WHEN dayofyear(date) % 35 = 0 THEN 'Postponed' ELSE 'Final' END AS status,
        CASE WHEN year(date) = 2001 AND month(date) >= 6 THEN NULL ELSE cents % 40000 END AS attendance,
        12 + n % 8 AS first_hour, CASE WHEN 12 + n % 8 >= 17 THEN 'night' ELSE 'day' END AS day_night, opponent
        FROM (SELECT CAST(o_orderdate AS DATE) AS date,
                CASE WHEN dayofyear(o_orderdate) % 45 = 0 AND o_custkey % 2 = 1 THEN 2 ELSE 1 END AS game_no,
                COUNT(*) AS n, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, MIN(o_orderpriority) AS opponent
              FROM orders WHERE dayofyear(o_orderdate) % 5 = 0 GROUP BY ALL)""",
    "rival_events": """SELECT date, 'match' AS kind, 'r' || CAST(n % 3 AS VARCHAR) AS detail,
        CASE WHEN n % 2 = 1 THEN 12 + n % 11 END AS start_hour FROM day_counts WHERE dayofyear(date) % 13 = 0""",
    "conventions": """SELECT date AS start_date, CASE WHEN month(date) <> 6 THEN date + 2 END AS end_date,
        'expo ' || CAST(year(date) AS VARCHAR) AS event,
        CASE WHEN month(date) % 2 = 0 THEN 'West Hall' ELSE 'Civic Square' END AS venue
        FROM day_counts WHERE dayofyear(date) % 60 = 0""",
    "convention_days": """SELECT CAST(unnest(generate_series(start_date, COALESCE(end_date, start_date), INTERVAL 1 DAY)) AS DATE) AS date,
        event, venue FROM conventions""",
    # every day once, and each thing that marks a day as a row of its own
    "day_marks": """SELECT date, 'day' AS what, NULL::VARCHAR AS label, NULL::VARCHAR AS type, NULL::BIGINT AS people, NULL::BIGINT AS hour, NULL::BOOLEAN AS late FROM all_days
        UNION ALL BY NAME SELECT date, 'game' AS what, opponent AS label, game_type AS type, attendance AS people, first_hour AS hour, day_night = 'night' AS late
          FROM games WHERE NOT list_contains(['S', 'E'], game_type)
        UNION ALL BY NAME SELECT date, 'fair' AS what, 'fair ' || CAST(n % 3 AS VARCHAR) AS label FROM day_counts WHERE dayofyear(date) % 50 = 0
        UNION ALL BY NAME SELECT date, 'venue' AS what, 'concert ' || CAST(n % 3 AS VARCHAR) AS label FROM day_counts WHERE dayofyear(date) % 11 = 0
        UNION ALL BY NAME SELECT date, 'rival' AS what, detail AS label FROM rival_events
        UNION ALL BY NAME SELECT date, if(contains(lower(venue), 'hall'), 'hall', 'city') AS what, event AS label FROM convention_days""",
    "calendar": "SELECT date, isodow(date) AS dow, "
        + "".join(f"coalesce(bool_or(what = '{w}'), false) AS {flag}, " for w, flag in
                  (("game", "game_day"), ("venue", "venue_day"), ("rival", "rival_day"), ("hall", "convention_day"), ("city", "citywide_day"), ("fair", "fair_day")))
        + "".join(f"string_agg(DISTINCT label, '; ' ORDER BY label) FILTER (what = '{w}') AS {name}, " for w, name in
                  (("game", "opponents"), ("venue", "venue_event"), ("rival", "rival_event"), ("hall", "convention_event"), ("city", "citywide_event"), ("fair", "fair_event")))
        + """string_agg(DISTINCT type, '; ' ORDER BY type) AS game_types, count_if(what = 'game') AS n_games, sum(people) AS attendance, min(hour) AS first_hour,
        CASE bool_or(late) WHEN true THEN 'night' WHEN false THEN 'day' END AS day_night,
        NOT bool_or(what IN ('game', 'venue')) AS clean_control, bool_and(what = 'day') AS clean_control_strict
        FROM day_marks GROUP BY date HAVING bool_or(what = 'day')""",
    "ring_panel": """SELECT c.*, k.ring_id, d.visits, d.cents FROM calendar c CROSS JOIN (SELECT unnest(range(1, 6)) AS ring_id) k
        LEFT JOIN ring_day d ON d.ring_id = k.ring_id AND d.date = c.date""",
    "hour_weather": """SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_orderkey % 24 AS INT) AS hour, AVG(l_quantity) AS temp_hr,
        MAX(l_discount) AS prcp_hr, MAX(l_tax) AS wind_hr FROM lineitem GROUP BY ALL""",
    "rival_hours": """SELECT date, unnest(generate_series(CASE WHEN start_hour IS NULL THEN 19 ELSE greatest(start_hour - 2, 0) END,
        CASE WHEN start_hour IS NULL THEN 23 ELSE least(start_hour + 3, 23) END)) AS hour, kind || ': ' || detail AS detail FROM rival_events""",
    "od": """SELECT CAST(l_shipdate AS DATE) AS date, l_linenumber + 13 AS hour, l_returnflag AS origin,
        'S' || CAST(l_suppkey % 8 AS VARCHAR) AS destination, CAST(l_quantity AS BIGINT) AS trip_count FROM lineitem""",
    "nations": """SELECT CAST(n_nationkey AS BIGINT) AS unit_id, lat, CAST(-122.3893 AS DOUBLE) AS lon,
        abs(lat - CAST(37.7786 AS DOUBLE)) * 111320 AS dist_m
        FROM (SELECT n_nationkey, CAST(37.7786 AS DOUBLE) - n_nationkey * CAST(0.002 AS DOUBLE) AS lat FROM nation)""",
    "unit_evening": f"""SELECT s.unit_id, s.date, s.hour, s.dow, s.game_day, s.rival_day, s.day_night, s.attendance,
        s.clean_control_strict AS is_control, s.lat, s.lon, s.dist_m, COALESCE(f.n, 0) AS person_hours, ln(1 + COALESCE(f.n, 0)) AS y,
        CASE WHEN s.date BETWEEN DATE '{SPLITS['train'][0]}' AND DATE '{SPLITS['train'][1]}' THEN 'train'
             WHEN s.date BETWEEN DATE '{SPLITS['val'][0]}' AND DATE '{SPLITS['val'][1]}' THEN 'val'
             WHEN s.date BETWEEN DATE '{SPLITS['test'][0]}' AND DATE '{SPLITS['test'][1]}' THEN 'test' END AS split
        FROM (SELECT * FROM nations, calendar, (SELECT unnest(range(16, 24)) AS hour)) s
        LEFT JOIN (SELECT unit_id, date, hour, COUNT(*) AS n FROM sales GROUP BY ALL) f USING (unit_id, date, hour)""",
    "resid": """SELECT *, y - cf_log AS resid FROM (SELECT u.*, COALESCE(a.m, b.m) AS cf_log, b.m AS how_global FROM unit_evening u
        LEFT JOIN (SELECT unit_id, dow, hour, AVG(y) AS m FROM unit_evening WHERE is_control GROUP BY ALL) a USING (unit_id, dow, hour)
        LEFT JOIN (SELECT dow, hour, AVG(y) AS m FROM unit_evening WHERE is_control GROUP BY ALL) b USING (dow, hour))""",
    "quarter_totals": """SELECT 'R' || CAST(ring_id AS VARCHAR) AS series, CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS period,
        SUM(cents) / CAST(100 AS DOUBLE) AS total FROM sales GROUP BY ALL""",
    "indicator": """SELECT 'R' || CAST(r_regionkey + 1 AS VARCHAR) AS series, s.date, COALESCE(q, 0) + 1 AS ind
        FROM (SELECT r_regionkey, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-11-04', INTERVAL 1 DAY)) AS DATE) AS date FROM region) s
        LEFT JOIN (SELECT n_regionkey AS r_regionkey, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS q FROM lineitem
                   JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) USING (r_regionkey, date)""",
    "basket": """SELECT o_custkey AS node_id, l_partkey AS key, SUM(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY ALL""",
}
