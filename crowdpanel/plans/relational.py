"""Relational vocabulary: scans, expressions, arrays, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, flags, geo, stats, text
from ..operators import aggregates, joins, reshape, windows
from ..operators.joins import asof_join
from .registry import query
from .standins import YEARS, Tables

HAVERSINE = ("2 * {r} * asin(sqrt(pow(sin((radians(lat) - radians(37.7786::DOUBLE)) / 2), 2) + cos(radians(lat)) * "
             "cos(radians(37.7786::DOUBLE)) * pow(sin((radians(lon) - radians(-122.3893::DOUBLE)) / 2), 2)))")
FLAT = ("sqrt(pow((lat - 37.7786::DOUBLE) * 111320, 2) + pow((lon - (-122.3893::DOUBLE)) * 111320 * "
        "cos(radians(37.7786::DOUBLE)), 2))")
BEARING = ("(degrees(atan2((lon - (-122.3893::DOUBLE)) * cos(radians(37.7786::DOUBLE)), lat - 37.7786::DOUBLE)) + 360) "
           "% 360")


def _ladder(expr: str, edges, op: str, label) -> str:
    arms = " ".join(f"WHEN {expr} {op} {hi} THEN {label(i)}" for i, hi in enumerate(edges))
    return f"CASE {arms} ELSE {label(len(edges))} END"


@query("place_geometry", "PRJ1 PRJ2 PRJ3", "poi_id l, hav_m f3, km f2, flat_m f3, bearing_deg f4", f"""
    SELECT poi_id, {HAVERSINE.format(r=6371008.8)} AS hav_m, round({HAVERSINE.format(r=6371.0)}, 2) AS km,
           {FLAT} AS flat_m, {BEARING} AS bearing_deg FROM poi""")
def _(t: Tables):
    return t.poi.select("poi_id", geo.haversine("lat", "lon", *geo.VENUE).alias("hav_m"),
                        geo.haversine_km("lat", "lon", *geo.VENUE).alias("km"),
                        geo.flat_distance("lat", "lon", *geo.VENUE).alias("flat_m"),
                        geo.bearing("lat", "lon", *geo.VENUE).alias("bearing_deg"))


@query("ring_and_band_labels", "PRJ4 PRJ5 PRJ6", "poi_id l, ring_id l, ring s, upto s, below s", f"""
    SELECT poi_id, CASE WHEN d >= 5000 THEN NULL ELSE {_ladder('d', (250, 500, 1000, 2500), '<', lambda i: i + 1)} END AS ring_id,
           CASE WHEN d >= 5000 THEN NULL ELSE {_ladder('d', (250, 500, 1000, 2500), '<',
               lambda i: "'" + ('0-250m', '250-500m', '500-1000m', '1000-2500m', '2500-5000m')[i] + "'")} END AS ring,
           {_ladder('d', (500, 1000, 2000, 4000), '<=', lambda i: "'" + ('0-500m', '500-1000m', '1000-2000m', '2000-4000m', '>4000m')[i] + "'")} AS upto,
           {_ladder('d', (250, 500, 1000, 2500, 5000), '<', lambda i: f"'b{i + 1}'")} AS below
    FROM (SELECT poi_id, {FLAT} AS d FROM poi)""")
def _(t):
    d = geo.flat_distance("lat", "lon", *geo.VENUE)
    return t.poi.select("poi_id", geo.ring_id(d).alias("ring_id"), geo.ring_label(d).alias("ring"),
                        geo.band_upto(d).alias("upto"), geo.band_below(d).alias("below"))


@query("grid_cells", "PRJ7 PRJ8", "poi_id l, gi l, gj l, unit_id s", "SELECT poi_id, gi, gj, unit_id FROM cells")
def _(t):
    return t.assigned


@query("window_predicates", "PRJ9", "week_start d, overlaps b, inside b, n l", """
    SELECT week_start, week_start <= DATE '2000-12-31' AND week_start + 6 >= DATE '1996-01-03' AS overlaps,
           week_start >= DATE '1996-01-03' AND week_start + 6 <= DATE '2000-12-31' AS inside, n
    FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, COUNT(*) AS n FROM lineitem GROUP BY 1)""")
def _(t):
    w = t.table("lineitem").groupBy(dates.week_start(F.to_date("l_shipdate")).alias("week_start")).agg(F.count("*").alias("n"))
    span = ("1996-01-03", "2000-12-31")
    return w.select("week_start", dates.week_overlaps(F.col("week_start"), *span).alias("overlaps"),
                    dates.week_inside(F.col("week_start"), *span).alias("inside"), "n")


@query("treatment_games", "PRJ10", "date d, game_no l, game_type s, attendance l",
       "SELECT date, game_no, game_type, attendance FROM games WHERE game_type NOT IN ('S', 'E')")
def _(t):
    return t.games.filter(flags.is_treatment_game(F.col("game_type")))


@query("null_safe_and_text_matches", "PRJ11 PRJ12", "segment s, differs l, prefixed l, liked l, iliked l, matched l", """
    SELECT c_mktsegment AS segment, COUNT(*) FILTER (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END IS DISTINCT FROM 'BUILDING') AS differs,
           COUNT(*) FILTER (starts_with(c_name, 'Customer#0000')) AS prefixed, COUNT(*) FILTER (c_name LIKE '%7_') AS liked,
           COUNT(*) FILTER (c_mktsegment ILIKE '%hold') AS iliked, COUNT(*) FILTER (regexp_matches(c_name, '[02468]{3}$')) AS matched
    FROM customer GROUP BY 1""")
def _(t):
    c = t.table("customer")
    seg = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        stats.count_if(flags.differs(seg, F.lit("BUILDING"))).alias("differs"),
        stats.count_if(F.col("c_name").startswith("Customer#0000")).alias("prefixed"),
        stats.count_if(F.col("c_name").like("%7_")).alias("liked"),
        stats.count_if(F.col("c_mktsegment").ilike("%hold")).alias("iliked"),
        stats.count_if(F.col("c_name").rlike("[02468]{3}$")).alias("matched"))


@query("control_flags", "PRJ13 PRJ14 P23", "all_days l, treated_days l, shipped_control l, strict_no_venue l, strict_control l", """
    SELECT COUNT(DISTINCT date) AS all_days, COUNT(DISTINCT date) FILTER (game_day) AS treated_days,
           COUNT(DISTINCT date) FILTER (clean_control) AS shipped_control,
           COUNT(DISTINCT date) FILTER (NOT game_day AND NOT rival_day AND NOT convention_day AND NOT citywide_day AND NOT fair_day) AS strict_no_venue,
           COUNT(DISTINCT date) FILTER (clean_control_strict) AS strict_control FROM calendar""")
def _(t):
    from ..operators.panel import control_pool_summary
    return control_pool_summary(t.calendar)


@query("calendar_parts", "PRJ16 PRJ17 PRJ22 PRJ23", "date d, dow l, month l, year l, quarter l, doy l, week_start d, weekend b, t_index l, clamped l, holiday b, split s", """
    SELECT DISTINCT d AS date, isodow(d) AS dow, month(d) AS month, year(d) AS year, quarter(d) AS quarter, dayofyear(d) AS doy,
           CAST(date_trunc('week', d) AS DATE) AS week_start, isodow(d) >= 6 AS weekend, date_diff('day', DATE '1995-01-01', d) AS t_index,
           least(date_diff('day', DATE '1995-01-01', d), 2000) AS clamped,
           strftime(d, '%m-%d') IN ('01-01', '06-19', '07-04', '11-11', '12-25')
             OR (isodow(d) = 1 AND ((month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) >= 25)
                 OR (month(d) = 9 AND day(d) <= 7) OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14)))
             OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28) AS holiday,
           CASE WHEN year(d) <= 1998 THEN 'train' WHEN year(d) = 1999 THEN 'val' WHEN year(d) <= 2001 THEN 'test' END AS split
    FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    from .standins import SPLITS
    d = F.col("date")
    days = t.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select(d, dates.iso_weekday(d).alias("dow"), F.month(d).alias("month"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
                       F.dayofyear(d).alias("doy"), dates.week_start(d).alias("week_start"), dates.is_weekend(d).alias("weekend"),
                       dates.trend_index(d, "1995-01-01").alias("t_index"), dates.trend_index(d, "1995-01-01", 2000).alias("clamped"),
                       dates.is_federal_holiday(d).alias("holiday"), dates.split_label(d, SPLITS).alias("split"))


@query("relative_hours", "PRJ18", "event_id l, rel l, clock_rel l", """
    SELECT event_id, CASE WHEN day(ts) % 9 <> 0 THEN hour(ts) - 19 END AS rel,
           date_diff('hour', CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 19 HOUR, date_trunc('hour', ts)) AS clock_rel FROM events""")
def _(t):
    d = F.to_date("ts")
    n = F.when(F.dayofmonth("ts") % 9 == 0, 2).otherwise(1)
    return t.table("events").select("event_id", dates.relative_hour(d, F.hour("ts"), d, F.lit(19), n).alias("rel"),
                                    dates.hours_between(dates.hour_stamp(d, F.lit(19)), F.col("ts")).alias("clock_rel"))


@query("wall_clock", "PRJ19", "o_orderkey l, local t", """
    SELECT o_orderkey, timezone('America/Los_Angeles', timezone('UTC', o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + INTERVAL 8 HOUR)) AS local
    FROM orders""")
def _(t):
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return t.table("orders").select("o_orderkey", dates.standard_to_wall_clock(ts, -8, "America/Los_Angeles").alias("local"))


@query("unit_conversions", "PRJ20 PRJ24", "event_id l, temp_f f1, inches f3, mph f1, logged f9, back f6", """
    SELECT event_id, round(value * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE, 1) AS temp_f, round(value / 25.4::DOUBLE, 3) AS inches,
           round(value * 2.23694::DOUBLE, 1) AS mph, ln(1 + value) AS logged, exp(greatest(ln(1 + value) - 1, 0)) - 1 AS back FROM events""")
def _(t):
    v = F.col("value")
    return t.table("events").select("event_id", text.celsius_to_f(v).alias("temp_f"), text.mm_to_inches(v).alias("inches"),
                                    text.mps_to_mph(v).alias("mph"), F.log1p(v).alias("logged"),
                                    F.expm1(F.greatest(F.log1p(v) - 1, F.lit(0.0))).alias("back"))


@query("sensor_text", "PRJ21", "event_id l, temp f2, prcp f2", """
    SELECT event_id, TRY_CAST(regexp_replace(txt, '[^-0-9.]', '', 'g') AS DOUBLE) AS temp,
           CASE WHEN trim(txt) = 'T' THEN 0 ELSE TRY_CAST(regexp_replace(txt, '[^0-9.]', '', 'g') AS DOUBLE) END AS prcp
    FROM (SELECT event_id, CASE WHEN value < 5 THEN ' T' WHEN event_type = 'click' THEN '-' || CAST(value AS VARCHAR) || 's'
                 WHEN event_type = 'error' THEN '*' ELSE CAST(value AS VARCHAR) || 'V' END AS txt FROM events)""")
def _(t):
    v = F.col("value").cast("string")
    txt = (F.when(F.col("value") < 5, " T").when(F.col("event_type") == "click", F.concat(F.lit("-"), v, F.lit("s")))
           .when(F.col("event_type") == "error", "*").otherwise(F.concat(v, F.lit("V"))))
    return t.table("events").select("event_id", text.sensor_number(txt, text.SIGNED_NUMBER, None).alias("temp"),
                                    text.sensor_number(txt).alias("prcp"))


@query("safe_arithmetic", "PRJ25 AG11", "segment s, ratio f6, mean_ratio f6, filled f4", """
    SELECT c_mktsegment AS segment, SUM(c_acctbal) FILTER (c_acctbal < 0) / NULLIF(SUM(c_acctbal), 0) AS ratio,
           AVG(c_acctbal / NULLIF(c_nationkey, 0)) AS mean_ratio, AVG(COALESCE(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0)) AS filled
    FROM customer GROUP BY 1""")
def _(t):
    b = F.col("c_acctbal")
    return t.table("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        stats.ratio_of_sums(F.when(b < 0, b), b).alias("ratio"),
        F.avg(F.try_divide(b, F.nullif("c_nationkey", F.lit(0)))).alias("mean_ratio"),
        F.avg(F.coalesce(F.when(b >= 0, b), F.lit(0.0))).alias("filled"))


@query("cyclic_encodings", "PRJ26", "hour l, dow l, n l, hs f9, hc f9, ds f9, dc f9", """
    SELECT hour(ts) AS hour, isodow(ts) AS dow, COUNT(*) AS n, sin(2 * pi() * hour(ts) / 24) AS hs, cos(2 * pi() * hour(ts) / 24) AS hc,
           sin(2 * pi() * isodow(ts) / 7) AS ds, cos(2 * pi() * isodow(ts) / 7) AS dc FROM events GROUP BY ALL""")
def _(t):
    by = t.table("events").groupBy(F.hour("ts").alias("hour"), dates.iso_weekday(F.col("ts")).alias("dow")).agg(F.count("*").alias("n"))
    (hs, hc), (ds, dc) = dates.cyclic(F.col("hour"), 24.0), dates.cyclic(F.col("dow"), 7.0)
    return by.select("*", hs.alias("hs"), hc.alias("hc"), ds.alias("ds"), dc.alias("dc"))


@query("train_standardised", "PRJ27", "ring_id l, date d, visits_z f6, cents_z f6", """
    SELECT ring_id, date, (visits - m.vm) / m.vs AS visits_z, (cents - m.cm) / m.cs AS cents_z FROM ring_day,
      (SELECT AVG(visits) AS vm, stddev_pop(visits) AS vs, AVG(cents) AS cm, stddev_pop(cents) AS cs FROM ring_day
       WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') m""")
def _(t):
    from ..operators.model import standardize
    from .standins import SPLITS
    rows = t.ring_day.withColumn("split", dates.split_label(F.col("date"), SPLITS))
    return standardize(rows, ["visits", "cents"])[0]


@query("one_hot_segments", "PRJ28", "c_custkey l, seg_BUILDING l, seg_MACHINERY l, balance f2", """
    SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS seg_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INT) AS seg_MACHINERY,
           COALESCE(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_acctbal >= 0)) AS balance FROM customer""")
def _(t):
    from ..operators.model import one_hot
    c = t.table("customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    med = aggregates.exact_quantiles(c, "b", {"m": 0.5})
    return one_hot(c, "seg", ["BUILDING", "MACHINERY"]).join(F.broadcast(med)).withColumn("balance", F.coalesce("b", "m"))


@query("unit_codes", "PRJ29 W11", "unit_id s, unit_code l", "SELECT unit_id, dense_rank() OVER (ORDER BY unit_id) AS unit_code FROM unit_stats")
def _(t):
    return windows.category_codes(t.units, "unit_id", "unit_code")


# -- arrays and JSON -----------------------------------------------------------------


@query("packed_hours_round_trip", "ARR2 ARR3 P15", "poi_id l, date d, hour l, visitor_hours l",
       "SELECT poi_id, date, hour, visitor_hours FROM hour_fact")
def _(t):
    from ..operators import unpack
    return unpack.explode_hours(t.patterns, "all_hours")


@query("packed_days_with_totals", "ARR1 ARR4 ARR5", "poi_id l, date d, visits l, array_sum l, array_len l", """
    SELECT w.poi_id, w.week_start + CAST(i AS INT) AS date, COALESCE(d.visits, 0) AS visits, w.visit_counts AS array_sum, 7 AS array_len
    FROM poi_week w CROSS JOIN (SELECT unnest(range(7)) AS i) LEFT JOIN day_fact d ON d.poi_id = w.poi_id AND d.date = w.week_start + CAST(i AS INT)""")
def _(t):
    from ..operators import unpack
    return unpack.explode_days(t.patterns, "packed_days", keep_zeros=True)


@query("daily_explode", "P15", "poi_id l, date d, visits l", "SELECT poi_id, date, visits FROM day_fact")
def _(t):
    from ..operators import unpack
    return unpack.explode_days(t.patterns, "packed_days")


@query("bad_slots", "ARR1 ARR2", "event_id l, lenient_sum l, lenient_null l, strict_null b", """
    SELECT event_id, CAST(floor(value) AS BIGINT) + (CASE WHEN event_type = 'click' THEN 0 ELSE 2 END) AS lenient_sum,
           CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS lenient_null, event_type = 'click' AS strict_null FROM events""")
def _(t):
    bad = F.when(F.col("event_type") == "click", "x").otherwise("2")
    txt = F.concat(F.lit("["), F.floor("value").cast("string"), F.lit(", "), bad, F.lit("]"))
    return t.table("events").select("event_id", txt.alias("txt")).select(
        "event_id", arrays.slot_sum(arrays.slots_lenient(F.col("txt"))).alias("lenient_sum"),
        F.size(F.filter(arrays.slots_lenient(F.col("txt")), lambda x: x.isNull())).alias("lenient_null"),
        arrays.slots_strict(F.col("txt")).isNull().alias("strict_null"))


@query("parallel_explode", "ARR6", "poi_id l, week_start d, ts t, v l, w l", """
    SELECT p.poi_id, p.week_start, CAST(p.week_start AS TIMESTAMP) + to_hours(CAST(i AS INT)) AS ts,
           COALESCE(h.visitor_hours, 0) AS v, i AS w
    FROM poi_week p CROSS JOIN (SELECT unnest(range(168)) AS i)
    LEFT JOIN hour_fact h ON h.poi_id = p.poi_id AND h.date = p.week_start + CAST(i // 24 AS INT) AND h.hour = i % 24""")
def _(t):
    a = arrays.slots_strict(F.col("all_hours"))
    z = t.patterns.select("poi_id", "week_start", F.explode(F.arrays_zip(
        a.alias("v"), F.sequence(F.lit(0), F.lit(167)).alias("w"))).alias("z"))
    return z.select("poi_id", "week_start", (F.col("week_start").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("z.w"))).alias("ts"),
                    F.col("z.v").alias("v"), F.col("z.w").alias("w"))


@query("json_count_vectors", "ARR7", "node_id l, key s, w f2", """
    SELECT user_id AS node_id, k.key AS key, SUM(CAST(k.value AS DOUBLE)) AS w FROM events, json_each(props) AS k GROUP BY ALL""")
def _(t):
    from ..operators.graph import json_vectors
    return json_vectors(t.table("events"), "user_id", "props")


@query("json_weighted_keys", "ARR8", "event_id l, minutes f3", """
    SELECT event_id, 2.5::DOUBLE * floor(value) + 60 * CAST(json_extract(props, '$.k') AS DOUBLE) AS minutes FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    txt = F.concat(F.lit('{"<5": '), F.floor("value").cast("string"), F.lit(', "21-60": '), k, F.lit("}"))
    return t.table("events").select("event_id", arrays.weighted_keys(arrays.counts_map(txt), {"<5": 2.5, "21-60": 60.0, ">240": 9.0}).alias("minutes"))


@query("convention_dates", "ARR9", "date d, event s, venue s", "SELECT date, event, venue FROM convention_days")
def _(t):
    from ..operators import days
    return days.explode_spans(t.conventions, "start_date", "end_date")


@query("event_hour_windows", "ARR10 J15 P10 AG6", "date d, hour l, detail s", """
    SELECT date, hour, string_agg(DISTINCT detail, '; ' ORDER BY detail) AS detail FROM rival_hours GROUP BY ALL""")
def _(t):
    from ..operators import days
    return days.event_hours(t.rival_events)


# -- joins -----------------------------------------------------------------------------


@query("fact_dimension_join", "J1 AG1", "region s, year l, orders l, cents l", """
    SELECT r_name AS region, year(date) AS year, COUNT(*) AS orders, CAST(SUM(cents) AS BIGINT) AS cents
    FROM sales JOIN region ON r_regionkey + 1 = ring_id GROUP BY ALL""")
def _(t):
    r = t.table("region").select((F.col("r_regionkey") + 1).alias("ring_id"), F.col("r_name").alias("region"))
    return t.sales.join(r, "ring_id").groupBy("region", F.year("date").alias("year")).agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))


@query("full_outer_days", "J3", "date d, orders l, lines l", """
    SELECT COALESCE(a.date, b.date) AS date, a.n AS orders, b.n AS lines FROM day_counts a
    FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n FROM lineitem GROUP BY 1) b ON a.date = b.date""")
def _(t):
    lines = t.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("lines"))
    return joins.full_merge(t.day_counts.withColumnRenamed("n", "orders"), lines, ["date"])


@query("dense_ring_spine", "J4 P18", "ring_id l, date d, hour l, visitor_hours l, cents l", "SELECT * FROM ring_hour")
def _(t):
    return t.ring_hour_plan


@query("events_around_start", "J5", "date d, relative_hour l, ts t, n l", """
    SELECT g.date, date_diff('hour', g.start_ts, h.ts) AS relative_hour, h.ts, h.n
    FROM (SELECT date, CAST(date AS TIMESTAMP) + to_hours(CAST(MIN(first_hour) AS INT)) AS start_ts FROM games GROUP BY 1) g
    JOIN (SELECT CAST(date AS TIMESTAMP) + to_hours(hour) AS ts, COUNT(*) AS n FROM sales GROUP BY 1) h
      ON h.ts BETWEEN g.start_ts - INTERVAL 6 HOUR AND g.start_ts + INTERVAL 8 HOUR""")
def _(t):
    h = t.sales.groupBy(dates.hour_stamp(F.col("date"), F.col("hour")).alias("ts")).agg(F.count("*").alias("n"))
    g = t.games.groupBy("date").agg(F.min("first_hour").alias("h")).select("date", dates.hour_stamp(F.col("date"), F.col("h")).alias("start_ts"))
    return joins.around(g, h, "start_ts", "ts", -6, 8)


@query("asof_last_purchase", "J8 W13", "event_id l, asof_ts t, value f2", """
    SELECT e.event_id, p.ts AS asof_ts, p.value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
      ON e.user_id = p.user_id AND e.ts > p.ts""")
def _(t):
    e = t.table("events")
    bought = e.filter(F.col("event_type") == "purchase").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    other = e.filter(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    return asof_join(other, bought, ["user_id"], "ts", ["value"], strict=True)


@query("asof_orders_by_nation", "J8", "o_orderkey l, asof_date d, n l", """
    SELECT o.o_orderkey, p.date AS asof_date, p.n FROM (SELECT o_orderkey, c_nationkey, CAST(o_orderdate AS DATE) AS date FROM orders
      JOIN customer ON o_custkey = c_custkey) o ASOF LEFT JOIN
      (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) p ON o.c_nationkey = p.c_nationkey AND o.date >= p.date""")
def _(t):
    o = t.table("orders").join(t.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    urgent = o.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("c_nationkey", "date").agg(F.count("*").alias("n"))
    return asof_join(o.select("o_orderkey", "c_nationkey", "date"), urgent, ["c_nationkey"], "date", ["n"], strict=False)


@query("anti_both_ways", "J9", "side s, n l", """
    SELECT 'orders only' AS side, COUNT(*) AS n FROM day_counts WHERE date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)
    UNION ALL SELECT 'lines only', COUNT(*) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) WHERE date NOT IN (SELECT date FROM day_counts)""")
def _(t):
    lines = t.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(joins.only_in(t.day_counts, lines, ["date"]), "orders only").unionByName(
        count(joins.only_in(lines, t.day_counts, ["date"]), "lines only"))


@query("semi_and_not_in", "J10", "poi_id l, active b", """
    SELECT poi_id, TRUE AS active FROM poi WHERE poi_id IN (SELECT poi_id FROM hour_fact)
    UNION ALL SELECT poi_id, FALSE FROM poi WHERE poi_id NOT IN (SELECT poi_id FROM hour_fact)""")
def _(t):
    yes = joins.also_in(t.poi, t.hour_fact, ["poi_id"]).select("poi_id", F.lit(True).alias("active"))
    return yes.unionByName(joins.only_in(t.poi, t.hour_fact, ["poi_id"]).select("poi_id", F.lit(False).alias("active")))


@query("units_within_radius", "J11", "src s, dst s, dist_m f3", """
    SELECT a.unit_id AS src, b.unit_id AS dst, sqrt(pow((b.lat - a.lat) * 111320, 2) + pow((b.lon - a.lon) * 111320 * cos(radians(a.lat)), 2)) AS dist_m
    FROM unit_stats a, unit_stats b WHERE a.unit_id <> b.unit_id
      AND sqrt(pow((b.lat - a.lat) * 111320, 2) + pow((b.lon - a.lon) * 111320 * cos(radians(a.lat)), 2)) <= 4000""")
def _(t):
    from ..operators.graph import units_within
    from .standins import STEP
    return units_within(t.units, 4000, STEP)


@query("weekly_coverage_join", "J14", "date d, has_hourly b, n l", """
    SELECT d.date, w.has_hourly, COUNT(*) AS n FROM day_fact d LEFT JOIN poi_week w
      ON w.poi_id = d.poi_id AND d.date BETWEEN w.week_start AND w.week_start + 6 GROUP BY ALL""")
def _(t):
    weekly = t.patterns.select("poi_id", "week_start", "has_hourly")
    return joins.by_week(t.day_fact, weekly, ["poi_id"]).groupBy("date", "has_hourly").agg(F.count("*").alias("n"))


@query("prefer_observed", "J18", "date d, hour l, temp_hr f6, source s", """
    SELECT s.date, s.hour, COALESCE(a.v, b.v) AS temp_hr, CASE WHEN a.v IS NOT NULL THEN 'orders' ELSE 'lines' END AS source
    FROM (SELECT date, hour FROM all_days, all_hours) s LEFT JOIN (SELECT date, hour, AVG(cents) AS v FROM sales GROUP BY ALL) a USING (date, hour)
    LEFT JOIN (SELECT date, hour, temp_hr AS v FROM hour_weather) b USING (date, hour)""")
def _(t):
    from ..operators import days
    spine = days.date_spine(t.spark, *YEARS).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    a = t.sales.groupBy("date", "hour").agg(F.avg("cents").alias("temp_hr"))
    return joins.prefer(spine, a, t.hour_weather, ["date", "hour"], ["temp_hr"], "temp_hr", ("orders", "lines"))


_HELD = """SELECT d.poi_id, d.date, COALESCE(w.v, {inside} l.v, 0) AS live, w.v IS NULL AS held FROM day_fact d
    LEFT JOIN (SELECT poi_id, week_start, visit_counts AS v FROM poi_week WHERE week_start < DATE '2024-01-15') w
      ON w.poi_id = d.poi_id AND w.week_start = CAST(date_trunc('week', d.date) AS DATE)
    LEFT JOIN (SELECT poi_id, arg_max(visit_counts, week_start) AS v FROM poi_week WHERE week_start < DATE '2024-01-15' GROUP BY 1) l ON l.poi_id = d.poi_id"""


def _weekly_live(t):
    weekly = t.patterns.filter(F.col("week_start") < F.lit("2024-01-15").cast("date"))
    return weekly.select("poi_id", "week_start", F.col("visit_counts").alias("live"))


@query("held_coverage", "J19 P29", "poi_id l, date d, live l, held b", _HELD.format(inside=""))
def _(t):
    return joins.carry_forward(t.day_fact.drop("visits"), _weekly_live(t), ["poi_id"], "live")


@query("held_coverage_zero_inside", "J19 P29", "poi_id l, date d, live l, held b",
       _HELD.format(inside="CASE WHEN date_trunc('week', d.date) <= DATE '2024-01-08' THEN 0 END,"))
def _(t):
    return joins.carry_forward(t.day_fact.drop("visits"), _weekly_live(t), ["poi_id"], "live", zero_inside=True)


# -- aggregates ---------------------------------------------------------------------------


@query("filtered_aggregates", "AG2 AG3", "status s, n l, urgent_cents l, customers l, urgent_customers l, day_customers l", """
    SELECT o_orderstatus AS status, COUNT(*) AS n, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent_cents,
           COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS urgent_customers,
           COUNT(DISTINCT (o_custkey, o_orderdate)) AS day_customers FROM orders GROUP BY 1""")
def _(t):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return t.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), stats.sum_if(urgent, F.round(F.col("o_totalprice") * 100).cast("long")).alias("urgent_cents"),
        F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(urgent, F.col("o_custkey"))).alias("urgent_customers"),
        F.countDistinct("o_custkey", "o_orderdate").alias("day_customers"))


@query("duplicate_keys", "AG3 Q3", "n_rows l, n_keys l, n_duplicates l", """
    SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (o_custkey, o_orderdate)) AS n_keys, COUNT(*) - COUNT(DISTINCT (o_custkey, o_orderdate)) AS n_duplicates FROM orders""")
def _(t):
    return aggregates.duplicate_count(t.table("orders"), ["o_custkey", "o_orderdate"])


@query("having_with_scalar", "AG5", "poi_id l, weeks l", """
    SELECT poi_id, COUNT(DISTINCT week_start) AS weeks FROM poi_week GROUP BY 1
    HAVING COUNT(DISTINCT week_start) >= ceil(0.95 * (SELECT COUNT(DISTINCT week_start) FROM poi_week))""")
def _(t):
    w = t.patterns.select("poi_id", "week_start")
    total = w.agg(F.countDistinct("week_start").alias("total"))
    per = w.groupBy("poi_id").agg(F.countDistinct("week_start").alias("weeks"))
    return per.join(F.broadcast(total)).filter(F.col("weeks") >= F.ceil(0.95 * F.col("total")))


@query("string_listing", "AG6 AG4", "date d, details s, kind s", """
    SELECT CAST(ts AS DATE) AS date, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS details, arg_max(event_type, event_id) AS kind
    FROM events GROUP BY 1""")
def _(t):
    e = t.table("events").withColumn("date", F.to_date("ts"))
    listed = aggregates.distinct_listing(e, ["date"], F.col("event_type"), "details")
    return listed.join(e.groupBy("date").agg(F.max_by("event_type", "event_id").alias("kind")), "date")


@query("peak_hour", "AG7 OR2", "date d, peak l", """
    SELECT date, arg_max(hour, v * 100 - hour) AS peak FROM (SELECT date, hour, SUM(visitor_hours) AS v FROM hour_fact GROUP BY ALL) GROUP BY 1""")
def _(t):
    by = t.hour_fact.groupBy("date", "hour").agg(F.sum("visitor_hours").alias("v"))
    return by.groupBy("date").agg(F.max_by("hour", F.struct("v", -F.col("hour"))).alias("peak"))


@query("exact_quantiles", "AG8", "flag s, q1 f6, median f6, p95 f6, p99 f6, p999 f6", """
    SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.95) AS p95,
           quantile_cont(l_extendedprice, 0.99) AS p99, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY 1""")
def _(t):
    rows = t.table("lineitem").withColumnRenamed("l_returnflag", "flag")
    return aggregates.exact_quantiles(rows, "l_extendedprice", {"q1": 0.25, "median": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}, ["flag"])


@query("signed_quantiles", "AG8", "p1 f6, median f6, p99 f6", """
    SELECT quantile_cont(c_acctbal, 0.01) AS p1, median(c_acctbal) AS median, quantile_cont(c_acctbal, 0.99) AS p99 FROM customer""")
def _(t):
    return aggregates.exact_quantiles(t.table("customer"), "c_acctbal", {"p1": 0.01, "median": 0.5, "p99": 0.99})


@query("small_quantiles", "AG8", "status s, p1 f12, q1 f12, median f12, p999 f12", """
    SELECT l_linestatus AS status, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.999) AS p999
    FROM (SELECT l_linestatus, 1 / (l_extendedprice * 10 + l_suppkey) AS v FROM lineitem) GROUP BY 1""")
def _(t):
    rows = t.table("lineitem").select(F.col("l_linestatus").alias("status"), (1 / (F.col("l_extendedprice") * 10 + F.col("l_suppkey"))).alias("v"))
    return aggregates.exact_quantiles(rows, "v", {"p1": 0.01, "q1": 0.25, "median": 0.5, "p999": 0.999}, ["status"])


@query("regression_aggregates", "AG9 AG10", "flag s, r f6, slope f6, intercept f3, mean f4, sd f4, se f6, t f3", """
    SELECT l_returnflag AS flag, corr(l_extendedprice, l_quantity) AS r, regr_slope(l_extendedprice, l_quantity) AS slope,
           regr_intercept(l_extendedprice, l_quantity) AS intercept, AVG(l_quantity) AS mean, stddev_samp(l_quantity) AS sd,
           stddev_samp(l_quantity) / sqrt(COUNT(*)) AS se, AVG(l_quantity) / (stddev_samp(l_quantity) / sqrt(COUNT(*))) AS t FROM lineitem GROUP BY 1""")
def _(t):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.corr(y, x).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"), stats.std_error(x).alias("se"), stats.t_statistic(x).alias("t"))


@query("weighted_means", "AG12", "flag s, price f6", """
    SELECT l_returnflag AS flag, SUM(l_extendedprice * l_quantity) / SUM(l_quantity) AS price FROM lineitem GROUP BY 1""")
def _(t):
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        stats.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"))


@query("shape_statistics", "AG13", "n l, zeros l, zero_rate f6, mean f6, max f2, skew f6, log_mean f6, log_skew f6", """
    SELECT COUNT(*) AS n, COUNT(*) FILTER (v = 0) AS zeros, AVG(CAST(v = 0 AS INT)) AS zero_rate, AVG(v) AS mean, MAX(v) AS max,
           (SUM(pow(v - m, 3)) / COUNT(*)) / pow(SUM(pow(v - m, 2)) / COUNT(*), 1.5) AS skew, AVG(ln(1 + v)) AS log_mean,
           (SUM(pow(ln(1 + v) - lm, 3)) / COUNT(*)) / pow(SUM(pow(ln(1 + v) - lm, 2)) / COUNT(*), 1.5) AS log_skew
    FROM (SELECT visitor_hours AS v FROM ring_hour), (SELECT AVG(visitor_hours) AS m, AVG(ln(1 + visitor_hours)) AS lm FROM ring_hour)""")
def _(t):
    return aggregates.shape_row(t.ring_hour, "visitor_hours")


@query("null_counts", "AG14", "column s, n_null l", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_null FROM calendar"
    for c in ("date", "n_games", "attendance", "day_night", "first_hour", "venue_event", "rival_event", "convention_event", "citywide_event", "fair_event")))
def _(t):
    names = ["date", "n_games", "attendance", "day_night", "first_hour", "venue_event", "rival_event", "convention_event", "citywide_event", "fair_event"]
    return aggregates.null_counts(t.calendar.select(*names))


@query("histograms", "AG15", "kind s, bin l, n l", """
    SELECT 'linear' AS kind, CAST(least(floor(l_quantity / 5.0::DOUBLE), 9) AS BIGINT) AS bin, COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL
    UNION ALL SELECT 'log', CAST(floor(log10(l_extendedprice) * 4) AS BIGINT), COUNT(*) FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL""")
def _(t):
    i = t.table("lineitem")
    return aggregates.linear_histogram(i, "l_quantity", 0.0, 5.0, 10).withColumn("kind", F.lit("linear")).unionByName(
        aggregates.log_histogram(i, "l_extendedprice").withColumn("kind", F.lit("log")))


@query("scalar_bundle", "AG16", "orders l, lines l, customers l", """
    SELECT (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(*) FROM lineitem) AS lines, (SELECT COUNT(*) FROM customer) AS customers""")
def _(t):
    n = lambda name, alias: t.table(name).agg(F.count("*").alias(alias))
    return joins.one_row(n("orders", "orders"), n("lineitem", "lines"), n("customer", "customers"))


@query("labelled_group_means", "AG17", "ring_id l, group s, mean f6, n l", """
    SELECT ring_id, CASE WHEN game_day AND day_night = 'night' THEN 'event night' WHEN game_day THEN 'event day' ELSE 'control' END AS "group",
           AVG(visits) AS mean, COUNT(visits) AS n FROM ring_panel WHERE game_day OR clean_control GROUP BY ALL""")
def _(t):
    label = F.when(F.col("game_day") & (F.col("day_night") == "night"), "event night").when(F.col("game_day"), "event day").otherwise("control")
    return aggregates.group_means(t.ring_panel.filter("game_day or clean_control"), label, "visits", ["ring_id"])


# -- windows ---------------------------------------------------------------------------------


@query("latest_row_per_key", "W1", "o_custkey l, o_orderkey l, o_orderstatus s, o_totalprice f2", """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(t):
    return windows.latest_per_key(t.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("trailing_means", "W3 W4", "ring_id l, date d, k4 f6, cap f6, n_cap l", """
    SELECT ring_id, date, AVG(visits) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS k4,
           AVG(visits) OVER (w RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW) AS cap,
           COUNT(visits) OVER (w RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW) AS n_cap
    FROM ring_day WINDOW w AS (PARTITION BY ring_id, isodow(date) ORDER BY date)""")
def _(t):
    rows = t.ring_day.withColumn("dow", dates.iso_weekday(F.col("date")))
    out = windows.trailing_rows(rows, ["ring_id", "dow"], "date", "visits", 4, "k4")
    return windows.trailing_days(out, ["ring_id", "dow"], "date", "visits", 120, "cap", "n_cap")


@query("quarter_change", "W5", "series s, period s, change f9", """
    SELECT series, period, total / lag(total) OVER (PARTITION BY series ORDER BY period) - 1 AS change FROM quarter_totals""")
def _(t):
    return windows.change_ratio(t.quarter_totals, ["series"], "period", "total", "change")


@query("attendance_terciles", "W6", "date d, tercile s", """
    SELECT date, CASE ntile(3) OVER (ORDER BY attendance NULLS FIRST, date) WHEN 1 THEN 'low' WHEN 2 THEN 'mid' ELSE 'high' END AS tercile
    FROM (SELECT DISTINCT date, attendance FROM calendar WHERE game_day)""")
def _(t):
    return windows.tercile_labels(t.calendar.filter("game_day"), "attendance")


@query("partition_extremes", "W7", "o_orderkey l, n l, first_date d, last_date d, top f2", """
    SELECT o_orderkey, COUNT(*) OVER w AS n, CAST(MIN(o_orderdate) OVER w AS DATE) AS first_date, CAST(MAX(o_orderdate) OVER w AS DATE) AS last_date,
           MAX(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def _(t):
    o = t.table("orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.to_date(F.min("o_orderdate")).alias("first_date"),
                                     F.to_date(F.max("o_orderdate")).alias("last_date"), F.max("o_totalprice").alias("top"))
    return o.select("o_orderkey", "o_custkey").join(per, "o_custkey")


@query("share_of_day", "W8", "ring_id l, date d, share f9", """
    SELECT ring_id, date, cents / SUM(cents) OVER (PARTITION BY date) AS share FROM ring_day""")
def _(t):
    return windows.share_of_total(t.ring_day, ["date"], "cents", "share")


@query("demeaned_by_hour", "W10", "ring_id l, date d, hour l, net f9", """
    SELECT ring_id, date, hour, visitor_hours - AVG(visitor_hours) OVER (PARTITION BY hour) AS net FROM ring_hour""")
def _(t):
    return windows.demean(t.ring_hour, ["hour"], ["visitor_hours"]).withColumnRenamed("visitor_hours_net", "net")


@query("running_minimum", "W12", "series s, period s, low f2", """
    SELECT series, period, MIN(total) OVER (PARTITION BY series ORDER BY period) AS low FROM quarter_totals""")
def _(t):
    return windows.running_min(t.quarter_totals, ["series"], "period", "total", "low")


# -- order, sampling, set operations --------------------------------------------------------


@query("top_orders_per_segment", "OR3 OR1", "segment s, o_orderkey l, o_totalprice f2, rank l", """
    SELECT c_mktsegment AS segment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 8""")
def _(t):
    o = t.table("orders").join(t.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return windows.top_k(o.select("segment", "o_orderkey", "o_totalprice"), ["segment"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 8)


@query("next_event_dates", "OR3", "asked d, event_date d, rank l", """
    SELECT a.date AS asked, g.date AS event_date, row_number() OVER (PARTITION BY a.date ORDER BY g.date) AS rank
    FROM day_counts a JOIN (SELECT DISTINCT date FROM games) g ON g.date > a.date QUALIFY rank <= 3""")
def _(t):
    from ..operators.score import next_events
    return next_events(t.day_counts, t.games, 3)


@query("seeded_sample", "OR4", "o_orderkey l, o_totalprice f2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def _(t):
    return reshape.sample_rows(t.table("orders"), 100, ["o_orderkey"], seed=7)


@query("extreme_picks", "OR5", "stratum s, pick l, poi_id l", """
    SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY d, poi_id) AS pick, poi_id FROM (
      SELECT 'inner' AS stratum, poi_id, d FROM (SELECT poi_id, has_hourly, """ + FLAT + """ AS d FROM poi) WHERE d < 2500
      UNION ALL SELECT 'unreported', poi_id, d FROM (SELECT poi_id, has_hourly, """ + FLAT + """ AS d FROM poi) WHERE NOT has_hourly
      UNION ALL SELECT 'outer', poi_id, d FROM (SELECT poi_id, """ + FLAT + """ AS d FROM poi) WHERE d >= 5000) QUALIFY pick <= 3""")
def _(t):
    rows = t.poi.withColumn("d", geo.flat_distance("lat", "lon", *geo.VENUE))
    strata = {"inner": F.col("d") < 2500, "unreported": ~F.col("has_hourly"), "outer": F.col("d") >= 5000}
    return reshape.pick_extremes(rows, strata, [F.col("d"), F.col("poi_id")], 3)


@query("union_relabelled", "OP1 SRC12", "kind s, n l, cents l", """
    SELECT kind, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS cents FROM (SELECT 'order' AS kind, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
      UNION ALL SELECT 'line', CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem) GROUP BY 1""")
def _(t):
    a = t.table("orders").select(F.lit("order").alias("kind"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    b = t.table("lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.lit("line").alias("kind"))
    return reshape.union_all([a, b]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("distinct_union", "OP2", "date d", "SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def _(t):
    return t.table("orders").select(F.to_date("o_orderdate").alias("date")).union(
        t.table("lineitem").select(F.to_date("l_shipdate").alias("date"))).distinct()


@query("wide_to_long", "OP3", "ring_id l, date d, measure s, value f2", """
    SELECT ring_id, date, 'visits' AS measure, visits AS value FROM ring_day UNION ALL SELECT ring_id, date, 'cents', cents FROM ring_day""")
def _(t):
    return reshape.to_long(t.ring_day, ["ring_id", "date"], ["visits", "cents"])


@query("long_to_wide", "OP4", "date d, ring1 l, ring2 l, ring3 l, ring4 l, ring5 l", "SELECT date, " + ", ".join(
    f"MAX(visits) FILTER (ring_id = {i}) AS ring{i}" for i in range(1, 6)) + " FROM ring_day GROUP BY 1")
def _(t):
    return reshape.to_wide(t.ring_day, ["date"], "ring_id", [1, 2, 3, 4, 5], "visits", "ring")


@query("slice_fan_out", "OP5", "slice s, n l, attendance l", """
    SELECT slice, COUNT(*) AS n, CAST(SUM(attendance) AS BIGINT) AS attendance FROM (SELECT 'all' AS slice, attendance FROM games
      UNION ALL SELECT day_night, attendance FROM games UNION ALL SELECT game_type, attendance FROM games) GROUP BY 1""")
def _(t):
    s = reshape.slice_fan_out(t.games, {"dn": F.col("day_night"), "gt": F.col("game_type")})
    return s.groupBy("slice").agg(F.count("*").alias("n"), F.sum("attendance").alias("attendance"))


@query("folded_calendars", "J2 OP6", "date d, orders l, lines l, game_day b, temp f6", """
    SELECT c.date, a.n AS orders, b.n AS lines, c.game_day, w.temp FROM calendar c LEFT JOIN day_counts a USING (date)
    LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n FROM lineitem GROUP BY 1) b USING (date)
    LEFT JOIN (SELECT date, AVG(temp_hr) AS temp FROM hour_weather GROUP BY 1) w USING (date)""")
def _(t):
    lines = t.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("lines"))
    temp = t.hour_weather.groupBy("date").agg(F.avg("temp_hr").alias("temp"))
    return joins.fold_left(t.calendar.drop("opponents", "game_types"), [t.day_counts.withColumnRenamed("n", "orders"), lines, temp], ["date"])


