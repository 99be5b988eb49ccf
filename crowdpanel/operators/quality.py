"""Data checks as one-row DataFrames (name, kind, ok, detail).

Kinds: gate (a failure stops the build), expectation, crosscheck, skipped (never
counts as passed) and note. Checks stay lazy; ``run_checks`` evaluates a set of
them in one job and raises for failed gates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, flags, geo
from ..functions.arrays import weighted_keys
from ..functions.stats import count_if, ratio_of_sums
from .aggregates import duplicate_count, exact_quantiles
from .joins import by_week, one_row
from .reshape import union_all
from .windows import change_ratio

SCHEMA = "name string, kind string, ok boolean, detail string"
KINDS = ("gate", "expectation", "crosscheck", "skipped", "note")


def check(one: DataFrame, name: str, ok: Column, detail: Column, kind: str = "gate") -> DataFrame:
    """Turn a one-row aggregate into a check row; an unknown outcome is a failure."""
    return one.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.coalesce(ok, F.lit(False)).alias("ok"),
                      detail.cast("string").alias("detail"))


def skipped(df: DataFrame, name: str, why: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, "skipped", False, why)], SCHEMA)


def note(one: DataFrame, name: str, detail: Column) -> DataFrame:
    return check(one, name, F.lit(True), detail, "note")


def run_checks(checks: Sequence[DataFrame]) -> list:
    """Evaluate all checks (a few dozen rows) and raise for failed gates."""
    rows = union_all(checks).collect()
    failed = [r["name"] for r in rows if r["kind"] == "gate" and not r["ok"]]
    if failed:
        raise RuntimeError("failed gates: " + ", ".join(failed))
    return rows


def report(rows: Sequence) -> str:
    """Markdown by kind with a headline; skipped rows are listed, not counted as passed."""
    counted = [r for r in rows if r["kind"] not in ("skipped", "note")]
    lines = [f"# Checks: {sum(r['ok'] for r in counted)} of {len(counted)} passed", ""]
    for kind in KINDS:
        some = [r for r in rows if r["kind"] == kind]
        if some:
            lines += [f"## {kind}", "", "| name | ok | detail |", "|---|---|---|"]
            lines += [f"| {r['name']} | {'yes' if r['ok'] else 'no'} | {r['detail']} |" for r in some] + [""]
    return "\n".join(lines)


def shape(df: DataFrame, keys: Sequence[str], expected: Column, name: str) -> DataFrame:
    """Rows equal the product of the dimensions and no key repeats."""
    one = duplicate_count(df, keys)
    return check(one, name, (F.col("n_rows") == expected) & (F.col("n_duplicates") == 0),
                 F.format_string("%d rows, %d duplicates", "n_rows", "n_duplicates"))


def array_lengths(df: DataFrame, array: Column, length: int, name: str) -> DataFrame:
    one = df.agg(count_if(F.size(array) != length).alias("bad"))
    return check(one, name, F.col("bad") == 0, F.format_string("%d rows without %d slots", "bad", F.lit(length)))


def monday_weeks(df: DataFrame, week: str = "week_start", name: str = "monday_weeks") -> DataFrame:
    one = df.agg(count_if(F.weekday(week) != 0).alias("bad"))
    return check(one, name, F.col("bad") == 0, F.format_string("%d weeks off Monday", "bad"))


def total_tolerance(df: DataFrame, array_sum: str, total: str, limit: float = 5, name: str = "array_total") -> DataFrame:
    """99th percentile of the gap between array sum and reported total."""
    gaps = df.select(F.abs(F.col(array_sum) - F.col(total)).alias("gap"))
    return check(exact_quantiles(gaps, "gap", {"p99": 0.99}), name, F.col("p99") <= limit, F.format_string("p99 %.3f", "p99"))


def construction_stability(weekly: DataFrame, limit: float = 0.15, name: str = "construction") -> DataFrame:
    """Hourly over daily sums per quarter of the places hourly in every year: largest change."""
    years = weekly.agg(F.countDistinct(F.year("week_start")).alias("_years"))
    fixed = weekly.filter("has_hourly").groupBy("poi_id").agg(F.countDistinct(F.year("week_start")).alias("n")).join(
        F.broadcast(years)).filter(F.col("n") == F.col("_years"))
    rows = weekly.filter(F.col("has_hourly") & (F.col("daily_sum") > 0)).join(fixed.select("poi_id"), "poi_id", "left_semi")
    per = rows.groupBy(F.trunc("week_start", "quarter").alias("quarter")).agg(
        ratio_of_sums(F.col("hourly_sum"), F.col("daily_sum")).alias("ratio")).withColumn("all", F.lit(1))
    one = change_ratio(per, ["all"], "quarter", "ratio", "change").agg(
        F.coalesce(F.max(F.abs("change")), F.lit(0.0)).alias("worst"))
    return check(one, name, F.col("worst") <= limit, F.format_string("largest change %.4f", "worst"))


def sparse_integrity(fact: DataFrame, coverage: DataFrame, name: str = "sparse_integrity") -> DataFrame:
    """Sparse rows are positive and lie in a covered place-week."""
    covered = coverage.filter("has_hourly").select("poi_id", "week_start", F.lit(True).alias("_c"))
    one = by_week(fact, covered, ["poi_id"]).agg(
        count_if((F.col("visitor_hours") <= 0) | F.col("_c").isNull()).alias("bad"))
    return check(one, name, F.col("bad") == 0, F.format_string("%d bad rows", "bad"))


def coverage_floor(panel: DataFrame, share: str = "visit_share_covered", floor: float = 0.80, name: str = "coverage") -> DataFrame:
    """Worst ring median of the covered share (a ring holds one value per date)."""
    dated = panel.select("ring_id", "date", share).distinct()
    med = dated.groupBy("ring_id").agg(F.median(share).alias("m")).agg(F.min("m").alias("worst"))
    return check(med, name, F.col("worst") >= floor, F.format_string("worst ring median %.3f", "worst"))


def not_empty(df: DataFrame, where: Column, name: str) -> DataFrame:
    one = df.agg(count_if(where).alias("n"))
    return check(one, name, F.col("n") > 0, F.format_string("%d rows", "n"))


def none_missing(df: DataFrame, column: str, name: str) -> DataFrame:
    one = df.agg(count_if(F.col(column).isNull()).alias("n"))
    return check(one, name, F.col("n") == 0, F.format_string("%d missing", "n"))


def hourly_weather(hourly: DataFrame, daily: DataFrame, share: float = 0.95, limit: float = 4.0,
                   name: str = "weather") -> DataFrame:
    """Share of hours with a temperature, and p95 gap between hourly and daily maxima."""
    spans = hourly.agg((F.count("temp_hr") / ((F.datediff(F.max("date"), F.min("date")) + 1) * 24)).alias("share"))
    peaks = hourly.groupBy("date").agg(F.max("temp_hr").alias("m")).join(daily.select("date", "tmax"), "date")
    gap = peaks.agg(F.percentile(F.abs(F.col("m") - F.col("tmax")), 0.95).alias("p95"))  # one row per date
    return check(one_row(spans, gap), name, (F.col("share") >= share) & (F.col("p95") <= limit),
                 F.format_string("share %.4f, p95 gap %.2f", "share", "p95"), "expectation")


def orphan_dates(hours: DataFrame, days: DataFrame, flag: Column, name: str = "event_hours") -> DataFrame:
    """Dates with event hours that the day calendar does not flag."""
    lost = hours.select("date").distinct().join(days.filter(flag).select("date"), "date", "left_anti")
    return check(lost.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.format_string("%d orphan dates", "n"))


def local_time(hourly: DataFrame, starts: DataFrame, reach: int = 3, share: float = 0.80, name: str = "local_time") -> DataFrame:
    """The daily peak hour lies within ±reach of the start on most event dates."""
    peak = hourly.groupBy("date", "hour").agg(F.sum("visitor_hours").alias("v")).groupBy("date").agg(
        F.max_by("hour", F.struct("v", (-F.col("hour")).alias("early"))).alias("peak"))
    both = peak.join(starts.select("date", "first_hour"), "date")
    one = both.agg(F.avg((F.abs(F.col("peak") - F.col("first_hour")) <= reach).cast("double")).alias("share"))
    return check(one, name, F.col("share") >= share, F.format_string("share %.4f", "share"))


def hours_per_visit(weekly: DataFrame, lo: float = 2.5, hi: float = 6.0, name: str = "hours_per_visit") -> DataFrame:
    """Median weekly hours per visit of the venue's own rows."""
    ratios = weekly.select(F.try_divide(F.col("hourly_sum").cast("double"), F.nullif("daily_sum", F.lit(0))).alias("r"))
    return check(exact_quantiles(ratios, "r", {"m": 0.5}), name, F.col("m").between(lo, hi), F.format_string("median %.3f", "m"))


def venue_hours_per_visit(weekly: DataFrame, venue: str, lo: float = 2.5, hi: float = 6.0, name: str = "venue_hours_per_visit") -> DataFrame:
    """Median over weeks of the venue's hours per visit, all its rows of a week added up first.

    Only rows of that name with an hourly array count, and weeks with visits; without any the check fails.
    """
    own = weekly.filter((F.col("poi_name") == venue) & F.col("has_hourly"))
    weeks = own.groupBy("week_start").agg(F.sum("hourly_sum").alias("h"), F.sum("daily_sum").alias("v")).filter("v > 0")
    ratios = weeks.select((F.col("h").cast("double") / F.col("v")).alias("r"))
    span = ratios.agg(F.min("r").alias("least"), F.max("r").alias("most"))
    # a left join of one-row aggregates, as there is no median without weeks
    one = span.join(F.broadcast(exact_quantiles(ratios, "r", {"m": 0.5})), how="left", on=F.lit(True))
    text = F.format_string("median %.2f, weeks %.2f to %.2f", "m", "least", "most")
    return check(one, name, F.col("m").between(lo, hi), F.when(F.col("m").isNull(), "no weeks with visits").otherwise(text))


# Whole-hour buckets that a visit of each dwell class spans on average.
DWELL_HOURS = {"<5": 1.042, "5-20": 1.208, "21-60": 1.667, "61-240": 3.5, ">240": 6.0}


def dwell_agreement(df: DataFrame, dwell: str, hours: str, weights: dict[str, float] = DWELL_HOURS, min_corr: float = 0.85,
                    span: tuple[float, float] = (0.7, 1.4), name: str = "dwell") -> DataFrame:
    """Hours implied by dwell buckets against measured hours: correlation and ratio over rows that imply any."""
    implied = weighted_keys(F.from_json(dwell, "map<string,double>"), weights)
    one = df.select(implied.alias("i"), F.col(hours).cast("double").alias("h")).filter("i > 0").agg(
        F.corr("i", "h").alias("r"), F.try_divide(F.sum("h"), F.nullif(F.sum("i"), F.lit(0.0))).alias("q"))
    return check(one, name, (F.col("r") >= min_corr) & F.col("q").between(*span), F.format_string("r %.4f, ratio %.4f", "r", "q"),
                 "crosscheck")


def trip_lift(trips: DataFrame, calendar: DataFrame, lo: float, hi: float, name: str = "trip_lift") -> DataFrame:
    """Mean trips of event dates over other dates, within expected bounds."""
    both = trips.join(calendar.select("date", "game_day"), "date")
    mean = lambda c: F.avg(F.when(c, F.col("trips")))
    one = both.agg((mean(F.col("game_day")) / mean(~F.col("game_day"))).alias("lift"))
    return check(one, name, F.col("lift").between(lo, hi), F.format_string("lift %.4f", "lift"), "crosscheck")


# One mile, and the percent by which trips may rise on event dates.
MILE_M = 1609.344
TRIP_LIFT_PCT = (4.0, 16.0)


def trip_lift_near(trips: DataFrame, calendar: DataFrame, first: str, last: str, venue: Sequence[float] = geo.VENUE, radius_m: float = MILE_M,
                   bounds: tuple[float, float] = TRIP_LIFT_PCT, name: str = "trip_lift_near") -> DataFrame:
    """Percent by which daily trip starts within the radius rise on event dates of a span (a month), within bounds.

    Raw trips are measured, so that ring edges do not matter; trips without a fix do not count, nor do days without a
    start. Skipped if the span has no event dates or no others.
    """
    near = trips.filter(geo.haversine("start_lat", "start_lng", *venue) <= radius_m).withColumn("date", F.to_date("started_at"))
    daily = near.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("date").agg(F.count("*").alias("n"))
    both = daily.join(calendar.select("date", "game_day"), "date")
    one = both.agg(F.avg(F.when(F.col("game_day"), F.col("n"))).alias("on"), F.avg(F.when(~F.col("game_day"), F.col("n"))).alias("off"))
    one = one.withColumn("pct", 100 * (F.col("on") - F.col("off")) / F.col("off"))
    text = F.when(F.col("pct").isNull(), "no contrast of dates").otherwise(F.format_string("lift %.2f percent", "pct"))
    return one.select(F.lit(name).alias("name"), F.when(F.col("pct").isNull(), "skipped").otherwise("gate").alias("kind"),
                      F.coalesce(F.col("pct").between(*bounds), F.lit(False)).alias("ok"), text.alias("detail"))


def external_series(own: DataFrame, other: DataFrame | None, value: str = "value", min_corr: float = 0.90,
                    name: str = "external") -> DataFrame:
    """Correlation of two dated series; skipped when the other is absent or shares no date."""
    if other is None:
        return skipped(own, name, "series not readable")
    both = own.select("date", F.col(value).alias("a")).join(other.select("date", F.col(value).alias("b")), "date")
    one = both.agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    kind = F.when(F.col("n") == 0, "skipped").otherwise("crosscheck")
    text = F.when(F.col("n") == 0, "no shared dates").otherwise(F.format_string("r %.4f on %d dates", "r", "n"))
    return check(one, name, F.col("r") >= min_corr, text, "crosscheck").drop("kind").join(
        F.broadcast(one.select(kind.alias("kind")))).select("name", "kind", "ok", "detail")


def at_least(one: DataFrame, column: str, floor: float, name: str, kind: str = "gate") -> DataFrame:
    return check(one, name, F.col(column) >= floor, F.concat(F.lit(f"{column} "), F.col(column).cast("string")), kind)


def study_expectations(study: DataFrame, measure: str) -> DataFrame:
    """Core lift positive with t > 4, decay inward, one row each."""
    rows = study.filter((F.col("measure") == measure) & (F.col("slice") == "all"))
    one = rows.agg(F.max(F.when(F.col("ring_id") == 1, F.col("mean_lift"))).alias("core"),
                   F.max(F.when(F.col("ring_id") == 1, F.col("se_lift"))).alias("se"),
                   F.max(F.when(F.col("ring_id") == 1, F.col("mean_lift_pct"))).alias("inner"),
                   F.max(F.when(F.col("ring_id") == 5, F.col("mean_lift_pct"))).alias("outer"))
    t = F.try_divide(F.col("core"), F.nullif("se", F.lit(0.0)))
    return union_all([
        check(one, "core_lift_positive", F.col("core") > 0, F.format_string("core %.1f", "core"), "expectation"),
        check(one, "core_significant", t > 4, F.format_string("t %.2f", t), "expectation"),
        check(one, "decay_inward", F.col("inner") > F.col("outer"), F.format_string("%.2f against %.2f", "inner", "outer"), "expectation")])


def hourly_expectations(study: DataFrame, measure: str, inner: int = 1, outer: int = 5) -> DataFrame:
    """Peak near the start at the core, outer ring mean t below 2."""
    rows = study.filter((F.col("measure") == measure) & (F.col("slice") == "all"))
    order = F.struct("effect", -F.col("relative_hour"))
    one = rows.agg(F.max_by(F.when(F.col("ring_id") == inner, F.col("relative_hour")),
                            F.when(F.col("ring_id") == inner, order)).alias("peak"),
                   F.avg(F.when(F.col("ring_id") == outer, F.col("t"))).alias("t"))
    return union_all([
        check(one, "peak_at_start", F.col("peak").between(-1, 2), F.format_string("peak %d", "peak"), "expectation"),
        check(one, "outer_null", F.col("t") < 2, F.format_string("mean t %.2f", "t"), "expectation")])


def graph_gates(nodes: DataFrame, edges: DataFrame, k: int, min_share: float = 0.0, name: str = "graph") -> DataFrame:
    """No self loops, every node with at least k edges, share of nodes with an edge."""
    loops = edges.agg(count_if(F.col("src") == F.col("dst")).alias("loops"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("deg"))
    per = nodes.select("node_id").join(ends, "node_id", "left").agg(
        F.count("*").alias("n"), F.min(F.coalesce("deg", F.lit(0))).alias("lo"), F.avg(F.col("deg").isNotNull().cast("double")).alias("share"))
    one = one_row(loops, per)
    return check(one, name, (F.col("loops") == 0) & (F.col("lo") >= k) & (F.col("share") >= min_share),
                 F.format_string("%d nodes, %d loops, min degree %d, share %.4f", "n", "loops", "lo", "share"))


def same_count(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    one = one_row(a.agg(F.count("*").alias("a")), b.agg(F.count("*").alias("b")))
    return check(one, name, F.col("a") == F.col("b"), F.format_string("%d and %d rows", "a", "b"))


def split_boundaries(spine: DataFrame, splits=dates.SPLITS, name: str = "split_leak") -> DataFrame:
    """Rows whose split label differs from the one their date implies."""
    wrong = flags.differs(F.col("split"), dates.split_label(F.col("date"), splits))
    one = spine.agg(count_if(wrong).alias("bad"), count_if(wrong & F.col("game_day")).alias("events"))
    return check(one, name, F.col("bad") == 0, F.format_string("%d rows, %d of events", "bad", "events"))


def rebuild_matches(panel: DataFrame, expected: dict[str, float], tolerance: float = 0.01, name: str = "rebuild") -> DataFrame:
    """Units, rows and non-zero share against expected values."""
    one = panel.agg(F.countDistinct("unit_id").alias("units"), F.count("*").alias("rows"),
                    F.avg((F.col("person_hours") > 0).cast("double")).alias("nonzero"))
    ok = F.lit(True)
    for key, value in expected.items():
        near = F.abs(F.col(key) - value) <= tolerance if key == "nonzero" else F.col(key) == value
        ok = ok & near
    return check(one, name, ok, F.format_string("%d units, %d rows, %.4f non-zero", "units", "rows", "nonzero"))


def overlap_identical(original: DataFrame, extended: DataFrame, keys: Sequence[str], columns: Sequence[str],
                      tolerance: float = 1e-12, name: str = "overlap") -> DataFrame:
    """The extended table equals the original wherever the original has rows."""
    a = original.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in columns])
    b = extended.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in"))
    bad = F.col("_in").isNull()
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        bad = bad | ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    one = a.join(b, list(keys), "left").agg(F.count("*").alias("n"), count_if(bad).alias("bad"))
    return check(one, name, F.col("bad") == 0, F.format_string("%d of %d rows differ", "bad", "n"))


def response_order(bands: DataFrame, name: str = "response_order") -> DataFrame:
    """Band lifts do not rise with distance unless the intervals overlap; a band without an interval overlaps none.

    Bands follow the number in their label, then the label.
    """
    w = Window.orderBy(F.regexp_extract("band", r"(\d+)", 1).try_cast("int"), "band")  # a handful of bands
    prev, prev_lo, prev_hi = F.lag("did").over(w), F.lag("lo").over(w), F.lag("hi").over(w)
    overlap = F.coalesce((prev_lo <= F.col("hi")) & (F.col("lo") <= prev_hi), F.lit(False))
    rising = bands.withColumn("up", (F.col("did") > prev + 1e-9) & ~overlap)
    return check(rising.agg(count_if(F.col("up")).alias("n")), name, F.col("n") == 0, F.format_string("%d rises", "n"), "expectation")
