"""Packed weekly arrays to sparse daily and hourly facts, and back checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dates

HOURS_PER_WEEK = 168


def pack_weeks(hourly: DataFrame, slots: int = HOURS_PER_WEEK, value: str = "visitor_hours") -> DataFrame:
    """(poi, week) rows with a JSON array text of 7 daily or 168 hourly slots."""
    day = F.weekday("date")
    slot = day if slots == 7 else day * 24 + F.col("hour")
    per_slot = (hourly.groupBy("poi_id", dates.week_start(F.col("date")).alias("week_start"), slot.alias("slot"))
                .agg(F.sum(value).alias("v")))
    entry = F.when(F.col("slot").between(0, slots - 1), F.struct("slot", "v"))  # hours that are none of the week's are left out
    filled = per_slot.groupBy("poi_id", "week_start").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # at most 168 entries
    # text between entries is repeated as a whole: a week costs its entries, not its slots
    before = lambda i: F.coalesce(F.get("e", i - 1)["slot"], F.lit(-1))
    pieces = F.transform("e", lambda e, i: F.concat(F.repeat(F.lit("0, "), (e["slot"] - before(i) - 1).cast("int")), F.coalesce(e["v"], F.lit(0)).cast("string"), F.lit(", ")))
    behind = F.lit(slots - 2) - F.coalesce(F.get("e", F.size("e") - 1)["slot"], F.lit(-1))  # zeros after the last entry, less the one without a comma
    text = F.concat(F.array_join(pieces, ""), F.repeat(F.lit("0, "), behind.cast("int")), F.when(behind >= 0, "0").otherwise(""))
    return filled.select("poi_id", "week_start", F.concat(F.lit("["), F.regexp_replace(text, ", $", ""), F.lit("]")).alias("packed"))


def explode_hours(patterns: DataFrame, text: str, value: str = "visitor_hours", strict: bool = True) -> DataFrame:
    """Sparse (poi, date, hour, value): slot i is day i div 24, hour i mod 24; zeros dropped.

    Filter places and weeks before this: it multiplies rows by up to 168.
    """
    slots = arrays.slots_strict(F.col(text)) if strict else arrays.slots_lenient(F.col(text))
    flat = patterns.select("poi_id", "week_start", F.posexplode(slots).alias("slot", value)).filter(F.col(value) > 0)
    return flat.select("poi_id", F.date_add("week_start", F.expr("int(slot div 24)")).alias("date"),
                       (F.col("slot") % 24).alias("hour"), value)


def explode_days(patterns: DataFrame, text: str, keep_zeros: bool = False) -> DataFrame:
    """(poi, date, visits) with the row's own array total and length."""
    slots = arrays.slots_lenient(F.col(text)) if keep_zeros else arrays.slots_strict(F.col(text))
    flat = patterns.withColumn("_s", slots).select(
        "poi_id", "week_start", arrays.slot_sum(F.col("_s")).alias("array_sum"), F.size("_s").alias("array_len"),
        F.posexplode("_s").alias("slot", "visits"))
    out = flat.select("poi_id", "week_start", F.date_add("week_start", F.col("slot")).alias("date"), "visits",
                      "array_sum", "array_len")
    return out if keep_zeros else out.filter(F.col("visits") > 0)


def occupancy(patterns: DataFrame, rings: DataFrame, first: str, last: str,
              text: str = "packed_hours") -> tuple[DataFrame, DataFrame]:
    """Sparse hourly occupancy of ringed places and POI-week coverage.

    Weeks must start inside the window. A week without an hourly array stays in
    the coverage table as not covered; nothing is imputed.
    """
    rows = patterns.filter(dates.between_dates(F.col("week_start"), first, last)).join(
        rings.select("poi_id"), "poi_id", "left_semi")
    coverage = rows.select("poi_id", "week_start", F.col(text).isNotNull().alias("has_hourly"), "visit_counts")
    return explode_hours(rows.filter(F.col(text).isNotNull()), text, strict=False), coverage


def balanced_units(coverage: DataFrame, opened: DataFrame, first: str, last: str, share: float = 0.95) -> DataFrame:
    """Places hourly in at least ceil(share x weeks) and open the whole window."""
    weeks = coverage.agg(F.countDistinct("week_start").alias("_weeks"))
    per_poi = coverage.groupBy("poi_id").agg(
        F.countDistinct(F.when(F.col("has_hourly"), F.col("week_start"))).alias("hourly_weeks"))
    enough = per_poi.join(F.broadcast(weeks)).filter(F.col("hourly_weeks") >= F.ceil(F.lit(share) * F.col("_weeks")))
    start = F.coalesce("open_date", F.lit("1900-01-01").cast("date")) <= F.lit(first).cast("date")
    end = F.coalesce("close_date", F.lit("9999-12-31").cast("date")) >= F.lit(last).cast("date")
    return enough.drop("_weeks").join(opened.filter(start & end).select("poi_id"), "poi_id", "left_semi")


def verify_alignment(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row comparing two builds of one fact: shared, equal, only left, only right."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    left, right = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count(F.when(left & right, 1)).alias("n_shared"),
                    F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("n_equal"),
                    F.count(F.when(left & ~right, 1)).alias("n_only_left"),
                    F.count(F.when(right & ~left, 1)).alias("n_only_right"))


def infill_hourly(daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """Daily visits spread by the pooled 24-slot shape, kept apart as imputed.

    The result mixes units (visits into hours), so it lands in its own column
    with ``is_imputed`` and is never added to measured hours.
    """
    by_hour = hourly.groupBy("hour").agg(F.sum("visitor_hours").alias("_h"))
    total = by_hour.agg(F.sum("_h").alias("_t"))
    shape = by_hour.join(F.broadcast(total)).select("hour", (F.col("_h") / F.col("_t")).alias("_share"))
    packed = shape.agg(F.collect_list(F.struct("hour", "_share")).alias("_shape"))  # at most 24 entries
    spread = daily.join(F.broadcast(packed)).select("poi_id", "date", "visits", F.inline("_shape"))
    return spread.select("poi_id", "date", "hour", F.round(F.col("visits") * F.col("_share"), 2).alias("imputed_hours"),
                         F.lit(True).alias("is_imputed"))
