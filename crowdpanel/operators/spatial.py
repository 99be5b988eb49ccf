"""Place tables: rings, grid units and last-known attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.stats import count_if
from .windows import latest_per_key

# Category code prefixes of the unit features.
FOOD_PREFIX = "722"
RETAIL_PREFIXES = ("44", "45")
LODGING_PREFIX = "721"


def poi_rings(patterns: DataFrame, first: str, last: str, venue: Sequence[float] = geo.VENUE,
              edges: Sequence[float] = geo.RING_EDGES_M) -> DataFrame:
    """One row per place: window weeks present, first and last week, distance, ring.

    Attributes come from the latest window week. Places outside every ring drop out.
    """
    rows = patterns.filter(dates.week_overlaps(F.col("week_start"), first, last))
    newest = lambda c: F.max_by(c, "week_start").alias(c)
    per_poi = rows.groupBy("poi_id").agg(
        newest("poi_name"), newest("category"), newest("lat"), newest("lon"),
        F.countDistinct("week_start").alias("weeks_present"),
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"))
    exact = geo.haversine("lat", "lon", *venue)
    return (per_poi.withColumn("ring_id", geo.ring_id(exact, edges))
            .withColumn("ring_label", geo.ring_label(exact, edges))
            .withColumn("dist_m", F.round(exact, 1))
            .filter(F.col("ring_id").isNotNull()))


def poi_dim(patterns: DataFrame) -> DataFrame:
    """Places at their last-known attributes with span and number of weeks."""
    latest = ["poi_name", "category", "lat", "lon"]
    packed = patterns.groupBy("poi_id").agg(
        F.max_by(F.struct(*latest), "week_start").alias("_row"),
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"),
        F.count("*").alias("weeks_present"))
    return packed.select("poi_id", *[F.col(f"_row.{c}").alias(c) for c in latest],
                         "first_week", "last_week", "weeks_present")


def assign_cells(poi: DataFrame, step: Sequence[float] = geo.GRID_STEP,
                 box: Sequence[float] = geo.GRID_BOX) -> DataFrame:
    """Places inside the box with their grid indexes and unit id."""
    inside = poi.filter(geo.in_box(F.col("lat"), F.col("lon"), box))
    gi, gj = geo.grid_index(F.col("lat"), step[0]), geo.grid_index(F.col("lon"), step[1])
    return inside.withColumn("gi", gi).withColumn("gj", gj).withColumn(
        "unit_id", geo.unit_key(F.col("gi"), F.col("gj")))


def grid_units(assigned: DataFrame, min_poi: int = 10, venue: Sequence[float] = geo.VENUE) -> DataFrame:
    """Unit features of the cells holding at least ``min_poi`` places."""
    code = F.col("category")
    retail = code.startswith(RETAIL_PREFIXES[0]) | code.startswith(RETAIL_PREFIXES[1])
    cells = assigned.groupBy("unit_id", "gi", "gj").agg(
        F.count("*").alias("n_poi"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        count_if(code.startswith(FOOD_PREFIX)).alias("n_food"),
        count_if(retail).alias("n_retail"),
        count_if(code.startswith(LODGING_PREFIX)).alias("n_lodging")).filter(F.col("n_poi") >= min_poi)
    return (cells.withColumn("food_share", F.col("n_food") / F.col("n_poi"))
            .withColumn("dist_m", geo.flat_distance("lat", "lon", *venue))
            .withColumn("bearing_deg", geo.bearing("lat", "lon", *venue)))


def poi_cell(assigned: DataFrame, units: DataFrame) -> DataFrame:
    """(poi_id, unit_id) of the kept units."""
    return assigned.select("poi_id", "unit_id").join(units.select("unit_id"), "unit_id", "left_semi")


def unit_coverage(assigned: DataFrame, units: DataFrame) -> DataFrame:
    """One row: places and cells seen, and how many sit in kept units."""
    per_cell = assigned.groupBy("unit_id").agg(F.count("*").alias("n")).join(
        units.select("unit_id", F.lit(True).alias("kept")), "unit_id", "left")
    kept = F.col("kept").isNotNull()
    return per_cell.agg(F.count("*").alias("n_cells"), count_if(kept).alias("n_kept_cells"),
                        F.sum("n").alias("n_poi"), F.sum(F.when(kept, F.col("n"))).alias("n_kept_poi"))


def poi_index(patterns: DataFrame, units: DataFrame, step: Sequence[float] = geo.GRID_STEP,
              box: Sequence[float] = geo.GRID_BOX) -> DataFrame:
    """Search index: named places in kept units, one per normalised name and address."""
    newest = latest_per_key(patterns, ["poi_id"], ["week_start"]).filter(F.col("poi_name").isNotNull())
    placed = assign_cells(newest, step, box).join(units.select("unit_id"), "unit_id", "left_semi")
    clean = placed.withColumn("name", F.trim("poi_name")).withColumn(
        "address", F.trim(F.coalesce("address", F.lit(""))))
    keyed = clean.groupBy(F.lower("name").alias("_n"), F.lower("address").alias("_a")).agg(
        F.min_by(F.struct("name", "address", "lat", "lon"), F.struct("name", "address", "poi_id")).alias("p"))
    return keyed.select("p.name", "p.address", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))
