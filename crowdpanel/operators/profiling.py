"""Profiles of panels and of whole table folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.stats import count_if, ratio_of_sums, share_if
from .aggregates import exact_quantiles, shape_row
from .joins import one_row
from .reshape import sample_rows, union_all
from .windows import demean

# Quantile ladder of the target profile, words in names of date columns.
LADDER = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99, "q999": 0.999}
DATE_HINTS = ("date", "datetime", "timestamp", "ts", "day", "time")


def missingness(df: DataFrame, structural: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Columns with NULLs: count, part a design rule explains, remaining gap, reason."""
    null = lambda c: F.col(c).isNull()
    rule = lambda c: structural[c][1] if c in structural else F.lit(False)
    reason = lambda c: structural[c][0] if c in structural else "no design predicate"
    one = df.agg(F.count("*").alias("_n"), *[F.struct(count_if(null(c)).alias("n_null"),
                                                      count_if(null(c) & rule(c)).alias("structural")).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n_null"), F.col(f"{c}.structural"),
                                         F.lit(reason(c)).alias("reason")) for c in df.columns]))
    flat = one.select("_n", cells.alias("x")).select("_n", "x.*").filter("n_null > 0")
    gap = F.col("n_null") - F.col("structural")
    return flat.select("column", "n_null", (F.col("n_null") / F.col("_n")).alias("null_rate"), "structural", gap.alias("gap"),
                       (gap / F.col("_n")).alias("gap_rate"), "reason")


def target_profile(df: DataFrame, value: str) -> DataFrame:
    """Shape of a target raw and after log1p, with exact quantiles."""
    shape = shape_row(df, value)
    ladder = exact_quantiles(df, value, LADDER)
    return one_row(shape, ladder).withColumn("log_median", F.log1p("median"))


def split_profile(panel: DataFrame, value: str = "person_hours") -> DataFrame:
    """Per split: window, rows, means, zero rate, coverage, event share."""
    v = F.col(value)
    return panel.groupBy("split").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_rows"), F.avg(v).alias("mean"),
        F.avg(F.log1p(v)).alias("mean_log"), share_if(v == 0).alias("zero_rate"),
        ratio_of_sums(F.col("n_poi_reporting"), F.col("n_poi")).alias("coverage"), share_if(F.col("game_day")).alias("event_share"))


def _corr(x: str, y: str) -> Column:
    """Correlation of two columns without NULLs; NULL where one of them is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, target: str, columns: Sequence[str], group: str = "hour", n: int | None = None,
                 key: Sequence[str] = ("unit_id", "date", "hour"), seed: int = 0, log: bool = True) -> DataFrame:
    """(column, n, r, r_net): correlation with the target, raw and net of group means; the target is log1p unless ``log`` is off.

    Pairs with a NULL drop out. Net of itself the group column has no correlation (NULL). ``n`` takes a seeded sample of rows first.
    """
    rows = sample_rows(df, n, key, seed) if n else df
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    y = F.col(target).cast("double")
    long = rows.select(group, (F.log1p(y) if log else y).alias("y"), cells.alias("c")).select(group, "y", "c.*").filter(
        "x is not null and y is not null")
    net = demean(long, ["column", group], ["x", "y"])
    return net.groupBy("column").agg(F.count("*").alias("n"), _corr("x", "y").alias("r"),
                                     F.when(F.col("column") != group, _corr("x_net", "y_net")).alias("r_net"))


def date_column(df: DataFrame) -> str | None:
    """A date or timestamp column by type, then one whose name hints at it."""
    typed = [c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    if typed:
        return typed[0]
    named = [c for c in df.columns if any(h in c.lower() for h in DATE_HINTS)]
    return named[0] if named else None


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """(table, column, type, n_rows, n_null, null_rate, first, last) from one pass."""
    when = date_column(df)
    ends = [F.min(when).cast("string").alias("_lo"), F.max(when).cast("string").alias("_hi")] if when else [
        F.lit(None).cast("string").alias("_lo"), F.lit(None).cast("string").alias("_hi")]
    one = df.agg(F.count("*").alias("n_rows"), *ends, *[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("n_null"),
                                         (F.lit(c) == F.lit(when or "")).alias("is_date")) for c, t in df.dtypes]))
    flat = one.select("n_rows", "_lo", "_hi", cells.alias("x"))
    return flat.select(F.lit(name).alias("table"), "x.column", "x.type", "n_rows", "x.n_null",
                       F.try_divide(F.col("x.n_null"), F.col("n_rows")).alias("null_rate"),
                       F.when(F.col("x.is_date"), F.col("_lo")).alias("first"), F.when(F.col("x.is_date"), F.col("_hi")).alias("last"))


def profile_tables(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Profiles of several Parquet tables and the errors of those that cannot be read."""
    parts, errors = [], {}
    for name, path in paths.items():
        try:
            parts.append(table_profile(spark.read.parquet(path), name))
        except Exception as exc:  # noqa: BLE001 - one bad table must not hide the others
            errors[name] = str(exc).splitlines()[0]
    return (union_all(parts) if parts else None), errors


def folder_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Part files rolled up to datasets: paths right below ``root``, files, bytes and rows.

    A dataset is named by its path without ``.parquet``, be that path a file or a folder of parts with any names.
    A file below folders that are no datasets (neither ``name.parquet`` nor holding parts or partitions) is a dataset by itself.
    Listing reads file names and sizes only. Row counts come from a metadata-only
    aggregate over the Parquet footers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(root).select("path", "length", "modificationTime")
    # up to the outermost folder called *.parquet, or else to the folder of partitions and part files, or the file itself
    whole = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(.*?/[^/]+\.parquet)/", 1), F.lit("")),
                                 F.regexp_extract(p, r"^(.*?/[^/]+?)(?:/[^/]*=[^/]*)*(?:/part-[^/]*)?$", 1))
    dataset = lambda p: F.regexp_extract(whole(p), r"([^/]+?)(?:\.parquet)?$", 1)
    sizes = files.groupBy(dataset(F.col("path")).alias("dataset")).agg(
        F.countDistinct(whole(F.col("path"))).alias("n_paths"), F.count("*").alias("n_files"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("last_modified"))
    rows = spark.read.format("parquet").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(
        "_none int").load(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    counts = rows.groupBy(dataset(F.col("path")).alias("dataset")).agg(F.sum("n").alias("n_rows"))
    return sizes.join(counts, "dataset", "left")


def monthly_level(panel: DataFrame, value: str = "person_hours") -> DataFrame:
    return panel.groupBy(dates.month_start(F.col("date")).alias("month")).agg(
        F.avg(value).alias("mean"), ratio_of_sums(F.col("n_poi_reporting"), F.col("n_poi")).alias("coverage"))


def weekly_drift(panel: DataFrame, value: str = "person_hours") -> DataFrame:
    """Weekly mean log level and zero rate, with the split the week starts in."""
    v = F.col(value)
    return panel.groupBy(dates.week_start(F.col("date")).alias("week_start")).agg(
        F.avg(F.log1p(v)).alias("mean_log"), share_if(v == 0).alias("zero_rate"), F.min_by("split", "date").alias("split"))


def diurnal_profile(panel: DataFrame, band: Column, value: str = "person_hours") -> DataFrame:
    """Mean by band, hour and group (night, day, control) with percent gap to control."""
    group = (F.when(F.col("game_day") & (F.col("day_night") == "night"), "night")
             .when(F.col("game_day") & (F.col("day_night") == "day"), "day").otherwise("control"))
    rows = panel.filter(F.col("game_day") | F.col("clean_control"))
    means = rows.groupBy(band.alias("band"), "hour", group.alias("group")).agg(F.avg(value).alias("mean"))
    base = means.filter(F.col("group") == "control").select("band", "hour", F.col("mean").alias("_base"))
    return means.join(base, ["band", "hour"], "left").withColumn(
        "gap_pct", 100 * (F.try_divide(F.col("mean"), F.nullif("_base", F.lit(0.0))) - 1)).drop("_base")


def covariate_balance(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardised mean difference, event against clean days, one row per covariate.

    ``days`` may repeat a date; its weekend covariate counts Friday, unlike the
    matching strata.
    """
    dated = days.dropDuplicates(["date"]).withColumn("weekend_fri", (dates.iso_weekday(F.col("date")) >= 5))
    names = [*columns, "weekend_fri"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in names]))
    long = dated.select("game_day", "clean_control", cells.alias("c")).select("game_day", "clean_control", "c.*")
    g, c = F.when(F.col("game_day"), F.col("x")), F.when(F.col("clean_control"), F.col("x"))
    s = long.groupBy("covariate").agg(F.avg(g).alias("mean_event"), F.avg(c).alias("mean_control"),
                                      F.stddev_samp(g).alias("_sg"), F.stddev_samp(c).alias("_sc"))
    pooled = F.sqrt((F.col("_sg") * F.col("_sg") + F.col("_sc") * F.col("_sc")) / 2)
    smd = F.when(pooled == 0, 0.0).otherwise((F.col("mean_event") - F.col("mean_control")) / pooled)
    return s.select("covariate", "mean_event", "mean_control", smd.alias("smd"))


def to_markdown(small: DataFrame, title: str) -> str:
    """Report of a small profile table."""
    rows = small.collect()
    cell = lambda v: "" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v))
    head = ["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns)]
    return "\n".join([f"## {title}", "", *head, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n"
