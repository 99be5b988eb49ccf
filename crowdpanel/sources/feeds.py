"""Readers of the landed feeds: trips, sales, schedules, spend index, stations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable_table

# Column layouts, category code and the day/night boundary.
OD_SCHEMA = "date date, hour tinyint, origin string, destination string, trip_count int"
TRIP_COLUMNS = ("started_at", "ended_at", "start_lat", "start_lng", "end_lat", "end_lng")
SALES_SCHEMA = ("value array<struct<County:string,BusinessGroupCode:string,BusinessType:string,CalendarYear:string,"
                "Quarter:string,TaxableTransactions:string,DisclosureFlag:string>>")
SCHEDULE_SCHEMA = ("struct<dates:array<struct<games:array<struct<gamePk:bigint,gameDate:string,"
                   "teams:struct<home:struct<team:struct<id:bigint,name:string>>,away:struct<team:struct<id:bigint,name:string>>>,"
                   "venue:struct<name:string>,gameInfo:struct<attendance:bigint>>>>>>")
FOOD_SERVICES = "C08"
NIGHT_FROM_HOUR = 17


def read_od_trips(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Headerless gzip OD files. A gzip file is one task, so rows are spread afterwards."""
    df = spark.read.schema(OD_SCHEMA).option("header", False).csv([paths] if isinstance(paths, str) else list(paths))
    return df.repartition(partitions) if partitions else df.repartition("date", "hour")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _archive(path: str) -> zipfile.ZipFile:
    """A zip archive read by seeking, a megabyte at a time."""
    fs, name = file_system(path)
    return zipfile.ZipFile(io.BufferedReader(fs.open_input_file(name), 1 << 20))


def _csv_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _archive(path) as archive:
                names = [m for m in archive.namelist() if m.endswith(".csv") and not m.startswith("__MACOSX")]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], ["path", "member"])


def _member_rows(columns: Sequence[str], chunk_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"]):
                with _archive(path) as archive, archive.open(member) as handle:
                    try:
                        chunks = pd.read_csv(handle, dtype=str, on_bad_lines="skip", chunksize=chunk_rows)
                    except pd.errors.EmptyDataError:
                        continue
                    for chunk in chunks:
                        yield chunk.reindex(columns=columns).astype(object)  # plain strings: arrow-backed ones may come in pieces
    return run


def read_zipped_csv(archives: DataFrame, columns: Sequence[str], chunk_rows: int = 50_000) -> DataFrame:
    """The listed columns, as text, of all CSV members of the archives named in ``path``.

    A first job reads the table of contents at the end of each archive; then every member is a task of its own that
    seeks to it and unpacks it in chunks, so neither an archive nor a member is held in memory. Members without a listed
    column give NULLs, empty ones no rows; malformed lines are left out, and a broken archive stops the query.
    """
    members = durable_table(archives.select("path").mapInArrow(_csv_members, "path string, member string"))
    spread = members.repartition(max(1, members.count()))
    return spread.mapInPandas(_member_rows(list(columns), chunk_rows), ", ".join(f"{c} string" for c in columns))


def read_zipped_trips(spark: SparkSession, folder: str, first_month: str, last_month: str) -> DataFrame:
    """Monthly zip archives of CSV; months are picked by file-name prefix (YYYYMM)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")
    month = F.substring(F.element_at(F.split("path", "/"), -1), 1, 6)
    text = read_zipped_csv(files.filter(month.between(first_month, last_month)), TRIP_COLUMNS)
    casts: list[Column] = [F.col(c).try_cast("timestamp_ntz" if c.endswith("_at") else "double").alias(c) for c in TRIP_COLUMNS]
    return text.select(*casts)


def tidy_sales(payload: DataFrame) -> DataFrame:
    """OData payload rows to county x quarter x category dollars; 'Q3' becomes 3."""
    v = payload.select(F.explode("value").alias("v")).select("v.*")
    return v.select(F.col("County").alias("geography"), F.lit("county").alias("geo_level"),
                    F.col("BusinessGroupCode").alias("business_group_code"), F.col("BusinessType").alias("category"),
                    F.col("CalendarYear").cast("int").alias("year"),
                    F.regexp_replace("Quarter", "^Q", "").cast("tinyint").alias("quarter"),
                    F.col("TaxableTransactions").cast("bigint").alias("taxable_sales_usd"),
                    F.col("DisclosureFlag").alias("disclosure_flag"))


def read_sales(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return tidy_sales(spark.read.schema(SALES_SCHEMA).option("multiLine", True).json(path))


def food_services(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("business_group_code") == FOOD_SERVICES)


def _games(payload: DataFrame, text: str) -> DataFrame:
    days = payload.select(F.explode(F.from_json(text, SCHEDULE_SCHEMA)["dates"]).alias("d"))
    return days.select(F.explode("d.games").alias("g")).select("g.*")


def home_schedule(payload: DataFrame, team_id: int, text: str = "value", zone: str = "America/Los_Angeles") -> DataFrame:
    """Schedule JSON text to one row per home game with local date, hour and day/night."""
    home = _games(payload, text).filter(F.col("teams.home.team.id") == team_id)
    utc = F.to_timestamp_ntz(F.regexp_replace("gameDate", "Z$", ""))
    rows = home.withColumn("local", F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
    hour = F.hour("local")
    return rows.select(F.to_date("local").alias("date"), hour.cast("tinyint").alias("first_hour"), F.col("gamePk").alias("game_pk"),
                       F.col("teams.away.team.name").alias("opponent"), F.col("venue.name").alias("venue"),
                       F.when(hour < NIGHT_FROM_HOUR, "day").otherwise("night").alias("day_night"))


def home_attendance(payload: DataFrame, team_id: int, text: str = "value", zone: str = "America/Los_Angeles") -> DataFrame:
    """Same payload with attendance; games without any are dropped."""
    rows = _games(payload, text).filter((F.col("teams.home.team.id") == team_id) & (F.col("gameInfo.attendance") > 0))
    utc = F.to_timestamp_ntz(F.regexp_replace("gameDate", "Z$", ""))
    return rows.select(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)).alias("date"),
                       F.col("gameInfo.attendance").alias("attendance"))


def spend_index(raw: DataFrame, county: str, value: str = "spend_all") -> DataFrame:
    """Daily index of one county from an all-text table; '.' cells are dropped."""
    rows = raw.filter((F.col("countyfips") == county) & (F.col("freq") == "d"))
    day = F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")])
    return rows.select(day.alias("date"), F.col(value).try_cast("double").alias("spend_idx")).dropna(subset=["spend_idx"])


def station_dimension(stops: DataFrame) -> DataFrame:
    """Platform rows to one row per station: first name by stop id, mean position."""
    platforms = stops.filter(F.col("location_type") == 0)
    return platforms.groupBy(F.col("parent_station").alias("station")).agg(
        F.min_by("stop_name", "stop_id").alias("station_name"), F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"))
