"""Readers and writers on given tables: written to the shared folder in each form, read back, and compared with the table."""

from __future__ import annotations

import shutil
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.text import sensor_number
from ..session import new_folder
from ..sources import feeds, files, sinks
from .registry import query
from .standins import Tables

CUSTOMER = "c_custkey long, c_mktsegment string, c_nationkey long, c_acctbal double"


@query("typed_csv", "SRC2", "c_custkey l, c_mktsegment s, c_nationkey l, c_acctbal f2", "SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer")
def _(t: Tables):
    path = new_folder(t.spark)
    t.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, CUSTOMER)


@query("dirty_csv_family", "SRC3", "month l, n l, n_value l, value f2, n_type l", """
    SELECT month(ts) AS month, COUNT(*) AS n, COUNT(*) FILTER (event_id % 7 <> 3) AS n_value,
           SUM(CASE event_id % 7 WHEN 3 THEN NULL WHEN 5 THEN 0 ELSE round(value, 2) END) AS value, COUNT(*) FILTER (event_id % 2 = 0 AND event_type IS NOT NULL) AS n_type
    FROM events GROUP BY 1""")
def _(t):
    """Two files with other columns; readings carry quality letters, trace marks and words."""
    e, path = t.table("events"), new_folder(t.spark)
    k, v = F.col("event_id") % 7, F.round("value", 2)
    reading = F.when(k == 3, "missing").when(k == 5, "T").when(k == 6, F.concat(v.cast("string"), F.lit("s"))).otherwise(v.cast("string"))
    rows = e.select("event_id", F.month("ts").alias("month"), reading.alias("reading"), "event_type")
    rows.filter("event_id % 2 = 0").select("month", "reading", "event_type").write.option("header", True).csv(f"{path}/a")
    rows.filter("event_id % 2 = 1").select("reading", "month").write.option("header", True).csv(f"{path}/b")
    got = files.read_text_columns(t.spark, [f"{path}/a", f"{path}/b"]).withColumn("number", sensor_number(F.col("reading")))
    return got.groupBy(F.col("month").cast("int").alias("month")).agg(F.count("*").alias("n"), F.count("number").alias("n_value"), F.sum("number").alias("value"),
                                                                    F.count("event_type").alias("n_type"))


@query("gzip_trips", "SRC4", "date d, hour l, origin s, destination s, n l, trips l", "SELECT date, hour, origin, destination, COUNT(*) AS n, SUM(trip_count) AS trips FROM od GROUP BY ALL")
def _(t):
    path = new_folder(t.spark)
    t.od.select("date", "hour", "origin", "destination", "trip_count").write.option("compression", "gzip").csv(path)
    return feeds.read_od_trips(t.spark, path).groupBy("date", "hour", "origin", "destination").agg(F.count("*").alias("n"), F.sum("trip_count").alias("trips"))


def _pack(folder: str):
    """Part files of a month into one archive, streamed; the archive gets its name when it is complete."""
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        fs, root = feeds.file_system(folder)
        fs.create_dir(root, recursive=True)
        name, paths = f"{root}/{parts.month[0]}-trips.zip", sorted(parts.path)
        draft = f"{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(draft, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for k, path in enumerate(paths):
                with fs.open_input_stream(feeds.file_system(path)[1], compression=None) as part, archive.open(f"part-{k}.csv", "w", force_zip64=True) as member:
                    shutil.copyfileobj(part, member, 1 << 20)
        fs.move(draft, name)
        return pd.DataFrame({"archive": [name]})
    return run


@query("zipped_trips", "SRC5", "date d, n l, n_fix l, lat f4, hours l", """
    SELECT l_shipdate AS date, COUNT(*) AS n, COUNT(*) FILTER (l_linenumber <> 3) AS n_fix, SUM(CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS lat,
           SUM(l_linenumber) AS hours
    FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1999 GROUP BY 1""")
def _(t):
    """Trips of all months in archives of several members each; the months of five years are read."""
    path = new_folder(t.spark)
    began = F.col("l_shipdate").cast("timestamp")
    rows = t.table("lineitem").select(
        F.date_format("l_shipdate", "yyyyMM").alias("month"), F.concat(F.lit("r"), "l_orderkey").alias("ride_id"),
        F.date_format(began, "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format(began + F.make_dt_interval(F.lit(0), F.col("l_linenumber").cast("int")), "yyyy-MM-dd HH:mm:ss").alias("ended_at"),
        F.when(F.col("l_linenumber") == 3, "no fix").otherwise(F.col("l_quantity").cast("string")).alias("start_lat"), F.lit("-122.4").alias("start_lng"))
    rows.repartition("month", F.crc32("ride_id") % 4).write.partitionBy("month").option("header", True).csv(f"{path}/parts")
    parts = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(f"{path}/parts").select(
        "path", F.regexp_extract("path", "month=([0-9]+)", 1).alias("month"))
    archives = parts.filter("month <> ''").groupBy("month").applyInPandas(_pack(f"{path}/zip"), "archive string")
    archives.write.parquet(f"{path}/manifest")
    trips = feeds.read_zipped_trips(t.spark, f"{path}/zip", "199501", "199912")
    hours = (F.unix_timestamp(F.col("ended_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))) / 3600
    return trips.groupBy(F.to_date("started_at").alias("date")).agg(F.count("*").alias("n"), F.count("start_lat").alias("n_fix"), F.sum("start_lat").alias("lat"),
                                                                  F.sum(hours.cast("long")).alias("hours"))


@query("optional_inputs", "SRC13 SRC14 SRC15", "c_nationkey l, n l, with_phone l, from_absent l", """
    SELECT c_nationkey, COUNT(*) AS n, 0 AS with_phone, 0 AS from_absent FROM customer GROUP BY 1""")
def _(t):
    """A scan in place, a column that the table lacks and a table that is not there."""
    path = new_folder(t.spark)
    t.table("customer").write.parquet(path)
    here = files.read_parquet(t.spark, path)
    absent = files.optional_parquet(t.spark, f"{path}-absent", "c_nationkey long, c_custkey long").groupBy("c_nationkey").agg(F.count("*").alias("from_absent"))
    by = here.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count(files.optional_column(here, "c_mobile", "string")).alias("with_phone"))
    return by.join(absent, "c_nationkey", "left").withColumn("from_absent", F.coalesce("from_absent", F.lit(0)))


@query("replaced_years", "SNK1 SNK2", "year l, n l, total f2", """
    SELECT year(o_orderdate) AS year, COUNT(*) AS n, SUM(CASE WHEN year(o_orderdate) = 1998 THEN 2 ELSE 1 END * o_totalprice) AS total FROM orders
    WHERE NOT (year(o_orderdate) = 1998 AND o_orderkey % 2 = 1) GROUP BY 1""")
def _(t):
    """All years, then one year again with half its rows at twice the price; the table is then replaced as a whole by itself."""
    path = new_folder(t.spark)
    orders = t.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    sinks.write_by_year(orders, f"{path}/by_year")
    sinks.write_by_year(orders.filter("year(date) = 1998 AND o_orderkey % 2 = 0").withColumn("o_totalprice", 2 * F.col("o_totalprice")), f"{path}/by_year")
    for _ in range(2):
        sinks.write_table(t.spark.read.parquet(f"{path}/by_year"), f"{path}/whole", ["date"])
    return files.read_parquet(t.spark, f"{path}/whole").groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


class _Broken(Exception):
    pass


@query("resumed_landing", "SNK2 SNK3 SNK4", "name s, n_rows l, builds l, total f2, n_inputs_differ l", """
    SELECT 'by_segment' AS name, COUNT(DISTINCT c_mktsegment) AS n_rows, 1 AS builds, SUM(c_acctbal) AS total, 0 AS n_inputs_differ FROM customer
    UNION ALL SELECT 'by_nation', COUNT(DISTINCT c_nationkey), 2, SUM(c_acctbal), 0 FROM customer""")
def _(t):
    """The second table breaks the first run off; the next run keeps the first table and builds only the second."""
    path, builds = new_folder(t.spark), {"by_segment": 0, "by_nation": 0}
    source = f"{path}/source"
    t.table("customer").write.parquet(source)
    customers = t.spark.read.parquet(source)

    def built(name: str, key: str):
        def build():
            builds[name] += 1
            if (name, builds[name]) == ("by_nation", 1):
                raise _Broken
            return customers.groupBy(key).agg(F.sum("c_acctbal").alias("total"))
        return build

    tables = {"by_segment": built("by_segment", "c_mktsegment"), "by_nation": built("by_nation", "c_nationkey")}
    try:
        sinks.land_resumable(t.spark, f"{path}/gold", tables, [source], {"k": 1})
    except _Broken:
        assert sinks.landed(t.spark, f"{path}/gold") == {}
    manifest = sinks.land_resumable(t.spark, f"{path}/gold", tables, [source], {"k": 1})
    differ = len(manifest["inputs"]) - len([f for f in sinks.input_snapshot(t.spark, [source]) if f in manifest["inputs"]])
    rows = [df.agg(F.lit(name).alias("name"), F.lit(manifest["rows"][name]).alias("n_rows"), F.lit(builds[name]).alias("builds"), F.sum("total").alias("total"),
                   F.lit(differ).alias("n_inputs_differ")) for name, df in sinks.landed(t.spark, f"{path}/gold").items()]
    return rows[0].unionByName(rows[1])
