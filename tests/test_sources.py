"""Readers and writers on landed files."""

import gzip
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from crowdpanel.operators import profiling
from crowdpanel.sources import feeds, files, sinks


def test_dirty_csv_family(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,T\n2,3\n")
    (tmp_path / "b.csv").write_text("y,z\n0.3s,q\n")
    got = files.read_text_columns(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert got.columns == ["x", "y", "z"] and got.count() == 3 and got.filter("z is null").count() == 2


def test_optional_inputs(spark, tmp_path):
    df = spark.range(2)
    got = df.select(files.optional_column(df, "id", "long").alias("a"), files.optional_column(df, "nope", "string").alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, None), (1, None)]
    empty = files.optional_parquet(spark, str(tmp_path / "none"), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]


def test_parquet_glob_skips_other_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "notes.txt").write_text("not parquet")
    assert files.read_parquet(spark, str(tmp_path / "t")).count() == 5


def test_gzip_od_trips(spark, tmp_path):
    with gzip.open(tmp_path / "2024.csv.gz", "wt") as f:
        f.write("2024-07-02,18,EMBR,MONT,7\n2024-07-02,19,EMBR,MONT,3\n")
    got = feeds.read_od_trips(spark, str(tmp_path / "2024.csv.gz"), partitions=2)
    assert got.agg(F.sum("trip_count")).first()[0] == 10 and got.first().date == date(2024, 7, 2)


def test_zipped_trips_pick_months(spark, tmp_path):
    for month, n in (("202401", 1), ("202402", 2), ("202403", 3)):
        body = "ride_id,started_at,ended_at,start_lat,start_lng,end_lat,end_lng\n" + "".join(
            f"r{i},2024-01-01 10:00:00,2024-01-01 10:09:00,37.7,-122.4,bad,-122.4\n" for i in range(n))
        with zipfile.ZipFile(tmp_path / f"{month}-trips.zip", "w") as z:
            z.writestr("trips.csv", body)
            z.writestr("__MACOSX/trips.csv", "junk")
    got = feeds.read_zipped_trips(spark, str(tmp_path), "202402", "202403").collect()
    assert len(got) == 5 and got[0].start_lat == 37.7 and got[0].end_lat is None


def test_sales_payload_and_its_empty_form(spark, tmp_path):
    row = {"County": "X", "BusinessGroupCode": "C08", "BusinessType": "Food", "CalendarYear": 2024, "Quarter": "Q3", "TaxableTransactions": 12, "DisclosureFlag": None}
    (tmp_path / "a.json").write_text(json.dumps({"value": [row, {**row, "BusinessGroupCode": "C01"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"value": []}))
    got = feeds.food_services(feeds.read_sales(spark, str(tmp_path / "a.json"))).collect()
    assert [(r.year, r.quarter, r.taxable_sales_usd) for r in got] == [(2024, 3, 12)]
    empty = feeds.read_sales(spark, str(tmp_path / "b.json"))
    assert empty.count() == 0 and dict(empty.dtypes)["quarter"] == "tinyint"


def test_home_schedule_is_local(spark):
    game = lambda home, when, att: {"gamePk": 1, "gameDate": when, "teams": {"home": {"team": {"id": home, "name": "h"}}, "away": {"team": {"id": 5, "name": "o"}}},
                                    "venue": {"name": "v"}, "gameInfo": {"attendance": att}}
    body = json.dumps({"dates": [{"games": [game(1, "2024-04-09T01:45:00Z", 100), game(2, "2024-04-09T01:45:00Z", 5)]}, {"games": [game(1, "2024-04-10T20:05:00Z", 0)]}]})
    payload = spark.createDataFrame([(body,)], "value string")
    got = sorted((r.date, r.first_hour, r.day_night) for r in feeds.home_schedule(payload, 1).collect())
    assert got == [(date(2024, 4, 8), 18, "night"), (date(2024, 4, 10), 13, "day")]
    assert [tuple(r) for r in feeds.home_attendance(payload, 1).collect()] == [(date(2024, 4, 8), 100)]


def test_year_folders_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "fact")
    both = spark.createDataFrame([(date(2023, 1, 1), 1), (date(2024, 1, 1), 2)], "date date, v int")
    sinks.write_by_year(both, path)
    sinks.write_by_year(both.filter("v = 2").withColumn("v", F.lit(9)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]
    plan = spark.read.parquet(path).filter("year = 2024")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_landing_writes_tables_and_manifest(spark, tmp_path):
    counts = sinks.land(spark, str(tmp_path), {"a": lambda: spark.range(3), "b": lambda: spark.range(4)}, {"k": 1})
    assert counts == {"a": 3, "b": 4} and spark.read.parquet(str(tmp_path / "a")).count() == 3
    body = json.loads(spark.read.text(str(tmp_path / "_manifest")).first().value)
    assert body["rows"] == {"a": 3, "b": 4} and body["params"] == {"k": 1}


def test_inventory_rolls_up_part_files(spark, tmp_path):
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "one"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "two"))
    got = {r.dataset: (r.n_files, r.n_rows) for r in profiling.folder_inventory(spark, str(tmp_path)).collect()}
    assert got == {"one": (2, 5), "two": (1, 4)}


def test_inventory_of_tables_as_folders(spark, tmp_path):
    """Folders called like files, with parts of any name and with partitions, are one dataset of their own name, as files are."""
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "flat"))
    part = next((tmp_path / "flat").glob("part-*.parquet"))
    for name in ("two.parquet/data_0.parquet", "two.parquet/data_1.parquet", "three.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(part.read_bytes())
    spark.range(6).selectExpr("id", "id % 3 AS m").write.partitionBy("m").parquet(str(tmp_path / "four.parquet"))
    got = {r.dataset: (r.n_paths, r.n_files, r.n_rows) for r in profiling.folder_inventory(spark, str(tmp_path)).collect()}
    assert got.pop("four") == (1, len(list((tmp_path / "four.parquet").rglob("*.parquet"))), 6)
    assert got == {"one": (1, 2, 5), "two": (1, 2, 8), "three": (1, 1, 4), "flat": (1, 1, 4)}


def test_profiles_survive_a_broken_table(spark, tmp_path):
    spark.createDataFrame([(date(2024, 1, 1), "a", 1), (date(2024, 1, 2), None, 2), (date(2024, 1, 3), "b", 3)], "date date, station string, n long").write.parquet(str(tmp_path / "ok"))
    found, errors = profiling.profile_tables(spark, {"ok": str(tmp_path / "ok"), "gone": str(tmp_path / "gone")})
    by = {r.column: r for r in found.collect()}
    assert by["station"].n_null == 1 and by["date"].first == "2024-01-01" and by["date"].last == "2024-01-03" and "gone" in errors
    assert profiling.to_markdown(found, "t").startswith("## t")


def test_a_broken_landing_resumes_and_readers_keep_the_old_version(spark, tmp_path):
    source, root, built = str(tmp_path / "source"), str(tmp_path / "gold"), []

    def table(name, fails=False):
        def build():
            built.append(name)
            if fails:
                raise RuntimeError("broken off")
            return spark.read.parquet(source)
        return build

    spark.range(3).write.parquet(source)
    with pytest.raises(RuntimeError):
        sinks.land_resumable(spark, root, {"a": table("a"), "b": table("b", True)}, [source])
    assert sinks.landed(spark, root) == {}
    first = sinks.land_resumable(spark, root, {"a": table("a"), "b": table("b")}, [source])
    assert built == ["a", "b", "b"] and first["resumed"] == ["a"] and first["rows"] == {"a": 3, "b": 3} and first["inputs"][0]["path"].startswith("file:")
    spark.range(5).write.mode("overwrite").parquet(source)
    with pytest.raises(RuntimeError):
        sinks.land_resumable(spark, root, {"a": table("a"), "b": table("b", True)}, [source])
    assert {name: df.count() for name, df in sinks.landed(spark, root).items()} == {"a": 3, "b": 3}
    second = sinks.land_resumable(spark, root, {"a": table("a"), "b": table("b")}, [source])
    assert second["version"] != first["version"] and {name: df.count() for name, df in sinks.landed(spark, root).items()} == {"a": 5, "b": 5}
    again = sinks.land_resumable(spark, root, {"a": table("a"), "b": table("b")}, [source])
    assert again["resumed"] == ["a", "b"] and again["version"] == second["version"]
