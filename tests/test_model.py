"""Counterfactual trees, their leaf intervals, zipped feeds and net correlations against direct computation."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdpanel.operators import model, profiling
from crowdpanel.sources import feeds


def _units(spark):
    """Forty units whose level jumps from code to code; every fifth row belongs to an event and is far off."""
    rows = spark.range(4000).select((F.col("id") % 40).alias("unit_code"), (F.col("id") % 7).cast("int").alias("hour"), (F.col("id") % 5 == 0).alias("event"))
    level = F.pmod(F.hash("unit_code"), F.lit(2)) * 4.0
    return rows.withColumn("is_control", ~F.col("event")).withColumn("y", level + F.when(F.col("event"), 100.0).otherwise(0.1 * F.col("hour")))


def test_units_are_split_by_sets_and_events_do_not_train(spark):
    rows, columns = _units(spark), ("unit_code", "hour")
    fitted = model.fit_counterfactual(rows, columns, trees=2, depth=2, bins=8)
    ordered = model.fit_counterfactual(rows, columns, trees=2, depth=2, bins=64, nominal=())

    def worst(m):
        got = model.predict_cf(m, rows.filter("is_control"), columns)
        return got.agg(F.avg(F.abs(F.col("cf_log") - F.col("y")))).first()[0]

    assert worst(fitted) < 0.3 < worst(ordered)
    unseen = rows.limit(1).withColumn("unit_code", F.lit(999)).unionByName(rows.limit(1).withColumn("unit_code", F.lit(None).cast("long")))
    got = model.predict_cf(fitted, unseen, columns, leaves="leaves").collect()
    assert all(math.isfinite(r.cf_log) and len(r.leaves) == 2 for r in got)
    assert set(got[0].asDict()) == {*rows.columns, "cf_log", "leaves"}
    assert len(model.tree_weights(fitted)) == 2


def test_leaf_interval_is_a_weighted_mean_of_leaf_quantiles(spark):
    rng = np.random.default_rng(3)
    leaves, error = rng.integers(0, 4, (300, 2)), rng.normal(size=300)
    valid = spark.createDataFrame([(float(e), 0.0, [int(a), int(b)]) for e, (a, b) in zip(error, leaves)], "y double, cf_log double, leaves array<int>")
    test = spark.createDataFrame([(0, 1.0, [1, 3]), (1, 2.0, [2, 9]), (2, -1.0, [0, 0])], "id int, cf_log double, leaves array<int>")
    got = {r.id: (r.lo, r.hi) for r in model.leaf_interval(valid, test, "leaves", [1.0, 0.1]).collect()}

    def want(p, a, b, q):
        first = np.quantile(error[leaves[:, 0] == a], q)
        second = np.quantile(error[leaves[:, 1] == b] if b < 4 else error, q)
        return p + (first + 0.1 * second) / 1.1

    for k, (p, a, b) in enumerate([(1.0, 1, 3), (2.0, 2, 9), (-1.0, 0, 0)]):
        assert got[k] == pytest.approx((want(p, a, b, 0.05), want(p, a, b, 0.95)))
    assert [(r.lo, r.hi) for r in model.leaf_interval(valid.limit(0), test, "leaves", [1.0, 0.1]).collect()] == [(None, None)] * 3


def test_zipped_members_are_read_in_chunks(spark, tmp_path):
    head = "ride_id,started_at,ended_at,start_lat,start_lng,end_lat,end_lng\n"
    line = "r,2024-01-01 10:00:00,2024-01-01 10:09:00,37.7,-122.4,37.8,-122.4\n"
    with zipfile.ZipFile(tmp_path / "202401-a b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", head + line * 23 + "a,b,c,d,e,f,g,h,i\n" + line * 2)
        z.writestr("two.csv", "started_at,start_lat\n2024-01-02 00:00:00,1.5\n")
        z.writestr("none.csv", "")
        z.writestr("readme.txt", "no rows")
    paths = spark.read.format("binaryFile").load(str(tmp_path))
    got = feeds.read_zipped_csv(paths, ["started_at", "start_lat", "end_lng"], chunk_rows=4)
    assert got.count() == 26 and got.filter("end_lng is null").count() == 1
    assert feeds.read_zipped_trips(spark, str(tmp_path), "202402", "202403").count() == 0
    (tmp_path / "202405-broken.zip").write_bytes(b"PK\x03\x04 cut off")
    with pytest.raises(Exception, match="not a zip file|BadZipFile"):
        feeds.read_zipped_trips(spark, str(tmp_path), "202405", "202405").count()


def test_correlations_of_constants_and_of_the_group_are_null(spark):
    rows = spark.range(60).select((F.col("id") % 6).alias("hour"), F.col("id").alias("v"), F.lit(2).alias("fixed"), (F.col("id") * F.col("id")).alias("y"))
    got = {r.column: r for r in profiling.correlations(rows, "y", ["hour", "v", "fixed"]).collect()}
    assert got["fixed"].r is None and got["fixed"].r_net is None and got["hour"].r_net is None
    x = np.arange(60)
    assert got["v"].r == pytest.approx(np.corrcoef(x, np.log1p(x * x))[0, 1])
    assert got["hour"].r == pytest.approx(np.corrcoef(x % 6, np.log1p(x * x))[0, 1])
