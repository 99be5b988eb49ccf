"""Small frames on which a silent mistake would show."""

import math
import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crowdpanel.functions import dates, flags, geo
from crowdpanel.operators import bootstrap, controls, days, disagg, effects, model, panel, profiling, quality, score, unpack
from crowdpanel.operators.baseline import rolling_baseline
from crowdpanel.operators.uplift import arrival_uplift, dollarize

D0 = date(2024, 7, 1)


def test_hour_slots_keep_their_date_and_hour(spark):
    text = "[" + ", ".join(str(i) for i in range(168)) + "]"
    df = spark.createDataFrame([Row(poi_id=1, week_start=D0, packed=text)])
    got = {(r.date, r.hour): r.visitor_hours for r in unpack.explode_hours(df, "packed").collect()}
    assert len(got) == 167  # slot 0 holds zero and drops out
    assert got[(D0, 23)] == 23 and got[(D0 + timedelta(1), 0)] == 24 and got[(D0 + timedelta(6), 23)] == 167


def test_day_slots_keep_their_date(spark):
    df = spark.createDataFrame([Row(poi_id=1, week_start=D0, packed="[1, 2, 3, 4, 5, 6, 7]")])
    got = {r.date: r.visits for r in unpack.explode_days(df, "packed").collect()}
    assert got == {D0 + timedelta(i): i + 1 for i in range(7)}


def test_coverage_is_last_weeks(spark):
    hourly = spark.createDataFrame([Row(poi_id=p, date=d, hour=1, visitor_hours=1) for p, d in (
        ("p1", date(2024, 5, 28)), ("p2", date(2024, 5, 29)), ("p3", date(2024, 6, 4)))])
    cells = spark.createDataFrame([Row(poi_id=p, unit_id=1) for p in ("p1", "p2", "p3")])
    got = {r.week_start: r.n_poi_live for r in panel.week_coverage(hourly, cells).collect()}
    assert got == {date(2024, 6, 3): 2, date(2024, 6, 10): 1}


@pytest.mark.parametrize("flag", ["game_day", "venue_day", "rival_day", "convention_day", "citywide_day", "fair_day"])
def test_strict_controls_are_a_subset(spark, flag):
    names = ["game_day", "venue_day", "rival_day", "convention_day", "citywide_day", "fair_day"]
    df = spark.createDataFrame([Row(**{n: n == flag for n in names}), Row(**{n: False for n in names})])
    got = df.select(flags.clean_control().alias("a"), flags.clean_control(strict=True).alias("b")).collect()
    assert got[0].b is False and got[1].a and got[1].b
    assert got[0].a is (flag not in ("game_day", "venue_day"))


def _baseline_rows(spark, spikes=(5, 9), observed=None):
    out = []
    for i in range(12):
        out.append(Row(unit_id="u", date=D0 + timedelta(7 * i), hour=1, dow=1, y=100.0 if i in spikes else float(i),
                       clean_control_strict=i not in spikes, observed=True if observed is None else i < observed))
    return spark.createDataFrame(out)


def test_baseline_is_strictly_past_and_event_free(spark):
    got = {r.date: r for r in rolling_baseline(_baseline_rows(spark)).collect()}
    assert got[D0].base_k2 is None
    assert got[D0 + timedelta(14)].base_k2 == 0.5  # days 0 and 1, not its own
    assert got[D0 + timedelta(42)].base_k2 == 3.5  # day 6: days 3 and 4, spike 5 skipped
    assert max(r.base_k4 or 0 for r in got.values()) < 12


def test_served_baseline_ignores_unobserved_rows(spark):
    got = {r.date: r for r in rolling_baseline(_baseline_rows(spark, (), 8), observed="observed").collect()}
    last = got[D0 + timedelta(77)]
    assert last.base_k2 == 6.5 and last.baseline_as_of == D0 + timedelta(49) and last.baseline_staleness_days == 28


def test_dense_panel_fills_zeros(spark):
    hourly = spark.createDataFrame([Row(poi_id=1, date=D0, hour=h, visitor_hours=5) for h in (1, 2, 3)])
    cells = spark.createDataFrame([Row(poi_id=1, unit_id="u")])
    dense = panel.cell_hour(hourly, cells, "2024-07-01", "2024-07-04")
    one = dense.agg(F.count("*").alias("n"), F.avg("person_hours").alias("m"), F.max("n_poi_reporting").alias("r")).first()
    assert (one.n, one.m, one.r) == (96, 15 / 96, 1)


def test_band_edges(spark):
    df = spark.createDataFrame([(0.0,), (213.7,), (500.0,), (500.1,), (1000.0,), (2000.0,), (4000.0,), (9000.0,)], "d double")
    got = [tuple(r) for r in df.select(geo.band_upto(F.col("d")), geo.band_below(F.col("d")), geo.ring_id(F.col("d"))).collect()]
    assert got == [("0-500m", "b1", 1), ("0-500m", "b1", 1), ("0-500m", "b3", 3), ("500-1000m", "b3", 3), ("500-1000m", "b4", 4),
                   ("1000-2000m", "b4", 4), ("2000-4000m", "b5", 5), (">4000m", "b6", None)]


def test_composition_multiplies_levels(spark):
    df = spark.createDataFrame([(math.log1p(1.0), math.log(1.5)), (math.log1p(100.0), math.log(1.5))], "cf_log double, effect_log double")
    got = effects.compose(df).collect()
    assert got[0].game_level == pytest.approx(1.5) and got[1].game_level == pytest.approx(150.0)
    assert got[0].extra_level == pytest.approx(0.5)


def test_drawn_days_count_as_often_as_drawn(spark):
    dayband = spark.createDataFrame([(D0, "b", 0.0), (D0 + timedelta(1), "b", 1.0)], "date date, band string, resid double")
    draws = spark.createDataFrame([(0, D0, "t"), (0, D0, "t"), (0, D0 + timedelta(1), "t"), (0, D0, "c")], "draw int, date date, side string")
    assert bootstrap.did_draws(dayband, draws).first().did == pytest.approx(1 / 3)


def test_bootstrap_interval_matches_theory(spark):
    rows = [Row(date=D0 + timedelta(i), band="b", resid=float(i % 5), game_day=i < 50, is_control=i >= 50) for i in range(100)]
    got = bootstrap.bootstrap_did(spark.createDataFrame(rows), F.col("game_day"), F.col("is_control"), 400).first()
    half = 1.96 * math.sqrt(2 * 2.0 / 50)
    assert got.lo == pytest.approx(-half, abs=0.15) and got.hi == pytest.approx(half, abs=0.15) and got.n_draws == 400


def test_placebo_is_centred(spark):
    rows = [Row(date=D0 + timedelta(i), band="b", resid=float(i % 7), game_day=i < 20, is_control=i >= 20) for i in range(120)]
    got = bootstrap.placebo(spark.createDataFrame(rows), F.col("game_day"), F.col("is_control"), 200).first()
    assert abs(got.placebo_mean) < 0.15 and got.placebo_sd > 0.2


def test_nan_rows_leave_the_day_means(spark):
    rows = [Row(date=D0, hour=18, dist_m=10.0, resid=r, game_day=True, is_control=False) for r in (float("nan"), 1.0, 3.0)]
    got = effects.day_means(spark.createDataFrame(rows), geo.band_upto(F.col("dist_m"))).first()
    assert got.resid == 2.0


def test_matched_did_ignores_the_calendar_mix(spark):
    rows = []
    for i in range(365):
        d = date(2023, 1, 1) + timedelta(i)
        season = 1.0 if d.month >= 6 else 0.0
        game = (i % 3 == 0) if season else (i % 9 == 0)
        rows.append(Row(date=d, band="b", resid=season + (0.2 if game else 0.0), game_day=game, is_control=not game))
    df = spark.createDataFrame(rows)
    assert effects.did_matched(df, F.col("game_day"), F.col("is_control")).first().did == pytest.approx(0.2)
    assert effects.did(df, F.col("game_day"), F.col("is_control")).first().did > 0.3


def test_insignificant_bands_ship_exact_zero(spark):
    df = spark.createDataFrame([("b1", 0.3, 0.1, 0.2, 0.4), ("b2", 0.1, 0.2, -0.1, 0.3)], "band string, did double, shift double, lo double, hi double")
    got = {r.band: r for r in effects.suppress(df).collect()}
    assert got["b1"].did_log == 0.3 and got["b2"].did_log == 0.0 and got["b2"].shift == 0.0 and got["b2"].did_log_raw == 0.1


def _effect_layer(spark):
    bands = spark.createDataFrame([("b1", 0.36, 0.0, True), ("b2", 0.50, 0.0, True), ("b3", 0.10, 0.0, False)], "band string, did_log double, shift double, significant boolean")
    response = spark.createDataFrame([("b1", 0.1, 0.2), ("b2", 0.0, 0.0), ("b3", 0.5, 0.5)], "band string, beta double, gamma double")
    center = spark.createDataFrame([(30000.0, 5000.0, 0.6)], "center double, scale double, night_share double")
    return bands, response, center


def test_totals_never_rise_with_distance_and_night_is_centred(spark):
    bands, response, center = _effect_layer(spark)
    ask = spark.createDataFrame([(D0, 30000.0, 1.0), (D0 + timedelta(1), 30000.0, 0.0)], "date date, attendance double, is_night double")
    got = {(r.date, r.band): r for r in effects.band_totals(ask, bands, response, center).collect()}
    assert got[(D0, "b1")].total == pytest.approx(0.36 + 0.2 * 0.4)
    assert got[(D0 + timedelta(1), "b1")].total == pytest.approx(0.36 - 0.2 * 0.6)
    assert got[(D0, "b2")].total == pytest.approx(got[(D0, "b1")].total)
    assert got[(D0, "b3")].total is None
    mix = 0.6 * got[(D0, "b1")].raw + 0.4 * got[(D0 + timedelta(1), "b1")].raw
    assert mix == pytest.approx(0.36)


def test_suppressed_rows_have_no_effect(spark):
    bands, response, center = _effect_layer(spark)
    ask = spark.createDataFrame([(D0, 30000.0, 1.0)], "date date, attendance double, is_night double")
    decay = spark.createDataFrame([(0.3, 800.0, 0.01)], "A double, L double, c double")
    rows = spark.createDataFrame([(D0, "b3", 2000.0, 1.0), (D0, "b1", 100.0, 1.0)], "date date, band string, dist_m double, cf_log double")
    got = {r.band: r.effect_log for r in effects.effect_log(rows, effects.band_totals(ask, bands, response, center), decay).collect()}
    assert got["b3"] == 0.0 and got["b1"] == pytest.approx(0.3 * math.exp(-100 / 800) + 0.01 + 0.08)


def test_decay_fit_recovers_the_curve(spark):
    units = [(i, 0.8 * math.exp(-(i * 60.0) / 900) + 0.02, i * 60.0, 1.0 + i % 3) for i in range(80)]
    df = spark.createDataFrame(units, "unit_id long, did double, dist_m double, level double")
    got = effects.fit_decay(df.select("unit_id", "did"), df.select("unit_id", "dist_m", "level")).first()
    assert got.L == pytest.approx(900, abs=1) and got.A == pytest.approx(0.8, abs=1e-3) and got.c == pytest.approx(0.02, abs=1e-3)
    assert got.weighted_r2 > 0.9999


def test_lift_needs_enough_controls(spark):
    rows = [Row(ring_id=1, date=D0 + timedelta(7 * i), value=float(i), game_day=i == 6, clean=i != 6) for i in range(10)]
    rows += [Row(ring_id=2, date=D0 + timedelta(7 * i), value=float(i), game_day=i == 1, clean=i in (0, 2)) for i in range(3)]
    got = {r.ring_id: r for r in controls.game_effects(spark.createDataFrame(rows), ["value"], control="clean", k=4).collect()}
    assert got[1].baseline is None and got[1].baseline_n == 4  # k below the minimum of five
    got = {r.ring_id: r for r in controls.game_effects(spark.createDataFrame(rows), ["value"], control="clean", k=6).collect()}
    assert got[1].baseline == pytest.approx((5 + 7 + 4 + 8 + 3 + 9) / 6) and got[2].baseline is None and got[2].baseline_n == 2


def test_hourly_controls_cross_midnight(spark):
    hours = []
    for i in range(60):
        d = D0 + timedelta(i)
        for h in range(24):
            v = 50.0 if (d.weekday() == 5 and h < 3) else 1.0
            hours.append(Row(ring_id=1, date=d, hour=h, v=v))
    cal = [Row(date=D0 + timedelta(i), game_day=i == 32, n_games=1 if i == 32 else 0, first_hour=20 if i == 32 else None, day_night="night",
               clean_control=i != 32) for i in range(60)]  # 32 is a Friday
    lifts = controls.hourly_lifts(spark.createDataFrame(hours), spark.createDataFrame(cal), ["v"])
    got = {r.relative_hour: r for r in lifts.collect()}
    assert got[5].value == 50.0 and got[5].baseline == 50.0  # Saturday 01:00 against Saturday 01:00


@pytest.mark.parametrize("slots", [7, 168])
def test_packed_weeks_equal_plain(spark, slots):
    """Full, sparse and edge weeks, several rows a slot; hours that are null or beyond the week count nowhere."""
    rnd = random.Random(3)
    shape = {1: range(slots), 2: [0], 3: [slots - 1], 4: [0, slots - 1], 5: sorted(rnd.sample(range(slots), 5)), 6: [slots // 2]}
    plain = {p: [0] * slots for p in [*shape, 7]}
    rows = [(7, D0 + timedelta(6), None, 5), (7, D0 + timedelta(6), 30, 5)] if slots == 168 else []
    for p, filled in shape.items():
        for i in filled:
            for v in (rnd.randint(1, 20), 100):
                plain[p][i] += v
                rows.append((p, D0 + timedelta(i if slots == 7 else i // 24), i % 24, v))
    got = {r.poi_id: r.packed for r in unpack.pack_weeks(spark.createDataFrame(rows, "poi_id int, date date, hour int, n long"), slots, "n").collect()}
    assert got == {p: str(v) for p, v in plain.items() if p != 7 or slots == 168}


def test_arrival_uplift(spark):
    od = []
    for week, n in ((0, 300), (1, 100), (2, 100)):
        for h in (16, 17, 18):
            od.append(Row(date=D0 + timedelta(1 + 7 * week), hour=h, origin="A", destination="S", trip_count=n))
            od.append(Row(date=D0 + timedelta(1 + 7 * week), hour=h, origin="A", destination="Z", trip_count=999))
    sched = spark.createDataFrame([Row(date=D0 + timedelta(1), first_hour=18, opponent="x", day_night="night")])
    od.append(Row(date=D0 + timedelta(1), hour=15, origin="A", destination="S", trip_count=7))  # before the window
    got = arrival_uplift(spark.createDataFrame(od), sched, "S").first()
    assert (got.game_arrivals, got.baseline_arrivals, got.uplift) == (900, 300.0, 600.0)


def test_arrival_uplift_adds_hours_in_order(spark):
    """Means are twentieths, so half of the sums lie on a tie of the first decimal, and some fall to either side of it by the order of their terms."""
    rnd = random.Random(1)
    total = {(d, h): rnd.randint(20000, 90000) for d in range(7) for h in range(24)}
    od = [(D0 + timedelta(d + 7 * week), h, "A", "S", total[d, h] if week == 0 else 0) for d in range(7) for h in range(24) for week in range(20)]
    games = {D0 + timedelta(7 * (20 + h) + d): (d, h) for d in range(7) for h in range(2, 24)}
    sched = spark.createDataFrame([(date_, h, "x", "night") for date_, (_, h) in games.items()], "date date, first_hour int, opponent string, day_night string")
    rows = arrival_uplift(spark.createDataFrame(od, "date date, hour int, origin string, destination string, trip_count long"), sched, "S").collect()
    mean = lambda d, h: total[d, h] / 20
    in_order = {t: (mean(d, h - 2) + mean(d, h - 1)) + mean(d, h) for t, (d, h) in games.items()}
    assert any(in_order[t] != mean(d, h - 2) + (mean(d, h - 1) + mean(d, h)) for t, (d, h) in games.items())
    half_up = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    assert {r.date: r.baseline_arrivals for r in rows} == {t: half_up(x) for t, x in in_order.items()}


def test_dollarize(spark):
    got = dollarize(spark.createDataFrame([(1.0, 20000.0)], "pp_per_10k double, attendance double"), 1e8).first()
    assert (got.lift_pct, got.dollars, got.dollars_per_head) == (2.0, 2_000_000.0, 100.0)


def test_split_gate_can_fail(spark):
    good = spark.createDataFrame([(date(2024, 6, 1), "train", True), (date(2025, 8, 1), "test", True)], "date date, split string, game_day boolean")
    bad = good.unionByName(spark.createDataFrame([(date(2025, 8, 2), "train", True)], good.schema))
    assert quality.split_boundaries(good).first().ok and not quality.split_boundaries(bad).first().ok
    with pytest.raises(RuntimeError, match="split_leak"):
        quality.run_checks([quality.split_boundaries(bad)])


def test_report_does_not_count_skipped_as_passed(spark):
    rows = quality.run_checks([quality.skipped(spark.range(1), "x", "no file"), quality.split_boundaries(spark.createDataFrame(
        [(date(2024, 6, 1), "train", True)], "date date, split string, game_day boolean"))])
    assert "1 of 1 passed" in quality.report(rows)


def test_treatment_filter_keeps_postseason(spark):
    df = spark.createDataFrame([(t,) for t in "SRDLWE"], "game_type string")
    assert [r[0] for r in df.filter(flags.is_treatment_game(F.col("game_type"))).collect()] == list("RDLW")


def test_folded_games(spark):
    g = spark.createDataFrame([(D0, "R", 100, "day", 13, "a"), (D0, "R", 200, "night", 19, "b"), (D0, "S", 9, "day", 1, "c")],
                              "date date, game_type string, attendance long, day_night string, first_hour int, opponent string")
    got = days.games_by_date(g).first()
    assert (got.n_games, got.attendance, got.day_night, got.first_hour, got.opponents) == (2, 300, "night", 13, "a; b")


def test_missingness_separates_structure_from_gaps(spark):
    df = spark.createDataFrame([(True, 19, 1.0), (False, None, None), (True, None, 2.0), (False, None, 3.0)], "game_day boolean, first_hour int, temp double")
    got = {r.column: r for r in profiling.missingness(df, {"first_hour": ("no event", ~F.col("game_day"))}).collect()}
    assert (got["first_hour"].n_null, got["first_hour"].structural, got["first_hour"].gap) == (3, 2, 1) and got["temp"].gap == 1


def test_response_order_needs_overlapping_intervals(spark):
    def ok(*rows):
        return quality.response_order(spark.createDataFrame(rows, "band string, did double, lo double, hi double")).first().ok

    assert ok(("b1", 0.4, 0.3, 0.5), ("b2", 0.1, 0.0, 0.2))
    assert ok(("b1", 0.10, 0.0, 0.2), ("b2", 0.15, 0.1, 0.3))
    assert not ok(("b1", 0.1, 0.0, 0.2), ("b2", 0.4, 0.3, 0.5))
    assert not ok(("b1", 0.1, None, None), ("b2", 0.4, None, None))
    assert ok(("b2", 0.3, 0.2, 0.4), ("b10", 0.1, 0.0, 0.15))


def test_dwell_agreement_leaves_out_rows_that_imply_nothing(spark):
    rows = [('{"<5": 10}', 10.5), ('{"61-240": 10}', 35.0), ('{"5-20": 100}', 121.0), ('{"<5": 0}', 5000.0), (None, 9000.0)]
    got = quality.dwell_agreement(spark.createDataFrame(rows, "dwell string, hours double"), "dwell", "hours").first()
    assert got.ok, got.detail


def test_feature_contract():
    class Fake:
        def __init__(self, dtypes):
            self.dtypes, self.columns = dtypes, [c for c, _ in dtypes]

    ok = [(f, "double") for f in model.FEATURES]
    assert model.feature_contract(Fake(ok)) == []
    assert model.feature_contract(Fake(ok[1:] + ok[:1])) == ["order"]
    assert model.feature_contract(Fake(ok[1:])) == ["missing unit_code"]


def test_quarters_need_enough_days(spark):
    ind = spark.createDataFrame([("s", date(2024, 1, 1) + timedelta(i), 1.0) for i in range(91 + 87)], "series string, date date, ind double")
    totals = spark.createDataFrame([("s", "2024Q1", 10.0), ("s", "2024Q2", 20.0)], "series string, period string, total double")
    assert {r.period for r in disagg.usable_days(totals, ind).select("period").distinct().collect()} == {"2024Q1"}


def test_relative_hour_and_holidays(spark):
    df = spark.createDataFrame([(date(2024, 7, 4),), (date(2024, 11, 28),), (date(2025, 5, 26),), (date(2024, 7, 5),)], "d date")
    assert [r[0] for r in df.select(dates.is_federal_holiday(F.col("d"))).collect()] == [True, True, True, False]


def test_requests_of_unserved_dates_stay(spark):
    served = spark.createDataFrame([(D0, "u", "b1", 10.0, 4.0, 5.0, 1.0)], "date date, unit_id string, band string, dist_m double, cf double, game double, extra double")
    units = spark.createDataFrame([("u", 37.77, -122.39)], "unit_id string, lat double, lon double").withColumn(
        "gi", geo.grid_index(F.col("lat"), geo.GRID_STEP[0])).withColumn("gj", geo.grid_index(F.col("lon"), geo.GRID_STEP[1]))
    asked = spark.createDataFrame([(1, D0, 37.77, -122.39), (2, D0 + timedelta(1), 37.77, -122.39)], "event_id long, date date, lat double, lon double")
    got = {r.event_id: r for r in score.score_requests(asked, served, units).collect()}
    assert (got[1].extra, got[1].extra_within, got[1].reason) == (1.0, 1.0, None)
    assert (got[2].extra, got[2].extra_within, got[2].reason) == (0.0, None, "date not served")
