"""Residuals to band effects: differences, decay, response, composition, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.stats import weighted_mean
from ..session import durable_table
from .bootstrap import bootstrap_did, bootstrap_matched, draw_days
from .panel import EVENING
from .reshape import to_wide

STRATA = ("month", "weekend")
# Bounds of the decay curve and the minimum events of the response.
DECAY_A = (0.0, 10.0)
DECAY_L = (100.0, 8000.0)
DECAY_C = (-0.5, 0.5)
MIN_RESPONSE_EVENTS = 30


def with_strata(frame: DataFrame) -> DataFrame:
    """Month and weekend (Saturday on) of the date."""
    return frame.withColumn("month", F.month("date")).withColumn("weekend", dates.is_weekend(F.col("date")))


def day_means(resid: DataFrame, key: Column, name: str = "band", hours: Sequence[int] = EVENING) -> DataFrame:
    """Evening rows folded to one mean residual per date and key; NaN rows drop out."""
    rows = resid.filter(F.col("hour").between(*hours) & ~F.isnan("resid") & F.col("resid").isNotNull())
    return rows.groupBy("date", key.alias(name)).agg(
        F.avg("resid").alias("resid"), F.bool_or("game_day").alias("game_day"), F.bool_or("is_control").alias("is_control"))


def did(dayband: DataFrame, treated: Column, control: Column, key: str = "band") -> DataFrame:
    """Treated-day mean minus control-day mean per key, in log and percent."""
    g, c = F.avg(F.when(treated, F.col("resid"))), F.avg(F.when(control, F.col("resid")))
    n = lambda cond: F.count(F.when(cond, F.col("resid")))
    return dayband.groupBy(key).agg((g - c).alias("did"), n(treated).alias("n_treated"), n(control).alias("n_control")).withColumn(
        "effect_pct", 100 * (F.exp("did") - 1))


def did_matched(frame: DataFrame, treated: Column, control: Column, key: str = "band") -> DataFrame:
    """Differences within (month, weekend), weighted by the treated days of the stratum.

    The weight counts all treated days of the stratum, not only those with the key.
    """
    strata = list(STRATA)
    rows = with_strata(frame)
    by = rows.groupBy(*strata, key).agg(F.avg(F.when(treated, F.col("resid"))).alias("g"),
                                        F.avg(F.when(control, F.col("resid"))).alias("c"))
    weight = rows.filter(treated).groupBy(*strata).agg(F.countDistinct("date").alias("n_g"))
    both = by.filter(F.col("g").isNotNull() & F.col("c").isNotNull()).join(weight, strata)
    return both.groupBy(key).agg((F.sum((F.col("g") - F.col("c")) * F.col("n_g")) / F.sum("n_g")).alias("did"),
                                 F.sum("n_g").alias("n_treated_days"))


def strata_coverage(frame: DataFrame, treated: Column, control: Column) -> DataFrame:
    """Treated and control days per treated stratum."""
    rows = with_strata(frame)
    return rows.groupBy(*STRATA).agg(F.countDistinct(F.when(treated, F.col("date"))).alias("n_g"),
                                     F.countDistinct(F.when(control, F.col("date"))).alias("n_c")).filter(F.col("n_g") > 0)


def activity_weights(resid: DataFrame, hours: Sequence[int] = EVENING) -> DataFrame:
    """Mean control-day evening level and distance per unit."""
    rows = resid.filter(F.col("hour").between(*hours) & F.col("is_control") & ~F.col("game_day"))
    return rows.groupBy("unit_id").agg(F.avg(F.expm1("y")).alias("level"), F.max("dist_m").alias("dist_m"))


def _decay_scan(units: DataFrame) -> DataFrame:
    """Best bounded (A, c) for every length L of the rows from weighted sums; one row per length."""
    e, y, w = F.exp(-F.col("d") / F.col("L")), F.col("y"), F.col("w")
    s = units.groupBy("L").agg(
        F.sum(w).alias("sw"), F.sum(w * e).alias("se"), F.sum(w * e * e).alias("see"), F.sum(w * y).alias("sy"),
        F.sum(w * e * y).alias("sey"), F.sum(w * y * y).alias("syy"), F.count("*").alias("n"))
    col = F.col
    clip = lambda x, b: F.least(F.greatest(x, F.lit(b[0])), F.lit(b[1]))
    det = col("sw") * col("see") - col("se") * col("se")
    free_a = F.try_divide(col("sw") * col("sey") - col("se") * col("sy"), det)
    free_c = F.try_divide(col("see") * col("sy") - col("se") * col("sey"), det)
    c_given = lambda a: clip((col("sy") - a * col("se")) / col("sw"), DECAY_C)
    a_given = lambda c: clip(F.try_divide(col("sey") - c * col("se"), col("see")), DECAY_A)
    inside = free_a.between(*DECAY_A) & free_c.between(*DECAY_C)
    pairs = [(F.when(inside, free_a), F.when(inside, free_c))]
    pairs += [(F.lit(a), c_given(F.lit(a))) for a in DECAY_A] + [(a_given(F.lit(c)), F.lit(c)) for c in DECAY_C]
    options = F.array(*[F.struct(a.alias("A"), c.alias("c")) for a, c in pairs])
    a, c = col("o.A"), col("o.c")
    sse = (col("syy") - 2 * a * col("sey") - 2 * c * col("sy") + a * a * col("see") + 2 * a * c * col("se") + c * c * col("sw"))
    total = col("syy") - col("sy") * col("sy") / col("sw")
    scored = s.withColumn("o", F.explode(options)).filter(a.isNotNull() & c.isNotNull())
    return scored.select("L", a.alias("A"), c.alias("c"), sse.alias("sse"), (1 - F.try_divide(sse, total)).alias("weighted_r2"),
                         col("n").alias("n_units"))


def fit_decay(unit_did: DataFrame, weights: DataFrame, coarse: float = 20.0, fine: float = 0.5) -> DataFrame:
    """Weighted fit of A·exp(-d/L)+c to unit effects: one row A, L, c, weighted_r2, n_units.

    For a fixed L the best A and c are closed form, so lengths are scanned as rows
    on a coarse grid and again on a fine grid around the best one.
    """
    rows = unit_did.join(weights, "unit_id").select(
        F.col("dist_m").alias("d"), F.col("did").alias("y"), F.col("level").alias("w")).filter(
        "d is not null and y is not null and not isnan(d) and not isnan(y) and w > 0")
    low, high = DECAY_L
    grid = F.explode(F.sequence(F.lit(0), F.lit(int((high - low) / coarse))))
    best = _decay_scan(rows.withColumn("i", grid).withColumn("L", F.col("i") * coarse + low)).agg(
        F.min_by("L", F.struct("sse", "L")).alias("L0"))
    span = int(coarse / fine)
    near = rows.join(F.broadcast(best)).withColumn("i", F.explode(F.sequence(F.lit(-span), F.lit(span)))).withColumn(
        "L", F.col("L0") + F.col("i") * fine).filter(F.col("L").between(low, high))
    return _decay_scan(near).agg(
        F.min_by(F.struct("A", "L", "c", "weighted_r2", "n_units"), F.struct("sse", "L")).alias("f")).select("f.*")


def smooth_effect(decay_row: DataFrame, units: DataFrame, dist: str = "dist_m") -> DataFrame:
    """Units with the decay curve's value at their distance."""
    value = F.col("A") * F.exp(-F.col(dist) / F.col("L")) + F.col("c")
    return units.join(F.broadcast(decay_row.select("A", "L", "c"))).withColumn("smooth", value).drop("A", "L", "c")


def band_shifts(decay_row: DataFrame, band_did: DataFrame, weights: DataFrame, band: Column) -> DataFrame:
    """Per band the offset that makes the smooth curve reproduce its effect exactly."""
    rows = smooth_effect(decay_row, weights.filter(F.col("level") > 0)).withColumn("band", band)
    sums = rows.groupBy("band").agg(F.sum("level").alias("w"), F.sum(F.col("level") * F.exp("smooth")).alias("ws"),
                                    F.count("*").alias("n_units"))
    return band_did.join(sums, "band", "left").withColumn(
        "shift", F.coalesce(F.col("did") + F.log(F.col("w") / F.col("ws")), F.lit(0.0))).drop("w", "ws")


def _solve3(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """Solution of a symmetric 3x3 system [[a,b,c],[b,d,e],[c,e,f]] by cofactors."""
    a, b, c, d, e, f = m
    co = [[d * f - e * e, c * e - b * f, b * e - c * d],
          [c * e - b * f, a * f - c * c, b * c - a * e],
          [b * e - c * d, b * c - a * e, a * d - b * b]]
    det = a * co[0][0] + b * co[0][1] + c * co[0][2]
    return [F.try_divide(sum((co[i][j] * v[j] for j in range(1, 3)), co[i][0] * v[0]), F.nullif(det, F.lit(0.0)))
            for i in range(3)]


def ols3(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """Intercept and two slopes per group from the sums of its normal equations."""
    p, q, t = F.col(x1), F.col(x2), F.col(y)
    s = df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("p"), F.sum(q).alias("q"),
                              F.sum(p * p).alias("pp"), F.sum(p * q).alias("pq"), F.sum(q * q).alias("qq"),
                              F.sum(t).alias("t"), F.sum(p * t).alias("pt"), F.sum(q * t).alias("qt"))
    col = F.col
    b0, b1, b2 = _solve3([col("n"), col("p"), col("q"), col("pp"), col("pq"), col("qq")], [col("t"), col("pt"), col("qt")])
    return s.select(*keys, b0.alias("alpha"), b1.alias("beta"), b2.alias("gamma"), col("n").cast("long").alias("n_events"))


def event_effects(dayband: DataFrame, treated: Column, control: Column, events: DataFrame) -> DataFrame:
    """Per event and band: residual minus the control mean of its stratum, z and night.

    z uses mean and population sd of attendance over the matched rows.
    """
    rows = with_strata(dayband)
    ctrl = rows.filter(control).groupBy(*STRATA, "band").agg(F.avg("resid").alias("c"))
    matched = rows.filter(treated).select("date", "band", "resid", *STRATA).join(
        events.filter(F.col("attendance") > 0).select("date", "attendance", "day_night"), "date").join(
        ctrl, [*STRATA, "band"])
    scale = matched.agg(F.avg("attendance").alias("center"), F.coalesce(F.nullif(
        F.stddev_pop("attendance"), F.lit(0.0)), F.lit(1.0)).alias("scale"))
    return matched.join(F.broadcast(scale)).select(
        "date", "band", (F.col("resid") - F.col("c")).alias("effect"),
        ((F.col("attendance") - F.col("center")) / F.col("scale")).alias("z"),
        (F.col("day_night") == "night").cast("double").alias("night"), "center", "scale")


def response_center(per_event: DataFrame) -> DataFrame:
    """One row: attendance centre and scale and the night share over event dates."""
    dated = per_event.groupBy("date").agg(F.max("night").alias("night"), F.max("center").alias("center"),
                                          F.max("scale").alias("scale"))
    return dated.agg(F.max("center").alias("center"), F.max("scale").alias("scale"), F.avg("night").alias("night_share"))


def attendance_response(per_event: DataFrame, significant: DataFrame, n_draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per band alpha, beta (attendance) and gamma (night) with bootstrap gates.

    A slope whose interval spans zero ships as zero; so do both slopes of a band
    that is not significant or holds fewer than 30 events.
    """
    point = ols3(per_event, ["band"], "effect", "z", "night")
    days = per_event.select("date", F.lit("t").alias("side"), "band").distinct()
    draws = draw_days(days, n_draws, seed, ["band"])
    drawn = draws.join(per_event, ["date", "band"])
    boot = ols3(drawn, ["band", "draw"], "effect", "z", "night").groupBy("band").agg(
        *[F.percentile(c, p).alias(f"{c}_{tag}") for c in ("beta", "gamma") for tag, p in (("lo", 0.025), ("hi", 0.975))])
    mean = per_event.groupBy("band").agg(F.avg("effect").alias("mean_effect"))
    out = point.join(boot, "band", "left").join(mean, "band").join(
        significant.select("band", "significant"), "band", "left")
    usable = F.coalesce("significant", F.lit(False)) & (F.col("n_events") >= MIN_RESPONSE_EVENTS)

    def gated(name: str) -> Column:
        signed = F.col(f"{name}_lo") * F.col(f"{name}_hi") > 0
        return F.when(usable & signed, F.col(name)).otherwise(0.0)

    alpha = F.when(~F.coalesce("significant", F.lit(False)), 0.0).when(
        F.col("n_events") < MIN_RESPONSE_EVENTS, F.col("mean_effect")).otherwise(F.col("alpha"))
    return out.select("band", alpha.alias("alpha"), gated("beta").alias("beta"), gated("gamma").alias("gamma"), "n_events",
                      "beta_lo", "beta_hi", "gamma_lo", "gamma_hi")


def suppress(bands: DataFrame) -> DataFrame:
    """Bands whose interval spans zero ship an exact zero; raw values stay visible."""
    sig = F.coalesce(F.col("lo") * F.col("hi") > 0, F.lit(False))
    ship = lambda c: F.when(sig, F.col(c)).otherwise(0.0)
    return (bands.withColumn("significant", sig).withColumn("did_log", ship("did")).withColumn("shift", ship("shift"))
            .withColumn("lift_pct", F.when(sig, 100 * (F.exp("did") - 1)).otherwise(0.0))
            .withColumn("lift_pct_raw", 100 * (F.exp("did") - 1)).withColumnRenamed("did", "did_log_raw"))


def estimate_effects(resid: DataFrame, events: DataFrame, uppers: Sequence[float] = geo.CANONICAL_BANDS_M,
                     n_draws: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """Bands, decay, response, centre and strata coverage from evening residuals.

    The day-level tables feed several estimators each, so they are written once;
    their size is bounded by dates x bands and dates x units.
    """
    treated, control = F.col("game_day"), F.col("is_control") & ~F.col("game_day")
    band = geo.band_below(F.col("dist_m"), uppers)
    dayband, dayunit = durable_table(day_means(resid, band)), day_means(resid, F.col("unit_id"), "unit_id")
    weights = durable_table(activity_weights(resid))
    point = did_matched(dayband, treated, control)
    decay = durable_table(fit_decay(did_matched(durable_table(dayunit), treated, control, "unit_id"), weights))
    shifts = band_shifts(decay, point, weights, band)
    ci = bootstrap_matched(with_strata(dayband), treated, control, STRATA, n_draws, seed)
    bands = durable_table(suppress(shifts.join(ci.select("band", "lo", "hi"), "band", "left")))
    per_event = durable_table(event_effects(dayband, treated, control, events))
    return {"bands": bands, "decay": decay, "response": attendance_response(per_event, bands, n_draws, seed),
            "center": response_center(per_event), "coverage": strata_coverage(dayband, treated, control)}


def band_totals(requests: DataFrame, bands: DataFrame, response: DataFrame, center: DataFrame,
                key: Sequence[str] = ("date",)) -> DataFrame:
    """Per request key and band: raw total, capped total and the response offset.

    z and night are the means over the key's rows. Totals may not rise with
    distance: a running minimum over the significant bands in order of band id.
    """
    one = requests.groupBy(*key).agg(F.avg("attendance").alias("_att"), F.avg("is_night").alias("_night")).join(
        F.broadcast(center))
    z = (F.col("_att") - F.col("center")) / F.coalesce(F.nullif("scale", F.lit(0.0)), F.lit(1.0))
    shaped = one.select(*key, z.alias("z"), (F.col("_night") - F.col("night_share")).alias("night_gap"))
    table = bands.join(response.select("band", "beta", "gamma"), "band", "left")
    adj = F.coalesce("beta", F.lit(0.0)) * F.col("z") + F.coalesce("gamma", F.lit(0.0)) * F.col("night_gap")
    # Bands are a fixed handful of rows.
    rows = shaped.join(F.broadcast(table)).withColumn("adj", adj).withColumn("raw", F.col("did_log") + F.col("adj"))
    order = Window.partitionBy(*key).orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = F.min(F.when(F.col("significant"), F.col("raw"))).over(order)
    return rows.withColumn("total", F.when(F.col("significant"), capped)).select(
        *key, "band", "raw", "total", "adj", "shift", "significant")


def effect_log(rows: DataFrame, totals: DataFrame, decay: DataFrame, key: Sequence[str] = ("date",)) -> DataFrame:
    """Row effect: curve + shift + offset + what the cap took off; 0 if suppressed."""
    joined = smooth_effect(decay, rows).join(totals, [*key, "band"], "left")
    eff = F.col("smooth") + F.col("shift") + F.col("adj") + (F.col("total") - F.col("raw"))
    value = F.when(F.coalesce("significant", F.lit(False)), eff).otherwise(0.0)
    return joined.withColumn("effect_log", value).select(*rows.columns, "effect_log")


def compose(rows: DataFrame, cf: str = "cf_log", effect: str = "effect_log") -> DataFrame:
    """Counterfactual, event and extra LEVELS: levels are multiplied, logs never added."""
    level = F.expm1(F.greatest(F.col(cf), F.lit(0.0)))
    mult = F.exp(effect)
    return (rows.withColumn("cf_level", level).withColumn("game_level", level * mult)
            .withColumn("extra_level", level * (mult - 1.0)))


def compose_log(cf: Column, effect: Column, is_game: Column) -> Column:
    """Composed forecast back in log1p; rows without an event pass through."""
    level = F.expm1(F.greatest(cf, F.lit(0.0)))
    return F.log1p(level * F.when(is_game, F.exp(F.coalesce(effect, F.lit(0.0)))).otherwise(1.0))


def forecast_score(rows: DataFrame, effects: DataFrame, by: Sequence[str], hours: Sequence[int] = EVENING) -> DataFrame:
    """Event evenings: error ignoring the event against the composed forecast."""
    ev = rows.filter(F.col("game_day") & F.col("hour").between(*hours)).join(
        effects.select("band", F.col("did").alias("_e")), "band", "left")
    comp = compose_log(F.col("cf_log"), F.col("_e"), F.col("game_day"))
    scored = ev.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("cf_log"))).alias("mae_ignore"),
                                 F.avg(F.abs(F.col("y") - comp)).alias("mae_composed"))
    return scored.withColumn("improvement_pct", 100 * F.try_divide(
        F.col("mae_ignore") - F.col("mae_composed"), F.col("mae_ignore")))


def crossover(resid: DataFrame, venues: dict[str, Sequence[float]], n_draws: int = 1500, seed: int = 0,
              uppers: Sequence[float] = geo.PUBLISHED_BANDS_M) -> DataFrame:
    """Each treatment (home only, rival only) in each venue's bands, with intervals.

    Days with both events are in neither treatment; controls have neither.
    """
    treatments = {"home_only": F.col("game_day") & ~F.col("rival_day"), "rival_only": F.col("rival_day") & ~F.col("game_day")}
    control = F.col("is_control") & ~F.col("game_day") & ~F.col("rival_day")
    out = None
    for venue, (lat, lon) in venues.items():
        band = geo.band_upto(geo.flat_distance("lat", "lon", lat, lon), uppers)
        rows = resid.filter(F.col("hour").between(*EVENING) & F.col("resid").isNotNull() & ~F.isnan("resid"))
        days = rows.groupBy("date", band.alias("band")).agg(
            F.avg("resid").alias("resid"), *[F.bool_or(c).alias(c) for c in ("game_day", "rival_day", "is_control")])
        for name, treated in treatments.items():
            one = did(days, treated, control).join(bootstrap_did(days, treated, control, n_draws, seed), "band", "left")
            one = one.select(F.lit(venue).alias("venue"), F.lit(name).alias("treatment"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def lift_frame(pred: DataFrame, events: DataFrame, window: tuple[int, int] = (-2, 4), rings: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One row per event: covariates and the mean lift of each ring around the start."""
    inside = pred.filter(F.col("game_day") & F.col("relative_hour").between(*window))
    lift = inside.groupBy("date", "ring_id").agg(F.avg(F.col("observed") - F.col("predicted")).alias("lift"))
    wide = to_wide(lift, ["date"], "ring_id", list(rings), "lift", "ring_lift_")
    out = events.join(wide, "date")
    for name, value, period in (("start", "first_hour", 24.0), ("dow", "dow", 7.0), ("month", "month", 12.0)):
        s, c = dates.cyclic(F.col(value), period)
        out = out.withColumn(f"{name}_sin", s).withColumn(f"{name}_cos", c)
    return out.withColumn("is_night", (F.col("day_night") == "night").cast("double")).dropna()


def level_weighted_effect(rows: DataFrame, key: str = "band") -> DataFrame:
    """Level-weighted mean effect per key."""
    return rows.groupBy(key).agg(weighted_mean(F.col("effect_log"), F.col("cf_level")).alias("effect"))
