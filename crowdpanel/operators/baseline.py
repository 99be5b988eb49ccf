"""Rolling control baselines: strictly past, event-free, one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_baseline(panel: DataFrame, depths: Sequence[int] = (2, 4), cap_days: int = 120, unit: str = "unit_id",
                     control: str = "clean_control_strict", y: str = "y", observed: str | None = None) -> DataFrame:
    """Baselines of each panel row from the latest control row strictly before it.

    Control rows of a (unit, weekday, hour) carry the mean of their last k control
    rows and of the last ``cap_days`` days; other rows take the state of the last
    control row of an earlier date. Both window passes use the same exchange on
    (unit, dow, hour): hash partitioning by those keys already clusters the
    finer (…, is control) groups, so no self-join is needed. A group holds one
    row per week of the panel.
    """
    keys = [unit, "dow", "hour"]
    flag = F.col(control) if observed is None else F.col(control) & F.col(observed)
    rows = panel.withColumn("_c", flag).repartition(*keys)
    controls = Window.partitionBy(*keys, "_c").orderBy("date")
    number = Window.partitionBy(*keys, "_c").orderBy(F.unix_date("date"))
    means = [F.avg(y).over(controls.rowsBetween(-(k - 1), 0)).alias(f"base_k{k}") for k in depths]
    capped = number.rangeBetween(-cap_days, 0)
    means += [F.avg(y).over(capped).alias(f"base_cap{cap_days}"), F.count("*").over(capped).alias(f"n_cap{cap_days}")]
    names = [f"base_k{k}" for k in depths] + [f"base_cap{cap_days}", f"n_cap{cap_days}"]
    stated = rows.select("*", *means)
    state = F.when(F.col("_c"), F.struct(*names, F.col("date").alias("as_of")))
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    out = stated.withColumn("_s", F.last(state, ignorenulls=True).over(past))
    picked = [F.col(f"_s.{n}").alias(n) for n in names]
    if observed is not None:
        picked += [F.col("_s.as_of").alias("baseline_as_of"),
                   F.datediff("date", "_s.as_of").alias("baseline_staleness_days")]
    return out.select(unit, "date", "hour", *picked)
