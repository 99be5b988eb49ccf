"""Joins that Spark has no node for, written as equi-joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, attach, carried, in_ranges


def fold_left(spine: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join every source onto the spine. Sources hold one row per key."""
    return reduce(lambda acc, src: acc.join(src, list(keys), "left"), sources, spine)


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with the keys coalesced."""
    return a.join(b, list(keys), "full")


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` without a partner in ``b`` (never NOT IN: no null trap)."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def also_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str,
              values: Sequence[str], strict: bool = True) -> DataFrame:
    """Left rows with the latest right row before (or at) their time.

    A segmented scan: both sides are dealt out together by ranges of (keys, time), inside a
    range a running ``last`` finds the state, and the state at the end of earlier ranges is carried
    in for the one key that each range may share with those. So the rows of a key, or of one hour of it, lie in
    as many tasks as they need. ``right`` holds one row per key and time; its rows without a
    time are never met. A null key meets nothing, a null time has nothing before it. Adds ``asof_<time>`` and the value columns.
    """
    keys = list(keys)
    at = f"asof_{time}"
    state = F.struct(F.col(time).alias(at), *[F.col(v) for v in values])
    # At equal times a probe sorts before the feed when strict, after it otherwise; probes of one key and time are spread by their hash.
    first, second = (F.lit(True), F.lit(False)) if strict else (F.lit(False), F.lit(True))
    probe = left.select("*", F.lit(None).cast(right.select(state.alias("s")).schema["s"].dataType).alias("_state"), F.lit(True).alias("_probe"),
                        (~first).alias("_late"), F.xxhash64(*left.columns).alias("_salt"))
    feed = right.filter(F.col(time).isNotNull()).select(*keys, time, state.alias("_state"), F.lit(False).alias("_probe"), (~second).alias("_late"), F.lit(0).cast("long").alias("_salt"))
    rows = in_ranges(probe.unionByName(feed, allowMissingColumns=True), [*keys, time, "_late", "_salt"])

    ends = rows.filter("NOT _probe").groupBy(*keys, RANGE).agg(F.max_by("_state", time).alias("_end"))
    # a range without a right row still has to get the state of its key
    parts = rows.select(*keys, RANGE).distinct()
    parts = parts.join(ends.withColumnsRenamed({c: f"_e{c}" for c in [*keys, RANGE]}), reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in [*keys, RANGE]]), "left")
    carry = carried(parts, keys, F.last("_end", ignorenulls=True), "_carry")
    running = (Window.partitionBy(*keys, RANGE).orderBy(F.col(time), F.col("_late"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = rows.withColumn("_here", F.last("_state", ignorenulls=True).over(running)).filter("_probe")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(time).isNotNull())
    out = attach(here, carry, keys, "_carry").withColumn("_hit", F.when(keyed, F.coalesce("_here", "_carry")))
    return out.select(*left.columns, F.col(f"_hit.{at}").alias(at), *[F.col(f"_hit.{v}").alias(v) for v in values])


def around(events: DataFrame, fact: DataFrame, start: str, ts: str, lo: int, hi: int) -> DataFrame:
    """Fact rows in start+lo … start+hi hours of each event.

    The range becomes an equi-join: each event is exploded to its hours first.
    """
    hours = events.withColumn("relative_hour", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
        ts, F.col(start) + F.make_dt_interval(F.lit(0), F.col("relative_hour")))
    return fact.join(hours, ts)


def by_week(fact: DataFrame, weekly: DataFrame, keys: Sequence[str], date: str = "date",
            week: str = "week_start", how: str = "left") -> DataFrame:
    """Attach weekly rows to dated rows through the Monday of the date."""
    dated = fact.withColumn(week, F.date_sub(F.col(date), F.weekday(date)))
    return dated.join(weekly, [*keys, week], how)


def prefer(spine: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str],
           columns: Sequence[str], decided_by: str, names: tuple[str, str]) -> DataFrame:
    """Value of ``first`` where it has one, else of ``second``, plus a source tag.

    The tag of a whole row is decided by one column, as every column is filled
    on its own.
    """
    a = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = fold_left(spine, [a, b], keys)
    tag = F.when(F.col(f"_a_{decided_by}").isNotNull(), names[0]).otherwise(names[1])
    return both.select(*spine.columns, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in columns],
                       tag.alias("source"))


def carry_forward(fact: DataFrame, weekly: DataFrame, keys: Sequence[str], value: str,
                  date: str = "date", week: str = "week_start", zero_inside: bool = False) -> DataFrame:
    """Weekly value by date; where absent the unit's last one, flagged ``held``.

    ``zero_inside`` sets held rows inside the span the weekly table covers to 0
    instead, so only dates after its last week keep the held value.
    """
    keys = list(keys)
    last = weekly.groupBy(*keys).agg(F.max_by(value, week).alias("_last"))
    joined = by_week(fact, weekly.select(*keys, week, F.col(value).alias("_week_value")), keys, date, week)
    out = joined.join(last, keys, "left").withColumn("held", F.col("_week_value").isNull())
    filled = F.coalesce("_week_value", "_last", F.lit(0))
    if zero_inside:
        end = weekly.agg(F.max(week).alias("_end_week"))  # one row
        out = out.join(F.broadcast(end))
        filled = F.when(F.col("held") & (F.col(week) <= F.col("_end_week")), F.lit(0)).otherwise(filled)
    return out.withColumn(value, filled).drop("_week_value", "_last", "_end_week")


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side bundle of one-row aggregates."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)
