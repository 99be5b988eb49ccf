"""Packed arrays and JSON maps held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slots_lenient(text: Column) -> Column:
    """'[1, 2, x]' to array<bigint>; a bad slot is NULL, the others survive."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    return F.transform(F.split(inner, ","), lambda s: F.trim(s).try_cast("bigint"))


def slots_strict(text: Column) -> Column:
    """JSON array to array<bigint>; any bad slot makes the array NULL."""
    return F.from_json(text, "array<bigint>")


def slot_sum(slots: Column) -> Column:
    """Sum of the non-NULL slots."""
    return F.aggregate(slots, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0).cast("bigint")))


def counts_map(text: Column) -> Column:
    """JSON object of counts to map<string,double>; odd keys such as '<5' work."""
    return F.from_json(text, "map<string,double>")


def weighted_keys(counts: Column, weights: dict[str, float]) -> Column:
    """Sum of map values times a fixed weight per key; missing keys count 0."""
    terms = [F.coalesce(F.element_at(counts, F.lit(k)), F.lit(0.0)) * w for k, w in weights.items()]
    return sum(terms[1:], terms[0])


def date_span(start: Column, end: Column) -> Column:
    """Every date start..end; a NULL end means a single day."""
    return F.sequence(start, F.greatest(start, F.coalesce(end, start)))


def hour_span(lo: Column, hi: Column) -> Column:
    """Hours lo..hi clipped to 0..23."""
    return F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(23)).cast("int"))
