"""Dirty numeric text, units and search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffix abbreviations and locality words of the place search.
STREET_SUFFIXES = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "road": "rd",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "terrace": "ter",
    "highway": "hwy",
    "parkway": "pkwy",
    "square": "sq",
    "plaza": "plz",
}
LOCALITY_WORDS = ("sf", "ca", "california", "usa")
LOCALITY_PAIRS = (("san", "francisco"), ("united", "states"))
LOCAL_POSTCODE = "^94[0-9]{3}$"


# Characters kept of a sensor reading.
SIGNED_NUMBER = "[^-0-9.]"
UNSIGNED_NUMBER = "[^0-9.]"


def sensor_number(text: Column, drop: str = UNSIGNED_NUMBER, trace: str | None = "T") -> Column:
    """Trace mark is 0, quality letters are stripped, what is left is cast or NULL."""
    number = F.regexp_replace(text, drop, "").try_cast("double")
    return number if trace is None else F.when(F.trim(text) == trace, F.lit(0.0)).otherwise(number)


def celsius_to_f(c: Column) -> Column:
    return F.round(c * 9.0 / 5.0 + 32.0, 1)


def mm_to_inches(mm: Column) -> Column:
    return F.round(mm / 25.4, 3)


def mps_to_mph(mps: Column) -> Column:
    return F.round(mps * 2.23694, 1)


def words(text: Column) -> Column:
    """Lowercase tokens, apostrophes dropped, street suffixes abbreviated."""
    plain = F.regexp_replace(F.lower(text), "['’]", "")
    tokens = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in STREET_SUFFIXES.items() for x in pair])
    return F.transform(tokens, lambda w: F.coalesce(table[w], w))


def _let(value: Column, body) -> Column:
    """Bind an expression once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def query_words(text: Column) -> Column:
    """Search tokens without locality words, unless nothing else is left."""

    def strip(tokens: Column) -> Column:
        def pair_at(i: Column) -> Column:
            here, after = F.get(tokens, i), F.get(tokens, i + 1)
            hit = F.lit(False)
            for first, second in LOCALITY_PAIRS:
                hit = hit | F.coalesce((here == first) & (after == second), F.lit(False))
            return hit

        def keep(w: Column, i: Column) -> Column:
            return ~(w.isin(*LOCALITY_WORDS) | w.rlike(LOCAL_POSTCODE) | pair_at(i) | pair_at(i - 1))

        return _let(F.filter(tokens, keep), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(tokens))

    return _let(words(text), strip)
