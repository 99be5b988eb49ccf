"""Treatment and control-day rules. One function per rule, used everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exhibition codes left out of treatment.
EXHIBITION_TYPES = ("S", "E")
NEARBY_FLAGS = ("rival_day", "convention_day", "citywide_day", "fair_day")


def is_treatment_game(game_type: Column, exhibition: Sequence[str] = EXHIBITION_TYPES) -> Column:
    """Everything but exhibitions; postseason codes stay in."""
    return ~game_type.isin(*exhibition)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def clean_control(strict: bool = False, game: str = "game_day", venue: str = "venue_day",
                  nearby: Sequence[str] = NEARBY_FLAGS) -> Column:
    """Shipped rule: no game and no other event at the venue.

    ``strict`` also excludes every nearby draw, so strict is always a subset.
    """
    flags = (game, venue, *(nearby if strict else ()))
    return reduce(lambda a, b: a & b, [~F.col(f) for f in flags])


def any_confounder(columns: Sequence[str]) -> Column:
    """At least one of the event detail columns is filled."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
