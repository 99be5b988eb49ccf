"""Query registration and the symmetric output casts of both engines."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .standins import CTES, Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(shared_tables(spark, folder))
        return df.select(*[_spark_cast(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(_sql_cast(n, k) for n, k in self.columns)
        ctes = needed_ctes(self.sql)
        head = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in ctes) + " " if ctes else ""
        return f"{head}SELECT {casts} FROM ({self.sql}) AS q"


QUERIES: dict[str, Query] = {}
_TABLES: dict[tuple[str, int, str], Tables] = {}


def shared_tables(spark: SparkSession, folder: str) -> Tables:
    """One set of stand-ins per application, session and folder."""
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]


def query(name: str, ids: str, columns: str, sql: str | None = None):
    """Register a builder. ``columns``: 'name kind, …' with kinds l (integer),
    b (boolean as 0/1), s (text), d (date as text), t (timestamp as text) and
    fN (double rounded to N places). Both engines apply the same casts.
    """
    spec = tuple(tuple(c.split()) for c in columns.split(","))

    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(ids.split()), spec, build, sql)
        return build

    return add


def needed_ctes(sql: str) -> list[str]:
    """Stand-in tables the SQL names, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                order.append(word)

    visit(sql)
    return order


def _spark_cast(name: str, kind: str):
    c = F.col(name)
    if kind in "lb":
        c = c.cast("long")
    elif kind == "s":
        c = c.cast("string")
    elif kind == "d":
        c = F.date_format(c.cast("date"), "yyyy-MM-dd")
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        c = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
    return c.alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind in "lb":
        body = f'CAST("{name}" AS BIGINT)'
    elif kind == "s":
        body = f'CAST("{name}" AS VARCHAR)'
    elif kind == "d":
        body = f"strftime(CAST(\"{name}\" AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        body = f"strftime(CAST(\"{name}\" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    else:
        body = f'ROUND(CAST("{name}" AS DOUBLE), {int(kind[1:])}) + CAST(0 AS DOUBLE)'
    return f'{body} AS "{name}"'
