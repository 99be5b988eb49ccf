"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets integer measures. Those that pass the base rules feed one sketch per language, source and measure: a
table of counts over log-linear bins (64 exact values, then 32 bins for each doubling, so a bin is at most 1/32 wide).
Sketches merge by adding counts, hence language and overall sketches are sums of the finer ones. A group's fences are
its quartiles less or plus ``reach`` times the quartile distance (at least the measure's ``LEAST_SPREAD``); a group
with fewer than ``least_rows`` rows takes its language's fences, then the overall ones. The fences are joined to the
rows and rows outside any fence are dropped. Only counts per bin are shuffled, and they are combined before that.

Null and empty texts have no words, fail the base rules and feed no sketch. A null language or source is a value of
its own. Repeated rows count and are judged each on its own. A column of the result replaces one of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Measures per thousand words, the quartile distance that each has at least, and whether low values are bad as well.
LEAST_SPREAD = {"symbols": (20, False), "chars": (500, True), "dup_lines": (20, False), "repeats": (50, False)}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [c for c in docs.columns if c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        *own, F.filter(F.split(t, SPACE), lambda w: w != "").alias("__w"), lines.alias("__l"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    # a lambda reads these columns many times, so the planner keeps them as steps of their own
    step = step.select(
        *own, "word_chars", "n_symbols", F.size("__w").cast("long").alias("n_words"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    many = F.sequence(F.lit(0), F.size("__h") - WINDOW)
    key = lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])
    step = step.withColumn("__s", F.when(F.size("__h") >= WINDOW, F.array_sort(F.transform(many, lambda i: F.struct(key(i).alias("k"), i.alias("i"))))).otherwise(F.array()))
    again = lambda x, i: (F.get("__s", i - 1)["k"].eqNullSafe(x["k"])) | (F.get("__s", i + 1)["k"].eqNullSafe(x["k"]))
    step = step.withColumn("__p", F.array_sort(F.transform(F.filter("__s", again), lambda x: x["i"])))
    new = F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), p - F.coalesce(F.get("__p", j - 1), F.lit(-WINDOW))))
    step = step.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda s, x: s + x))
    return step.select(*own, *made)


def base_failed() -> Column:
    """Fewer than 20 words, or over three in ten words inside repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def bin_of(v: Column) -> Column:
    """Log-linear bin of a whole number from 0."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("long")


def bin_low(b: Column) -> Column:
    """Smallest value of a bin."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = {"symbols": "n_symbols", "chars": "word_chars", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
    return {m: F.floor(F.col(c) * 1000 / n).cast("long") for m, c in parts.items()}


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bin, n): counts of the rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(v).alias("bin")) for m, v in measures().items()]))
    return rows.where(~base_failed()).select(*keys, each.alias("x")).groupBy(*keys, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up to coarser keys."""
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, q1, q3): smallest values of the bins in which the quartiles lie."""
    by = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("rows", F.sum("n").over(by))
    at = lambda pct: bin_low(F.min(F.when(F.col("upto") * 100 >= F.col("rows") * pct, F.col("bin"))))
    return run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(25).alias("q1"), at(75).alias("q3"))


def fences(sketch: DataFrame, lang: str, source: str, reach: int, least_rows: int) -> DataFrame:
    """One row per language and source with the low and high fence of each measure."""
    levels = [quartiles(sketch, [lang, source]), quartiles(merged(sketch, [lang]), [lang]), quartiles(merged(sketch, []), [])]
    pick = lambda i: F.struct(*[F.col(f"l{i}.{c}").alias(c) for c in ("rows", "q1", "q3")])
    own, wide, all_ = (d.alias(f"l{i}") for i, d in enumerate(levels))
    joined = own.join(wide, [lang, "measure"]).join(all_, "measure")
    best = F.when(F.col("l0.rows") >= least_rows, pick(0)).when(F.col("l1.rows") >= least_rows, pick(1)).otherwise(pick(2))
    q = joined.select(F.col(f"l0.{lang}").alias(lang), F.col(f"l0.{source}").alias(source), F.col("measure"), best.alias("q"))
    least = F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in LEAST_SPREAD.items() for x in (m, s)]), F.col("measure"))
    spread = F.greatest(F.col("q.q3") - F.col("q.q1"), least) * reach
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    return q.groupBy(lang, source).agg(*[of(m, F.col("q.q3") + spread).alias(f"high_{m}") for m in LEAST_SPREAD],
                                       *[of(m, F.col("q.q1") - spread).alias(f"low_{m}") for m, (_, both) in LEAST_SPREAD.items() if both])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = 3, least_rows: int = 100) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed and kept."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = stored(measured(docs.withColumns({"__lang": name(lang), "__source": name(source)}), text).drop(text))
    limit = fences(sketches(rows, ["__lang", "__source"]), "__lang", "__source", reach, least_rows)
    inside = [v <= F.col(f"high_{m}") for m, v in measures().items()]
    inside += [v >= F.col(f"low_{m}") for m, v in measures().items() if LEAST_SPREAD[m][1]]
    made = ("base_failed", "kept")
    out = rows.join(limit, ["__lang", "__source"], "left")
    return out.select(*[c for c in rows.columns if not c.startswith("__") and c not in made], base_failed().alias("base_failed"),
                      (~base_failed() & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(True))).alias("kept"))
