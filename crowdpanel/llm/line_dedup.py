"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words between white space. Two lines are the same if their words are, and near if one word
inserted, deleted or replaced turns one into the other and both have at least ``least_words`` words (shorter lines must
be the same). A line goes if an earlier line of the table is the same or near; earlier means a smaller (doc_id, line
number). Whether that earlier line stays itself plays no part, so the result does not depend on any order of work.

Each distinct line emits the hash of itself and of all variants with one word deleted. Lines that share a variant made by
deleting the same place differ in that word at most; a line that equals another's variant lacks one word of it. In
both cases the smallest member of a group serves all others, so groups are aggregated to a minimum and joined back,
never paired. The found pairs are verified on the words.

Before variants are made, lines that cannot have a neighbour are set aside: of two near lines the first or the second
half agrees, so halves are counted and only lines with a half that another line shares go on.

Null and empty texts and lines without words are left alone. Rows of equal id and text (repeated rows) are treated
alike. A null id counts as the smallest. Other columns pass through unchanged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, NOT_SPACE, U64, mix, powers, slices, stored, word_hashes

_BACK = U64(pow(BASE, -1, 1 << 64))
LINE = "no int, h bigint, g bigint, n int, p0 bigint, s0 bigint, p1 bigint, s1 bigint"


def line_offsets(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of the rows (n + 1) and the row of each line; empty rows have one empty line."""
    cut = np.flatnonzero(body == 10) + 1
    row_of_cut = np.searchsorted(offs, cut - 1, side="right") - 1
    start = np.r_[offs[:-1], cut]
    row = np.r_[np.arange(len(offs) - 1), row_of_cut]
    order = np.lexsort([np.r_[np.zeros(len(offs) - 1), np.ones(len(cut))], start, row])
    return np.r_[start[order], offs[-1]], row[order]


def _sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(len(words)), out=out[1:])
    return out


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(len(sums), inverse=True)[a] + (b - a).astype(U64) + U64(salt << 32))


def _lines(batches):
    for rows, body, offs in slices(batches, "text"):
        at, row = line_offsets(body, offs)
        words, _, _, cut = word_hashes(body, at, NOT_SPACE)
        no = np.arange(len(row)) - np.searchsorted(row, row)
        n = np.diff(cut)
        full = np.flatnonzero(n)
        a, b, n = cut[:-1][full], cut[1:][full], n[full]
        sums = _sums(words)
        halves = []
        for k in (0, 1):
            short = np.maximum(n - k, 0)
            half = short // 2
            halves += [_hash(sums, a, a + half, 2) ^ mix(short.astype(U64)), _hash(sums, b - (short - half), b, 3) ^ mix(short.astype(U64))]
        pick = pa.array(row[full])
        numbers = [no[full].astype(np.int32), _hash(sums, a, b).view(np.int64), _hash(_sums(mix(words)), a, b, 7).view(np.int64), n.astype(np.int32),
                   *(x.view(np.int64) for x in halves)]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), *map(pa.array, numbers)],
                                         ["doc_id", "kb", *[f.split()[0] for f in LINE.split(", ")]])


def _variants(batches):
    """For each line its own hash (place -1) and the hash of each variant with one word deleted."""
    for rows, body, offs in slices(batches, "text"):
        words, _, _, cut = word_hashes(body, offs, NOT_SPACE)
        sums = _sums(words)
        a, b = cut[:-1], cut[1:]
        n = b - a
        line = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(words))
        raw = ((sums[i] - sums[a[line]]) + (sums[b[line]] - sums[i + 1]) * _BACK) * powers(len(sums), inverse=True)[a[line]]
        cutout = mix(raw + (n[line] - 1).astype(U64))
        v = np.r_[_hash(sums, a, b), cutout]
        place = np.r_[np.full(len(n), -1), i - a[line]]
        pick = pa.array(np.r_[np.arange(len(n)), line])
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(place.astype(np.int32)), *(rows.column(c).take(pick) for c in range(3))],
                                         ["v", "place", "doc_id", "kb", "no"])


def within_one(a: str, b: str) -> bool:
    """True if one word inserted, deleted or replaced, or nothing, turns one line into the other."""
    x, y = sorted((re.findall(r"[^\x20\x09-\x0D]+", t) for t in (a, b)), key=len)
    if len(y) - len(x) > 1:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) == len(y)):] == y[k + 1:]


def dropped_lines(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """(doc_id, kb, no, same): lines with an earlier equal (same) or near line; docs: doc_id, text and kb, a hash of the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lines = stored(docs.select("doc_id", "kb", "text").mapInArrow(_lines, f"doc_id {id_type}, kb bigint, {LINE}"))
    pos = F.struct("doc_id", "kb", "no")
    halves = ("p0", "s0", "p1", "s1")
    firsts = stored(lines.groupBy("h", "g").agg(F.min(pos).alias("pos"), F.count("*").alias("c"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in halves]))
    copies = firsts.where("c > 1").select("h", "g", F.col("pos").alias("first"))
    same = lines.select("h", "g", "doc_id", "kb", "no").join(copies, ["h", "g"]).where(~pos.eqNullSafe(F.col("first"))).select("doc_id", "kb", "no")

    long_ = firsts.where(F.col("n") >= least_words)
    keys = long_.select("pos", F.explode(F.array_distinct(F.array(*halves))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = keys.join(shared, "key", "left_semi").select("pos.*").groupBy("doc_id", "kb").agg(F.collect_set("no").alias("nos"))
    picked = docs.join(live.toDF("l_id", "l_kb", "nos"), docs["doc_id"].eqNullSafe(F.col("l_id")) & (docs["kb"] == F.col("l_kb")))
    cut = picked.select("doc_id", "kb", "nos", F.split("text", "\n").alias("all"))
    line = F.explode(F.transform("nos", lambda i: F.struct(i.alias("no"), F.get("all", i).alias("text"), F.size("all").alias("of"))))  # two uses keep the split outside
    texts = stored(cut.select("doc_id", "kb", line.alias("x")).select("doc_id", "kb", "x.no", "x.text").dropDuplicates(["doc_id", "kb", "no"]))

    posts = stored(texts.mapInArrow(_variants, f"v bigint, place int, doc_id {id_type}, kb bigint, no int"))
    deleted, whole = posts.where("place >= 0"), posts.where("place < 0").select("v", pos.alias("own"))
    swapped = deleted.groupBy("v", "place").agg(F.min(pos).alias("near"), F.count("*").alias("c")).where("c > 1").drop("c")
    one = deleted.join(swapped, ["v", "place"]).select(pos.alias("pos"), "near")
    two = deleted.join(whole, "v").select(pos.alias("pos"), F.col("own").alias("near"))
    three = whole.join(deleted.groupBy("v").agg(F.min(pos).alias("near")), "v").select(F.col("own").alias("pos"), "near")
    pairs = one.union(two).union(three).where("near < pos").groupBy("pos").agg(F.min("near").alias("near"))
    at = lambda s: texts.select(pos.alias(s), F.col("text").alias(f"text_{s}"))
    check = F.udf(within_one, "boolean")
    near = pairs.join(at("pos"), "pos").join(at("near"), "near").where(check("text_pos", "text_near")).select("pos.*")
    return same.withColumn("same", F.lit(True)).union(near.withColumn("same", F.lit(False)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 8) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and n_lines (all lines), n_same and n_near (lines that went)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("kb"))
    gone = dropped_lines(base, least_words).groupBy("doc_id", "kb").agg(
        F.collect_set(F.when(F.col("same"), F.col("no"))).alias("__same"), F.collect_set(F.when(~F.col("same"), F.col("no"))).alias("__near"))
    made = ("n_lines", "n_same", "n_near")
    own = [c for c in docs.columns if c not in made]
    left = docs.select(*own).withColumn("__kb", F.xxhash64(F.col(text)))
    both = left.join(gone.toDF("__id", "__gkb", "__same", "__near"), left[id_col].eqNullSafe(F.col("__id")) & (left["__kb"] == F.col("__gkb")), "left")
    none = F.array().cast("array<int>")
    both = both.withColumns({"__same": F.coalesce("__same", none), "__near": F.coalesce("__near", none)})
    both = both.withColumn("__lines", F.split(F.col(text), "\n"))
    lines = F.col("__lines")
    left_over = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.concat("__same", "__near"))
    stay = F.transform(left_over, lambda i: F.get("__lines", i))
    fresh = F.when((F.size("__same") + F.size("__near")) == 0, F.col(text)).otherwise(F.array_join(stay, "\n"))
    counts = [F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.size("__same").cast("long").alias("n_same"),
              F.size("__near").cast("long").alias("n_near")]
    return both.select(*[fresh.alias(c) if c == text else F.col(f"`{c}`") for c in own], *counts)
