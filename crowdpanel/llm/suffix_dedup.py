"""Removal of long repeated byte strings with suffix arrays over a routed phrase dictionary.

Wanted: every byte of every text that lies in a string of ``length`` bytes that also starts anywhere else.

Routing. Each start p gets the anchor of its string: of the ``grain``-byte strings inside text[p : p + length] the one
with the smallest hash (the first of equals). Equal strings have equal anchors at equal offsets. Consecutive starts
with one anchor form a phrase, text[first start : last start + length]; phrases overlap so that each string lies in
exactly one (as in prefix-free parsing). An anchor seen once holds no repeat and is dropped before any text moves.

Dictionary. Of an anchor seen more often only distinct phrases are sorted. A phrase that occurs twice is a repeat as a
whole. For the rest a task builds the suffix array of an anchor's phrases, the anchor itself written as one symbol, by
linear grouping (suffix_sort); strings equal over ``length`` bytes are neighbours there. An anchor with more than
``chunk`` distinct phrases is cut into several arrays, and their distinct strings are matched by a join on hashes, so no
anchor, however common, is one task's work.

A null text is empty. Texts shorter than ``length`` lose nothing. Matches never cross texts. Repeated rows are copies
of each other and are removed as such. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, list_array, mix, powers, prefix_sums, slices, stored, stretch_hash, text_bytes, windows
from .suffix_sort import suffix_array

PHRASE = "ka bigint, kb bigint, fp bigint, ph bigint, s int, e int, a int"


def anchors(body: np.ndarray, offs: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, anchor, anchor hash and phrase hash of every phrase of the rows."""
    start, row = windows(offs, length)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    sums = prefix_sums(body)
    m = len(body) - grain + 1
    value = mix((sums[grain:] - sums[:m]) * powers(m, inverse=True))
    width = length - grain + 1
    key = np.full(-(-m // width) * width + width, ~U64(0))
    key[:m] = ((value >> U64(31)) << U64(31)) | np.arange(m, dtype=U64)
    block = key.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[start], ahead[start + width - 1]) & U64((1 << 31) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    first, last = start[begin], start[np.r_[begin[1:], len(start)] - 1]
    at, row = anchor[begin], row[begin]
    return row, first, last, at, value[at], stretch_hash(sums, first, last + length)


def _phrases(length: int, grain: int):
    def run(batches):
        for rows, body, offs in slices(batches, "text"):
            row, first, last, at, fp, ph = anchors(body, offs, length, grain)
            base = offs[:-1][row]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pick), rows.column(1).take(pick), pa.array(fp.view(np.int64)), pa.array(ph.view(np.int64)),
                 *(pa.array((x - base).astype(np.int32)) for x in (first, last, at))], ["ka", "kb", "fp", "ph", "s", "e", "a"])
    return run


def equal_strings(phrases: list[bytes], anchor: list[int], starts: list[int], length: int,
                  grain: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each phrase the offsets of starts whose string another phrase holds as well; second, one of each distinct string.

    All phrases share the ``grain`` bytes at their ``anchor`` offset; strings start at offsets below ``starts``.
    """
    symbols: list[int] = []
    owner: list[tuple[int, int]] = []
    for k, (body, a) in enumerate(zip(phrases, anchor)):
        symbols += body[:a]
        symbols.append(256)
        symbols += body[a + grain:]
        symbols.append(257 + k)
        owner.append((len(symbols), k))
    phrase_of = [0] * len(symbols)
    begin_of, at = [], 0
    for end, k in owner:
        phrase_of[at:end] = [k] * (end - at)
        begin_of.append(at)
        at = end
    twice: list[set[int]] = [set() for _ in phrases]
    first: list[list[int]] = [[] for _ in phrases]
    last, last_k, last_o = b"", -1, -1
    for pos in suffix_array(symbols):
        k = phrase_of[pos]
        o = pos - begin_of[k]
        if o >= starts[k] or o > anchor[k]:
            continue
        here = phrases[k][o:o + length]
        if here == last:
            twice[last_k].add(last_o)
            twice[k].add(o)
        else:
            first[k].append(o)
        last, last_k, last_o = here, k, o
    return [sorted(t) for t in twice], first


def _sort_groups(length: int, grain: int):
    """Batches sorted by (fp, part): one suffix array for each group; out: repeated starts, and distinct strings of split anchors."""
    def solve(group: list[dict]):
        bodies = [g["body"] for g in group]
        twice, first = equal_strings(bodies, [g["a"] - g["s"] for g in group], [g["e"] - g["s"] + 1 for g in group], length, grain)
        for g, t in zip(group, twice):
            if t and g["c"] == 1:
                t = np.array(t)
                cut = np.flatnonzero(np.diff(t) > 1)
                for a, b in zip(t[np.r_[0, cut + 1]], t[np.r_[cut, len(t) - 1]]):
                    yield g["ka"], g["kb"], g["s"] + int(a), g["s"] + int(b), None, None, False
        if group[0]["parts"] > 1:
            flat, offs = text_bytes(pa.array([g["body"][o:o + length] for g, f in zip(group, first) for o in f], pa.binary()))
            sums = prefix_sums(flat)
            one = stretch_hash(sums, offs[:-1], offs[1:]).view(np.int64)
            two = stretch_hash(sums, offs[:-1], offs[:-1] + length - grain).view(np.int64)
            places = ((g, o) for g, f in zip(group, first) for o in f)
            for (g, o), x, y in zip(places, one.tolist(), two.tolist()):
                yield g["ka"], g["kb"], g["s"] + o, g["s"] + o, x, y, g["c"] == 1

    def run(batches):
        group: list[dict] = []
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                if group and (g["fp"], g["part"]) != (group[0]["fp"], group[0]["part"]):
                    out += solve(group)
                    group = []
                if not group or any(g[c] != group[-1][c] for c in ("ka", "kb", "s")):  # else a row repeated in the table
                    group.append(g)
            yield _found(out)
        if group:
            yield _found(list(solve(group)))
    return run


FOUND = "ka bigint, kb bigint, s int, e int, g1 bigint, g2 bigint, single boolean"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in FOUND.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def repeated_starts(base: DataFrame, length: int, grain: int, chunk: int) -> DataFrame:
    """(ka, kb, s, e): ranges of starts of repeated strings; base has the row keys ka, kb and the text."""
    spread = stored(base.where(F.octet_length("text") >= length).select("ka", "kb", "text").mapInArrow(_phrases(length, grain), PHRASE))
    live = spread.groupBy("fp").agg(F.count("*").alias("n"), F.min("ph").alias("lo"), F.max("ph").alias("hi")).where("n > 1")
    hits = stored(spread.join(live.select("fp", (F.col("lo") == F.col("hi")).alias("same")), "fp"))
    discard(spread)
    whole = hits.where("same").select("ka", "kb", "s", "e")

    mixed = hits.where("not same")
    distinct = stored(mixed.groupBy("fp", "ph").agg(F.count("*").alias("c"), F.min(F.struct("ka", "kb", "s", "e", "a")).alias("at")).select("fp", "ph", "c", "at.*"))
    copied = mixed.join(distinct.where("c > 1").select("fp", "ph"), ["fp", "ph"], "left_semi").select("ka", "kb", "s", "e")
    parts = distinct.groupBy("fp").agg(F.ceil(F.count("*") / chunk).alias("parts"), F.min("c").alias("least")).where("least = 1").select("fp", "parts")
    wanted = distinct.join(parts, "fp").withColumn("part", F.pmod("ph", "parts"))
    asked = wanted.groupBy("ka", "kb").agg(F.collect_set(F.struct("fp", "part", "parts", "c", "s", "e", "a")).alias("asked"))
    raw = F.col("text").cast("binary")
    cut = F.transform("asked", lambda r: F.struct(
        *[r[c].alias(c) for c in ("fp", "part", "parts", "c", "s", "e", "a")],
        F.substring(raw, r["s"] + 1, r["e"] - r["s"] + length).alias("body")))
    bodies = base.join(asked, ["ka", "kb"]).select("ka", "kb", F.explode(cut).alias("r")).select("ka", "kb", "r.*")
    grouped = bodies.repartition("fp", "part").sortWithinPartitions("fp", "part", "ka", "kb", "s")
    found = stored(grouped.mapInArrow(_sort_groups(length, grain), FOUND))
    sorted_ = found.where("g1 is null").select("ka", "kb", "s", "e")
    strings = found.where("g1 is not null")
    across = strings.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1").select("g1", "g2")
    crossed = strings.where("single").join(across, ["g1", "g2"], "left_semi").select("ka", "kb", "s", "e")
    return whole.union(copied).union(sorted_).union(crossed)


def _cut(body: np.ndarray, offs: np.ndarray, ranges: pa.Array, length: int) -> tuple[pa.Array, pa.Array]:
    """Merged removed spans and the bytes that stay, for each row."""
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ranges), 0))
    flat = ranges.flatten()
    row = np.repeat(np.arange(len(counts)), counts)
    step = np.zeros(len(body) + 1, np.int64)
    base = offs[:-1][row]
    np.add.at(step, base + np.asarray(flat.field("s")), 1)
    np.add.at(step, base + np.asarray(flat.field("e")) + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.zeros(len(body) + 1, bool)
    edge[offs] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]])) if len(body) else np.zeros(0, np.int64)
    end = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1 if len(body) else begin
    where = np.searchsorted(offs, begin, side="right") - 1
    lead = offs[:-1][where]
    spans = pa.StructArray.from_arrays([pa.array((begin - lead).astype(np.int32)), pa.array((end - lead).astype(np.int32))], ["start", "end"])
    stay = np.r_[0, np.cumsum(~gone)][offs] if len(body) else offs
    rest = body[~gone]
    kept = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(stay.astype(np.int32)), pa.py_buffer(rest.tobytes())])
    return list_array(spans, np.bincount(where, minlength=len(counts))), kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, grain: int = 64, chunk: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the removed byte ranges and the bytes that stay, joined."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("doc_id").alias("ka"), F.xxhash64("text").alias("kb"))
    ranges = repeated_starts(base, length, grain, chunk).groupBy("ka", "kb").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    joined = base.join(ranges, ["ka", "kb"], "left").select("doc_id", "text", "ranges")
    id_field = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rows, body, offs in slices(batches, "text"):
            spans, kept = _cut(body, offs, rows.column(2), length)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {id_field}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
