"""Benchmark decontamination by suffix arrays over the training texts.

A task cuts its documents into shards of about a megabyte and sorts the word suffixes of each shard into a suffix
array. Suffixes whose first two words start no test window are left out (a sparse suffix array): no search can end
there. Every test suffix is then binary-searched in the array, word by word; the range it ends in lists all places
of the window, and windows that follow each other in text and item join into the longest verbatim matches.

Words are runs of digits, letters a-z (A-Z lower-cased first) and anything beyond ASCII. A window has ``width``
words; an item of fewer words, but not none, is one window. Documents stay where they are: no row is shuffled.
The test side is handled in blocks of at most ``block_bytes`` of text on average, so what a task receives is bounded.

Null or empty texts have no words and no hits. Repeated rows are judged alike, each on its own. Items with null or
no words never match; a null item_id counts as the text "null". Columns of the result replace input columns of the
same name. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, U64, list_array, map_texts, mix, stored, text_bytes, windows, word_hashes

FIELDS = ("n_words bigint, n_hit bigint, longest_match bigint, item_ids array<string>, "
          "spans array<struct<start:int,end:int>>")
RESULT = ("n_words", "n_hit", "longest_match", "item_ids", "spans")


class TestWindows:
    """Distinct windows of a block of items, sorted by word hashes, and which items hold each."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        body, offs = text_bytes(pa.array(texts, pa.string()))
        words, _, _, rows = word_hashes(LOWER[body], offs, LETTERS)
        n = np.diff(rows)
        first, item = windows(rows, width)
        short = np.flatnonzero((n > 0) & (n < width))
        self.items = [str(i) for i in ids]
        length = np.r_[np.full(len(first), width), n[short]]
        first, item = np.r_[first, rows[short]], np.r_[item, short]
        place = first[:, None] + np.arange(width)
        key = np.where(np.arange(width) < length[:, None], np.r_[words, np.zeros(width, U64)][place], U64(0))
        full = np.column_stack([key, length.astype(U64)])
        self.keys, inverse = np.unique(full, axis=0, return_inverse=True) if len(full) else (full, np.zeros(0, int))
        inverse = inverse.ravel()
        self.length, self.keys = self.keys[:, -1].astype(np.int64), np.ascontiguousarray(self.keys[:, :-1].T)
        order = np.argsort(inverse, kind="stable")
        self.item, self.at = item[order], (first - rows[item])[order]
        self.holds = np.searchsorted(inverse[order], np.arange(len(self.length) + 1))
        two = np.where(self.length > 1, lead(self.keys[0], self.keys[1] if width > 1 else self.keys[0]), 0) if len(self.length) else np.zeros(0, U64)
        self.two = np.unique(two[self.length > 1])
        self.one = np.unique(self.keys[0][self.length == 1]) if len(self.length) else np.zeros(0, U64)
        self.mark = np.zeros(1 << 22, bool)
        self.mark[(self.two & U64((1 << 22) - 1)).astype(np.int64)] = True
        self.width = width


def lead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two words that follow each other."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def _narrow(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every wanted value inside its own range of a column that is sorted there."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        value = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((value <= want) if right else (value < want))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def search(tests: TestWindows, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of all places of all test windows in a shard of documents."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(tests.length):
        return none, none
    after = np.r_[words[1:], U64(0)]
    last = np.zeros(len(words), bool)
    last[(rows[1:] - 1)[np.diff(rows) > 0]] = True
    pair = lead(words, after)
    near = np.flatnonzero(tests.mark[(pair & U64((1 << 22) - 1)).astype(np.int64)] & ~last)
    near = near[np.isin(pair[near], tests.two)]
    if len(tests.one):
        near = np.union1d(near, np.flatnonzero(np.isin(words, tests.one)))
    if not len(near):
        return none, none
    row_end = rows[1:][np.searchsorted(rows, near, side="right") - 1]
    padded = np.r_[words, np.zeros(tests.width, U64)]
    column = [np.where(near + j < row_end, padded[near + j], U64(0)) for j in range(tests.width)]
    left = row_end - near
    order = np.lexsort([left, *column[::-1]])
    column, near, left = [c[order] for c in column], near[order], left[order]
    low = np.searchsorted(column[0], tests.keys[0], "left")
    high = np.searchsorted(column[0], tests.keys[0], "right")
    found = np.flatnonzero(low < high)
    low, high = low[found], high[found]
    for j in range(1, tests.width):
        deeper = tests.length[found] > j
        want, a, b = tests.keys[j][found[deeper]], low[deeper], high[deeper]
        low[deeper], high[deeper] = _narrow(column[j], a, b, want, False), _narrow(column[j], a, b, want, True)
        some = low < high
        found, low, high = found[some], low[some], high[some]
    count = high - low
    window = np.repeat(found, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    fits = left[place] >= tests.length[window]
    return window[fits], near[place][fits]


def _judge(tests: TestWindows, body: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    words, _, _, rows = word_hashes(LOWER[body], offs, LETTERS)
    n_rows = len(offs) - 1
    window, place = search(tests, words, rows)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + tests.length[window], -1)
    hit = np.cumsum(step[:-1]) > 0
    row_of = lambda p: np.searchsorted(rows, p, side="right") - 1
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    row_cut = rows[1:-1]
    row_cut = row_cut[(row_cut > 0) & (row_cut < len(words))]
    inner = row_cut[hit[row_cut] & hit[row_cut - 1]] if len(row_cut) else row_cut
    start = np.sort(np.r_[edges[::2], inner]).astype(np.int64)
    end = np.sort(np.r_[edges[1::2], inner]).astype(np.int64)
    span_row = row_of(start) if len(start) else start
    n_hit = np.bincount(row_of(np.flatnonzero(hit)), minlength=n_rows) if hit.any() else np.zeros(n_rows, np.int64)
    # items of each row; runs of windows along one item and diagonal are one match
    many = np.diff(tests.holds)[window]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(tests.holds[:-1][window], many)
    item, at, pos, size = tests.item[entry], tests.at[entry], np.repeat(place, many), np.repeat(tests.length[window], many)
    row = row_of(pos) if len(pos) else pos
    order = np.lexsort([pos, pos - at, item, row])
    item, at, pos, size, row = item[order], at[order], pos[order], size[order], row[order]
    longest = np.zeros(n_rows, np.int64)
    pair_row, pair_item = row[:0], item[:0]
    if len(pos):
        fresh = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(pos - at) != 0) | (np.diff(pos) != 1)]
        begin = np.flatnonzero(fresh)
        close = np.r_[begin[1:], len(pos)] - 1
        np.maximum.at(longest, row[begin], pos[close] + size[close] - pos[begin])
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
        pair_row, pair_item = row[new], item[new]
    names = pa.array([tests.items[i] for i in pair_item], pa.string())
    base = rows[:-1][span_row] if len(span_row) else span_row
    spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"])
    return [pa.array(np.diff(rows).astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(longest),
            list_array(names, np.bincount(pair_row, minlength=n_rows)), list_array(spans, np.bincount(span_row, minlength=n_rows))]


def _merge(spans: list[list[tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for part in spans for s in part):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sum(b - a for a, b in out), [tuple(x) for x in out]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns and rows of ``docs`` with ``n_words``, ``n_hit`` (words inside a window), ``longest_match`` (words),
    ``item_ids`` (items with an occurring window, sorted as text) and ``spans`` (hit word ranges).

    One block of items (the usual case) is one pass. For more, each pass searches the next block in the result of the
    one before, and the hits of a row are merged in that row.
    """
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).where("length(t) > 0").distinct()
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        bench = stored(bench)
    out = docs
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else bench
        got = part.toPandas()
        tests = TestWindows(list(got["i"]), list(got["t"]), width)
        if k == 0:
            out = map_texts(out, text, FIELDS, lambda body, offs, tests=tests: _judge(tests, body, offs))
            continue
        kept = [c for c in out.columns if c not in RESULT]
        before = out.select(*kept, F.struct(*RESULT).alias("__before"))
        now = map_texts(before, text, FIELDS, lambda body, offs, tests=tests: _judge(tests, body, offs))
        merge = F.udf(lambda a, b: _merge([a, b]), "struct<n:bigint,spans:array<struct<start:int,end:int>>>")
        now = now.withColumn("__both", merge(F.col("__before.spans"), F.col("spans")))
        out = now.select(*kept, "n_words", F.col("__both.n").alias("n_hit"), F.greatest("longest_match", "__before.longest_match").alias("longest_match"),
                         F.array_union("__before.item_ids", "item_ids").alias("item_ids"), F.col("__both.spans").alias("spans"))
    return out.withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))


def contaminated(share: int = 20) -> Column:
    """True for rows with a hit whose hit words are at least one in ``share`` of all."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    own = {c: f"__own_{c}" if c in RESULT else c for c in docs.columns}
    judged = contamination(docs.withColumnsRenamed(own), items, own[text], **options)
    return judged.where(~contaminated()).select(*[F.col(f"`{v}`").alias(c) for c, v in own.items()])
