"""Phrases of words that keep company, from the sizes of equal partitions of sorted suffixes.

A suffix is the run of words from one position to the end of its piece, at most ``longest`` of them. Suffixes are routed
over the cluster by their leading words: the counts of leading words and leading pairs over all texts show which of them
can reach ``least``; a suffix is cut before the first word, or behind the first pair, that can not. What is left is
range-partitioned by its words, so that even a very common leading word or pair is dealt evenly, and each task sorts
pointers to its suffixes by a multikey three-way quicksort. Its equal partitions at depth d hold all occurrences of one phrase of d words
in the task's range; their sizes are the counts. Partitions below ``least`` are abandoned, but for those that a range border cuts, whose parts are
added up over the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, U64, discard, mix, prefix_sums, slices, stored, stretch_hash, text_bytes, word_bounds

#: Bytes that end a piece, and bytes that belong to words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SEPARATOR
WORD[[0x20, 0x09]] = False
#: Bits of the marks of frequent words and pairs; more marks than fit only let more suffixes pass.
MARK_BITS = 1 << 25
#: Bytes of text that are counted together before rows leave a task.
COUNT_BYTES = 3 << 20
#: Suffixes that one task sorts.
SHARE = 1 << 19
#: Sub-groups in which a language's rows are ranked before the last ranking.
RANK_GROUPS = 64


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, absorb: int = 80, first: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases (all if None).

    A phrase has 2 to ``longest`` words of one piece and a = f(phrase) >= ``least``; n counts all words of the language. A cut
    behind the first k words gives l and r, the counts of both parts, and floor(2000000 a / (l + r)); the lowest such score
    counts, then the smallest k. Phrases that lie in a longer one with 100 f(longer) >= ``absorb`` a are dropped.

    Null and empty texts have no words; a null language is ``und`` and joins rows that say so. Repeated rows count each time.
    An empty table, or one without frequent phrases, gives no rows. Ties in score go by a, then by phrase in byte order, so
    that ranks are unique. A text is held whole in one task, with about 30 bytes of memory for one of text; suffixes of all texts are dealt out
    evenly. Other columns of ``docs`` are not read and may have any names.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    all_words = stored(_summed(_counted(rows, 1, longest, [])))
    n = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = [stored(all_words.where(F.col("f") >= least))]
    marks = [_marks(frequent[0])]
    frequent.append(stored(_summed(_counted(rows, 2, longest, marks)).where(F.col("f") >= least)))
    marks.append(_marks(frequent[1]))
    suffixes = stored(_counted(rows, 3, longest, marks))
    frequent.append(stored(sorted_counts(suffixes, least)))
    discard(suffixes)
    known = frequent[0].unionByName(frequent[1]).unionByName(frequent[2]).withColumn("words", F.split("phrase", " "))
    return _ranked(_scored(known, least, absorb).join(n, "lang"), first)


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _counted(rows: DataFrame, depth: int, longest: int, marks: list[np.ndarray]) -> DataFrame:
    """Partial counts (lang, phrase, f): of words, of pairs of marked words, or of marked suffixes of 3 to ``longest`` words."""
    shared = [rows.sparkSession.sparkContext.broadcast(m) for m in marks]

    def run(batches):
        for batch, body, offs in slices(batches, "text", COUNT_BYTES):
            for phrase, f, langs in _slice_counts(batch.column(batch.schema.get_field_index("lang")), LOWER[body], offs, depth, longest, [m.value for m in shared]):
                for at in range(0, len(f), 1 << 17):
                    yield pa.RecordBatch.from_arrays([x[at:at + (1 << 17)] for x in (langs, phrase, f)], ["lang", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, phrase string, f bigint")


def _slice_counts(lang_column, body: np.ndarray, offs: np.ndarray, depth: int, longest: int, marks: list[np.ndarray]):
    start, end = word_bounds(body, offs, WORD)
    if not len(start):
        return
    lengths = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=lengths[1:])
    letters = np.ascontiguousarray(body[WORD[body]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(lengths), pa.py_buffer(letters)]).dictionary_encode()
    code, word = words.indices.to_numpy().astype(np.int64), words.dictionary
    spoken = lang_column.dictionary_encode()
    row = np.searchsorted(offs, start, side="right") - 1
    tongue = spoken.indices.to_numpy().astype(np.int64)[row]
    piece = np.searchsorted(np.flatnonzero(SEPARATOR[body]), start)
    follows = np.zeros(len(start), bool)  # the next word stands in the same piece
    follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])

    def out(at: np.ndarray, count: np.ndarray, k: int):
        phrase = word.take(pa.array(code[at]))
        for j in range(1, k):
            phrase = pc.binary_join_element_wise(phrase, word.take(pa.array(code[at + j])), pa.scalar(b" ", pa.large_binary()))
        return phrase.cast(pa.large_string()).cast(pa.string()), pa.array(count.astype(np.int64)), spoken.dictionary.take(pa.array(tongue[at])).cast(pa.string())

    size = len(word)
    if depth == 1:
        _, at, count = np.unique(tongue * size + code, return_index=True, return_counts=True)
        yield out(at, count, 1)
        return
    heard, said = _hashes(spoken.dictionary), _hashes(word)
    good = _marked(marks[0], _joined(heard[tongue], said[code]))
    pair = np.flatnonzero(follows[:-1] & good[:-1] & good[1:])
    if depth == 2:
        _, at, count = np.unique((tongue[pair] * size + code[pair]) * size + code[pair + 1], return_index=True, return_counts=True)
        yield out(pair[at], count, 2)
        return
    pair = pair[_marked(marks[1], _joined(_joined(heard[tongue[pair]], said[code[pair]]), said[code[pair + 1]]))]
    reach = np.zeros(len(start) + longest, np.int64)  # marked pairs in a row from each word on
    reach[pair] = 1
    linked = reach.copy()
    for _ in range(longest - 2):
        reach[:len(start)] = linked[:len(start)] * (1 + reach[1:len(start) + 1])
    rank = np.zeros(len(start), np.int64)
    rank[pair] = np.unique((tongue[pair] * size + code[pair]) * size + code[pair + 1], return_inverse=True)[1]
    for k in range(3, longest + 1):
        here = np.flatnonzero(reach[:len(start)] >= k - 1)
        if not len(here):
            return
        rank[here] = np.unique(rank[here] * size + code[here + k - 1], return_inverse=True)[1]
        last = here[reach[here] == k - 1]  # of equal phrases some end here, others go on
        _, at, count = np.unique(rank[last], return_index=True, return_counts=True)
        yield out(last[at], count, k)


def _hashes(texts) -> np.ndarray:
    body, offs = text_bytes(texts)
    return stretch_hash(prefix_sums(body), offs[:-1], offs[1:])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(BASE) + right)


def _marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (marks[(key % U64(len(marks))).astype(np.int64)] >> (key >> U64(58)).view(np.int64)) & 1 == 1


def _marks(frequent: DataFrame) -> np.ndarray:
    """A bit for the hash of each row's language and words, in MARK_BITS / 64 numbers at most, whatever the number of rows."""
    slots = MARK_BITS // 64

    def run(batches):
        for b in batches:
            key = _hashes(b.column(0))
            parts = pc.split_pattern(b.column(1), " ")
            width = int(pc.max(pc.list_value_length(parts)).as_py() or 1) if b.num_rows else 1
            said = _hashes(parts.flatten()).reshape(-1, width)
            for j in range(width):
                key = _joined(key, said[:, j])
            yield pa.RecordBatch.from_arrays([pa.array((key % U64(slots)).astype(np.int32)), pa.array(np.left_shift(np.int64(1), (key >> U64(58)).view(np.int64)))], ["slot", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "slot int, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(slots, np.int64)
    marks[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return marks


def equal_partitions(words: np.ndarray, weight: np.ndarray, least: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, row, size) of the equal partitions of a multikey three-way quicksort of pointers to the rows of ``words``.

    ``words`` holds a code for each depth and row, -1 behind the last word. All open partitions are split at once, each
    by the word of its middle pointer: smaller and larger ones are sorted on at the same depth, equal ones at the next. A
    partition of a summed weight below ``least`` is abandoned unless it holds a row of ``cut``.
    """
    found = []
    order = np.arange(words.shape[1])
    first, count, depth = np.array([0]), np.array([len(order)]), np.array([0])
    while len(order):
        part = np.repeat(np.arange(len(first)), count)
        key = words[depth[part], order]
        pivot = key[first + count // 2]
        side = 1 + (key > pivot[part]).astype(np.int64) - (key < pivot[part])
        group = part * 3 + side
        rows = np.bincount(group, minlength=3 * len(first))
        size = np.bincount(group, weight[order], minlength=3 * len(first)).astype(np.int64)
        open_ = (size >= least) | (np.bincount(group, cut[order], minlength=3 * len(first)) > 0)
        place = np.zeros(len(order), np.int64)
        base = np.cumsum(rows) - rows
        for k in range(3):
            mine = np.flatnonzero(side == k)
            rank = np.arange(len(mine))
            before = np.cumsum(rows[k::3]) - rows[k::3]
            place[mine] = base[group[mine]] + rank - before[part[mine]]
        dealt = np.empty_like(order)
        dealt[place] = order
        equal = np.arange(3 * len(first)) % 3 == 1
        deep = np.repeat(depth, 3) + equal
        done = np.flatnonzero(equal & open_ & (np.repeat(pivot, 3) >= 0))
        found.append((deep[done], dealt[base[done]], size[done]))
        on = open_ & (rows > 0) & (deep < len(words)) & ~(equal & (np.repeat(pivot, 3) < 0))
        order = dealt[np.repeat(on, rows)]
        count, depth = rows[on], deep[on]
        first = np.cumsum(count) - count
    return tuple(np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))


def sorted_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of 3 words and more with f >= ``least``, from partial suffix counts (lang, phrase, f)."""

    def run(batches):
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        lang, phrase, f = (c.chunk(0) for c in pa.Table.from_batches(mine).combine_chunks().columns)
        spoken, parts = lang.dictionary_encode(), pc.split_pattern(phrase, " ")
        said = parts.flatten().dictionary_encode()
        offs = parts.offsets.to_numpy()
        width = np.diff(offs)
        words = np.full((1 + int(width.max()), len(width)), -1, np.int32)
        words[0] = spoken.indices.to_numpy()
        code = said.indices.to_numpy()
        for j in range(len(words) - 1):
            has = width > j
            words[1 + j, has] = code[offs[:-1][has] - offs[0] + j]
        cut = np.zeros(len(width))
        for edge in (pc.min, pc.max):  # a phrase at the border of this task's range may go on in the next
            tongue = edge(lang)
            cut[pc.index(pc.if_else(pc.equal(lang, tongue), phrase, pa.scalar(None, pa.string())), edge(pc.filter(phrase, pc.equal(lang, tongue)))).as_py()] = 1
        depth, row, size = equal_partitions(words, f.to_numpy(), least, cut)
        for k in range(4, len(words) + 1):  # depth 0 is the language
            mine = depth == k
            at = row[mine]
            out = said.dictionary.take(pa.array(words[1, at]))
            for j in range(2, k):
                out = pc.binary_join_element_wise(out, said.dictionary.take(pa.array(words[j, at])), " ")
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(at)), out, pa.array(size[mine])], ["lang", "phrase", "f"])

    tasks = max(1, math.ceil(suffixes.count() / SHARE))
    routed = suffixes.repartitionByRange(tasks, "lang", "phrase")
    return _summed(routed.mapInArrow(run, "lang string, phrase string, f bigint")).where(F.col("f") >= least)


def _joined_words(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def _scored(known: DataFrame, least: int, absorb: int) -> DataFrame:
    """Undropped phrases with a, l, r and the score of the lowest cut; each part of a frequent phrase is frequent itself."""
    phrases = known.where(F.size("words") >= 2)
    length = F.size("words")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined_words(F.lit(1), F.col("k")).alias("left"), _joined_words(F.col("k") + 1, length - F.col("k")).alias("right"))
    part = known.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # 2000000 a may pass 64 bits: divide twice, what the first division leaves is below l + r
    cuts = cuts.withColumn("score", F.expr("2000 * (1000 * a div (l + r)) + 2000 * (1000 * a % (l + r)) div (l + r)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    inner = phrases.where(F.size("words") >= 3).select("lang", F.col("f").alias("longer"), "words", F.explode(F.sequence(F.lit(2), length - 1)).alias("d"))
    inner = inner.select("lang", "longer", "words", "d", F.explode(F.sequence(F.lit(1), length - F.col("d") + 1)).alias("s"))
    most = inner.groupBy("lang", _joined_words(F.col("s"), F.col("d")).alias("phrase")).agg(F.max("longer").alias("longer"))
    return lowest.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True))).drop("longer")


def _ranked(rows: DataFrame, first: int | None) -> DataFrame:
    """Ranks inside each language; sub-groups are ranked before, so that one task meets RANK_GROUPS x ``first`` rows of it at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if first is not None:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return rows.where(F.col("rank") <= first if first is not None else F.lit(True)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
