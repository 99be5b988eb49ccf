"""Secret scans with a random forest that removes false positives.

A candidate is a run of the token alphabet that is mixed (a digit and a letter, ``mixed`` = 8 characters and more), all letters
(20 and more; a sign in it makes it text), or whose part behind a key word with ``:`` or ``=`` has ``keyed`` = 6 characters
and more, whatever they are. These lengths define a candidate; the forest decides on each. A candidate gets
features: length, character transitions (mean letter bigram cost under the table's own letters, changes between letter
and digit, changes of case, distinct characters), dictionary coverage (share of its letters in common words), path
signs (slashes, dots, scheme, at sign) and the hashed words beside it. A random forest learns from labelled findings,
at most ``sample_rows`` of each label, and scores every candidate; those below one half are false positives.

The dictionary is a bitmap over hashed words that hold at least one in ``rare`` of all words, so its size is fixed
while its counts come from all texts. Candidates are found in a map over rows; only labelled findings move.

Null and empty texts have no candidates. Repeated rows give their findings again. Without findings of both labels
every score is the share of label 1 (one half if there is none). A null id is carried along. An empty table has no
findings. A token of any length is read whole; the words beside it are looked for within 80 bytes on each side.
Ties for a place in the sample are cut by a hash of candidate, id and offset.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, list_array, prefix_sums, slices, stretch_hash, word_bounds
from .toxicity import LETTER, trigram_counts

KEYS = ("token", "key", "secret", "password", "passwd", "pwd", "apikey", "bearer", "auth")
_ASSIGNED = re.compile(rb"(?i)(?:" + "|".join(KEYS).encode() + rb")[\s\"'`]{0,3}[:=][\s\"'`=]{0,3}")
TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "+/_=-.@:")]] = True
SLOTS, BESIDE = 1 << 20, 32
PLAIN = 11
FINDING = "start int, end int, candidate string, before string, after string, features array<double>"


def common_words(docs: DataFrame, text: str = "text", rare: int = 50_000) -> np.ndarray:
    """Bitmap of hashed words that make up at least one in ``rare`` of all words of the table."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for _, body, offs in slices(batches, text):
            start, end = word_bounds(body, offs, LETTER[LOWER])
            long_ = end - start >= 3
            value = stretch_hash(prefix_sums(LOWER[body]), start[long_], end[long_])
            total += np.bincount((value & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    counts = docs.select(text).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    size = counts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(SLOTS, bool)
    for (slot,) in counts.where(F.col("n") * rare >= size).select("slot").collect():  # at most ``rare`` rows
        out[slot] = True
    return out


def letter_costs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log chance of a letter after another, from all texts."""
    counts = np.zeros(28**3)
    for code, n in trigram_counts(docs, text).collect():  # at most 28**3 rows
        counts[code] = n
    two = counts.reshape(28, 28, 28).sum(axis=0) + 1.0
    return -np.log(two / two.sum(axis=1, keepdims=True))


def covered(low: np.ndarray, letter: np.ndarray, words: np.ndarray) -> float:
    """Share of the letters of a lower-case token that dictionary words of 3 to 20 letters cover; starts are looked up in blocks."""
    n = len(low)
    end = np.minimum.accumulate(np.where(letter, n, np.arange(n))[::-1])[::-1]
    sums, edge = prefix_sums(low), np.zeros(n + 1, np.int32)
    for first in range(0, n, 4096):
        start = np.arange(first, min(n, first + 4096))[:, None]
        stop = start + np.arange(3, 21)
        row, col = np.nonzero(stop <= end[start])
        a, b = start[row, 0], stop[row, col]
        known = words[(stretch_hash(sums, a, b) & U64(SLOTS - 1)).astype(np.int64)]
        np.add.at(edge, a[known], 1)
        np.add.at(edge, b[known], -1)
    total = int(letter.sum())
    return int((np.cumsum(edge[:-1]) > 0).sum()) / total if total else 0.0


def features(token: str, before: str, after: str, lead: str, cost: np.ndarray, words: np.ndarray) -> list[float]:
    raw = np.frombuffer(token.encode(), np.uint8)
    low = LOWER[raw]
    letter, digit, upper = (low >= 97) & (low <= 122), (raw >= 48) & (raw <= 57), (raw >= 65) & (raw <= 90)
    both = letter[:-1] & letter[1:]
    steps = cost[low[:-1][both] - 96, low[1:][both] - 96]
    kinds = np.where(digit, 0, np.where(letter, 1, 2))
    plain = [len(token), float(steps.mean()) if len(steps) else 0.0, int((kinds[1:] != kinds[:-1]).sum()) / len(token),
             int((upper[1:] != upper[:-1]).sum()) / len(token), len(np.unique(raw)) / len(token), covered(low, letter, words),
             token.count("/"), token.count("."), float("://" in token), token.count("@"), float(lead[-1:] in ("'", '"', "=", ":"))]
    beside = np.zeros(2 * BESIDE)
    for k, word in enumerate((before, after)):
        if word:
            raw = np.frombuffer(word.lower().encode(), np.uint8)
            beside[k * BESIDE + int(stretch_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0] % U64(BESIDE))] = 1
    return [float(x) for x in plain] + beside.tolist()


_WORD = re.compile(r"[^\W\d_]+")


def assigned(raw: bytes, offs: np.ndarray, start: np.ndarray, end: np.ndarray, keyed: int) -> np.ndarray:
    """Which runs hold ``keyed`` bytes or more behind a key word and its sign, of the same row."""
    found = [m.span() for m in _ASSIGNED.finditer(raw)]
    if not found or not len(start):
        return np.zeros(len(start), bool)
    a, b = np.array(found).T
    row = np.searchsorted(offs, a, side="right")
    whole = (row == np.searchsorted(offs, b, side="right")) & ((a == offs[row - 1]) | ~LETTER[LOWER[np.frombuffer(raw, np.uint8)[a - 1]]])
    b = np.r_[b[whole], len(raw) + 1]
    after = b[np.searchsorted(b, start)]
    return end - after >= keyed


def findings(docs: DataFrame, cost: np.ndarray, words: np.ndarray, id_col: str = "doc_id", text: str = "text", mixed: int = 8, letters: int = 20,
             keyed: int = 6) -> DataFrame:
    """(doc_id, start, end, candidate, before, after, features): every candidate, with byte offsets and the words beside it."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *[f.split()[0] for f in FINDING.split(", ")]]

    def run(batches):
        for rows, body, offs in slices(batches, "text"):
            start, end = word_bounds(body, offs, TOKEN)
            digit = np.r_[0, np.cumsum((body >= 0x30) & (body < 0x3A))]
            alpha = np.r_[0, np.cumsum(LETTER[LOWER[body]])]
            raw = body.tobytes()
            odd = (end - start >= mixed) & (digit[end] > digit[start]) & (alpha[end] > alpha[start])
            odd |= (end - start >= letters) & (alpha[end] - alpha[start] == end - start)
            odd |= assigned(raw, offs, start, end, keyed)
            start, end = start[odd], end[odd]
            row = np.searchsorted(offs, start, side="right") - 1
            made = []
            for a, b, k in zip(start.tolist(), end.tolist(), row.tolist()):
                token = raw[a:b].decode("ascii")
                lead = raw[max(offs[k], a - 80):a].decode("utf-8", "replace")
                ahead, behind = _WORD.findall(lead), _WORD.search(raw[b:min(offs[k + 1], b + 80)].decode("utf-8", "replace"))
                before, after = ahead[-1] if ahead else "", behind[0] if behind else ""
                made.append((a - int(offs[k]), b - int(offs[k]), token, before, after, features(token, before, after, lead, cost, words)))
            columns = list(zip(*made)) if made else [()] * 6
            flat = pa.array(np.array([x for f in columns[5] for x in f]), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:5]),
                 list_array(flat, np.full(len(made), PLAIN + 2 * BESIDE))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, {FINDING}")


def weak_label() -> Column:
    """Labels for findings whose kind is plain to see: a key word in front (1); an address or a dotted path (0); else null."""
    keyed = F.lower("before").isin(*KEYS) & F.col("candidate").rlike("[0-9]")
    address = F.col("candidate").contains("@") | F.col("candidate").contains("://") | F.col("candidate").rlike(r"[.:/][A-Za-z]{2,}")
    bare = F.col("candidate").rlike("^[A-Za-z]+[-_.=:]*[0-9]{1,3}$")
    return F.when(address | bare, 0).when(keyed, 1)


def judged(found: DataFrame, labelled: DataFrame, sample_rows: int = 5000, trees: int = 20, depth: int = 8) -> DataFrame:
    """``found`` with score and is_secret; ``labelled``: findings with features and an integer label."""
    parts = [labelled.where(F.col("label") == k).orderBy(F.xxhash64("candidate", "doc_id", "start")).limit(sample_rows) for k in (0, 1)]
    few = parts[0].union(parts[1]).select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y")).cache()
    n = {int(r["y"]): r["count"] for r in few.groupBy("y").count().collect()}
    if len(n) < 2:
        share = float(next(iter(n), 0.5))
        return found.withColumns({"score": F.lit(share), "is_secret": F.lit(share >= 0.5)})
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=7, maxMemoryInMB=128).fit(few)
    few.unpersist()
    model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y")
    out = model.transform(found.withColumn("__x", array_to_vector("features")))
    return out.withColumn("score", vector_to_array("__p")[1]).withColumn("is_secret", F.col("score") >= 0.5).drop("__x", "__p", "__r", "__y")
