"""Toxicity with noisy-channel deobfuscation.

Words are letters; a sender may write some with look-alikes (leetspeak), pull them apart or repeat letters. A token
that shows such signs becomes a character lattice: each character stands for itself, for the letters it resembles, for
nothing (a separator) or for a repetition of the letter before. Viterbi decoding takes the path of the highest
probability under a letter trigram model times the channel's costs, and the restored word joins the plain words of
the text. The trigram counts come from all texts of the table: each task counts its own, the sums are shuffled.

The restored text is scored by logistic regression on the presence of hashed words, learned from at most
``sample_rows`` labelled texts (those with the smallest hash of their id). Scoring is a map over rows.

Null and empty texts have no words and get the score of the intercept. Repeated rows score alike. Null labels and ids
are left out. Without labels of both kinds every score is the share of label 1 (one half if there is none). Result
columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, map_texts, slices, word_bounds, word_hashes
from .mil import sample

#: Letters that a character can stand for besides itself.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
             "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "&": "e", "%": "x"}
#: Characters put between the letters of one word.
SEPARATOR = frozenset(" .-_*~'`,/\\")
#: Costs (negative log chances) of a look-alike, a dropped separator, a dropped repetition, a dropped other character.
SWAP, DROP_SEPARATOR, DROP_REPEAT, DROP_OTHER = 1.5, 0.5, 0.3, 12.0
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKE] + [ord(c) for c in SEPARATOR if c != " "]] = True
#: Separators that stand for no letter.
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in SEPARATOR if c not in LOOKALIKE and c != " "]] = True
#: Letter codes of the trigram model: 0 is the edge of a word, 27 any letter beyond a-z.
_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0xC0:] = 27
SLOTS = 1 << 18


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): counts of letter trigrams, word edges included, over all texts."""

    def run(batches):
        total = np.zeros(28**3, np.int64)
        for _, body, offs in slices(batches, text):
            keep = ~((body >= 0x80) & (body < 0xC0))
            code = _CODE[LOWER[body[keep]]]
            code = np.r_[0, code, 0]
            hole = (code[1:] == 0) & (code[:-1] == 0)
            code = np.r_[0, code[np.r_[True, ~hole]]]
            total += np.bincount((code[:-2] * 28 + code[1:-1]) * 28 + code[2:], minlength=28**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    return docs.select(text).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Decoder:
    """Negative log chances of a letter after two others, and Viterbi over character lattices."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(28, 28, 28).astype(float)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 1.0
        unigram = one / one.sum()
        bigram = (two + 5 * unigram) / (two.sum(axis=1, keepdims=True) + 5)
        chance = (three + 5 * bigram[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(chance)).tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def restore(self, token: str, cut: bool = False) -> str:
        """The most likely word behind a token, lower-case letters only; with ``cut`` white space may also end a word."""
        got = self.known.get((token, cut))
        if got is None:
            got = self._viterbi(token, cut)
            if len(token) <= 64:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[token, cut] = got
        return got

    def _viterbi(self, token: str, cut: bool) -> str:
        cost = self.cost
        # state: the last two letter codes; value: cost and a linked list of letters
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        token = token.lower()
        shown = len(token.rstrip("!"))
        for at, char in enumerate(token):
            letter = "a" <= char <= "z"
            other = not letter and char.isalpha()
            options = [(char, 0.0)] if letter or other else [(c, SWAP) for c in LOOKALIKE.get(char, "")]
            fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def put(state, value, path):
                old = fresh.get(state)
                if old is None or value < old[0]:
                    fresh[state] = (value, path)

            for (a, b), (value, path) in states.items():
                row = cost[a][b]
                for c, more in options:
                    code = 27 if other else ord(c) - 96
                    put((b, code), value + row[code] + more, (c, path))
                if not letter and not other:
                    put((a, b), value + (DROP_SEPARATOR if char in SEPARATOR or char.isspace() or at >= shown else DROP_OTHER), path)
                    if cut and char.isspace() and b:
                        put((0, 0), value + row[0] + DROP_SEPARATOR, (" ", path))
                elif path is not None and path[0] == char:
                    put((a, b), value + DROP_REPEAT, path)
            states = fresh
        value, path = min(((v + cost[a][b][0], p) for (a, b), (v, p) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


_RUN = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?:[A-Za-z0-9@$!|*+][\s._-]+){2,}[A-Za-z0-9@$!|*+](?![A-Za-z0-9\x80-\xff])")
_GAP, _FIRST, _LAST = re.compile(rb"[\s._-]+"), re.compile(rb"^.[\s._-]+"), re.compile(rb"[\s._-]+.$")


def readings(decoder: Decoder, run: bytes) -> str:
    """Restored words of a run of single characters: with word breaks at white space, as one word, and as one word without the first,
    the last or both characters, as these may be words of their own. Stretches between gaps unlike the run's most common gap are read as well."""
    parts, gaps = [run], _GAP.findall(run)
    if len(set(gaps)) > 1:
        usual = max(sorted(set(gaps)), key=gaps.count)
        chars = _GAP.split(run)
        part = chars[0]
        for gap, char in zip(gaps, chars[1:]):
            if gap == usual:
                part += gap + char
            else:
                parts.append(part)
                part = char
        parts = [x for x in [*parts, part] if len(x) > 1]
    out = []
    for x in parts:
        head, tail = _FIRST.sub(b"", x), _LAST.sub(b"", x)
        out += [decoder.restore(x.decode("ascii"), cut=True), *[decoder.restore(y.decode("ascii")) for y in (x, head, tail, _LAST.sub(b"", head))]]
    return " ".join(out)


def suspects(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens with any letter that hold a look-alike, a separator inside, or a letter three times in a row.

    Separators at the ends of a token are left out: every path drops them, so what is decoded stays the same.
    """
    start, end = word_bounds(body, offs, NOT_SPACE)
    core = np.flatnonzero(NOT_SPACE[body] & ~_EDGE[body])
    first, last = np.searchsorted(core, start), np.searchsorted(core, end)
    some = last > first
    start, end = core[first[some]], core[last[some] - 1] + 1
    low = LOWER[body]
    letter = LETTER[low]
    triple = np.zeros(len(body), bool)
    triple[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    letters, signs, triples = (np.r_[0, np.cumsum(x)] for x in (letter, _SIGN[low], triple))
    odd = (signs[end] > signs[start]) | (triples[end] > triples[np.minimum(start + 2, end)])
    odd &= letters[end] > letters[start]
    return start[odd], end[odd]


def restored(decoder: Decoder, body: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Restored words and the row of each."""
    start, end = suspects(body, offs)
    raw = body.tobytes()
    words = [decoder.restore(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start.tolist(), end.tolist())]
    row = np.searchsorted(offs, start, side="right") - 1
    spaced, where = [], []
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        for m in _RUN.finditer(raw[a:b]):
            spaced.append(readings(decoder, m[0]))
            where.append(k)
    return words + spaced, np.r_[row, np.array(where, np.int64)]


def word_slots(decoder: Decoder, body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) once for each distinct hashed word of the restored rows."""
    value, _, _, rows = word_hashes(LOWER[body], offs, LETTER)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    words, where = restored(decoder, body, offs)
    if words:
        flat = "\n".join(words).encode()
        made, _, _, cut = word_hashes(np.frombuffer(flat, np.uint8), np.r_[0, np.cumsum([len(w.encode()) + 1 for w in words])[:-1], len(flat)], LETTER)
        value, row = np.r_[value, made], np.r_[row, np.repeat(where, np.diff(cut))]
    pair = np.unique(row * SLOTS + (value & U64(SLOTS - 1)).astype(np.int64))
    return pair // SLOTS, pair % SLOTS


@dataclass
class Scorer:
    decoder: Decoder
    weight: np.ndarray
    bias: float

    def score(self, body: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, slot = word_slots(self.decoder, body, offs)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weight[slot], minlength=len(offs) - 1))))


def fit(rows: list[np.ndarray], y: np.ndarray, least: int = 5, epochs: int = 300, rate: float = 0.1, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights of words that at least ``least`` texts hold, by full-batch Adam on the ridge-penalised log loss."""
    bag = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    used, inverse, n = np.unique(slot, return_inverse=True, return_counts=True)
    often = n >= least
    name = np.cumsum(often) - 1
    keep = often[inverse]
    bag, col = bag[keep], name[inverse[keep]]
    w = np.zeros(int(often.sum()) + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    for step in range(1, epochs + 1):
        logit = np.bincount(bag, w[col], minlength=len(y)) + w[-1]
        d = 1 / (1 + np.exp(-logit)) - y
        g = np.r_[np.bincount(col, d[bag], minlength=len(w) - 1) + ridge * w[:-1], d.sum()]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])  # a harmless word takes nothing back
    out = np.zeros(SLOTS)
    out[used[often]] = w[:-1]
    return out, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", sample_rows: int = 8000) -> Scorer:
    """Counts over all documents and weights from a bounded sample of the labelled ones."""
    counts = np.zeros(28**3)
    for code, n in trigram_counts(docs, text).collect():  # at most 28**3 rows
        counts[code] = n
    decoder = Decoder(counts)

    def pack(body, offs):
        row, slot = word_slots(decoder, body, offs)
        cut = np.searchsorted(row, np.arange(len(offs)))
        return [pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())]

    got = map_texts(sample(docs, labels, label, sample_rows, id_col, text), "text", "x binary", pack).select("id", "y", "x").toPandas().sort_values(["id", "y", "x"])
    if got["y"].nunique() < 2:
        share = float(np.clip(got["y"].mean() if len(got) else 0.5, 1e-6, 1 - 1e-6))
        return Scorer(decoder, np.zeros(SLOTS), float(np.log(share / (1 - share))))
    weight, bias = fit([np.frombuffer(b, np.int32) for b in got["x"]], got["y"].to_numpy(float))
    return Scorer(decoder, weight, bias)


def scored(docs: DataFrame, model: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with score and n_restored (tokens that were decoded)."""

    def work(body, offs):
        found = np.searchsorted(offs, suspects(body, offs)[0], side="right") - 1
        return [pa.array(model.score(body, offs)), pa.array(np.bincount(found, minlength=len(offs) - 1).astype(np.int64))]

    return map_texts(docs, text, "score double, n_restored bigint", work)
