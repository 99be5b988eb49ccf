"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded: its byte pairs, with bytes reduced to 64
classes, are hashed to ``WIDTH`` counts, taken as square roots of shares and sent through a learned tanh layer to h.
Gated attention a = softmax over the bag of w . (tanh(V h) * sigmoid(U h)) weighs the passages, and the score is
sigmoid(c . sum(a h) + b). All weights are learned together from document labels by full-batch Adam.

Learning takes at most ``sample_rows`` labelled texts (a bound on the driver's memory; those with the smallest hash of
their id, so the choice does not depend on order); everything else covers whole tables. Scoring is a map over rows.

A null or empty text is a bag of one passage without features and gets the score that follows from that. Repeated
rows score alike. Repeated labels of an id all count; null labels and ids do not. Without labels of both kinds every
score is the share of label 1 (one half if there is none). Result columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, map_texts, mix, word_bounds

PASSAGE, WIDTH, HIDDEN, GATE = 64, 256, 24, 12
_CLASS = np.full(256, 31, np.uint16)
_CLASS[0x61:0x7B] = np.arange(26)
_CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[10], _CLASS[0x80:0xC0] = 26, 27, 28, 29, 30
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS[_MARKS] = 32 + np.arange(len(_MARKS))
_SLOT = (mix(np.arange(64 * 64, dtype=np.uint64)) % np.uint64(WIDTH)).astype(np.int64)


def passages(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all rows and the n + 1 passage offsets of the rows; an empty row has one empty passage."""
    start, _ = word_bounds(body, offs, NOT_SPACE)
    first = np.searchsorted(start, offs)
    count = np.maximum(-(-np.diff(first) // PASSAGE), 1)
    rows = np.r_[0, np.cumsum(count)]
    nth = np.arange(rows[-1]) - np.repeat(rows[:-1], count)
    at = np.where(nth == 0, np.repeat(offs[:-1], count), np.r_[start, 0][np.minimum(np.repeat(first[:-1], count) + nth * PASSAGE, len(start))])
    size = np.diff(np.r_[at, len(body)])
    kind = _CLASS[body]
    after = np.r_[kind[1:], 29] if len(body) else kind
    after[offs[1:][offs[1:] > 0] - 1] = 29
    slot = _SLOT[kind.astype(np.int64) * 64 + after]
    hist = np.bincount(np.repeat(np.arange(len(at)), size) * WIDTH + slot, minlength=len(at) * WIDTH).reshape(-1, WIDTH)
    return np.sqrt(hist / np.maximum(size, 1)[:, None]).astype(np.float32), rows


@dataclass
class Attention:
    """The learned weights."""

    w: np.ndarray
    wb: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, rows: np.ndarray):
        h = np.tanh(x @ self.w + self.wb)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        bag = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        e = np.exp(e - np.maximum.reduceat(e, rows[:-1])[bag])
        a = e / np.add.reduceat(e, rows[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, rows[:-1], axis=0)
        return h, t, g, a, bag, z, z @ self.c + self.b[0]

    def score(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and the passage with the most attention."""
        _, _, _, a, bag, _, logit = self.forward(x, rows)
        best = np.lexsort([-a, bag])[rows[:-1]] - rows[:-1]
        return 1 / (1 + np.exp(-logit)), best


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Full-batch Adam on the log loss."""
    draw = np.random.default_rng(seed)
    init = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    net = Attention(init(x.shape[1], HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, GATE), init(HIDDEN, GATE), init(GATE), init(HIDDEN), np.zeros(1, np.float32))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    net.b[0] = np.log(share / (1 - share))
    names = list(net.__dict__)
    m, s = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    for step in range(1, epochs + 1):
        h, t, g, a, bag, z, logit = net.forward(x, rows)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        dz = d[:, None] * net.c
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, rows[:-1])[bag])
        dt, dg = de[:, None] * net.a * g * (1 - t * t), de[:, None] * net.a * t * g * (1 - g)
        dh += dt @ net.v.T + dg @ net.u.T
        dp = dh * (1 - h * h)
        grad = {"w": x.T @ dp, "wb": dp.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()], np.float32)}
        for k in names:
            p = getattr(net, k)
            q = grad[k] + (decay * p if k not in ("b", "wb") else 0)
            m[k] = 0.9 * m[k] + 0.1 * q
            s[k] = 0.999 * s[k] + 0.001 * q * q
            p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text: str) -> DataFrame:
    """At most ``rows`` labelled texts (id, y, text): a bounded label side meets all documents."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    few = known.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", sample_rows: int = 4000) -> Attention | float:
    """The learned weights, or the share of label 1 where one of the two labels is missing."""

    def pack(body, offs):
        x, rows = passages(body, offs)
        x = x.astype(np.float16)
        return [pa.array([x[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], pa.binary())]

    got = map_texts(sample(docs, labels, label, sample_rows, id_col, text), "text", "x binary", pack).select("id", "y", "x").toPandas()
    if got["y"].nunique() < 2:
        return float(got["y"].mean()) if len(got) else 0.5
    got = got.sort_values(["id", "y", "x"])
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"]]
    return fit(np.concatenate(bags).astype(np.float32), np.r_[0, np.cumsum([len(b) for b in bags])], got["y"].to_numpy(np.float32))


def scored(docs: DataFrame, model: Attention | float, text: str = "text") -> DataFrame:
    """``docs`` with score, n_passages and top_passage (the one with the most attention, from 0)."""

    def work(body, offs):
        x, rows = passages(body, offs)
        n = np.diff(rows)
        if isinstance(model, float):
            score, best = np.full(len(n), model), np.zeros(len(n), np.int64)
        else:
            score, best = model.score(x, rows)
        return [pa.array(score.astype(np.float64)), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int64))]

    return map_texts(docs, text, "score double, n_passages bigint, top_passage bigint", work, 1 << 19)
