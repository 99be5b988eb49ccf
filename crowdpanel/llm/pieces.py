"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton holds every ordinary piece of a given model. It reads a word once; at each position it reports all pieces
that end there, the longest first and then, along its output links, the shorter ones. Each report relaxes the best
score at its end from the best score at its start. A character that no piece covers costs more than any piece and
becomes byte pieces (or the unknown piece where a model has none). Among equal scores the longer last piece wins.

Pieces hold the word mark (U+2581) only at their start, so the best segmentation of a text is that of its words one
after the other, and a task keeps the words it has solved. Words are cut once more between characters that no piece
holds side by side (line ends, most ideographs): nothing can cross there, so scripts without spaces are kept in parts
too. A model with a mark elsewhere in a piece is solved text by text. Texts are normalised as the model says it: a leading space is put in front, spaces become word marks. A U+2581
of the text itself is written in bytes, so decoding gives back every text exactly.

Scores are those of the model. For a model trained as BPE they are merge ranks; the method here takes the best sum of
scores, which is not the order of merges, so ids differ from a merge-based encoder while the round trip is exact.

Null and empty texts have no ids; both decode to an empty text, and a null id to nothing. Repeated rows give equal rows, an empty table an empty one. Rows pass through
with all their columns, but one named like a result is replaced by it. Texts are handled in slices of about a megabyte; a longer text makes a
slice of its own. What a task remembers of solved words is bounded in bytes.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import list_array, map_texts

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Solved words that each of a task's two tables keeps, by number and bytes (and as many old ones), and the length of a word that is kept.
MEMORY_WORDS, MEMORY_BYTES, MEMORY_LENGTH = 200_000, 48 << 20, 64
#: Bytes of a table entry besides its word and ids: headers of both objects and the slot.
ENTRY_BYTES = 190


class _Solved(dict):
    """Packed ids of words by word. A new one is solved, and kept if it is short; when the table is full it becomes the
    old one, from which words that come up again are taken back."""

    def __init__(self, solve):
        self.solve, self.old, self.bytes = solve, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.solve(word)
            if len(word) > MEMORY_LENGTH:
                return ids
        size = ENTRY_BYTES + 4 * len(word) + len(ids)
        if len(self) >= MEMORY_WORDS or self.bytes + size > MEMORY_BYTES:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[word] = ids
        self.bytes += size
        return ids


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Pieces:
    """Pieces with scores; ids of bytes, the unknown piece and pieces that are not text."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], unknown: int, silent: set[int]):
        self.text = pieces
        self.bytes, self.unknown = bytes_, unknown
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.silent = silent
        skip = silent | {unknown} | set(bytes_.values())
        self.tree = ahocorasick.Automaton()
        for i, (p, s) in enumerate(zip(pieces, scores)):
            if p and i not in skip:
                self.tree.add_word(p, (len(p), s, i))
        self.tree.make_automaton()
        ordinary = [s for i, s in enumerate(scores) if i not in skip]
        self.penalty = (min(ordinary) if ordinary else 0.0) - 10.0
        self.by_word = all(MARK not in p.lstrip(MARK) for i, p in enumerate(pieces) if i not in skip)
        #: Pairs of characters that some piece holds side by side.
        self.pairs = {p[i:i + 2] for k, p in enumerate(pieces) if k not in skip for i in range(len(p) - 1)}
        # signs that no piece holds behind anything but such signs and marks: text is cut in front of their runs
        signs = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "}
        while joined := {y for x, y in self.pairs if y in signs and x not in signs and x != MARK}:
            signs -= joined
        some = re.escape("".join(sorted(signs)))
        rest = f"[^{MARK}{some}]"
        self.words = re.compile(f"{MARK}+[{some}]*{rest}*|[{some}]+{rest}*|{rest}+" if signs else f"{MARK}*{rest}+|{MARK}+")
        self.parts = _Solved(lambda part: _packed(self.viterbi(part)))
        self.solved = _Solved(lambda word: b"".join(map(self.parts.__getitem__, self.cut(word))))
        self.blobs = pa.array([bytes((self.byte_of[i],)) if i in self.byte_of else b"" if i in silent else p.replace(MARK, " ").encode()
                               for i, p in enumerate(pieces)], pa.large_binary())

    def cut(self, word: str) -> list[str]:
        """Consecutive parts of a word that no piece reaches across."""
        pairs = self.pairs
        at = [0, *[i for i in range(1, len(word)) if word[i - 1:i + 1] not in pairs], len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every],
                   {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}, model.unk_id(),
                   {i for i in every if model.is_control(i)})

    def _escape(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Ids of the best segmentation."""
        n = len(word)
        penalty = self.penalty
        best = [0.0] + [float("-inf")] * n
        sizes, ids = [1] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final: the single-character escape was weighed against all pieces
        for end, (size, score, i) in self.tree.iter(word):
            while done < end:
                done += 1
                s = best[done - 1] + penalty
                if s > best[done]:
                    best[done], sizes[done], ids[done] = s, 1, -1
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], sizes[end + 1], ids[end + 1] = s, size, i
        while done < n:
            done += 1
            s = best[done - 1] + penalty
            if s > best[done]:
                best[done], sizes[done], ids[done] = s, 1, -1
        out: list[int] = []
        at = n
        while at:
            i = ids[at]
            if i < 0:
                out += reversed(self._escape(word[at - 1]))
            else:
                out.append(i)
            at -= sizes[at]
        out.reverse()
        return tuple(out)

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers one after the other."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(_packed(self._escape(MARK)))
            plain = (MARK + part if k == 0 else part).replace(" ", MARK)
            # ``solved`` looks a word up, or solves it where it is new
            out += map(self.solved.__getitem__, self.words.findall(plain)) if self.by_word else [_packed(self.viterbi(plain))]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def encode_texts(self, body: np.ndarray, offs: np.ndarray) -> pa.Array:
        raw = body.tobytes()
        made = [self.packed(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return list_array(pa.array(np.frombuffer(b"".join(made), np.int32)), np.array([len(m) // 4 for m in made], np.int64))

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_column(self, ids: pa.Array) -> pa.Array:
        flat = self.blobs.take(ids.flatten()).fill_null(b"")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        _, offsets, data = flat.buffers()
        offs = np.frombuffer(offsets, np.int64, count=len(flat) + 1, offset=8 * flat.offset)[ends].tolist() if len(flat) else [0] * len(ends)
        raw = memoryview(data) if data is not None else memoryview(b"")
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(offs, offs[1:])]
        return pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces.load(path)


def _per_column(df: DataFrame, column: str, field: str, work) -> DataFrame:
    added = StructType.fromDDL(field)
    name = added.names[0]
    kept = [f for f in df.schema.fields if f.name != name]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                old = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                made = work(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*old, made], [*[f.name for f in kept], name])

    return df.mapInArrow(run, StructType([*kept, *added.fields]))


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text; ``model`` is a path that every executor can open (or a file added to the job)."""
    return map_texts(docs, text, f"{ids} array<int>", lambda body, offs: [loaded(model).encode_texts(body, offs)])


def encode_and_decode(docs: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text and the text that these decode to; one Python worker of a task does both."""

    def work(body: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        made = loaded(model).encode_texts(body, offs)
        return [made, loaded(model).decode_column(made)]

    return map_texts(docs, text, f"{ids} array<int>, {decoded} string", work)


def decode(rows: DataFrame, ids: str = "token_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of each list of ids."""
    return _per_column(rows, ids, f"{text} string", lambda c: loaded(model).decode_column(c))
