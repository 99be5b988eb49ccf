"""What several operators share: slices of Arrow text, rolling hashes of bytes and words, components, stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpanel.session import durable_table

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
#: Bytes of text handled at once in a task; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back, so that lost executors never recompute what led to it."""
    return durable_table(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored frame that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * column.offset)
    body = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows whose texts hold about ``limit`` bytes, with their bytes and offsets."""
    for batch in batches:
        body, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), body[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
            at = to


@lru_cache(maxsize=4)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    out = np.full(1 << bits, pow(BASE, -1, 1 << 64) if inverse else BASE, U64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base, or of its inverse, modulo 2**64."""
    return _powers(max(20, int(n - 1).bit_length()), inverse)[:n] if n else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of bytes follows by one subtraction."""
    sums = np.zeros(len(body) + 1, U64)
    np.cumsum(_CODES[body] * powers(len(body)), out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to each end."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start] + (end - start).astype(U64))


def word_bounds(body: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked in the 256-entry table; a run never crosses a row."""
    flag = inside[body]
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    edge = offs[:-1][offs[:-1] < len(body)]
    start[edge] = flag[edge]
    end = np.zeros(len(body) + 1, bool)
    end[1:] = flag
    end[1:-1] &= ~flag[1:]
    end[edge[edge > 0]] = flag[edge[edge > 0] - 1]
    return np.flatnonzero(start), np.flatnonzero(end)


#: Words between white space: space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of digits, a to z and all beyond ASCII; other text ends them.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(body: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of the rows, and the n + 1 word offsets of the rows."""
    start, end = word_bounds(body, offs, inside)
    return stretch_hash(prefix_sums(body), start, end), start, end, np.searchsorted(start, offs)


def windows(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First items of all windows of ``width`` items inside one row, and the row of each; rows: n + 1 offsets."""
    count = np.maximum(np.diff(rows) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + rows[row], row


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges (a, b); each node of an edge is returned.

    Every round gives each node, and the node that its old label names, the smallest label of a label around it, and then takes the
    label of that label, until nothing changes. As whole trees of labels hook, not single nodes, a path of n nodes in any
    order takes about log2(n) + 2 rounds. Labels only fall, so the rounds end without a cap.
    Aggregates are combined before the shuffle and joins are plain equi-joins, so one node may have any number of edges.
    """
    both = edges.where("a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    state = stored(_jumped(first.withColumn("old", F.col("node"))))
    while not state.where("label < old").isEmpty():
        near = both.join(state.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("m"))
        step = state.join(near, "node")
        hooks = step.select("node", F.least("far", "m").alias("label"), F.col("label").alias("old"))
        roots = step.select(F.col("label").alias("node"), F.col("m").alias("label"), F.lit(None).cast(state.schema["node"].dataType).alias("old"))
        new = hooks.union(roots).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        state, past = stored(_jumped(stored(new))), state
        discard(past)
    return state.select("node", "label")


def _jumped(labels: DataFrame) -> DataFrame:
    """``labels`` with far, the label of the label; each label is a node of the same frame."""
    return labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", "label", "old", "far")


def map_texts(df: DataFrame, text: str, fields: str, work, limit: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` and the new ``fields`` (DDL), made by ``work(bytes, offsets) -> list of Arrow arrays``.

    A new field takes the place of an input column of the same name; rows are neither added nor lost.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    names = [f.name for f in kept]

    def run(batches):
        for rows, body, offs in slices(batches, text, limit):
            old = [rows.column(rows.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*old, *work(body, offs)], [*names, *added.names])

    return df.mapInArrow(run, StructType([*kept, *added.fields]))


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Arrow lists of the given lengths over consecutive values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
