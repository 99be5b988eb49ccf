"""WARC archives whose records are Zstandard frames over a dictionary that the archive carries.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on records of that archive;
every record follows as a frame of its own over that dictionary, so one record can be read without the rest. Each task
writes the rows of its partition to its own archive: it trains on the first ``train_bytes`` of its records (a bound on
memory, not on what is written) and streams the rest. A file gets its final name only when it is complete, so a task
that runs again, or twice, replaces the file with an equal one.

Of the records with equal payloads of at least ``least_bytes`` bytes the one with the largest page id is a response;
the others are revisits that refer to it and carry no payload. Smaller records are all responses. Copies are found by
an aggregate on (digest, size), combined before the shuffle, and a join that adaptive execution can split.

A null payload is empty. A null url is written as an empty target. A null page id ranks below all others; equal
records of equal page id (repeated rows) are all responses, or all revisits. An empty table gives no record.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpanel.session import _shared_folder

from .common import stored

#: Magic numbers of the dictionary frame and of the frame that gives a record's packed size; readers that know neither skip both.
MAGIC, SIZE_MAGIC = 0x184D2A5D, 0x184D2A50
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = ("page_id string, record_id string, record_type string, target_uri string, payload_digest string, refers_to_record string, "
          "content_length bigint, content binary")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record_bytes(page: int | None, url: str | None, digest: str, kind: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record: header lines, an empty line, the block, two empty lines."""
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The fields of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    size = int(field["Content-Length"])
    return (field.get("X-Page-ID"), field["WARC-Record-ID"], field["WARC-Type"], field["WARC-Target-URI"], field["WARC-Payload-Digest"].removeprefix("sha1:"),
            field.get("WARC-Refers-To"), size, rest[:size])


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; empty where there are too few of them to learn from."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _writer(folder: str, dict_size: int, train_bytes: int, level: int):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}.warc.zst"
        draft = f"{name}.{task.taskAttemptId()}"

        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    yield record_bytes(r["page"], r["url"], r["digest"], r["kind"], r["refers"], r["body"] or b"")

        source, first, size = records(), [], 0
        for raw in source:
            first.append(raw)
            size += len(raw)
            if size >= train_bytes:
                break
        if not first:
            return
        words = train(first, dict_size)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True)
        count = 0
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(struct.pack("<II", MAGIC, len(words)) + words)
            for part in (first, source):
                for raw in part:
                    frame = packer.compress(raw)
                    out.write(struct.pack("<II", SIZE_MAGIC, 4) + struct.pack("<I", len(frame)) + frame)
                    count += 1
        fs.move(draft, name)
        yield pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": fs.get_file_info(name).size}],
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
    return run


def _exactly(stream, n: int) -> bytes:
    got = stream.read(n)
    if len(got) != n:
        raise ValueError("the archive ends inside a frame")
    return got


def read_archive(stream):
    """The records of an archive, one after the other."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    words = _exactly(stream, size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while head := stream.read(8):
        if struct.unpack("<II", head) != (SIZE_MAGIC, 4):
            raise ValueError("no length frame before a record")
        (size,) = struct.unpack("<I", _exactly(stream, 4))
        yield unpacker.decompress(_exactly(stream, size))


def _reader(folder: str):
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for part in batches:
            for path in part.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse_record(raw))
                        size += len(raw)
                        if size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)
    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000,
                   dict_size: int = 64 << 10, train_bytes: int = 4 << 20, level: int = 6) -> DataFrame:
    """Write the pages as archives below ``folder``; returns the manifest (path, records, bytes)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"), body.alias("body"))
    top = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    ranked = rows.join(top, ["digest", "size"], "left")
    again = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    name = F.udf(record_id)
    ready = ranked.select("page", "url", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
                          F.when(again, name("top", "digest")).alias("refers"), F.when(~again, F.col("body")).alias("body"))
    return stored(ready.mapInArrow(_writer(folder, dict_size, train_bytes, level), MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that a manifest lists, one archive a task at a time."""
    return manifest.select("path").repartition("path").mapInArrow(_reader(folder), RECORD)


def new_folder(spark) -> str:
    """A fresh folder for archives in the folder that all executors share."""
    root = _shared_folder(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/warc/{uuid.uuid4().hex}"


def resolved(records: DataFrame) -> DataFrame:
    """One row per record with the digest and size of its full payload; a revisit takes both from the response it refers to."""
    own = stored(records.select("page_id", "record_id", "record_type", "target_uri", "payload_digest", "refers_to_record",
                                F.octet_length("content").cast("long").alias("size"), F.sha1("content").alias("found")))
    answers = own.where("record_type = 'response'")
    full = answers.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.max("size").alias("payload_bytes"), F.max("found").alias("full_digest"), F.max("page_id").alias("refers_to"))
    again = own.where("record_type = 'revisit'").join(full, "refers_to_record", "left")
    plain = answers.withColumns({"payload_bytes": F.col("size"), "full_digest": F.col("found"), "refers_to": F.lit(None).cast("string")})
    return plain.unionByName(again).drop("size", "found")
