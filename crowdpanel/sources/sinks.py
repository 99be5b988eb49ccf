"""Table writers, manifests and a named-table runner."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """ZSTD Parquet, replaced as a whole; rows are ordered inside files only."""
    out = df.sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    """Year folders; only the years in the data are replaced, so a build can resume."""
    rows = df.withColumn("year", F.year(date))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy("year").parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Write and return the row count, observed during the write."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return int(seen.get["n"])


def write_manifest(spark: SparkSession, path: str, params: Mapping, counts: Mapping[str, int], checks: Sequence = ()) -> None:
    """One JSON row: parameters, rows per table and check results."""
    body = {"params": dict(params), "rows": dict(counts), "checks": [c.asDict() for c in checks]}
    spark.createDataFrame([(json.dumps(body, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def land(spark: SparkSession, root: str, builders: Mapping[str, Callable[[], DataFrame]], params: Mapping | None = None) -> dict[str, int]:
    """Write every named table under a root and a manifest beside them."""
    counts = {name: write_counted(build(), f"{root}/{name}") for name, build in builders.items()}
    write_manifest(spark, f"{root}/_manifest", params or {}, counts)
    return counts


def input_snapshot(spark: SparkSession, paths: Sequence[str]) -> list[dict]:
    """Path, bytes and time of change of every file below the given paths, in order of path."""
    found = []
    for root in paths:
        fs, path = _file_system(spark, root)
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append({"path": f.getPath().toString(), "bytes": f.getLen(), "changed": f.getModificationTime()})
    return sorted(found, key=lambda f: f["path"])


def land_resumable(spark: SparkSession, root: str, builders: Mapping[str, Callable[[], DataFrame]], inputs: Sequence[str] = (), params: Mapping | None = None,
                   checks: Sequence = ()) -> dict:
    """Write every named table into a version of its own and point the manifest to it last; returns the manifest.

    The version is named by parameters, table names and a snapshot of the input files. A run that broke off left its finished
    tables there, each with a note of its rows written after the table, so the next run with the same inputs builds only what has no note.
    Readers follow the manifest (``landed``), which is renamed into place, and so see the version before until the new one is whole.
    """
    snapshot = input_snapshot(spark, inputs)
    body = {"params": dict(params or {}), "tables": sorted(builders), "inputs": snapshot}
    version = hashlib.sha256(json.dumps(body, default=str, sort_keys=True).encode()).hexdigest()[:16]
    counts, resumed = {}, []
    for name, build in builders.items():
        note = f"{root}/{version}/_rows/{name}"
        known = read_small(spark, note)
        if known is None:
            counts[name] = write_counted(build(), f"{root}/{version}/{name}")
            write_small(spark, note, str(counts[name]))
        else:
            counts[name] = int(known)
            resumed.append(name)
    manifest = {**body, "version": version, "rows": counts, "resumed": resumed, "checks": [c.asDict() for c in checks]}
    write_small(spark, f"{root}/_current", json.dumps(manifest, default=str, sort_keys=True))
    return manifest


def landed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that the manifest points to; none before the first whole run."""
    text = read_small(spark, f"{root}/_current")
    if text is None:
        return {}
    manifest = json.loads(text)
    return {name: spark.read.parquet(f"{root}/{manifest['version']}/{name}") for name in manifest["tables"]}


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole: written beside its place, then renamed."""
    fs, place = _file_system(spark, path)
    _, aside = _file_system(spark, f"{path}.new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(aside, place):
        raise OSError(f"could not move {path}.new into place")


def read_small(spark: SparkSession, path: str) -> str | None:
    """Its text; one that was written but not yet renamed counts, as a run may break off between deleting and renaming."""
    for p in (path, f"{path}.new"):
        fs, place = _file_system(spark, p)
        if fs.exists(place):
            stream = fs.open(place)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return text
    return None
