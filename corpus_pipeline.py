"""A text corpus from raw documents to token ids, one written table between any two stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpanel.llm import decontam, line_dedup, mil, minhash, pieces
from crowdpanel.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go."""
    model = mil.train(docs, table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    own = {c: f"__own_{c}" if c in ("score", "n_passages", "top_passage") else c for c in docs.columns}
    good = mil.scored(docs.withColumnsRenamed(own), model, own["text"]).where("score >= 0.5")
    return good.select(*[F.col(f"`{v}`").alias(c) for c, v in own.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are the same as or near an earlier one go; n_chars follows the text where the column exists."""
    out = line_dedup.dedup_lines(docs.withColumnsRenamed({c: f"__own_{c}" for c in LINE_COUNTS if c in docs.columns}))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_same") + F.col("n_near") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`__own_{c}`").alias(c) if c in LINE_COUNTS else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more stays."""
    return minhash.keep_first(docs, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover at least one word in twenty go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with a check that they decode to it."""
    rows = pieces.encode_and_decode(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


LINE_COUNTS = ("n_lines", "n_same", "n_near")
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", tokens),
]

#: Learned weights and hashed signatures have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
