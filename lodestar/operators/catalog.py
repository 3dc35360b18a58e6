"""The catalogue: once-delivered rows, eligibility, filters, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import has_prefix
from lodestar.schema import MODALITIES


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice count once."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def live_files(files: DataFrame, revisions: DataFrame, roots: DataFrame) -> DataFrame:
    """Ready files of enabled, ready roots with the revision that is visible: the base of every search.

    Files without an active revision, of unknown roots or revisions are not live.
    """
    up = roots.where(F.col("enabled") & (F.col("status") == "ready")).select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    revision = once(revisions).select(F.col("id").alias("active_revision_id"), "sha256", "pipeline_hash")
    ready = files.where((F.col("status") == "ready") & F.col("active_revision_id").isNotNull()).withColumnRenamed("id", "file_id")
    return ready.join(up, "root_id").join(revision, "active_revision_id")


def filters(root_id: int | None = None, modality: str | None = None, extension: str | None = None, path_prefix: str | None = None, after_ns: int | None = None, before_ns: int | None = None) -> Column:
    """The conjunction of the given filters on live files; bounds of time are inclusive."""
    if modality is not None and modality not in MODALITIES:
        raise ValueError(f"unknown modality {modality!r}")
    parts: list[Column] = [F.lit(True)]
    if root_id is not None:
        parts.append(F.col("root_id") == root_id)
    if modality is not None:
        parts.append(F.col("modality") == modality)
    if extension is not None:
        parts.append(F.lower("extension") == extension.lower())
    if path_prefix is not None:
        parts.append(has_prefix(F.col("relative_path"), path_prefix))
    if after_ns is not None:
        parts.append(F.col("mtime_ns") >= after_ns)
    if before_ns is not None:
        parts.append(F.col("mtime_ns") <= before_ns)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def live_chunks(chunks: DataFrame, live: DataFrame, columns: Sequence[str] = ("ordinal", "kind", "text", "text_hash", "symbol", "locator")) -> DataFrame:
    """Chunks of the visible revisions with their file's columns; only ``columns`` of the chunks are read."""
    own = once(chunks.select("id", "revision_id", *columns)).withColumnRenamed("id", "chunk_id")
    return own.join(live.select(F.col("active_revision_id").alias("revision_id"), "file_id", "root_id", "relative_path", "name", "extension", "modality", "mtime_ns", "sha256"), "revision_id")


def hydrate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full rows for candidate ids only; the candidates travel, not the table."""
    return chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, live: DataFrame) -> DataFrame:
    """One row: ready files, live chunks, all embeddings."""
    ready = files.agg(F.count_if(F.col("status") == "ready").alias("ready_files"), F.count_if(F.col("status") == "failed").alias("failed_files"))
    passages = chunks.select("id", "revision_id").distinct().join(live.select(F.col("active_revision_id").alias("revision_id")), "revision_id", "left_semi").agg(F.count("*").alias("live_chunks"))
    stored = vectors.agg(F.count_distinct("id").alias("embeddings"))
    return ready.crossJoin(passages).crossJoin(stored)  # three tables of one row each


def modality_counts(live: DataFrame) -> DataFrame:
    return live.groupBy("modality").agg(F.count("*").alias("files"))


def failures(files: DataFrame) -> DataFrame:
    return files.where(F.col("error_code").isNotNull()).select(F.col("id").alias("file_id"), "relative_path", "status", "error_code")
