"""Comparing a listing of files with the catalogue: decisions, deletions, reuse, bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.schema import AUDIO_EXTENSIONS, VIDEO_EXTENSIONS


def decisions(listing: DataFrame, catalog: DataFrame, pipeline: str, max_bytes: int = 50 * 2**20, media: bool = True, verify: bool = False) -> DataFrame:
    """``(path_key, decision, code)`` for the full outer match of ``listing`` and ``catalog``.

    ``listing``: ``path_key, extension, size, mtime_ns, sha256, forced``; ``catalog``: ``path_key, status, size, mtime_ns, sha256,
    pipeline_hash``. Decisions: skipped, failed, reuse_checked (same content), extract, deleted. One shuffle on ``path_key``.
    """
    left = listing.select("path_key", F.lower("extension").alias("ext"), "size", "mtime_ns", "sha256", F.coalesce("forced", F.lit(False)).alias("forced"), F.lit(True).alias("here"))
    right = catalog.select("path_key", "status", F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime"), F.col("sha256").alias("c_sha"), F.col("pipeline_hash").alias("c_pipe"))
    both = left.join(right, "path_key", "full_outer")
    is_media = F.col("ext").isin(*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS)
    known = (F.col("status") == "ready") & (F.col("c_pipe") == pipeline)
    decision = (
        F.when(F.col("here").isNull(), "deleted")
        .when(is_media & F.lit(not media), "skipped")
        .when(known & (F.col("size") == F.col("c_size")) & (F.col("mtime_ns") == F.col("c_mtime")) & F.lit(not verify) & ~F.col("forced"), "skipped")
        .when((F.col("size") > max_bytes) & ~is_media, "failed")
        .when(known & (F.col("sha256") == F.col("c_sha")), "reuse_checked")
        .otherwise("extract")
    )
    return both.select("path_key", decision.alias("decision"), F.when(decision == "failed", "FILE_TOO_LARGE").alias("code"))


def deleted(catalog: DataFrame, listing: DataFrame, complete: DataFrame) -> DataFrame:
    """Catalogue rows that a complete scan of their root did not see; ``complete``: ``root_id`` of the roots scanned to the end."""
    return catalog.join(complete.select("root_id").distinct(), "root_id", "left_semi").join(listing.select("path_key"), "path_key", "left_anti")


def donors(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``(path_key, donor_id)``: the lowest ready file of equal extension, content and pipeline to take chunks from.

    Donors are first reduced to one per content, so a content held a million times costs one row in the join.
    """
    key = ["extension", "sha256", "pipeline_hash"]
    one = held.where((F.col("status") == "ready") & F.col("sha256").isNotNull()).groupBy(*key).agg(F.min("file_id").alias("donor_id"))
    return wanted.join(one, key).select("path_key", "donor_id")


def embedding_misses(chunks: DataFrame, vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(profile_id, text_hash)`` once each: texts of chunks without a stored vector of a profile, which alone are encoded.

    ``profiles`` are a few fixed rows: each text is met by each of them, as each encodes every text.
    """
    have = vectors.where("vector is not null and input_hash is not null").select("profile_id", F.col("input_hash").alias("text_hash")).distinct()
    need = chunks.where(F.col("text").rlike(r"\S") & F.col("text_hash").isNotNull()).select("text_hash").distinct()
    ids = [r.id for r in profiles.select("id").distinct().collect() if r.id is not None]  # fixed rows
    each = need.withColumn("profile_id", F.explode(F.array(*map(F.lit, sorted(ids))))) if ids else need.withColumn("profile_id", F.lit(None).cast("string")).limit(0)
    return each.join(have, ["profile_id", "text_hash"], "left_anti").select("profile_id", "text_hash")


def orphan_assets(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored assets that no chunk names."""
    return stored.select("asset").distinct().join(chunks.where("asset is not null").select("asset").distinct(), "asset", "left_anti")


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """``(root_id, inside_id)``: roots at or below another root, by a join on the ancestors of each path."""
    from lodestar.functions.text import ancestors

    up = roots.select(F.col("id").alias("root_id"), F.explode(ancestors(F.rtrim("path", F.lit("/")))).alias("path"))
    at = roots.select(F.col("id").alias("inside_id"), F.rtrim("path", F.lit("/")).alias("path"))
    return up.join(at, "path").where("root_id <> inside_id").select("root_id", "inside_id")


def forgotten(files: DataFrame, revisions: DataFrame, chunks: DataFrame, root_id: int) -> DataFrame:
    """One row: how many files, revisions and chunks go with a root."""
    own = files.where(F.col("root_id") == root_id).select(F.col("id").alias("file_id"))
    revs = revisions.select("id", "file_id").distinct().join(own, "file_id", "left_semi").select(F.col("id").alias("revision_id"))
    parts = chunks.select("id", "revision_id").distinct().join(revs, "revision_id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(own, "files").crossJoin(count(revs, "revisions")).crossJoin(count(parts, "chunks"))  # one row each


def job_counters(outcomes: DataFrame) -> DataFrame:
    """Per job: total, processed, indexed, skipped, failed, deleted; ``outcomes``: ``job_id, outcome``."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    done = F.count_if(F.col("outcome").isin("indexed", "skipped", "failed")).alias("processed")
    return outcomes.groupBy("job_id").agg(F.count("*").alias("total"), done, n("indexed"), n("skipped"), n("failed"), n("deleted"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job: top-1 without a full sort."""
    return jobs.where("state = 'queued'").orderBy("created_at", "job_id").limit(1)


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs are queued again with counters reset, cancelled ones stay cancelled."""
    state = F.when((F.col("state") == "running") & F.col("cancel"), "cancelled").when(F.col("state") == "running", "queued").otherwise(F.col("state"))
    return jobs.withColumn("processed", F.when(F.col("state") == "running", 0).otherwise(F.col("processed"))).withColumn("state", state)


def next_revision(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """``(file_id, revision_id)``: the newest ready revision of each file, which publication makes visible."""
    w = Window.partitionBy("file_id").orderBy(F.desc("created_at"), F.desc("id"))
    ready = revisions.where("state = 'ready'").select("id", "file_id", "created_at").distinct()
    return ready.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("file_id", F.col("id").alias("revision_id")).join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
