"""Incremental ingestion: a folder is listed, compared with the catalogue, read, chunked and published as a generation."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import chunking, reconcile
from lodestar.operators.prefix import dense_ids
from lodestar.plans.generations import Generations
from lodestar.plans.storage import written
from lodestar.schema import AUDIO_EXTENSIONS, CODE_EXTENSIONS, IMAGE_EXTENSIONS, LOCATOR, PRESENTATION_EXTENSIONS, TEXT_EXTENSIONS, VIDEO_EXTENSIONS, Settings
from lodestar.sources import files as sources
from lodestar.streaming import watch

FILES = "id long, root_id long, path string, path_key string, relative_path string, name string, extension string, modality string, size long, mtime_ns long, status string, active_revision_id long, error_code string"
REVISIONS = "id long, file_id long, sha256 string, pipeline_hash string, created_at timestamp, state string, warnings array<string>"
ROOTS = "id long, path string, exclusions array<string>, enabled boolean, status string, last_scan timestamp"
CHUNKS = T.StructType([T.StructField("id", T.LongType()), T.StructField("revision_id", T.LongType()), T.StructField("ordinal", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("kind", "text", "text_hash")), T.StructField("locator", LOCATOR), T.StructField("symbol", T.StringType()), T.StructField("asset", T.StringType())])


def modality_of(extension: Column) -> Column:
    e = F.lower(extension)
    groups = (("text", TEXT_EXTENSIONS), ("code", CODE_EXTENSIONS), ("image", IMAGE_EXTENSIONS), ("audio", AUDIO_EXTENSIONS), ("video", VIDEO_EXTENSIONS), ("presentation", PRESENTATION_EXTENSIONS), ("document", (".pdf",)))
    out = F.when(F.lit(False), "")
    for name, exts in groups:
        out = out.when(e.isin(*exts), name)
    return out


def pipeline_of(s: Settings) -> str:
    """The identity of everything that changes what a file is turned into."""
    import hashlib
    import json

    identity = {"extractor": 2, "chunker": 1, "budget": s.chunk_tokens, "overlap": s.overlap_tokens, "ocr": s.enable_ocr, "media": s.enable_media}
    return hashlib.sha256(json.dumps(identity, separators=(",", ":")).encode()).hexdigest()


def register(roots: DataFrame, path: str, exclusions: list[str] | None = None) -> tuple[int, bool]:
    """``(id, new)`` of a folder among the roots; OVERLAPPING_ROOT if it lies below, or above, another of them. ``roots`` is small."""
    path = os.path.abspath(path).rstrip("/") or "/"
    held = {r.path.rstrip("/"): r.id for r in roots.select("path", "id").collect()}  # roots are few
    if path in held:
        return held[path], False
    if any(path.startswith(p + "/") or p.startswith(path + "/") for p in held):
        raise ValueError(f"OVERLAPPING_ROOT: {path}")
    return max(held.values(), default=0) + 1, True


def forget(catalog: Generations, path: str) -> dict[str, int]:
    """Publishes a generation without a root, its files, revisions and chunks. Returns what is left."""
    with catalog.writing():
        roots, files, revisions, chunks = (catalog.read(t) for t in ("roots", "files", "revisions", "chunks"))
        gone = roots.where(F.col("path") == os.path.abspath(path)).select(F.col("id").alias("root_id"))
        files = files.join(gone, "root_id", "left_anti")
        revisions = revisions.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        chunks = chunks.join(revisions.select(F.col("id").alias("revision_id")), "revision_id", "left_semi")
        catalog.publish({"roots": roots.join(gone.withColumnRenamed("root_id", "id"), "id", "left_anti"), "files": files.select(*catalog.read("files").columns), "revisions": revisions.select(*catalog.read("revisions").columns), "chunks": chunks.select(*CHUNKS.fieldNames())})
    return catalog.current()["tables"]


def index(spark: SparkSession, root: str, catalog: Generations, exclusions: list[str] | None = None, settings: Settings | None = None, verify: bool = False, forced: list[str] | None = None) -> dict[str, int]:
    """Brings the catalogue up to date with a folder. Returns the counts of decisions.

    Files of unchanged size and time are neither opened nor read, unless ``verify`` is set or they lie at or below a path of ``forced``;
    others are read and hashed, and those of unchanged content only get their new size and time. A content that another
    ready file of the same extension and pipeline holds is not extracted again: its chunks are taken. A folder that cannot be
    listed is marked unavailable and keeps its files; a scan that could not read everything deletes nothing. Ids go on
    from the highest in use and are never used twice. One writer at a time (INDEX_BUSY).
    """
    with catalog.writing():
        return _index(spark, os.path.abspath(root), catalog, exclusions, settings or Settings(), verify, forced or [])


def _index(spark: SparkSession, root: str, catalog: Generations, exclusions: list[str] | None, s: Settings, verify: bool, forced: list[str]) -> dict[str, int]:
    now = catalog.current()
    empty = lambda schema: spark.createDataFrame([], schema)
    files, revisions, chunks, roots = (catalog.read(t) if now else empty(k) for t, k in (("files", FILES), ("revisions", REVISIONS), ("chunks", CHUNKS), ("roots", ROOTS)))
    top = lambda df, c="id": df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
    root_id, _ = register(roots, root)
    me = lambda state: spark.createDataFrame([(root_id, root, exclusions or [], True, state)], "id long, path string, exclusions array<string>, enabled boolean, status string").withColumn("last_scan", F.current_timestamp())
    try:
        listed, whole = sources.listing(spark, root, exclusions)
    except FileNotFoundError:
        if now:
            catalog.publish({"roots": _merge(roots, me("unavailable"), None), "files": files, "revisions": revisions, "chunks": chunks})
        return {"unavailable": 1}
    pipeline = pipeline_of(s)
    dirty = spark.createDataFrame([(p.strip("/"),) for p in forced], "path string")
    listed = listed.withColumn("path_key", F.concat(F.lit(root + "/"), "relative_path"))
    marked = watch.forced(listed, dirty).select("path_key", F.lit(True).alias("forced"))
    here = written(listed.join(marked, "path_key", "left").withColumn("forced", F.coalesce("forced", F.lit(False))), "listing")
    held = files.where(F.col("root_id") == root_id).join(revisions.select(F.col("id").alias("active_revision_id"), "sha256", "pipeline_hash").distinct(), "active_revision_id", "left")
    # by size and time first: only what that leaves open is read
    unread = reconcile.decisions(here.withColumn("sha256", F.lit(None).cast("string")), held, pipeline, s.max_file_bytes, s.enable_media, verify)
    open_ = written(here.join(unread.where("decision in ('extract', 'reuse_checked')"), "path_key", "left_semi"), "unread")
    read = written(sources.contents(open_, root), "read")
    hashed = here.join(read.select("relative_path", "sha256", F.col("error").alias("read_error")), "relative_path", "left")
    chosen = written(reconcile.decisions(hashed, held, pipeline, s.max_file_bytes, s.enable_media, verify), "decisions")
    counts = {r.decision: r["count"] for r in chosen.groupBy("decision").count().collect()}
    if not whole:
        chosen = chosen.where("decision <> 'deleted'")
    todo = written(hashed.join(chosen.where("decision in ('extract', 'failed')").select("path_key", "decision", "code"), "path_key"), "todo")
    numbered = dense_ids(todo.join(held.select("path_key", F.col("id").alias("_old")), "path_key", "left"), ["path_key"], "_n")
    fresh = numbered.select("*", F.coalesce("_old", F.col("_n") + top(files)).alias("file_id"), (F.col("_n") + top(revisions)).alias("revision_id"), F.lit(pipeline).alias("pipeline_hash"))
    fresh = fresh.withColumn("_problem", F.coalesce("code", "read_error"))
    ready = files.join(revisions.select(F.col("id").alias("active_revision_id"), "sha256", "pipeline_hash").distinct(), "active_revision_id").withColumnRenamed("id", "file_id")
    lender = reconcile.donors(fresh.where("_problem is null").select("path_key", "extension", "sha256", "pipeline_hash"), ready).join(ready.select(F.col("file_id").alias("donor_id"), F.col("active_revision_id").alias("_from")), "donor_id").select("path_key", "_from")
    fresh = written(fresh.join(lender, "path_key", "left"), "fresh")
    own = fresh.where("_problem is null and _from is null")
    read = read.where("error is null").drop("error", "sha256")
    fresh_read = own.select("relative_path", "extension", "file_id", "revision_id")
    d = sources.decoded(F.col("content"))
    texts = read.join(fresh_read, "relative_path").select("relative_path", F.lower("extension").alias("extension"), "content", d["text"].alias("text"), d["error"].alias("error"))
    units = written(sources.units(texts), "units")
    errors = units.where("error is not null").select("relative_path", "error").unionByName(fresh.where("_problem is not null").select("relative_path", F.col("_problem").alias("error")))
    cut = chunking.chunk_units(units.where("error is null"), "relative_path", s.chunk_tokens, s.overlap_tokens)
    cut = cut.join(units.select("relative_path", "unit", "symbol", "parser", "slide", "section"), ["relative_path", "unit"]).join(fresh.select("relative_path", "revision_id", F.lower(F.regexp_replace("extension", r"^\.", "")).alias("_ext")), "relative_path")
    place = Window.partitionBy("revision_id").orderBy("unit", "ordinal_in_unit")
    locator = F.from_json(F.to_json(F.struct("line_start", "line_end", "char_start", "char_end", F.when(F.col("kind") == "code", F.col("_ext")).alias("language"), "parser", "slide", "section")), LOCATOR)
    cut = dense_ids(cut, ["revision_id", "unit", "ordinal_in_unit"], "id", top(chunks))
    new_chunks = cut.select("id", "revision_id", (F.row_number().over(place) - 1).alias("ordinal"), "kind", "text", F.sha2("text", 256).alias("text_hash"), locator.alias("locator"), "symbol", F.lit(None).cast("string").alias("asset"))
    new_chunks = written(new_chunks, "chunks")
    copied = chunks.join(fresh.where("_from is not null").select("revision_id", "_from").withColumnRenamed("revision_id", "_to"), F.col("revision_id") == F.col("_from")).drop("id", "revision_id", "_from").withColumnRenamed("_to", "revision_id")
    copied = dense_ids(copied, ["revision_id", "ordinal"], "id", max(top(chunks), top(new_chunks)))
    new_chunks = new_chunks.unionByName(copied.select(*CHUNKS.fieldNames()))
    state = fresh.join(errors, "relative_path", "left")
    new_files = state.select(F.col("file_id").alias("id"), F.lit(root_id).cast("long").alias("root_id"), F.col("path_key").alias("path"), "path_key", "relative_path", "name", "extension", modality_of(F.col("extension")).alias("modality"), "size", "mtime_ns", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.col("revision_id")).alias("active_revision_id"), F.col("error").alias("error_code"))
    new_revisions = state.where("error is null").select(F.col("revision_id").alias("id"), "file_id", "sha256", F.lit(pipeline).alias("pipeline_hash"), F.current_timestamp().alias("created_at"), F.lit("ready").alias("state"), F.array().cast("array<string>").alias("warnings"))
    gone = held.join(chosen.where("decision = 'deleted'"), "path_key", "left_semi").select("id")
    stale = held.join(fresh.select("path_key"), "path_key", "left_semi").select(F.col("active_revision_id").alias("id")).union(gone.join(held.select("id", "active_revision_id"), "id").select("active_revision_id")).where("id is not null")
    # a content that was read and is the same has its new size and time noted
    kept = hashed.join(chosen.where("decision = 'reuse_checked'"), "path_key", "left_semi").select("path_key", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"))
    touched = files.join(kept, "path_key", "left").withColumn("size", F.coalesce("_s", "size")).withColumn("mtime_ns", F.coalesce("_t", "mtime_ns")).select(*files.columns)
    whole_files = _merge(touched, new_files, gone)
    whole_revisions = revisions.join(stale, "id", "left_anti").unionByName(new_revisions)
    whole_chunks = chunks.join(stale.withColumnRenamed("id", "revision_id"), "revision_id", "left_anti").select(*CHUNKS.fieldNames()).unionByName(new_chunks)
    catalog.publish({"roots": _merge(roots, me("ready"), None), "files": whole_files, "revisions": whole_revisions, "chunks": whole_chunks}, by={"chunks": ["revision_id"]})
    return counts


def _merge(old: DataFrame, fresh: DataFrame, gone: DataFrame | None) -> DataFrame:
    from lodestar.plans.generations import merged

    return merged(old, fresh, "id", gone)
