"""Change events: relevance, coalescing, debouncing, forced verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestar.functions.text import ancestors, glob_column
from lodestar.plans.storage import shared_dir
from lodestar.schema import EXCLUDED_NAMES, SUPPORTED

WATCHED = ("created", "modified", "deleted", "moved")


def touched(events: DataFrame) -> DataFrame:
    """One row per path an event touches: moves keep both paths, changes of directories themselves do not count."""
    keep = F.col("event_type").isin(*WATCHED) & ~((F.col("event_type") == "modified") & F.coalesce("is_directory", F.lit(False)))
    paths = F.array_compact(F.array("src_path", F.when(F.col("event_type") == "moved", F.col("dest_path"))))
    return events.where(keep).withColumn("path", F.explode(paths))


def relevant(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths below a root without hidden or excluded parts, matching no exclusion of the root at any prefix, of a supported kind.

    ``roots`` are a dimension; the join is by equality of ancestors, so no path is tried against all roots.
    """
    up = paths.withColumn("_up", F.explode(ancestors(F.col("path"))))
    held = roots.select(F.col("id").alias("root_id"), F.rtrim("path", F.lit("/")).alias("_up"), F.coalesce("exclusions", F.array().cast("array<string>")).alias("_globs"))
    at = up.join(held, "_up").withColumn("relative", F.expr("substring(path, length(_up) + 2)")).where("relative <> ''")
    parts = F.split("relative", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | F.lower(p).isin(*EXCLUDED_NAMES))
    globbed = F.exists(ancestors(F.col("relative")), lambda p: F.exists("_globs", lambda g: F.regexp_like(p, glob_column(g))))
    suffix = F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1))
    kind = F.coalesce("is_directory", F.lit(False)) | suffix.isin(*SUPPORTED)
    return at.where(~hidden & ~globbed & kind).drop("_up", "_globs")


def coalesced(paths: DataFrame, by: str = "root_id") -> DataFrame:
    """The set of dirty paths of each root and the time of the last change; pre-aggregated per path first."""
    once = paths.groupBy(by, "path").agg(F.max("ts").alias("ts"))
    return once.groupBy(by).agg(F.count("*").alias("dirty"), F.max("ts").alias("changed_at"))


def sessions(events: DataFrame, by: str, gap: str = "1 second") -> DataFrame:
    """Bursts of events no further apart than ``gap``: when a burst is over, the paths are indexed. ``ts`` is a timestamp."""
    return events.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def forced(files: DataFrame, dirty: DataFrame) -> DataFrame:
    """Files at or below a dirty path, which are verified by content even where size and time are unchanged."""
    return files.withColumn("_up", F.explode(ancestors(F.col("relative_path")))).join(dirty.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").drop("_up").distinct()


def watch(events: DataFrame, roots: DataFrame, handle, name: str = "watch", lateness: str = "10 seconds", once: bool = True) -> StreamingQuery:
    """Runs ``handle(batch_of_sessions, batch_id)`` for each burst of relevant changes of an event stream.

    ``events`` is a streaming table ``event_type, src_path, dest_path, is_directory, ts``; ``roots`` a batch table. Events later than the
    watermark are hints lost, which the next full comparison finds. The query's state lives in the shared folder.
    """
    spark = events.sparkSession
    dirty = relevant(touched(events.withWatermark("ts", lateness)), roots)
    writer = sessions(dirty, "root_id").writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", f"{shared_dir(spark)}/lodestar/stream-{name}").queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def watch_state(enabled: bool, roots: int, query: StreamingQuery | None) -> str:
    """off, waiting (nothing to watch), stopped (failed or ended), watching."""
    if not enabled:
        return "off"
    if not roots:
        return "waiting"
    if query is None or not query.isActive:
        return "stopped"
    return "watching"
