"""Fusion of ranked branches and the grouping of hits into results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(branches: list[tuple[DataFrame, float | Column]], item: str, k: int = 60, key: str = "query_id") -> DataFrame:
    """``(query_id, item, score)``: the sum of weight / (k + rank) over the branches, an item once per branch."""
    out = None
    for df, weight in branches:
        best = df.groupBy(key, item).agg(F.min("rank").alias("rank"))
        part = best.select(key, item, ((F.lit(weight) if not isinstance(weight, Column) else weight) / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, item).agg(F.round(F.sum("part"), 12).alias("score"))


def by_file(branch: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """``(query_id, file_id, rank)``: a file's rank is the place of its best chunk among files."""
    best = branch.join(chunks.select("chunk_id", "file_id"), "chunk_id").groupBy(key, "file_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy(key).orderBy("_r", "file_id")
    return best.withColumn("rank", F.row_number().over(w)).drop("_r")


def one_per_content(results: DataFrame, key: str = "query_id") -> DataFrame:
    """The first file of each content in rank order; ``results`` has ``query_id, file_id, sha256, rank``."""
    w = Window.partitionBy(key, "sha256").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def content_classes(live: DataFrame) -> DataFrame:
    """``(file_id, class_id, copies)``: files of equal content share the lowest id as their class; copies are not spread into pairs."""
    lowest = live.where("sha256 is not null").groupBy("sha256").agg(F.min("file_id").alias("class_id"), F.count("*").alias("copies"))
    return live.select("file_id", "sha256").join(lowest, "sha256").select("file_id", "class_id", "copies")


def aliases(live: DataFrame) -> DataFrame:
    """``(file_id, class_id, copies)`` of the files whose content is held more than once: the aliases of a file are the members of its class."""
    return content_classes(live).where("copies > 1")


def evidence(hits: DataFrame, n: int = 3, key: str = "query_id") -> DataFrame:
    """The first ``n`` hits of each file, in rank order, equal texts once unless the earlier hit is a picture.

    ``hits``: ``query_id, file_id, chunk_id, text_hash, kind, rank``.
    """
    picture = F.col("kind").isin("image", "frame")
    same = Window.partitionBy(key, "file_id", "text_hash").orderBy("rank", "chunk_id")
    seen = F.sum(F.when(picture, 0).otherwise(1)).over(same.rowsBetween(Window.unboundedPreceding, -1))
    kept = hits.withColumn("_seen", F.coalesce(seen, F.lit(0))).where("_seen = 0").drop("_seen")
    w = Window.partitionBy(key, "file_id").orderBy("rank", "chunk_id")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def rerank(branch: DataFrame, scores: DataFrame | None = None, head: int = 20, key: str = "query_id") -> DataFrame:
    """The first ``head`` candidates in the order of another score, the rest as they were.

    ``scores``: ``query_id, chunk_id, other``; none if the branch has ``other`` itself. They grow with the queries and pack so small on disk
    that the planner would take them for a small table, so they are merged, not broadcast.
    """
    both = branch if scores is None else branch.join(scores.hint("merge"), [key, "chunk_id"], "left")
    first = F.col("rank") <= head
    w = Window.partitionBy(key).orderBy(F.when(first, 0).otherwise(1), F.when(first, -F.coalesce("other", F.lit(0.0))), F.when(first, F.col("chunk_id")), "rank")
    return both.withColumn("new_rank", F.row_number().over(w)).select(key, "chunk_id", F.col("new_rank").alias("rank"))


def match_kind(files: DataFrame, lexical_files: DataFrame, text_files: DataFrame, key: str = "query_id") -> DataFrame:
    """terms if a file is in the lexical branch, else semantic if in the text branches, else visual."""
    a = lexical_files.select(key, "file_id").distinct().withColumn("_l", F.lit(True))
    b = text_files.select(key, "file_id").distinct().withColumn("_t", F.lit(True))
    both = files.join(a, [key, "file_id"], "left").join(b, [key, "file_id"], "left")
    return both.withColumn("match_kind", F.when(F.col("_l"), "terms").when(F.col("_t"), "semantic").otherwise("visual")).drop("_l", "_t")
