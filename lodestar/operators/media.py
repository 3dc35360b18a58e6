"""Frames, transcripts, boxes and pictures of decks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_segments(segments: DataFrame, start: str, end: str, duration: Column) -> DataFrame:
    """Segments cut to 0..duration; empty intervals and blank texts leave."""
    a, b = F.greatest(F.lit(0), F.col(start)).cast("long"), F.least(F.col(end), duration).cast("long")
    return segments.withColumn(start, a).withColumn(end, b).where((F.col(end) > F.col(start)) & F.col("text").rlike(r"\S"))


def clamp_to_recordings(chunks: DataFrame) -> DataFrame:
    """The transcript chunks (see ``clamp_segments``), each cut to the length of its own recording.

    ``chunks``: ``revision_id, kind, text, start_ms, end_ms``. No table holds the length of a recording: it is the largest ``end_ms`` of the
    revision's passages and frames, as frames may end before the sound. Of a recording without any end nothing is cut.
    """
    length = chunks.where("kind in ('transcript', 'frame')").groupBy("revision_id").agg(F.max("end_ms").alias("_length"))
    said = chunks.where("kind = 'transcript'").join(length, "revision_id", "left")
    return clamp_segments(said, "start_ms", "end_ms", F.col("_length")).drop("_length")


def covering_frames(points: DataFrame, frames: DataFrame, at: str = "start_ms") -> DataFrame:
    """For each passage the first frame of its revision that covers its start: an equi-join on time slots, then the exact test.

    Each frame is listed in every slot of ten seconds it touches, each passage in one.
    """
    slot = 10_000
    f = frames.select("revision_id", F.col("chunk_id").alias("frame_id"), F.col("ordinal").alias("_o"), F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"))
    f = f.where("_a is not null and _b > _a").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_a") / slot), F.floor((F.col("_b") - 1) / slot))))
    p = points.withColumn("_slot", F.floor(F.col(at) / slot))
    hit = p.join(f, ["revision_id", "_slot"]).where((F.col("_a") <= F.col(at)) & (F.col(at) < F.col("_b")))
    best = hit.groupBy("chunk_id").agg(F.min_by("frame_id", F.struct("_o", "frame_id")).alias("frame_id"))
    return points.join(best, "chunk_id", "left")


def boxes_by_asset(pictures: DataFrame, read: DataFrame) -> DataFrame:
    """``(chunk_id, ocr_id)``: for each picture the first recognised passage of the same asset; pictures without one have a null.

    Passages are first reduced to one per asset, so an asset shown very often costs one row.
    """
    first = read.where("asset is not null").groupBy("asset").agg(F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("ocr_id"))
    return pictures.join(first, "asset", "left").select("chunk_id", "ocr_id")


def section_of(points: DataFrame, sections: DataFrame, at: str = "start_ms") -> DataFrame:
    """For each point the first section of its recording that covers it, else the recording's last.

    ``points``: ``recording, point_id`` and ``at``; ``sections``: ``recording, section_id, start_ms, end_ms``. Sections are listed in slots of ten seconds.
    """
    slot = 10_000
    s = sections.select("recording", "section_id", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b")).where("_a is not null and _b > _a")
    listed = s.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_a") / slot), F.floor((F.col("_b") - 1) / slot))))
    hit = points.withColumn("_slot", F.floor(F.col(at) / slot)).join(listed, ["recording", "_slot"]).where((F.col("_a") <= F.col(at)) & (F.col(at) < F.col("_b")))
    first = hit.groupBy("point_id").agg(F.min_by("section_id", F.struct("_a", "section_id")).alias("_first"))
    last = s.groupBy("recording").agg(F.max_by("section_id", F.struct("_a", "section_id")).alias("_last"))
    return points.join(first, "point_id", "left").join(last, "recording", "left").select("point_id", F.coalesce("_first", "_last").alias("section_id"))


def sample_frames(frames: DataFrame, key: str, time: str, mask: str, interval: int = 10_000, distance: int = 4, most: int = 1500) -> DataFrame:
    """``(key, time)`` of kept frames: greedy by interval, dropping a frame whose mask is near that of the last kept.

    The next time moves on even when a frame is dropped as a repeat. ``mask`` is a string of bits. A recording is one group; its
    frames are bounded by its length (four hours at most by the catalogue's limit).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, due, last = [], float("-inf"), None
        for i, (t, m) in enumerate(zip(pdf[time], pdf[mask])):
            if t < due or len(kept) >= most:
                continue
            due = t + interval
            near = last is not None and m is not None and sum(a != b for a, b in zip(m, last)) <= distance
            if not near:
                kept.append(i)
                last = m
        return pdf.iloc[kept][[key, time]]

    small = frames.select(key, time, mask).where(F.col(time).isNotNull())
    schema = f"{key} {dict(small.dtypes)[key]}, {time} {dict(small.dtypes)[time]}"
    return small.groupBy(key).applyInPandas(lambda pdf: run(pdf.sort_values([time, mask], kind="stable")), schema)


def ocr_words(tsv: DataFrame, text: str) -> DataFrame:
    """Words and boxes of a recogniser's table: rows of level 5 with a word in the twelfth field. Short rows are dropped."""
    line = tsv.select(*[c for c in tsv.columns if c != text], F.explode(F.split(F.col(text), "\n")).alias("_line"))
    f = F.split("_line", "\t")
    rows = line.where((F.size(f) >= 12) & (f[0] == "5")).where(F.trim(f[11]) != "")
    return rows.select(*[c for c in tsv.columns if c != text], F.trim(f[11]).alias("word"), *(f[i].cast("int").alias(n) for i, n in ((6, "x"), (7, "y"), (8, "width"), (9, "height"))))


def matching_boxes(locator: Column, query: Column, most: int = 200) -> Column:
    """Boxes whose text shares a word with the query, cut to the picture, each place once, at most ``most``."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    inside = F.transform(
        F.filter(F.coalesce(locator["boxes"], F.array()), lambda b: b["text"].isNotNull() & (b["width"] > 0) & (b["height"] > 0) & F.arrays_overlap(words(b["text"]), words(query))),
        lambda b: F.struct(
            b["text"].alias("text"),
            F.greatest(F.lit(0), b["x"]).alias("x"),
            F.greatest(F.lit(0), b["y"]).alias("y"),
            (F.least(locator["width"], b["x"] + b["width"]) - F.greatest(F.lit(0), b["x"])).alias("width"),
            (F.least(locator["height"], b["y"] + b["height"]) - F.greatest(F.lit(0), b["y"])).alias("height"),
        ),
    )
    good = F.filter(inside, lambda b: (b["width"] > 0) & (b["height"] > 0))
    place = lambda b: F.struct(b["x"], b["y"], b["width"], b["height"])
    first = F.filter(F.transform(good, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda p: F.array_position(F.transform(good, place), place(p["b"])) == p["i"] + 1)
    return F.when((locator["width"] > 0) & (locator["height"] > 0), F.slice(F.transform(first, lambda p: p["b"]), 1, most)).otherwise(F.array())


def picture_budget(pictures: DataFrame, deck: str = "deck", budget: int = 48) -> DataFrame:
    """Pictures of a deck worth reading: each content once, those without text first, then the largest, at most ``budget``."""
    once = Window.partitionBy(deck, "sha").orderBy("has_text", F.desc("area"), "picture")
    rank = Window.partitionBy(deck).orderBy("has_text", F.desc("area"), "picture")
    return pictures.withColumn("_c", F.row_number().over(once)).where("_c = 1").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= budget).drop("_c")
