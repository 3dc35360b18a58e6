"""Queries that must give the whole of their job, on small tables."""

from __future__ import annotations

import __spark_entry__ as entry

from lodestar.schema import LOCATOR

CHUNK = f"id long, revision_id long, ordinal int, kind string, text string, text_hash string, locator {LOCATOR.simpleString()}, symbol string, asset string"


def locator(**k):
    return tuple(k.get(n) for n in LOCATOR.fieldNames())


def run(spark, folder, name, **tables):
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder))


def chunk(i, revision, ordinal, kind, text, **k):
    return (i, revision, ordinal, kind, text, None, locator(**k), None, None)


def test_transcripts_of_long_recordings(spark, tmp_path):
    rows = [
        chunk(1, 7, 0, "transcript", "a", start_ms=-5, end_ms=20_000),
        chunk(2, 7, 1, "transcript", "crosses half a minute", start_ms=20_000, end_ms=40_000),
        chunk(3, 7, 2, "transcript", "late", start_ms=3_600_000, end_ms=3_601_000),
        chunk(3, 7, 2, "transcript", "late", start_ms=3_600_000, end_ms=3_601_000),
        chunk(4, 7, 3, "transcript", " ", start_ms=50_000, end_ms=51_000),
        chunk(5, 7, 4, "frame", "", start_ms=0, end_ms=60_000),
        chunk(6, 8, 0, "transcript", "short", start_ms=1000, end_ms=2000),
        chunk(7, 8, 1, "transcript", "empty", start_ms=2000, end_ms=2000),
        chunk(8, None, 0, "transcript", "of no revision", start_ms=90_000, end_ms=91_000),
    ]
    got = run(spark, tmp_path, "transcript_clamp", chunks=spark.createDataFrame(rows, CHUNK)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 20_000), (2, 20_000, 40_000), (3, 3_600_000, 3_601_000), (6, 1000, 2000), (8, 90_000, 91_000)]


def test_hydrates_every_kind(spark, tmp_path):
    kinds = ["text", "code", "ocr", "image", "frame", "transcript"]
    rows = [chunk(i, 7, i, k, k * 400) for i, k in enumerate(kinds)] + [chunk(0, 7, 0, "text", "text" * 400), chunk(50, 7, 9, "image", None), chunk(60, 8, 0, "text", "not live")]
    got = run(
        spark,
        tmp_path,
        "hydrate_candidates",
        chunks=spark.createDataFrame(rows, CHUNK),
        roots=spark.createDataFrame([(1, "/r", True, "ready")], "id long, path string, enabled boolean, status string"),
        revisions=spark.createDataFrame([(7, 3, "s", "p"), (8, 3, "t", "p")], "id long, file_id long, sha256 string, pipeline_hash string"),
        files=spark.createDataFrame([(3, 1, "a", "a", ".x", "text", 0, "ready", 7)], "id long, root_id long, relative_path string, name string, extension string, modality string, mtime_ns long, status string, active_revision_id long"),
    )
    assert {tuple(r) for r in got.collect()} == {(i, k, (k * 400)[:1400]) for i, k in enumerate(kinds)} | {(50, "image", None)} and got.count() == 7


def test_notes_of_named_warnings(spark, tmp_path):
    warnings = ["page_skipped", "slide_3:OCR_TIMEOUT", "slide_4:IMAGE_UNREADABLE", "slide_5", "presentation_ocr_partial:12_of_40", "transcription_unavailable:x", "no_audio_stream", "frame_limit_reached"]
    rows = [(1, warnings[:4]), (2, warnings[3:]), (2, warnings[3:]), (3, []), (4, None), (5, [None])]
    got = {r.warning: r.note for r in run(spark, tmp_path, "extraction_notes", revisions=spark.createDataFrame(rows, "id long, warnings array<string>")).collect()}
    want = {
        "page_skipped": "page skipped",
        "slide_3:OCR_TIMEOUT": "Image OCR on Slide 3 reached its time limit. Slide text is still searchable.",
        "slide_4:IMAGE_UNREADABLE": "An embedded image on Slide 4 could not be read. Slide text is still searchable.",
        "slide_5": "slide 5",
        "presentation_ocr_partial:12_of_40": "Slide text is searchable. Image OCR stopped early; 12 image placements were not processed.",
        "transcription_unavailable:x": "Video frames are searchable, but the audio could not be transcribed. Check local speech setup and rescan.",
        "no_audio_stream": "This video has no audio track. Its sampled frames are searchable.",
        "frame_limit_reached": "Video sampling reached its frame limit. Later visuals may be missing.",
    }
    assert {k: got.get(k) for k in want} == want and None not in got
