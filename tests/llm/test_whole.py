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


def test_pieces_keep_their_places(spark, tmp_path):
    long = "\n".join("This is a sentence of some words." for _ in range(60))
    rows = [chunk(1, 7, 0, "text", "short", char_start=0, char_end=5, line_start=1, line_end=1, page=4), chunk(2, 7, 1, "text", long, char_start=100, char_end=100 + len(long), line_start=5, line_end=64, page=5), (3, 7, 2, "image", None, None, None, None, None)]
    got = run(spark, tmp_path, "p1_pieces", chunks=spark.createDataFrame(rows, CHUNK)).orderBy("ordinal").collect()
    pieces = [r for r in got if r.chunk_id == 2]
    assert len(pieces) > 1 and pieces[-1].locator.line_end == 64 and {r.locator.page for r in pieces} == {5}
    for r in pieces:
        a, b = r.locator.char_start - 100, r.locator.char_end - 100
        assert long[a:b] == r.text and (r.locator.line_start, r.locator.line_end) == (5 + long[:a].count("\n"), 5 + long[:b].count("\n"))
    assert got[0].locator.char_end == 5 and got[-1].locator is None


def test_mixture_itself_comes_out(spark, tmp_path):
    documents = spark.createDataFrame([(i, "word " * (5 + i % 7), "en", "a" if i % 3 else " B", "text") for i in range(300)], "doc_id long, text string, lang string, source string, modality string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 4)], "source string, target_share double, max_repeats int")
    got = run(spark, tmp_path, "p8_mixture", documents=documents, source_targets=targets).collect()
    shares = {r.source: r.mixed_tokens for r in entry.queries()["p8_shares"](spark, str(tmp_path)).collect()}
    assert len({r.doc_id for r in got}) == len(got) and {r.source: 0 for r in got} == {"a": 0, "b": 0}
    assert {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in shares} == shares
    assert all(r.source == ("a" if r.doc_id % 3 else "b") and 1 <= r.copies <= (1 if r.source == "a" else 4) for r in got)


def test_documented_functions_without_a_body(spark, tmp_path):
    files = [
        (1, "c", "#include <a.h>\n/** Sorts all the pages by number. */\nint sort_all(int a, char *b);\n/** Gives the number of open pages. */\nint open_pages(void);\nint plain(int a);\n"),
        (2, "c", "#include <a.h>\nint sort_all(int x, char *y)\n{\n  return 1;\n}\n"),
        (3, "java", "package a;\npublic interface A {\n  /** Counts all the rows of a table. */\n  int rows(String t);\n}\n"),
        (4, "rs", "pub trait A {\n    /// Closes every page that was read.\n    fn close_all(&self, a: i64) -> i64;\n}\n"),
    ]
    rows = [(i, i, 0, "code", t, None, locator(char_start=0, line_start=1, language=x), None, None) for i, x, t in files]
    got = run(
        spark,
        tmp_path,
        "p4_found",
        chunks=spark.createDataFrame(rows, CHUNK),
        revisions=spark.createDataFrame([(i, i) for i in (1, 2, 3)], "id long, file_id long"),
        files=spark.createDataFrame([(i, 9) for i in (1, 2, 3)], "id long, root_id long"),
    )
    assert sorted(map(tuple, got.collect())) == [(1, "open_pages"), (1, "sort_all"), (3, "rows"), (4, "close_all")]
    pairs = entry.queries()["p4_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.revision_id, r.func_name, r.own) for r in pairs) == [(1, "open_pages", True), (2, "sort_all", False), (3, "rows", True), (4, "close_all", True)]


def test_misreadings_on_many_pages(spark, tmp_path):
    common = "\n".join(["the priority of a straße is known to the table"] * 10)
    wrong = ["one 5traße is here", "a pri-\n0rity is here", "some kn0wn! is here"]
    rows = [chunk(i, 1, i, "ocr", f"{common}\n{wrong[i % 3]}\nand so it goes on from here", page=i + 1) for i in range(180)] + [chunk(500, 1, 500, "ocr", common, page=501)]
    df = spark.createDataFrame(rows, CHUNK).coalesce(1)  # one task: each misreading stands on 60 of its 181 pages
    got = run(spark, tmp_path, "p3_found", chunks=df).where("defect = 'misread'").collect()
    assert {r.chunk_id for r in got} == set(range(180))
