from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import numeric, text
from lodestar.operators import catalog, chunking, evaluation, fusion, lexical, media, reconcile, vectors
from lodestar.operators.prefix import running_sum
from lodestar.plans import generations
from lodestar.schema import LOCATOR, Settings
from lodestar.sources import files as sources


def one(spark, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


def test_query_terms(spark):
    got = one(spark, q="Find my notes about shortestPaths and BCNF x² naïve").select(text.query_terms(F.col("q"))).first()[0]
    assert got == ["shortestpaths", "bcnf", "x²", "naïve", "shortest", "paths"]


def test_text_functions(spark):
    df = one(spark, p="Notes/A_b%c.md", s="parseHTTPName_of", t="Straße café a·b")
    r = df.select(
        text.has_prefix(F.col("p"), "notes/a_").alias("a"),
        text.has_prefix(F.col("p"), "notes/%").alias("b"),
        text.split_identifiers(F.col("s")).alias("c"),
        text.index_tokens(F.col("t")).alias("d"),
        text.ancestors(F.lit("a/b/c")).alias("e"),
        text.mark_terms(F.lit("The Page table"), F.lit("find page")).alias("f"),
        text.mark_terms(F.lit("The Page table"), F.lit("find")).alias("g"),
        text.extraction_note(F.lit("slide_3:OCR_TIMEOUT")).alias("h"),
        text.clock(F.lit(61_000)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, "parse HTTPName of".replace("HTTPName", "HTTPName"), ["straße", "cafe", "a", "b"], ["a", "a/b", "a/b/c"])
    assert (r.f, r.g, r.i) == ("The <mark>Page</mark> table", "The Page table", "1:01") and "Slide 3" in r.h
    import re

    assert re.search(text.glob_pattern("src/*.py"), "src/a/b.py") and not re.search(text.glob_pattern("*.py"), "a.pyc")


def test_settings():
    with pytest.raises(ValueError):
        Settings(chunk_tokens=32, overlap_tokens=32)
    assert Settings(limit=20).candidates == 100
    with pytest.raises(ValueError):
        catalog.filters(modality="smell")


def test_running_sum(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else "b", i, int(v)) for i, v in enumerate(rng.integers(0, 9, 300))] + [(None, 0, 4), (None, 1, None)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], F.floor(F.col("o") / 7), ["o"], "v", "s").collect()}
    for k, o, _ in data:
        assert got[k, o] == sum(v or 0 for a, b, v in data if a == k and b < o)
    assert running_sum(df.limit(0), ["k"], F.col("o"), ["o"], "v", "s").count() == 0


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(1, "a b b", "n", "p", ""), (2, "a", "b", "p", ""), (3, "c c c", "n", "p", "b"), (4, "", "", "", "")], "chunk_id long, text string, name string, path string, symbol string")
    terms = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "missing")], "query_id string, term string")
    got = {r.chunk_id: r.score for r in lexical.bm25(terms, lexical.postings(rows), lexical.corpus_stats(rows, lexical.postings(rows))).collect()}
    length = {1: 5, 2: 3, 3: 6, 4: 0}
    mean = sum(length.values()) / 4
    f = {"b": {1: 2, 2: 3, 3: 4}, "c": {3: 3}}
    for d in (1, 2, 3):
        want = 0.0
        for t, at in f.items():
            if d in at:
                idf = math.log((4 - len(at) + 0.5) / (len(at) + 0.5))
                want -= (idf if idf > 0 else 1e-6) * at[d] * 2.2 / (at[d] + 1.2 * (0.25 + 0.75 * length[d] / mean))
        assert abs(got[d] - want) < 1e-8
    assert 4 not in got


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 8)).round(2)
    base[50] = base[51]
    items = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(base)], "group int, id long, v array<double>")
    asked = items.where("id % 40 = 0").withColumn("id", F.concat(F.lit("q"), F.col("id")))
    got = vectors.exact_neighbours(asked, items, 5, query_block=2, base_block=32).collect()
    for i in range(0, 200, 40):
        s = np.round(base @ base[i], 9)
        want = sorted(range(200), key=lambda j: (-s[j], j))[:5]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == f"q{i}"), key=lambda r: r["rank"])] == want
    bad = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.2), (4, 0.9), (5, float("inf"))], "id int, score double")
    assert [r.id for r in vectors.floor(bad, 0.35).collect()] == [4]
    state = numeric.vector_state(F.col("v"), F.lit(2))
    rows = spark.createDataFrame([([1.0, 0.0],), ([3.0, 4.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "v array<double>")
    assert [r[0] for r in rows.select(state).collect()] == ["ok", "norm", "zero", "dimension", "null", "not_finite"]


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, item int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2), ("q", 2, 9)], "query_id string, item int, rank int")
    got = lexical.top(fusion.rrf([(a, 1.0), (b, 1.0)], "item"), 9, item="item", best_first="desc").collect()
    assert [r.item for r in sorted(got, key=lambda r: r["rank"])] == [2, 1, 3]
    hits = spark.createDataFrame([("q", 1, i, h, k, i) for i, (h, k) in enumerate([("x", "text"), ("x", "text"), ("x", "image"), ("y", "frame"), ("y", "text"), ("z", "text")], 1)], "query_id string, file_id int, chunk_id int, text_hash string, kind string, rank int")
    assert sorted(r.chunk_id for r in fusion.evidence(hits, 3).collect()) == [1, 4, 5]
    live = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "s")], "file_id int, sha256 string")
    assert {tuple(r) for r in fusion.aliases(live).collect()} == {(1, 1, 3), (2, 1, 3), (4, 1, 3)}


def test_measures(spark):
    q = spark.createDataFrame([("q",), ("e",)], "query_id string")
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, path string, rank int")
    jud = spark.createDataFrame([("q", "a", 2), ("q", "c", 2), ("q", "b", 1)], "query_id string, path string, grade int")
    r = {x.query_id: x for x in evaluation.metrics(res, jud, q, 5).collect()}
    assert (r["q"].precision, r["q"].recall, r["q"].hit_rate, r["q"].mrr) == (0.2, 0.5, 1, 1.0)
    dcg, best = 3 + 1 / math.log2(3), 3 + 3 / math.log2(3) + 1 / 2
    assert abs(r["q"].ndcg - dcg / best) < 1e-12
    assert (r["e"].answerable, r["e"].recall, r["e"].mrr, r["e"].ndcg) == (False, 0.0, 0.0, 0.0)
    assert one(spark, a="the cat sat on mats").select(numeric.word_edits(F.col("a"), F.lit("a cat sat mat on"))).first()[0] == 3


def test_chunker(spark):
    body = "\n".join(f"word{i} another" for i in range(20))
    for a, b in chunking.cut(body, 8, 2):
        assert len(body[a:b].split()) <= 8
    spans = chunking.cut(body, 8, 2)
    assert all(body[a2:b1].split() and len(body[a2:b1].split()) == 2 for (_, b1), (a2, _) in zip(spans, spans[1:]))
    snap = "a b c d e f g\n\nh i j k l"
    assert [snap[a:b] for a, b in chunking.cut(snap, 8, 2)][0] == "a b c d e f g"
    units = spark.createDataFrame([(1, 0, body, "text", 10, 3), (1, 1, None, "text", 0, 1), (1, 2, "", "image", None, None)], "k long, unit int, text string, kind string, char_start int, line_start int")
    got = chunking.chunk_units(units, "k", 8, 2).collect()
    assert got[0].line_start == 3 and got[0].char_start == 10 and got[-1].kind == "image" and max(r.line_end or 0 for r in got) == 22
    assert chunking.chunk_units(units.limit(0), "k").count() == 0


def test_reconcile(spark):
    listing = spark.createDataFrame([("a", ".md", 1, 1, "s", False), ("b", ".md", 2, 1, "s", False), ("c", ".md", 1, 1, "s", True), ("d", ".md", 99, 1, "n", None), ("e", ".MP4", 99, 1, "n", False)], "path_key string, extension string, size long, mtime_ns long, sha256 string, forced boolean")
    held = spark.createDataFrame([(k, "ready", 1, 1, "s", "p") for k in "abcz"] + [("e", "failed", None, None, None, None)], "path_key string, status string, size long, mtime_ns long, sha256 string, pipeline_hash string")
    got = {r.path_key: r.decision for r in reconcile.decisions(listing, held, "p", max_bytes=50).collect()}
    assert got == {"a": "skipped", "b": "reuse_checked", "c": "reuse_checked", "d": "failed", "e": "extract", "z": "deleted"}
    jobs = spark.createDataFrame([(1, "running", False, 5), (2, "running", True, 5), (3, "queued", False, 0)], "job_id int, state string, cancel boolean, processed int")
    assert [(r.state, r.processed) for r in reconcile.recovered(jobs).orderBy("job_id").collect()] == [("queued", 0), ("cancelled", 0), ("queued", 0)]


def test_media(spark):
    frames = spark.createDataFrame([("v", 0, "0000"), ("v", 1000, "1111"), ("v", 10_000, "0000"), ("v", 20_000, "1111"), ("w", 5, None)], "k string, t long, m string")
    got = sorted((r.k, r.t) for r in media.sample_frames(frames, "k", "t", "m", distance=1).collect())
    assert got == [("v", 0), ("v", 20_000), ("w", 5)]
    seg = spark.createDataFrame([(-1000, 2000, "a"), (8000, 15000, "b"), (12000, 15000, "c"), (1, 2, " ")], "start_ms long, end_ms long, text string")
    assert [(r.start_ms, r.end_ms) for r in media.clamp_segments(seg, "start_ms", "end_ms", F.lit(10_000)).collect()] == [(0, 2000), (8000, 10000)]
    loc = spark.createDataFrame([((None,) * 10 + (100, 100, [("BCNF", 90, 5, 20, 10), ("bcnf!", 90, 5, 20, 10), ("other", 1, 1, 5, 5), ("BCNF", 200, 1, 5, 5), (None, 1, 1, 1, 1)], None, None, None),)], f"l {LOCATOR.simpleString()}")
    boxes = loc.select(media.matching_boxes(F.col("l"), F.lit("bcnf"))).first()[0]
    assert [(b.x, b.width) for b in boxes] == [(90, 10)]


def test_generations(spark, tmp_path):
    g = generations.Generations(spark, f"file://{tmp_path}/catalog")
    assert g.current() is None
    with pytest.raises(LookupError):
        g.read("files")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert g.publish({"files": a}) == 1
    b = generations.merged(g.read("files"), spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), "id", spark.createDataFrame([(1,)], "id int"))
    assert g.publish({"files": b}) == 2
    assert sorted(map(tuple, g.read("files").collect())) == [(2, "B"), (3, "c")]
    assert sorted(map(tuple, g.read("files", 1).collect())) == [(1, "a"), (2, "b")]
    assert g.retire(1) == [1] and g.current()["generation"] == 2
    assert generations.checksum(a, ["id", "v"]).first() == generations.checksum(a.orderBy(F.desc("id")), ["id", "v"]).first()


def test_sources(spark, tmp_path):
    for name, data in {"a.md": b"\xef\xbb\xbfhello", "b.py": "# café\ndef solve():\n    return 1\n".encode(), "w.txt": "paging".encode("utf-16"), "x.txt": b"\xffnot", "z.txt": b"a\x00b", "node_modules/c.js": b"1", ".hidden/d.md": b"1", "e.exe": b"1", "skip/f.md": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    listed, whole = sources.listing(spark, str(tmp_path), ["skip"])
    assert whole and sorted(r.relative_path for r in listed.collect()) == ["a.md", "b.py", "w.txt", "x.txt", "z.txt"]
    with pytest.raises(FileNotFoundError):
        sources.listing(spark, str(tmp_path / "none"))
    read = sources.contents(listed, str(tmp_path)).join(listed.select("relative_path", "extension"), "relative_path")
    d = sources.decoded(F.col("content"))
    got = read.select("relative_path", "extension", "content", d["text"].alias("text"), d["error"].alias("error"))
    by = {r.relative_path: (r.text, r.error) for r in got.collect()}
    assert by["a.md"] == ("hello", None) and by["w.txt"] == ("paging", None) and by["x.txt"] == (None, "UNSUPPORTED_ENCODING") and by["z.txt"] == (None, "BINARY_FILE")
    units = [r for r in sources.units(got).collect() if r.relative_path == "b.py"]
    assert [(u.symbol, u.line_start) for u in units if u.symbol] == [("solve", 2)] and units[-1].text.startswith("def solve")


def test_empty_catalogue(spark, sf):
    from lodestar.plans.storage import load

    f, r, c, k = (load(spark, sf, t).limit(0) for t in ("files", "revisions", "chunks", "roots"))
    live = catalog.live_files(f, r, k)
    assert live.count() == 0 and catalog.live_chunks(c, live).count() == 0 and fusion.aliases(live).count() == 0


def test_changed_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("now longer than it was")
    (tmp_path / "out.md").write_text("x")
    (tmp_path / "in").mkdir()
    os.symlink(tmp_path / "out.md", tmp_path / "in" / "link.md")
    s = os.stat(tmp_path / "a.md")
    rows = [("a.md", 3, s.st_mtime_ns), ("gone.md", 1, 1), ("in/link.md", 1, 1), ("../x.md", 1, 1)]
    got = {r.relative_path: r.error for r in sources.contents(spark.createDataFrame(rows, "relative_path string, size long, mtime_ns long"), str(tmp_path)).collect()}
    assert got == {"a.md": "SOURCE_CHANGED", "gone.md": "SOURCE_UNAVAILABLE", "in/link.md": "SOURCE_BLOCKED", "../x.md": "SOURCE_BLOCKED"}
    (tmp_path / "doc.json").write_text('[{"a": 1,\n "b": "x"},\n {"a": 2}]')
    assert sorted(r.a for r in sources.json_document(spark, f"file://{tmp_path}/doc.json", "a int, b string").collect()) == [1, 2]


A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def deck(path, slides, extra=()):
    """A small presentation: of each slide its shapes as XML, and its notes."""
    import zipfile

    rel = lambda rows: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    with zipfile.ZipFile(path, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + n}" r:id="r{n}"/>' for n in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rel([(f"r{n}", "slide", f"slides/s{n}.xml") for n in range(len(slides))]))
        for n, (shapes, notes) in enumerate(slides):
            z.writestr(f"ppt/slides/s{n}.xml", f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>')
            if notes:
                z.writestr(f"ppt/slides/_rels/s{n}.xml.rels", rel([("n", "notesSlide", f"../notesSlides/n{n}.xml")]))
                z.writestr(f"ppt/notesSlides/n{n}.xml", f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{said("7", "sldNum")}{said(notes)}</p:spTree></p:cSld></p:notes>')
        for name, text in extra:
            z.writestr(name, text)


def said(text, kind="body"):
    return f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def test_decks(spark, tmp_path):
    from lodestar.sources import decks

    cell = lambda t, more="": f"<a:tc{more}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell("Determinant")}{cell("Superkey")}</a:tr><a:tr>{cell("a")}{cell("b", chr(32) + "hMerge=" + chr(34) + "1" + chr(34))}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    deck(tmp_path / "d.pptx", [(said("First slide"), "Say this"), (f"<p:grpSp>{said('In a group')}</p:grpSp>{table}", None), ("", None)])
    data = (tmp_path / "d.pptx").read_bytes()
    assert decks.deck_units(data) == [(1, "slide", "First slide"), (1, "notes", "Say this"), (2, "slide", "In a group\nDeterminant | Superkey\na")]
    for bad, code in ((b"nothing", "PRESENTATION_UNREADABLE"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", "ENCRYPTED_PRESENTATION")):
        with pytest.raises(decks.DeckError, match=code):
            decks.deck_units(bad)
    with pytest.raises(decks.DeckError, match="PRESENTATION_TOO_LARGE"):
        decks.deck_units(data, 10)
    read = spark.createDataFrame([("d.pptx", ".PPTX", data, None, None), ("bad.pptx", ".pptx", b"x", None, None), ("p.png", ".png", b"x", None, None)], "relative_path string, extension string, content binary, text string, error string")
    got = [(r.relative_path, r.slide, r.section, r.error) for r in sources.units(read).collect()]
    assert ("d.pptx", 1, "notes", None) in got and ("bad.pptx", None, None, "PRESENTATION_UNREADABLE") in got and ("p.png", None, None, "OCR_UNAVAILABLE") in got
    own = sources.units(read, {".png": lambda path, data: [(path, 0, "read", "ocr", None, None, None, None, None, None, None, None)]})
    assert own.where("text = 'read'").count() == 1


def test_spans_and_errors(spark):
    actual = "struct<slide int, section string, page int, line_start int, line_end int, start_ms long, end_ms long>"
    rows = [(1, (2, "slide", None, None, None, None, None), (2, "notes", None, None, None, None, None)), (2, (None, None, None, None, None, 500, 900), (None, None, None, None, None, 850, None)), (3, (None, None, 1, 5, 10, None, None), (None, None, 1, 9, 15, None, None)), (4, (None, None, 1, None, None, None, None), (None, None, None, 9, 15, None, None))]
    df = spark.createDataFrame(rows, f"id int, own {actual}, want {actual}")
    got = {r.id: r.ok for r in df.select("id", evaluation.span_matches(F.col("own"), F.col("want"), ("slide", "section", "page", "line_start", "start_ms")).alias("ok")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
    long = " ".join(f"w{i}" for i in range(400))
    e = spark.createDataFrame([("a b c d", "a x c"), (long, long.replace("w399", "y")), (None, "a")], "a string, b string").select(numeric.word_edits(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in e.collect()] == [2, 1, None]


def test_requests():
    from lodestar.plans.search import Request

    with pytest.raises(ValueError):
        Request(mode="psychic")


def test_rerank_broadcasts_no_scores(spark):
    """Scores grow with the queries; on disk they look small enough for a broadcast that no driver holds."""
    rows = [(f"q{q}", c, c + 1, float((c * 7 + q) % 5) if c % 6 else None) for q in range(3) for c in range(25)]
    branch = spark.createDataFrame(rows, "query_id string, chunk_id long, rank int, other double")
    apart = fusion.rerank(branch.drop("other"), branch.where("other is not null").select("query_id", "chunk_id", "other"))
    assert "Broadcast" not in apart._jdf.queryExecution().executedPlan().toString()
    whole = fusion.rerank(branch)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    want = set()
    for q in range(3):
        own = [r for r in rows if r[0] == f"q{q}"]
        order = sorted(own[:20], key=lambda r: (-(r[3] or 0.0), r[1])) + own[20:]
        want |= {(r[0], r[1], k + 1) for k, r in enumerate(order)}
    assert {tuple(r) for r in apart.collect()} == want == {tuple(r) for r in whole.collect()}
