"""Listings and readers: files become units of text with their places."""

from __future__ import annotations

import ast
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schema import CODE_EXTENSIONS, EXCLUDED_NAMES, IMAGE_EXTENSIONS, SUPPORTED, TEXT_EXTENSIONS
from lodestar.sources.decks import DeckError, deck_units

#: From a path and its bytes to rows of UNITS.
Reader = Callable[[str, bytes], list[tuple]]


def listing(spark: SparkSession, root: str, exclusions: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``(relative_path, name, extension, size, mtime_ns)`` of the supported files below a folder, and whether all could be read.

    Hidden and excluded folders, links, and what a shell pattern of ``exclusions`` matches at any prefix are left out.
    """
    from lodestar.functions.text import glob_pattern

    if os.path.islink(root) or not os.path.isdir(root):
        raise FileNotFoundError(f"ROOT_UNAVAILABLE: {root}")
    globs = [re.compile(glob_pattern(g)) for g in exclusions or ()]
    rows, whole = [], True

    def failed(_: OSError) -> None:
        nonlocal whole
        whole = False

    for folder, folders, names in os.walk(root, onerror=failed):
        near = os.path.relpath(folder, root)
        rel = lambda n, near=near: n if near == "." else f"{near}/{n}"
        out = lambda n: n.startswith(".") or n.lower() in EXCLUDED_NAMES or any(g.match(rel(n)) for g in globs)
        folders[:] = sorted(n for n in folders if not out(n) and not os.path.islink(os.path.join(folder, n)))
        for n in sorted(names):
            ext = os.path.splitext(n)[1]
            path = os.path.join(folder, n)
            if out(n) or ext.lower() not in SUPPORTED or os.path.islink(path):
                continue
            try:
                s = os.stat(path)
            except OSError:
                whole = False
                continue
            rows.append((rel(n), n, ext, s.st_size, s.st_mtime_ns))
    return spark.createDataFrame(rows, "relative_path string, name string, extension string, size long, mtime_ns long"), whole


READ = "relative_path string, sha256 string, content binary, error string"


def contents(listed: DataFrame, root: str) -> DataFrame:
    """The bytes and digests of listed files, read by the executors one by one from the shared folder ``root``.

    ``listed``: ``relative_path, size, mtime_ns``. A file whose size or time is no longer that of the listing when it has been read has the error
    SOURCE_CHANGED, one that is gone SOURCE_UNAVAILABLE, one that leads out of the folder SOURCE_BLOCKED; these have no content.
    """

    def read(path: str, size: int, mtime_ns: int) -> tuple[str | None, bytes | None, str | None]:
        full = os.path.join(root, path)
        if not contained(root, full):
            return None, None, "SOURCE_BLOCKED"
        try:
            with open(full, "rb") as f:
                data = f.read()
            now = os.stat(full)
        except OSError:
            return None, None, "SOURCE_UNAVAILABLE"
        if (now.st_size, now.st_mtime_ns) != (size, mtime_ns) or len(data) != size:
            return None, None, "SOURCE_CHANGED"
        return hashlib.sha256(data).hexdigest(), data, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # bounds the bytes held at once
                part = batch.slice(first, 64)
                rows = [read(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                sha, data, error = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, pa.string()), pa.array(data, pa.binary()), pa.array(error, pa.string())], names=["relative_path", "sha256", "content", "error"])

    return listed.select("relative_path", "size", "mtime_ns").mapInArrow(run, READ)


def contained(root: str, path: str) -> bool:
    """Whether a path lies below a folder and no link leads to it."""
    root = os.path.abspath(root)
    path = os.path.abspath(path)
    if os.path.commonpath([root, path]) != root:
        return False
    return os.path.realpath(path) == os.path.join(os.path.realpath(root), os.path.relpath(path, root)) if path != root else True


def source_state(catalog: DataFrame, listed: DataFrame) -> DataFrame:
    """``(file_id, state)``: ok, SOURCE_CHANGED if size or time differ from the catalogue's, SOURCE_UNAVAILABLE if the file is gone.

    ``catalog``: ``file_id, path_key, size, mtime_ns``; ``listed``: ``path_key, size, mtime_ns``, each path once.
    """
    now = listed.select("path_key", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"))
    same = (F.col("_s") == F.col("size")) & (F.col("_t") == F.col("mtime_ns"))
    return catalog.join(now, "path_key", "left").select("file_id", F.when(F.col("_s").isNull(), "SOURCE_UNAVAILABLE").when(same, "ok").otherwise("SOURCE_CHANGED").alias("state"))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def decoded(content: Column) -> Column:
    """``struct(text, error)``: UTF-16 with a mark, else UTF-8; bytes that are neither are errors, as are zero bytes."""
    head = F.hex(F.substring(content, 1, 2))
    wide = head.isin("FFFE", "FEFF")
    zero = F.locate("00", F.regexp_replace(F.hex(content), "(..)", "$1 ")) > 0
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.when(wide, F.decode(content, "UTF-16")).otherwise(utf8)
    text = F.regexp_replace(text, "^﻿", "")
    error = F.when(~wide & zero, "BINARY_FILE").when(text.isNull(), "UNSUPPORTED_ENCODING")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


_JAVA = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\],.? ]+?\s+(\w+)\s*\([^()]*\)\s*(?:throws [\w., ]+)?\{", re.M)


def code_units(text: str, extension: str) -> list[tuple[str, str, int, int, int, str | None]]:
    """``(text, symbol, line_start, line_end, char_start, parser)``: functions and methods of Python and Java, and what lies between.

    A file that does not parse, and a file in another language, is one unit.
    """
    whole = [(text, "", 1, text.count("\n") + 1, 0, None)]
    spans: list[tuple[int, int, str]] = []
    if extension == ".py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [(text, "", 1, text.count("\n") + 1, 0, "fallback")]
        heads = [0]
        for line in text.splitlines(keepends=True):
            heads.append(heads[-1] + len(line))
        raw = [x.encode() for x in text.splitlines(keepends=True)] + [b""]
        place = lambda line, col: heads[line - 1] + len(raw[line - 1][:col].decode(errors="ignore"))

        def visit(body: list[ast.stmt]) -> None:
            for node in body:
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    col = node.col_offset if first == node.lineno else node.decorator_list[0].col_offset - 1
                    spans.append((place(first, col), place(node.end_lineno, node.end_col_offset), node.name))
                elif isinstance(node, ast.ClassDef):
                    visit(node.body)

        visit(tree.body)
    elif extension == ".java":
        for m in _JAVA.finditer(text):
            depth, at = 1, m.end()
            while at < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
            if depth:
                return [(text, "", 1, text.count("\n") + 1, 0, "fallback")]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if not spans or start >= spans[-1][1]:
                spans.append((start, at, m[1]))
    if not spans:
        return whole
    out, last = [], 0
    for a, b, name in [*sorted(spans), (len(text), len(text), "")]:
        for x, y, symbol, parser in ((last, a, "", None), (a, b, name, "tree")):
            if text[x:y].strip():
                out.append((text[x:y], symbol, text.count("\n", 0, x) + 1, text.count("\n", 0, y) + 1, x, parser))
        last = max(last, b)
    return out


UNITS = "relative_path string, unit int, text string, kind string, symbol string, char_start int, line_start int, line_end int, parser string, slide int, section string, error string"


def _deck(path: str, data: bytes) -> list[tuple]:
    try:
        return [(path, i, t, "text", None, None, None, None, None, n, section, None) for i, (n, section, t) in enumerate(deck_units(data))]
    except DeckError as wrong:
        return [(path, 0, None, None, None, None, None, None, None, None, None, str(wrong))]


def units(read: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Units of text, code and presentations; ``read``: ``relative_path, extension, content, text, error``. What has no reader gives an error row.

    ``readers``: further readers by extension, each from ``(path, bytes)`` to rows of UNITS: pictures, recordings and PDF need libraries that
    a session may lack. Without one their files carry the code that says so. A unit's place is its slide and section, or its
    lines and characters.
    """
    missing = {".pdf": "PDF_UNAVAILABLE", ".ppt": "LEGACY_PPT_UNAVAILABLE", **{e: "OCR_UNAVAILABLE" for e in IMAGE_EXTENSIONS}}
    by_suffix: dict[str, Reader] = {".pptx": _deck, **(readers or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * 10
        for batch in batches:
            rows: list[tuple] = []
            for path, ext, data, text, error in zip(*(c.to_pylist() for c in batch.columns)):
                ext = (ext or "").lower()
                if ext in by_suffix and data is not None:
                    rows += by_suffix[ext](path, data)
                elif error or text is None or ext not in (*CODE_EXTENSIONS, *TEXT_EXTENSIONS):
                    known = error if ext in (*CODE_EXTENSIONS, *TEXT_EXTENSIONS) else None
                    rows.append((path, 0, *none[:9], known or missing.get(ext, "MEDIA_UNAVAILABLE")))
                elif ext in CODE_EXTENSIONS:
                    rows += [(path, i, t, "code", s, c, a, b, p, None, None, None) for i, (t, s, a, b, c, p) in enumerate(code_units(text, ext))]
                else:
                    rows.append((path, 0, text, "text", None, 0, 1, text.count("\n") + 1, None, None, None, None))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in UNITS.split(", ")])

    return read.select("relative_path", "extension", "content", "text", "error").mapInArrow(run, UNITS)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of several lines: one object, or one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Queries or judgments, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
