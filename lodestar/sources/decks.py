"""Presentations: packages of XML parts become units of text, by slide."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

# The namespaces of presentation parts, and the bounds of a package.
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
MOST_PARTS, MOST_PART_BYTES, EXPANSION, MOST_SLIDES, DEEPEST = 10_000, 20 * 2**20, 4, 1000, 32


class DeckError(ValueError):
    """Why a presentation cannot be read; the message is its error code."""


def package(data: bytes, max_bytes: int) -> zipfile.ZipFile:
    """The opened package, if its parts are few and small enough, none is encrypted, and it holds a presentation."""
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":  # a compound file: an encrypted package, or the old format
        raise DeckError("ENCRYPTED_PRESENTATION")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as bad:
        raise DeckError("PRESENTATION_UNREADABLE") from bad
    parts = z.infolist()
    if any(p.flag_bits & 1 for p in parts):
        raise DeckError("ENCRYPTED_PRESENTATION")
    if len(parts) > MOST_PARTS or sum(p.file_size for p in parts) > EXPANSION * max_bytes or any(p.file_size > MOST_PART_BYTES for p in parts):
        raise DeckError("PRESENTATION_TOO_LARGE")
    if "ppt/presentation.xml" not in z.namelist():
        raise DeckError("PRESENTATION_UNREADABLE")
    return z


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """``id -> (kind, part)`` of what a part refers to within the package."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(rels)):
        if r.get("TargetMode") != "External":
            target = r.get("Target", "")
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return out


def _paragraphs(body: ElementTree.Element) -> str:
    lines = []
    for p in body.iter(f"{_A}p"):
        lines.append("".join("\n" if x.tag == f"{_A}br" else x.text or "" for x in p.iter() if x.tag in (f"{_A}t", f"{_A}br")))
    return "\n".join(x for x in lines if x.strip())


def _table(table: ElementTree.Element) -> str:
    rows = []
    for row in table.iter(f"{_A}tr"):
        cells = [_paragraphs(c) for c in row.findall(f"{_A}tc") if not (c.get("hMerge") in ("1", "true") or c.get("vMerge") in ("1", "true"))]
        rows.append(" | ".join(c.replace("\n", " ") for c in cells))
    return "\n".join(r for r in rows if r.strip(" |"))


def _chart(z: zipfile.ZipFile, part: str) -> str:
    """A chart's title, the names of its series and its categories."""
    if part not in z.namelist():
        return ""
    root = ElementTree.fromstring(z.read(part))
    title = root.find(f".//{_C}title")
    out = [_paragraphs(title)] if title is not None else []
    for tag in ("tx", "cat"):
        for x in root.iterfind(f".//{_C}ser/{_C}{tag}"):
            out += [v.text for v in x.iter(f"{_C}v") if v.text]
    return "\n".join(dict.fromkeys(x for x in out if x.strip()))


def _shapes(z: zipfile.ZipFile, tree: ElementTree.Element, related: dict, depth: int = 0) -> list[str]:
    """The texts of a tree of shapes in their order; groups are walked to a bounded depth."""
    out: list[str] = []
    if depth > DEEPEST:
        return out
    for shape in tree:
        if shape.tag == f"{_P}grpSp":
            out += _shapes(z, shape, related, depth + 1)
        elif shape.tag == f"{_P}sp":
            body = shape.find(f"{_P}txBody")
            if body is not None:
                out.append(_paragraphs(body))
        elif shape.tag == f"{_P}graphicFrame":
            out += [_table(t) for t in shape.iter(f"{_A}tbl")]
            out += [_chart(z, related[c.get(f"{_R}id")][1]) for c in shape.iter(f"{_C}chart") if c.get(f"{_R}id") in related]
    return [x for x in out if x.strip()]


def deck_units(data: bytes, max_bytes: int = 50 * 2**20) -> list[tuple[int, str, str]]:
    """``(slide, section, text)``: per slide its text, then its notes, slides counted from 1; slides without text have no unit.

    Raises DeckError with the code of what is wrong; more than MOST_SLIDES slides are too large.
    """
    z = package(data, max_bytes)
    try:
        top = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        related = _related(z, "ppt/presentation.xml")
        ids = [s.get(f"{_R}id") for s in top.iterfind(f"{_P}sldIdLst/{_P}sldId")]
        if len(ids) > MOST_SLIDES:
            raise DeckError("PRESENTATION_TOO_LARGE")
        out = []
        for n, i in enumerate(ids, 1):
            part = related[i][1]
            own = _related(z, part)
            tree = ElementTree.fromstring(z.read(part)).find(f"{_P}cSld/{_P}spTree")
            text = "\n".join(_shapes(z, tree, own)) if tree is not None else ""
            if text.strip():
                out.append((n, "slide", text))
            for kind, notes in own.values():
                if kind == "notesSlide" and notes in z.namelist():
                    said = [_paragraphs(s.find(f"{_P}txBody")) for s in ElementTree.fromstring(z.read(notes)).iter(f"{_P}sp") if s.find(f"{_P}txBody") is not None and not _fixture(s)]
                    said = "\n".join(x for x in said if x.strip())
                    if said:
                        out.append((n, "notes", said))
        return out
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile) as bad:
        raise DeckError("PRESENTATION_UNREADABLE") from bad


def _fixture(shape: ElementTree.Element) -> bool:
    """Whether a shape of a notes page is the slide's picture, its number, date, header or footer."""
    holder = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
    return holder is not None and bool(re.fullmatch("sldImg|sldNum|dt|hdr|ftr", holder.get("type", "")))
