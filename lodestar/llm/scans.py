"""Problem 3: noise in text from scanned pages.

Method: skip-gram vectors of all words are learned (sums of fixed random vectors of the words within two places, which is a
random projection of the skip-gram counts and merges over any split of the pages); rare words are linked to frequent
neighbours that differ by plausible confusions of glyphs, the best in context is taken; then furniture is removed and the
lines are reflowed into paragraphs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.prefix import running_sum
from lodestar.plans.storage import written

DIM = 24
EDGE = 3  # lines at either end of a page that may be furniture or stand next to it
HYPHENS = "-­¬‐‑"
#: Confusions of glyphs, as read and as printed (fixed values); each also stands for its reverse.
CONFUSIONS = (("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("5", "s"), ("@", "a"), ("6", "b"), ("9", "g"), ("8", "b"), ("c", "e"), ("b", "h"), ("f", "t"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("h", "li"), ("vv", "w"), ("v", "y"), ("2", "z"), ("q", "g"), ("0", "c"), ("3", "e"), ("4", "a"), ("7", "t"), ("|", "l"), ("u", "n"), ("o", "c"))
WORD = re.compile(r"[\w@!|]*\w[\w@!|]*")
_BREAK = re.compile(rf"(?:^|[\s\W])?([\w@!|]*\w)[{HYPHENS}]$")
_LEAD = re.compile(r"[\w@!|]+")
ROMAN = re.compile(r"(?=[mdclxvi])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUM = r"(?:\d{1,10}|[ivxlc]{1,8}|[IVXLC]{1,8})"
_ALONE = re.compile(rf"(?P<d>[\[({{<~*•·=_\-–—\s]*|(?:page|seite|página|pagina|p|pp|pg|s|f|fol)\.?\s*|[-–—]\s*(?:page|p\.)\s*)(?P<n>{_NUM})(?P<e>[\])}}>~*•·=_.\-–—\s]*|\s*(?:/|of|von|de|sur)\s*\d{{1,10}}[\]\s)]*)", re.I)
_BEFORE = re.compile(rf"(?P<n>{_NUM})(?:\s{{2,}}|\s*[|•·–—]\s*|\t+)(?P<h>\S.*)")
_AFTER = re.compile(rf"(?P<h>.*\S)(?:(?:\s*[.·…_]{{2,}}\s*)|\s+(?:[|•·–—]\s*)?|\s+(?:p(?:age)?\.?\s*))(?P<n>{_NUM})")


def number(text: str) -> int | None:
    if text.isdigit():
        return int(text)
    if not ROMAN.fullmatch(text):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(values, values[1:] + [0]))


class Edge(NamedTuple):
    title: str | None  # what may be a running title, normalised
    number: int | None
    alone: bool
    decorated: bool


def edge(line: str) -> Edge:
    """What a line at the top or bottom of a page may be."""
    line = line.strip()
    m = _ALONE.fullmatch(line)
    if m and number(m["n"]) is not None:
        return Edge(None, number(m["n"]), True, bool(m["d"].strip() or m["e"].strip()))
    title, n = line, None
    m = _BEFORE.fullmatch(line)
    if m and number(m["n"]) is not None:
        title, n = m["h"], number(m["n"])
    else:
        m = _AFTER.fullmatch(line)
        if m and number(m["n"]) is not None and (m["n"].isdigit() or len(m["n"]) > 1):
            title, n = m["h"], number(m["n"])
    title = re.sub(r"\s+", " ", title).strip(" .·…_-–—|•")
    ok = 3 <= len(title) <= 90 and not re.search(r"[.!?;,:…]$", line) and bool(re.match(r"[\"'(«„]?(?:[A-ZÀ-ÞŒ]|\d|[@!|](?=\w))", title)) and any(c.isalpha() for c in title)
    return Edge(title.lower() if ok else None, n, False, False)


def words_of(line: str) -> list[str]:
    return [w.lower() for w in WORD.findall(line)]


def _split_word(token: str) -> str:
    """A word without sentence marks around it; the mark ! may be a letter within."""
    return token.rstrip("!|") if len(token.rstrip("!|")) > 1 else token.strip("!|")


def line_words(lines: list[str]) -> Iterator[tuple[list[str], list[str], tuple[str, str, str] | None, re.Match | None]]:
    """Of each line of a page its tokens, the words that stand whole in it, the word cut at the line before that ends in it
    (both halves and the mark), and the cut at its own end."""
    carry = None
    for k, line in enumerate(lines):
        tokens = line.split()
        low = [_split_word(w).lower() for t in tokens for w in WORD.findall(t)]
        cut = None
        if carry is not None:
            head = _LEAD.match(tokens[0])
            b = _split_word(head[0].lower()) if head else None
            if b:
                cut = (carry[0], b, carry[1])
                low = low[1:]
        m = _BREAK.search(tokens[-1])
        carry = (m[1].lower(), tokens[-1][-1]) if m and k + 1 < len(lines) else None
        yield tokens, low[:-1] if m else low, cut, m


def page_words(text: str | None) -> set[str]:
    """The words of a page, as ``_Reader`` counts them."""
    out: set[str] = set()
    for _, low, cut, _ in line_words([x for x in (text or "").split("\n") if x.strip()]):
        out.update(low)
        if cut:
            out.add(cut[0] + cut[1])
    return out


def _vector(word: str) -> np.ndarray:
    state = np.random.default_rng(zlib.crc32(word.encode()))
    return state.integers(0, 2, DIM, dtype=np.int8) * 2 - 1


SCAN = "type string, revision_id long, ordinal int, chunk_id long, page int, pos int, word string, second string, n long, alone boolean, decorated boolean, hyphen string, lines int, v array<float>"
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.float32())]
_NAMES = [x.strip().split()[0] for x in SCAN.split(",")]


class _Reader:
    """Reads the pages of one task. Rows: E edge lines, H words cut at line ends, F first and L last words of a page,
    W rare words and where they stand, V words with their counts and vectors, C words joined by a hyphen."""

    def __init__(self, common: float = 0.02) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.counts: np.ndarray = np.zeros(0, np.int64)
        self.sums = np.zeros((0, DIM), np.float32)
        self.random = np.zeros((0, DIM), np.int8)
        self.where: dict[int, list[int] | None] = {}
        self.compounds: Counter = Counter()
        self.pages, self.common = 0, common

    def id(self, word: str) -> int:
        i = self.ids.get(word)
        if i is None:
            i = self.ids[word] = len(self.words)
            self.words.append(word)
        return i

    def read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stream: list[int] = []
        gap = self.id("")
        for revision, ordinal, chunk, page, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = [x for x in (text or "").split("\n") if x.strip()]
            if not lines:
                continue
            self.pages += 1
            at = (revision, ordinal, chunk, page)
            n = len(lines)
            for k in sorted({*range(min(EDGE, n)), *range(max(0, n - EDGE), n)}):
                e = edge(lines[k])
                if e.title or e.number is not None:
                    rows.append(("E", *at, k, e.title, None, e.number, e.alone, e.decorated, None, n, None))
            seen: set[int] = set()
            for k, (tokens, low, cut, m) in enumerate(line_words(lines)):
                for t in tokens:
                    if "-" in t[1:-1]:
                        inner = [w.lower() for w in t.strip(".,;:!?()").split("-") if w]
                        self.compounds.update(f"{a}-{b}" for a, b in zip(inner, inner[1:]))
                head = _LEAD.match(tokens[0])
                if k < EDGE:
                    rows.append(("F", *at, k, head[0].lower() if head else None, None, None, None, None, None, n, None))
                if cut:  # the second half of a word cut at the line before
                    rows.append(("H", *at, k, cut[0], cut[1], None, None, None, cut[2], n, None))
                    joined = self.id(cut[0] + cut[1])
                    stream.append(joined)
                    seen.add(joined)
                if m and k >= n - EDGE:
                    rows.append(("L", *at, n - 1 - k, m[1].lower(), None, None, None, None, tokens[-1][-1], n, None))
                ids = [self.id(w) for w in low]
                stream += ids
                seen.update(ids)
            stream += [gap, gap]
            for i in seen:
                pages = self.where.setdefault(i, [])
                if pages is not None:
                    pages.append(self.pages - 1)
                    if len(pages) > max(1000, self.common * self.pages):
                        self.where[i] = None  # frequent words need no list; see misread_words
            self.ends.append((revision, ordinal, chunk, page))
        self._learn(np.array(stream, dtype=np.int64))
        yield self._batch(rows)

    ends: list[tuple]

    def _learn(self, stream: np.ndarray) -> None:
        n = len(self.words)
        if n > len(self.counts):
            more = n - len(self.counts)
            self.counts = np.concatenate([self.counts, np.zeros(more, np.int64)])
            self.sums = np.concatenate([self.sums, np.zeros((more, DIM), np.float32)])
            fresh = np.array([_vector(w) for w in self.words[n - more :]], dtype=np.int8).reshape(-1, DIM)
            self.random = np.concatenate([self.random, fresh])
            self.random[0] = 0  # the mark between pages
        if not len(stream):
            return
        r = self.random[stream].astype(np.int16)
        near = np.zeros_like(r)
        for d in (1, 2):
            near[d:] += r[:-d]
            near[:-d] += r[d:]
        order = np.argsort(stream, kind="stable")
        s = stream[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.sums[s[start]] += np.add.reduceat(near[order].astype(np.int32), start, axis=0)
        self.counts[s[start]] += np.diff(np.r_[start, len(s)])

    def rest(self) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        none = (None,) * 4
        for i, w in enumerate(self.words):
            if not w or not self.counts[i]:
                continue
            pages = self.where.get(i, [])
            often = pages is None or len(pages) > max(50, self.common * self.pages)
            rows.append(("V", *none, None, w, None, int(self.counts[i]), often, None, None, None, self.sums[i].tolist()))
            if not often and len(w) > 2:
                rows += [("W", *self.ends[p], None, w, None, None, None, None, None, None, None) for p in pages]
            if len(rows) > 20_000:
                yield self._batch(rows)
                rows = []
        rows += [("C", *none, None, w, None, n, None, None, None, None, None) for w, n in self.compounds.items()]
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def pages_of(chunks: DataFrame) -> DataFrame:
    """The ocr chunks, each once: ``revision_id, ordinal, chunk_id, page, text``."""
    rows = chunks.where("kind = 'ocr'").select("revision_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("id").alias("chunk_id"), F.col("locator.page").alias("page"), "text")
    return rows.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def scan(pages: DataFrame) -> DataFrame:
    """One pass over the pages (see ``_Reader``), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        reader.ends = []
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):  # bounds the arrays of one step
                yield from reader.read(batch.slice(first, 1000))
        yield from reader.rest()

    return written(pages.select("revision_id", "ordinal", "chunk_id", "page", "text").mapInArrow(run, SCAN), "scan")


def variants(word: str) -> set[str]:
    """How a printed word may be misread by one confusion."""
    out = set()
    for a, b in CONFUSIONS:
        for wrong, right in ((a, b), (b, a)):
            k = word.find(right)
            while k >= 0:
                out.add(word[:k] + wrong + word[k + len(right) :])
                k = word.find(right, k + 1)
    out.discard(word)
    return out


def corrections(scanned: DataFrame, least: int = 4, ratio: float = 4.0, alike: float = 0.3, much: float = 40.0) -> DataFrame:
    """``(wrong, right)``: rare words linked to the frequent neighbour by up to two confusions that fits their contexts best.

    A neighbour is at least ``ratio`` times and ``least`` times as frequent; words with a digit or sign among letters need no likeness
    of context, other words a cosine of ``alike`` between their skip-gram vectors; one confusion of a word ``much`` times as
    frequent only needs contexts that are not opposed, as the vector of a word seen a few times is mostly noise. Words shorter than three letters and
    words without letters are never wrong.
    """
    v = scanned.where("type = 'V'").groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)))
    v = written(v.select("word", "n", F.array(*(F.col(f"v{i}") for i in range(DIM))).alias("v")), "scan-words")
    mean = v.agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"m{i}") for i in range(DIM))).first()
    total = float(mean["n"] or 1)
    centre = F.array(*(F.lit(float(mean[f"m{i}"] or 0) / total) for i in range(DIM)))
    v = v.withColumn("u", F.zip_with(F.col("v"), centre, lambda a, m: a / F.col("n") - m))
    frequent = v.where((F.col("n") >= least) & (F.length("word") > 2) & ~F.col("word").rlike("[0-9@!|_]"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong, right = [], []
            for w in batch.column(0).to_pylist():
                one = variants(w)
                two = set().union(*(variants(x) for x in one)) - one - {w} if len(w) > 4 else set()
                for x in one:
                    wrong.append(x), right.append((w, 1))
                for x in two:
                    wrong.append(x), right.append((w, 2))
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string()), pa.array([r for r, _ in right], pa.string()), pa.array([k for _, k in right], pa.int32())], names=["wrong", "right", "edits"])

    near = frequent.select("word").mapInArrow(spread, "wrong string, right string, edits int")
    rare = v.where((F.length("word") > 2) & F.col("word").rlike(r"\p{L}")).select(F.col("word").alias("wrong"), F.col("n").alias("_n"), F.col("u").alias("_u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    linked = near.join(rare, "wrong").join(frequent.select(F.col("word").alias("right"), "n", "u"), "right").where(F.col("n") >= ratio * F.col("_n"))
    cosine = dot(F.col("u"), F.col("_u")) / F.sqrt(dot(F.col("u"), F.col("u")) * dot(F.col("_u"), F.col("_u")) + 1e-12)
    odd = F.col("wrong").rlike("[0-9@!|]")
    plain = (F.col("edits") == 1) & (F.length("wrong") > 3) & (F.col("n") >= much * F.col("_n")) & (F.col("_cos") > -alike)
    linked = linked.withColumn("_cos", cosine).where((odd & (F.col("edits") == 1)) | plain | (F.col("_cos") >= alike))
    best = F.max_by("right", F.struct(-F.col("edits"), F.col("_cos"), F.col("n"), "right")).alias("right")
    return written(linked.groupBy("wrong").agg(best), "scan-corrections")


def furniture(scanned: DataFrame, least: int = 3) -> DataFrame:
    """``(revision_id, ordinal, chunk_id, pos, lines, header, page_number)``: the lines of pages that are titles or page numbers.

    A title stands at the top or bottom of at least ``least`` pages of its revision and mostly close together (two or more among
    eight pages), which chance repeats of body lines in a long revision do not; a line that differs from a title of its
    revision by at most two letters (a tenth of a long one) is that title misread. A number is a page's if it stands alone with signs
    around it, or is the page's own, or has the same distance to it as on another page of the revision.
    """
    e = scanned.where("type = 'E'").select("revision_id", "ordinal", "chunk_id", "page", "pos", F.col("word").alias("title"), F.col("n").alias("number"), "alone", "decorated", "lines")
    e = e.withColumn("outer", F.least(F.col("pos"), F.col("lines") - 1 - F.col("pos")))
    e = e.where("outer < 2")
    t = e.where("title is not null")
    close = t.groupBy("revision_id", "title", F.floor(F.col("ordinal") / 8).alias("_b")).agg(F.count_distinct("chunk_id").alias("c"))
    titles = close.groupBy("revision_id", "title").agg(F.sum("c").alias("pages"), F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)).alias("near"))
    titles = written(titles.where((F.col("pages") >= least) & (F.col("near") >= F.greatest(F.lit(2), 0.3 * F.col("pages")))).select("revision_id", F.col("title").alias("known")), "scan-titles")
    lines = t.select("revision_id", "title").distinct()
    # a misread title keeps its beginning or its end
    some = []
    for cut in (F.substring("title", 1, 4), F.expr("right(title, 4)")):
        left = lines.withColumn("_k", cut)
        right = titles.withColumn("title", F.col("known")).withColumn("_k", cut).drop("title")
        near = F.levenshtein("title", "known") <= F.greatest(F.lit(2), F.floor(F.length("known") / 10))
        some.append(left.join(right, ["revision_id", "_k"]).where((F.abs(F.length("title") - F.length("known")) <= F.greatest(F.lit(2), F.floor(F.length("known") / 10))) & (F.length("known") >= 6) & near).select("revision_id", "title"))
    is_title = some[0].union(some[1]).union(titles.select("revision_id", F.col("known").alias("title"))).distinct().withColumn("header", F.lit(True))
    e = e.join(is_title, ["revision_id", "title"], "left").withColumn("header", F.coalesce("header", F.lit(False)))
    page = F.coalesce("page", F.col("ordinal") + 1)
    e = e.withColumn("_off", F.col("number") - page)
    like = e.where("number is not null and (alone or header)").groupBy("revision_id", "_off").agg(F.count_distinct("chunk_id").alias("_like"))
    e = e.join(like, ["revision_id", "_off"], "left")
    is_number = F.col("number").isNotNull() & (F.col("alone") | F.col("header")) & ((F.col("_off") == 0) | (F.col("_like") >= 2) | (F.col("alone") & F.col("decorated")))
    e = e.withColumn("page_number", F.coalesce(is_number, F.lit(False))).where("header or page_number")
    # an inner line is furniture only beside an outer one
    outer = e.groupBy("chunk_id").agg(F.max(F.col("pos") == 0).alias("_top"), F.max(F.col("pos") == F.col("lines") - 1).alias("_end"))
    e = e.join(outer, "chunk_id").where((F.col("pos") == 0) | (F.col("pos") == F.col("lines") - 1) | (F.col("_top") & (F.col("pos") == 1)) | (F.col("_end") & (F.col("pos") == F.col("lines") - 2)))
    return written(e.select("revision_id", "ordinal", "chunk_id", "pos", "lines", "header", "page_number"), "scan-furniture")


def cut_words(scanned: DataFrame, furniture_: DataFrame, fixes: DataFrame, least: int = 2) -> DataFrame:
    """``(chunk_id, pos, whole, kept)``: words cut at the end of a line or page, ``pos`` the line of the second half, -1 for the next page.

    ``kept``: the hyphen belongs to the word, as it stands within lines elsewhere; else the word is ``whole``, without it.
    """
    body = furniture_.groupBy(F.col("chunk_id").alias("_c")).agg(F.sum(F.when(F.col("pos") < 2, 1).otherwise(0)).cast("int").alias("_t"), F.sum(F.when((F.col("pos") >= 2) & (F.col("pos") >= F.col("lines") - 2), 1).otherwise(0)).cast("int").alias("_u"))
    marks = scanned.where("type in ('H', 'F', 'L')").join(body, F.col("chunk_id") == F.col("_c"), "left").na.fill({"_t": 0, "_u": 0}).drop("_c")
    inside = marks.where("type = 'H' and pos > _t and pos < lines - _u").select("chunk_id", "pos", F.col("word").alias("a"), F.col("second").alias("b"), "hyphen")
    ends = marks.where("type = 'L' and pos = _u").select("revision_id", F.col("ordinal").alias("_o"), "chunk_id", F.col("word").alias("a"), "hyphen")
    begins = marks.where("type = 'F' and pos = _t and word is not null").select("revision_id", (F.col("ordinal") - 1).alias("_o"), F.col("word").alias("b")).dropDuplicates(["revision_id", "_o"])
    over = ends.join(begins, ["revision_id", "_o"], "left").select("chunk_id", F.lit(-1).alias("pos"), "a", "b", "hyphen")
    pair = inside.unionByName(over).withColumn("whole", F.concat("a", F.coalesce("b", F.lit("")))).withColumn("both", F.concat_ws("-", "a", "b"))
    words = scanned.where("type = 'V'").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words.where(F.col("n") >= least), "scan-known")
    bound = scanned.where("type = 'C'").groupBy(F.col("word").alias("both")).agg(F.sum("n").alias("_both"))
    out = pair.join(bound, "both", "left")
    for c in ("whole", "a", "b"):
        out = out.join(words.select(F.col("word").alias(c), F.col("n").alias(f"_n_{c}")), c, "left")
    out = out.join(fixes.select(F.col("wrong").alias("whole"), "right"), "whole", "left")
    out = out.na.fill({"_both": 0, "_n_whole": 0, "_n_a": 0, "_n_b": 0})
    # the joined word was counted once for each time it is cut; it is known if it also stands uncut, or is a misread known word
    kept = F.when(F.col("_both") > 0, F.col("_both") >= F.col("_n_whole")).otherwise(False)
    return out.select("chunk_id", "pos", F.coalesce("right", "whole").alias("whole"), kept.alias("kept"))


def defects(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, defect)`` of the ocr chunks: hyphen, misread, running_header, page_number.

    Null and blank texts have no defects; pages delivered twice count once; a page without ``page`` counts as its ordinal + 1.
    """
    pages = pages_of(chunks)
    scanned = scan(pages)
    fixes = corrections(scanned)
    lines = furniture(scanned)
    cuts = cut_words(scanned, lines, fixes)
    wrong = misread_words(scanned, fixes, pages)
    parts = [
        cuts.where("not kept").select("chunk_id", F.lit("hyphen").alias("defect")),
        wrong.select("chunk_id", F.lit("misread").alias("defect")),
        lines.where("header").select("chunk_id", F.lit("running_header").alias("defect")),
        lines.where("page_number").select("chunk_id", F.lit("page_number").alias("defect")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def misread_words(scanned: DataFrame, fixes: DataFrame, pages: DataFrame) -> DataFrame:
    """``(chunk_id, wrong, right)``: where misread words stand."""
    found = scanned.where("type = 'W'").select("chunk_id", F.col("word").alias("wrong")).join(fixes, "wrong").select("chunk_id", "wrong", "right").distinct()
    # words that one task saw on many pages have no list of places there; should one be misread, the pages are read again
    listed = scanned.where("type = 'V' and alone").select(F.col("word").alias("wrong")).distinct().join(fixes, "wrong")
    listed = written(listed, "scan-often")
    if listed.isEmpty():
        return found

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                at, words = [], []
                for chunk, text in zip(*(c.to_pylist() for c in batch.slice(first, 1000).columns)):
                    own = page_words(text)
                    at += [chunk] * len(own)
                    words += own
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], names=["chunk_id", "wrong"])

    words = pages.select("chunk_id", "text").mapInArrow(again, "chunk_id long, wrong string")
    return found.unionByName(words.join(listed, "wrong").select("chunk_id", "wrong", "right")).distinct()


def paragraphs(chunks: DataFrame) -> DataFrame:
    """``(revision_id, paragraph, first_page, text)``: the repaired text of each revision in paragraphs, numbered from 0.

    Furniture is gone, cut words are whole, misread words corrected, lines joined; a paragraph goes on over a page unless the page
    before ends a sentence and the next begins a new one. Paragraph numbers run over blocks of 1,024 pages, so that a revision
    of any length is many tasks; a paragraph is put together from its own pieces only.
    """
    pages = pages_of(chunks)
    scanned = scan(pages)
    fixes = corrections(scanned)
    lines = furniture(scanned)
    cuts = cut_words(scanned, lines, fixes)
    drop = lines.groupBy(F.col("chunk_id").alias("_a")).agg(F.collect_set("pos").alias("drop"))
    kept = cuts.where("kept").groupBy(F.col("chunk_id").alias("_b")).agg(F.collect_set("pos").alias("kept"))
    wrong = misread_words(scanned, fixes, pages).groupBy(F.col("chunk_id").alias("_w")).agg(F.map_from_entries(F.collect_set(F.struct("wrong", "right"))).alias("wrong"))
    full = pages.join(drop, F.col("chunk_id") == F.col("_a"), "left").join(kept, F.col("chunk_id") == F.col("_b"), "left").join(wrong, F.col("chunk_id") == F.col("_w"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for revision, ordinal, text, gone, keep, bad in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (part, new) in enumerate(reflow(text or "", set(gone or ()), set(keep or ()), dict(bad or ()))):
                    for col, x in zip(out, (revision, ordinal, k, part, int(new))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()))], names=["revision_id", "ordinal", "k", "part", "new"])

    pieces = written(full.select("revision_id", "ordinal", "text", "drop", "kept", "wrong").mapInArrow(run, "revision_id long, ordinal int, k int, part string, new int"), "scan-pieces")
    numbered = running_sum(pieces, ["revision_id"], F.floor(F.col("ordinal") / 1024), ["ordinal", "k"], "new", "_before")
    numbered = numbered.withColumn("paragraph", F.col("_before") + F.col("new"))
    joined = numbered.groupBy("revision_id", "paragraph").agg(F.min("ordinal").alias("first_page"), F.array_sort(F.collect_list(F.struct("ordinal", "k", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), " ")
    # a word cut at the end of a page: its first half keeps the mark until both halves meet
    text = F.regexp_replace(F.regexp_replace(text, "­ ", ""), "­$", "-")
    return joined.select("revision_id", "paragraph", "first_page", text.alias("text"))


def reflow(text: str, gone: set[int], keep: set[int], wrong: dict[str, str]) -> list[tuple[str, bool]]:
    """The pieces of paragraphs of a page and whether each begins a paragraph; a word cut at the page's end ends in a soft hyphen."""
    out: list[tuple[list[str], bool]] = []
    k, fresh, last, cut_at = -1, False, "", None

    def fix(m: re.Match) -> str:
        own = _split_word(m[0])
        right = wrong.get(own.lower())
        if not right:
            return m[0]
        return (right.upper() if own.isupper() and len(own) > 1 else right.capitalize() if own[0].isupper() else right) + m[0][len(own) :]

    for line in text.split("\n"):
        if not line.strip():
            fresh = True
            continue
        k += 1
        if k in gone:
            continue
        line = " ".join(line.split())
        if cut_at is not None and out:
            out[-1][0][-1] += line if k not in keep else "-" + line
        elif not out:
            out.append(([line], bool(re.match(r"[\"'«„(]?[A-ZÀ-Þ]", line)) and fresh))
        elif fresh or (re.search(r"[.!?…][\"'»“)]*$", last) and len(last) < 0.7 * max(len(last), len(line))):
            out.append(([line], True))
        else:
            out[-1][0].append(line)
        fresh, last = False, line
        m = _BREAK.search(line.split()[-1])
        cut_at = k if m else None
        if m:
            out[-1][0][-1] = out[-1][0][-1][:-1]
    parts = [(WORD.sub(fix, " ".join(x)), new) for x, new in out]
    if cut_at is not None and parts:
        parts[-1] = (parts[-1][0] + ("-" if -1 in keep else "­"), parts[-1][1])
    return parts
