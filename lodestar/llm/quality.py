"""Problem 9: per-document text quality statistics.

Method: mergeable quantile sketches (KLL) of each statistic per language turn values into robust z-scores, and documents in a
tail of a distribution are flagged. What form a flagged document has is told block by block: the same sketches say how
few common words and letters a block may have, for its size, before it is junk; entries and rows are told by their lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.plans.storage import written

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MARKED = re.compile(r"^\s*(?:[-*+•◦‣▪–—]|\[[ xX]?\]|\(?(?:\d{1,4}|[A-Za-z]|[ivxlc]{1,6})[.)]|\d{1,3}(?:\.\d{1,3})+\.?)\s+(?=\S)")
HEADING = re.compile(r"^\s*#{1,6}\s+\S|^\s*(?:={3,}|-{3,}|\*{3,})\s*$")
SENTENCE_END = re.compile(r"[.!?…;:。][)\]\"'”’»]*\s*$")
RULE = re.compile(r"^[\s|+:=-]+$")
GAP = re.compile(r"\S(?:\t+| {2,})(?=\S)")
HEX_ROW = re.compile(r"^\s*[0-9a-fA-F]{4,16}:?(?:\s+[0-9a-fA-F]{2,8}){4,}(?:\s{2,}.*|\s+\|.*\|)?\s*$")
PROSE, LIST, TABLE, JUNK, NEUTRAL = "prose", "list", "table", "junk", "neutral"
#: The statistics that sketches are built of.
STATISTICS = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "marked_lines", "line_separators", "mean_line_words", "variety", "letter_ratio")
#: Robust z-scores beyond which a document is looked at and a block is junk.
TAIL, FENCE = 3.5, 3.5


def _endless(words: list[str], width: int = 8) -> bool:
    """Whether more than 0.6 of the windows of ``width`` words occur before; fewer than twice as many words: no."""
    n = len(words) - width + 1
    if n < width or len(set(words)) > 0.4 * n + width:  # so many different words make too many different windows
        return False
    return len(set(zip(*(words[i : n + i] for i in range(width))))) < 0.4 * n


def _cells(line: str) -> tuple[str, int]:
    """The separator by which a line may be a row of cells, and how often it stands there."""
    if line.count("|") >= 2:
        return "|", line.count("|")
    if "\t" in line:
        return "\t", line.count("\t")
    gaps = len(GAP.findall(line.strip()))
    if gaps:
        return " ", gaps
    for sep in ",;":
        n = line.count(sep)
        if n >= 2 and max(len(c.split()) for c in line.split(sep)) <= 4 and not re.search(sep + r"\s", line):
            return sep, n
    return "", 0


def _rows(lines: list[str]) -> list[bool]:
    """Which lines are rows: at least three in a run (rules and captions apart) with the same separator and like counts."""
    marks = [("", 0) if HEX_ROW.match(x) else _cells(x) for x in lines]
    out = [False] * len(lines)
    i = 0
    while i < len(lines):
        sep = marks[i][0]
        if not sep:
            i += 1
            continue
        j = i
        while j < len(lines) and (marks[j][0] == sep or (RULE.match(lines[j]) and lines[j].strip())):
            j += 1
        counts = Counter(marks[k][1] for k in range(i, j) if marks[k][0] == sep)
        most, n = counts.most_common(1)[0]
        # aligned columns with empty cells have fewer gaps; other separators are never left out
        fits = sum(v for k, v in counts.items() if (k <= most if sep == " " else k == most))
        if sum(counts.values()) >= 3 and fits >= 0.7 * sum(counts.values()):
            rows = [k for k in range(i, j) if marks[k][0] == sep]
            if sep != " " or sum(len(lines[k].split()) for k in rows) <= 4.5 * sum(marks[k][1] + 1 for k in rows):
                for k in range(i, j):
                    out[k] = True
        i = j
    for k, x in enumerate(lines):  # rules of boxes beside rows
        if RULE.match(x) and x.strip() and ("+" in x or "|" in x) and ((k and out[k - 1]) or (k + 1 < len(x) and k + 1 < len(lines) and out[k + 1])):
            out[k] = True
    return out


def _off(value: float, n: int, limits: tuple[float, float] | None) -> float:
    """How far a share over ``n`` items lies from its median, as a z-score of the language's distribution.

    ``limits``: median and robust spread. Two standard errors of a share over so few items are granted before, so that short
    blocks are not judged by chance. Without a distribution nothing is off.
    """
    if limits is None or not n:
        return 0.0
    median, spread = limits
    chance = 2 * (max(median * (1 - median), 0.0) / n) ** 0.5
    gap = value - median
    gap = max(0.0, abs(gap) - chance) * (1 if gap > 0 else -1)
    return gap / spread if spread > 0 else gap * float("inf") if gap else 0.0


def _is_junk(text: str, common: frozenset, usual: dict[str, tuple[float, float] | None]) -> bool:
    """Beyond FENCE in the language's distributions: too few common words, no words and too few letters, or one
    phrase without end."""
    words = WORD.findall(text.lower())
    n = len(words)
    if _endless(words):
        return True
    if n >= 8 and _off(sum(w in common for w in words) / n, n, usual["common_words"]) < -FENCE:
        return True
    solid = len(text) - sum(map(str.isspace, text))
    letters = sum(map(str.isalpha, text))
    return letters < 0.5 * solid and _off(letters / max(solid, 1), solid, usual["letter_ratio"]) < -FENCE


def _plain_block(lines: list[str], common: frozenset, usual: dict) -> str:
    """What lines without marks or cells are, that stand together without a blank line."""
    text = " ".join(lines)
    words = WORD.findall(text.lower())
    if len(lines) > 1:
        # in prose a line ends where a sentence does, or because the next word has no room at the width set: entries end anywhere
        width = max(map(len, lines))
        ends = sum(bool(SENTENCE_END.search(a)) or len(a.rstrip()) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:]))
        short = max(len(x.split()) for x in lines) <= 12 and len(words) <= 8 * len(lines) and max(map(len, text.split())) <= 40
        if ends < 0.8 * (len(lines) - 1) and short and sum(map(str.isalpha, text)) > 0.6 * sum(map(len, text.split())) and not _endless(words):
            return LIST
    if _is_junk(text, common, usual):
        return JUNK
    return PROSE if len(words) >= 4 or SENTENCE_END.search(text) else NEUTRAL


def kinds(text: str, common: frozenset, usual: dict, cells: bool = True, marks: bool = True, varied: bool = False) -> Counter:
    """The characters of a text, blanks apart, by kind of the block they stand in.

    Marked lines are entries, whatever they say; lines with the same separators are rows; what is left between blank lines is
    judged as a block. A caption or heading goes with what follows it, the last with what stands before. What the statistics
    rule out, marks of cells, marked lines or few different words, is not looked for.
    """
    every = text.splitlines()
    found: list[tuple[str, int]] = []
    block: list[str] = []

    def close() -> None:
        if block:
            found.append((_plain_block(block, common, usual), sum(len("".join(x.split())) for x in block)))
            block.clear()

    for line, row in zip(every, _rows(every) if cells else [False] * len(every)):
        size = len("".join(line.split()))
        if not size:
            close()
            continue
        mark = MARKED.match(line) if marks else None
        if row:
            close()
            found.append((TABLE, size))
        elif HEADING.match(line):
            close()
            found.append((NEUTRAL, size))
        elif mark and any(c.isalpha() for c in line[mark.end() :]) and not _is_junk(line[mark.end() :], common, usual):
            close()
            found.append((LIST, size))
        else:
            block.append(line)
    close()
    chars: Counter = Counter()
    for i, (kind, size) in enumerate(found):
        if kind == NEUTRAL:
            after = next((k for k, _ in found[i + 1 :] if k != NEUTRAL), None)
            kind = after or next((k for k, _ in reversed(found[:i]) if k != NEUTRAL), PROSE)
        chars[kind] += size
    if not varied and 2 * chars[TABLE] <= chars.total() and _endless(WORD.findall(text.lower()), 8):
        return Counter({JUNK: chars.total()})
    return chars


def word_lists(common_words: DataFrame) -> dict[str, frozenset]:
    """The common words by language: a short fixed list, read by the driver. Nulls are left out."""
    lists: dict[str, set] = {}
    for r in common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct().collect():
        if r.lang and r.word:
            lists.setdefault(r.lang, set()).add(r.word)
    return {k: frozenset(v) for k, v in sorted(lists.items())}


def _count(text: str, mark: str) -> Column:
    """How often ``mark`` stands in a column."""
    return F.floor((F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))) / len(mark))


def _hits(words: str, own: frozenset) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*sorted(own))))


def statistics(documents: DataFrame, commons: dict[str, frozenset], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``text`` and per document the language, ``words`` and each of STATISTICS, as expressions; one pass, no shuffle.

    The language is the one most of whose common words occur; with none, the declared one, else ``und``. Null and blank texts
    have zeros.
    """
    given = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lower(F.trim(F.col(lang))).alias("_lang"))
    body = F.col("text")
    out = given.withColumn("_solid", F.regexp_replace(body, r"[\s\p{Z}]+", "")).withColumn("_words", F.regexp_extract_all(F.lower(body), F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0)))
    out = out.withColumn("_lines", F.filter(F.split(F.translate(body, "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\n" * 9), "\n"), lambda x: F.trim(F.translate(x, "\t\xa0", "  ")) != ""))
    out = out.withColumn("words", F.size("_words").cast("long")).withColumn("_n", F.size("_lines")).withColumn("solid", F.length("_solid"))
    # words of any list first, so that each list is tried on few
    out = out.withColumn("_common", F.filter("_words", lambda w: w.isin(*sorted(frozenset().union(*commons.values()))))) if commons else out
    hits = [F.struct(_hits("_common", own).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("language")) for i, (name, own) in enumerate(commons.items())]
    declared = F.when(F.col("_lang").isin(*commons), F.col("_lang")).otherwise("und") if commons else F.lit("und")
    out = out.withColumn("_best", F.sort_array(F.array(*hits), False)[0] if hits else F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit("und").alias("language")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    out = out.withColumn("_letters", F.length(F.array_join("_words", "")))
    solid, n, lines, letters = F.col("solid"), F.col("words"), F.col("_n"), F.col("_letters")
    ends = F.filter("_lines", lambda x: F.right(F.rtrim(x, F.lit(" \t)]\"'”’»")), F.lit(1)).isin(*".!?…;:。"))
    marked = F.filter("_lines", lambda x: F.regexp_like(x, F.lit(r"^\s*(?:[-*+•◦‣▪–—]|\[[ xX]?\]|\(?(?:[0-9]{1,4}|[A-Za-z]|[ivxlc]{1,6})[.)]|[0-9]{1,3}(?:\.[0-9]{1,3})+\.?)\s+\S")))
    # marks that may part cells: bars, tabs, pairs of blanks, commas and semicolons with no blank behind
    cells = _count("text", "|") + _count("text", "\t") + _count("text", "  ") + _count("text", ",") - _count("text", ", ") + _count("text", ";") - _count("text", "; ")
    values = {
        "mean_word_length": share(letters, n),
        "symbol_ratio": share(F.length(F.regexp_replace(F.col("_solid"), r"\p{N}+", "")) - letters, solid),
        "punctuated_lines": share(F.size(ends), lines),
        "common_words": share(F.col("_best")["n"], n),
        "marked_lines": share(F.size(marked), lines),
        "line_separators": share(cells, lines),
        "mean_line_words": share(n, lines),
        # distinct words of so many, as the ratio of their logarithms, which hardly depends on the length of a text
        "variety": F.when(n > 1, F.log(F.size(F.array_distinct("_words")).cast("double")) / F.log(n.cast("double"))).otherwise(1.0),
        "letter_ratio": share(letters, solid),
    }
    language = F.when(F.col("_best")["n"] > 0, F.col("_best")["language"]).otherwise(declared)
    return out.select(key, "text", language.alias("language"), "words", "solid", *(c.alias(k) for k, c in values.items()))


def limits(stats: DataFrame) -> DataFrame:
    """Per language the quartiles of each statistic, from KLL sketches of all documents that have words, merged over the tasks.

    One row per language of the list of common words, and ``und``: the merged sketches of all documents, as documents whose
    language cannot be told would set no measure.
    """
    each = stats.where("words > 0").groupBy("language").agg(*(F.kll_sketch_agg_double(c).alias(f"_k_{c}") for c in STATISTICS))
    each = written(each, "quality-sketches")
    whole = each.groupBy(F.lit("und").alias("language")).agg(*(F.kll_merge_agg_double(f"_k_{c}").alias(f"_k_{c}") for c in STATISTICS))
    sketches = each.where("language <> 'und'").unionByName(whole)
    return sketches.select("language", *(F.expr(f"kll_sketch_get_quantile_double(_k_{c}, array(0.25D, 0.5D, 0.75D))").alias(f"_q_{c}") for c in STATISTICS))


def scored(stats: DataFrame, limits_: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds ``z_<statistic>``, the robust z-score within the language, and ``flagged``: some score beyond ``tail``.

    The spread is that of the narrower half of a distribution about its median: documents that are no prose widen one half of it.
    A statistic without spread within a language has the score 0 at the median and infinity elsewhere. A document without
    words is flagged. ``usual`` has median and spread of common words and letters, by which ``forms`` judges blocks.
    """
    out = stats.join(F.broadcast(limits_), "language", "left")  # one row per language
    beyond = F.lit(False)
    spread = lambda q: F.least(q[2] - q[1], q[1] - q[0]) / 0.6745
    for c in STATISTICS:
        q = F.col(f"_q_{c}")
        off = F.col(c) - q[1]
        z = F.when(off == 0, 0.0).when(spread(q) > 0, off / spread(q)).when(off.isNotNull(), F.signum(off) * F.lit(float("inf")))
        out = out.withColumn(f"z_{c}", F.coalesce(z, F.lit(0.0)))
        beyond = beyond | (F.abs(F.col(f"z_{c}")) > tail)
    pair = lambda c: F.array(F.col(f"_q_{c}")[1], spread(F.col(f"_q_{c}")))
    usual = F.when(F.col("_q_common_words").isNotNull(), F.concat(pair("common_words"), pair("letter_ratio")))
    return out.withColumn("usual", usual).drop(*(f"_q_{c}" for c in STATISTICS)).withColumn("flagged", beyond | (F.col("words") == 0))


def forms(scores: DataFrame, commons: dict[str, frozenset], key: str = "doc_id") -> DataFrame:
    """Adds ``form`` and the characters by kind: ``prose``, or of a flagged document most of whose characters are not prose the
    most frequent other kind. Documents within all tails are prose; only flagged texts cross to Python. Null and blank texts have no form.
    """
    names = ("prose_chars", "list_chars", "table_chars", "junk_chars")
    kept = [f for f in scores.schema.fields if f.name not in ("text", "usual", "solid")]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in names]
            read = ("text", "solid", "usual", "language", "words", "variety", "line_separators", "marked_lines")
            for text, solid, usual, language, words, variety, separators, marked in zip(*(batch.column(c).to_pylist() for c in read)):
                if text is None:
                    got = Counter({PROSE: solid})
                else:
                    known = None if usual is None else {"common_words": tuple(usual[:2]), "letter_ratio": tuple(usual[2:])}
                    got = kinds(text, commons.get(language, frozenset()), known or {"common_words": None, "letter_ratio": None}, separators > 0, marked > 0, words**variety > 0.4 * words + 9)
                for col, k in zip(cols, (PROSE, LIST, TABLE, JUNK)):
                    col.append(got[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    sent = scores.withColumn("text", F.when(F.col("flagged") & (F.col("solid") > 0), F.col("text")))
    out = sent.select(*(f.name for f in kept), "text", "usual", "solid").mapInArrow(run, schema)
    parts = ("list", "table", "junk")
    rest = sum((F.col(f"{p}_chars") for p in parts[1:]), F.col("list_chars"))
    most = F.greatest(*(F.col(f"{p}_chars") for p in parts))
    other = F.when(F.col("table_chars") == most, TABLE).when(F.col("list_chars") == most, LIST).otherwise(JUNK)
    return out.withColumn("form", F.when(rest > F.col("prose_chars"), other).when(F.col("words") + rest > 0, PROSE))


def assess(documents: DataFrame, common_words: DataFrame, tail: float = TAIL) -> DataFrame:
    """Statistics, scores, flags and forms of all documents. Texts and statistics are written once, so that neither is
    made again when the sketches are known."""
    commons = word_lists(common_words)
    stats = written(statistics(documents, commons), "quality")
    return forms(scored(stats, written(limits(stats), "quality-limits"), tail), commons)
