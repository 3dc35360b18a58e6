"""Problem 1: splitting oversized items at natural boundaries.

Method: pointer doubling. Every token of an item is a possible start; each start is joined to its farthest legal end
and from there, minus the overlap, to the start of the next piece. Squaring that successor table (``jump = jump[jump]``)
marks every start of the greedy cut of all items of a batch in a logarithmic number of vector steps, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.prefix import running_sum

BLANKS = " \t\n\r"
TOKEN = re.compile(r"[^ \t\n\r]+")
SENTENCE_ENDS = re.compile(r"""[.!?…;:][)\]"'”’»]*$""")
#: Ends of pieces, best first: the end of a paragraph, of a sentence or line, of any token.
PARAGRAPH, LINE = 2, 1


def _tokens(text: str, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ranks of the boundary behind each token; tokens beyond ``longest`` characters are cut."""
    spans: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while b - a > longest:
            spans.append((a, a + longest))
            a += longest
        spans.append((a, b))
    if not spans:
        spans = [(a, min(a + longest, len(text))) for a in range(0, len(text), longest)]
    at = np.array(spans, dtype=np.int64).reshape(-1, 2)
    rank = np.zeros(len(at), dtype=np.int8)
    for i in range(len(at)):
        gap = text[at[i, 1] : at[i + 1, 0]] if i + 1 < len(at) else "\n\n"
        if gap.count("\n") >= 2:
            rank[i] = PARAGRAPH
        elif "\n" in gap or (gap and SENTENCE_ENDS.search(text[max(at[i, 0], at[i, 1] - 4) : at[i, 1]])):
            rank[i] = LINE
    return at[:, 0], at[:, 1], rank


def _farthest(n: int, marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each i the last marked j with low[i] <= j <= high[i], else -1."""
    last = np.full(n + 1, -1, dtype=np.int64)
    last[1:] = np.maximum.accumulate(np.where(marks, np.arange(n), -1))
    found = last[np.minimum(high, n - 1) + 1]
    return np.where(found >= low, found, -1)


def cut(texts: list[str], max_tokens: int, max_chars: int, overlap: int) -> list[list[tuple[int, int]]]:
    """Character spans of the pieces of each text, all texts at once by pointer doubling."""
    longest = max(1, max_chars // 2)
    starts, ends, ranks, first = [], [], [], [0]
    shift = 0
    shifts = []
    for text in texts:
        a, b, r = _tokens(text, longest)
        shifts.append(shift)
        starts.append(a + shift)
        ends.append(b + shift)
        ranks.append(r)
        first.append(first[-1] + len(a))
        shift += len(text) + 2 * max_chars  # no piece reaches from one text into the next
    n = first[-1]
    if not n:
        return [[] for _ in texts]
    start, end, rank = np.concatenate(starts), np.concatenate(ends), np.concatenate(ranks)
    item_last = np.repeat(np.array(first[1:]) - 1, np.diff(first))
    i = np.arange(n)
    high = np.minimum(np.minimum(i + max_tokens - 1, np.searchsorted(end, start + max_chars, side="right") - 1), item_last)
    # a piece must reach beyond the overlap with the one before, else the cut would stand still
    shared_chars = max_chars // 4
    low = np.minimum(np.maximum(i + overlap, np.searchsorted(end, start + shared_chars, side="right")), high)
    stop = high.copy()
    inner = high < item_last
    for wanted, least in ((LINE, low), (PARAGRAPH, np.maximum(low, i + (high - i) // 2))):
        best = _farthest(n, rank >= wanted, least, high)
        stop = np.where(inner & (best >= 0), best, stop)
    # the next start: the first boundary within the overlap, else the whole overlap, never at or before this start
    earliest = np.maximum(np.maximum(stop + 1 - overlap, np.searchsorted(start, end[stop] - shared_chars)), i + 1)
    earliest = np.minimum(earliest, stop + 1)
    opens = np.ones(n, dtype=bool)
    opens[1:] = rank[:-1] >= LINE
    upcoming = np.full(n + 1, n, dtype=np.int64)
    upcoming[:n] = np.minimum.accumulate(np.where(opens, i, n)[::-1])[::-1]
    natural = upcoming[np.minimum(earliest, n)]
    succ = np.where(natural <= stop, natural, earliest)
    succ = np.where(stop >= item_last, n, succ)
    reached = np.zeros(n + 1, dtype=bool)
    reached[np.array(first[:-1])[np.diff(first) > 0]] = True
    jump = np.append(succ, n)
    while True:
        before = reached.sum()
        reached[jump[np.flatnonzero(reached)]] = True
        if reached.sum() == before:
            break
        jump = jump[jump]
    heads = np.flatnonzero(reached[:n])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for t, h in zip(np.searchsorted(np.array(first), heads, side="right") - 1, heads):
        out[t].append((int(start[h]) - shifts[t], int(end[stop[h]]) - shifts[t]))
    return out


def split_items(items: DataFrame, key: str, text: str, max_tokens: int = 192, max_chars: int = 2000, overlap: int = 32) -> DataFrame:
    """One row ``(key, piece, piece_text, start, stop, first_line, last_line)`` per piece of each oversized item.

    ``items`` has unique ``key``; only items beyond a limit come out. ``start`` and ``stop`` are characters from the
    item's first; lines likewise from 0. A text of blanks alone is cut by characters. Null and empty texts give no row.
    A token longer than half of ``max_chars`` is cut by characters, as nothing natural divides it. Other columns of
    ``items`` are not read, so their names cannot clash.
    """
    if not 0 <= overlap < max_tokens or max_chars < 4:
        raise ValueError("0 <= overlap < max_tokens and max_chars >= 4 must hold")
    one = F.col(text)
    # 2 * max_tokens + 1 characters is the least that max_tokens + 1 tokens take: the pattern runs on few texts only
    many = (F.length(one) > 2 * max_tokens) & (F.length(F.regexp_replace(one, "[^ \t\n\r]+", "x")) - F.length(F.regexp_replace(F.regexp_replace(one, "[^ \t\n\r]+", "x"), "x", "")) > max_tokens)
    large = items.select(F.col(key).alias("_key"), one.alias("_text")).where((F.length(one) > max_chars) | many)
    schema = T.StructType(
        [
            T.StructField("_key", items.schema[key].dataType),
            *(T.StructField(c, T.IntegerType()) for c in ("piece", "start", "stop", "first_line", "last_line")),
            T.StructField("piece_text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at: list[int] = []
            cols: list[list] = [[] for _ in range(6)]
            for n, (whole, spans) in enumerate(zip(texts, cut(texts, max_tokens, max_chars, overlap))):
                line, seen = 0, 0
                for k, (a, b) in enumerate(spans):
                    line, seen = line + whole.count("\n", seen, a), a
                    at.append(n)
                    for col, value in zip(cols, (k, a, b, line, line + whole.count("\n", a, b), whole[a:b])):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=schema.names)

    return large.mapInArrow(run, schema).withColumnRenamed("_key", key)


def split_chunks(chunks: DataFrame, max_tokens: int = 192, max_chars: int = 2000, overlap: int = 32) -> DataFrame:
    """All chunks with the oversized ones as pieces: ``ordinal`` and the positions in ``locator`` carried on.

    Rows delivered twice (same ``id``) count once. ``chunk_id`` names the chunk a piece comes from, ``pieces`` how many it
    has. Chunks without ``locator`` keep none; a null ``char_start`` or ``line_start`` stays null. A chunk within the limits
    comes out as it is, with its new ``ordinal``. Ordinals run on over blocks of 1,024 ordinals, so that no revision, however
    large, is handled by one task. A row without ``id`` gets no ``ordinal``.
    """
    once = chunks.select("id", "revision_id", "ordinal", "kind", "text", "locator").dropDuplicates(["id"])
    pieces = split_items(once, "id", "text", max_tokens, max_chars, overlap)
    counts = pieces.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_pieces"))
    # only ids and ordinals travel to the numbering; the rows themselves stay where they were made single
    slim = once.select(F.col("id").alias("_key"), "revision_id", "ordinal")
    sized = slim.join(counts, F.col("_key") == F.col("_id"), "left").drop("_id").withColumn("pieces", F.coalesce(F.col("_pieces"), F.lit(1))).drop("_pieces")
    base = running_sum(sized, ["revision_id"], F.floor(F.col("ordinal") / 1024), ["ordinal", "_key"], "pieces", "_base").select("_key", "pieces", "_base")
    placed = once.join(base, F.col("id") == F.col("_key"), "left").join(pieces.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    loc = F.col("locator")
    moved = loc
    for name, value in (
        ("char_end", F.when(F.col("piece").isNotNull(), loc["char_start"] + F.col("stop")).otherwise(loc["char_end"])),
        ("char_start", F.when(F.col("piece").isNotNull(), loc["char_start"] + F.col("start")).otherwise(loc["char_start"])),
        ("line_end", F.when(F.col("piece").isNotNull(), loc["line_start"] + F.col("last_line")).otherwise(loc["line_end"])),
        ("line_start", F.when(F.col("piece").isNotNull(), loc["line_start"] + F.col("first_line")).otherwise(loc["line_start"])),
    ):
        moved = moved.withField(name, value)
    return placed.select(
        F.col("id").alias("chunk_id"),
        "revision_id",
        (F.col("_base") + F.coalesce(F.col("piece"), F.lit(0))).cast("int").alias("ordinal"),
        "kind",
        F.coalesce(F.col("piece_text"), F.col("text")).alias("text"),
        F.when(loc.isNotNull(), moved).alias("locator"),
        F.coalesce(F.col("piece"), F.lit(0)).alias("piece"),
        F.col("pieces").cast("int").alias("pieces"),
        F.col("piece").isNotNull().alias("oversized"),
    )
