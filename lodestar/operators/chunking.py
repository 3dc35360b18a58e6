"""Windows of tokens over texts, with their places in the source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\S+")


def stride_windows(documents: DataFrame, key: str, text: str, budget: int = 192, overlap: int = 32) -> DataFrame:
    """``(key, ordinal, tokens, first, last)`` of texts without paragraphs: windows of fixed stride, in the JVM.

    A text of blanks alone, empty or null has no window.
    """
    step = budget - overlap
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0)))
    counted = documents.select(key, n.alias("n")).where("n > 0")
    last = F.when(F.col("n") <= budget, 0).otherwise(F.ceil((F.col("n") - overlap) / step) - 1).cast("int")
    spread = counted.select(key, "n", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    first = F.col("ordinal") * step
    stop = F.least(first + budget, F.col("n"))
    return spread.select(key, "ordinal", (stop - first).alias("tokens"), first.alias("first"), (stop - 1).alias("last"))


def cut(text: str, budget: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans of windows of at most ``budget`` tokens that share ``overlap``; a paragraph's end in the last quarter ends one.

    Two tables over the tokens say it all: ``ends[i]``, the number of tokens up to the end of the window that begins at token i,
    and from it the next beginning, ``ends[i] - overlap``. The windows are the beginnings reached from token 0.
    """
    spans = np.array([m.span() for m in TOKEN.finditer(text)], dtype=np.int64).reshape(-1, 2)
    n = len(spans)
    if not n:
        return []
    begin = np.arange(n)
    full = np.minimum(begin + budget, n)
    # breaks[j]: the last token up to j that an empty line stands directly before
    parted = np.zeros(n, dtype=bool)
    parted[1:] = ["\n\n" in text[a:b] for a, b in zip(spans[:-1, 1].tolist(), spans[1:, 0].tolist())]
    breaks = np.maximum.accumulate(np.where(parted, begin, 0))
    last = breaks[full - 1]
    late = begin + (3 * (full - begin)) // 4
    ends = np.where((full < n) & (last > late), np.maximum(last, begin + overlap + 1), full)
    out, at = [], 0
    while True:
        stop = int(ends[at])
        out.append((int(spans[at, 0]), int(spans[stop - 1, 1])))
        if stop == n:
            return out
        at = stop - overlap


def chunk_units(units: DataFrame, key: str, budget: int = 192, overlap: int = 32) -> DataFrame:
    """``(key, unit, ordinal_in_unit, text, kind, char_start, char_end, line_start, line_end)`` of units.

    ``units``: ``key, unit, text, kind, char_start, line_start``. Pictures and frames pass as they are; blank units give nothing.
    Windows never join two units, and a window's text is an exact substring of its unit's.
    """
    if not 0 <= overlap < budget:
        raise ValueError("0 <= overlap < budget must hold")
    ints = ("ordinal_in_unit", "char_start", "char_end", "line_start", "line_end")
    schema = T.StructType([units.schema[key], T.StructField("unit", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in ints), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (unit, text, kind, base, line) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                text = text or ""
                if kind in ("image", "frame"):
                    at.append(i)
                    rows.append((unit, 0, base, None, line, line, kind, text))
                    continue
                for n, (a, b) in enumerate(cut(text, budget, overlap)):
                    at.append(i)
                    up = text.count("\n", 0, a)
                    first = None if line is None else line + up
                    rows.append((unit, n, None if line is None else (base or 0) + a, None if line is None else (base or 0) + b, first, None if line is None else first + text.count("\n", a, b), kind, text[a:b]))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return units.select(key, F.col("unit").cast("int"), "text", "kind", F.col("char_start").cast("int"), F.col("line_start").cast("int")).mapInArrow(run, schema)
