"""Problem 6: source files that do not parse; and the putting together of files from their chunks.

Method: chunks become lexer-state maps with bracket residues (see ``syntax``), which are reduced associatively, block by block
and then over the blocks of a file; what stays is parsed by the local grammar of the file's level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import syntax

#: Chunks of a file that are handled together; files are of any length.
BLOCK = 64


def blocks(code: DataFrame, keep: list[str], per_block: int = BLOCK, by_file: bool = False) -> DataFrame:
    """``(revision_id, block, *keep, pieces)``: the chunks of a block in order, without what they share with the one before.

    ``code`` has ``id, revision_id, ordinal, text, char_start, line_start`` and the columns ``keep``, equal for all chunks of a
    revision. ``pieces`` are ``(ordinal, text)``: a chunk's own text, led by the blanks between it and the chunk before,
    as the positions tell. Rows delivered twice count once. Without positions a chunk begins on a new line. The last chunk
    of the block before is also read. ``by_file``: all blocks of a file lie in one partition.
    """
    block = F.floor(F.col("ordinal") / per_block).cast("int")
    rows = code.select("id", "revision_id", F.col("ordinal").cast("int").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), "char_start", "line_start", *keep, block.alias("block"), F.lit(False).alias("ghost"))
    edge = rows.where(F.col("ordinal") % per_block == per_block - 1).withColumn("block", F.col("block") + 1).withColumn("ghost", F.lit(True))
    one = rows.unionByName(edge).repartition(*(["revision_id"] if by_file else ["revision_id", "block"])).dropDuplicates(["revision_id", "block", "ordinal", "id"])
    w = Window.partitionBy("revision_id", "block").orderBy("ordinal", "id")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    gap = F.col("char_start") - F.lag(F.col("char_start") + F.length("text")).over(w)
    down = F.greatest(F.lit(0), F.least(F.col("_gap"), F.coalesce(F.col("line_start") - F.col("_line"), F.lit(0))))
    one = one.withColumn("_gap", gap).withColumn("_line", F.lag(F.col("line_start") + lines).over(w)).withColumn("_first", F.lag("ordinal").over(w).isNull())
    own = (
        F.when(F.col("_first"), F.col("text"))
        .when(F.col("_gap").isNull(), F.concat(F.lit("\n"), "text"))
        .when(F.col("_gap") < 0, F.expr("substring(text, 1 - _gap)"))
        .otherwise(F.concat(F.repeat(F.lit("\n"), down.cast("int")), F.repeat(F.lit(" "), (F.col("_gap") - down).cast("int")), "text"))
    )
    one = one.withColumn("_own", own).where(~F.col("ghost"))
    return one.groupBy("revision_id", "block").agg(*(F.max(k).alias(k) for k in keep), F.array_sort(F.collect_list(F.struct("ordinal", "id", F.col("_own").alias("text")))).alias("pieces"))


def _pack(whole: dict) -> str:
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


def reduced(blocks_: DataFrame, chunks_most: int, fan: int = 64) -> DataFrame:
    """``(revision_id, language, valid)`` from blocks with ``language``; ``chunks_most`` is the highest number of chunks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, language, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                whole = None
                for k, p in enumerate(pieces):
                    part = syntax.summary(p["text"], language, not block and not k)
                    whole = part if whole is None else syntax.combine(whole, part, language)
                out.append(_pack(whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["revision_id", "block", "language", "whole"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for language, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                whole = None
                for p in parts:
                    part = {k: tuple(v) for k, v in json.loads(p["whole"]).items()}
                    whole = part if whole is None else syntax.combine(whole, part, language)
                out.append(_pack(whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["revision_id", "block", "language", "whole"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for language, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole = {k: tuple(v) for k, v in json.loads(text).items()}
                out.append(syntax.CODE in whole and syntax.valid(whole, language))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.bool_())], names=["revision_id", "language", "valid"])

    shape = "revision_id long, block int, language string, whole string"
    now = blocks_.select("revision_id", "block", "language", "pieces").mapInArrow(first, shape)
    left = -(-chunks_most // BLOCK)
    while left > 1:
        up = F.floor(F.col("block") / fan).cast("int")
        now = now.groupBy("revision_id", up.alias("block")).agg(F.max("language").alias("language"), F.array_sort(F.collect_list(F.struct("block", "whole"))).alias("parts"))
        now = now.select("revision_id", "block", "language", "parts").mapInArrow(further, shape)
        left = -(-left // fan)
    return now.select("revision_id", "language", "whole").mapInArrow(judge, "revision_id long, language string, valid boolean")


def verdicts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(file_id, root_id, language, valid)`` for each code file with an active revision and an extension of a known language.

    Null or unknown extensions have no row; a file whose active revision has no code chunk is empty, which is valid.
    ``error_code`` and ``parser`` are not read.
    """
    language = F.create_map(*(F.lit(x) for kv in syntax.LANGUAGES.items() for x in kv))[F.lower(F.regexp_replace("extension", r"^\.", ""))]
    live = files.where((F.col("modality") == "code") & F.col("active_revision_id").isNotNull()).select(F.col("id").alias("file_id"), "root_id", F.col("active_revision_id").alias("_active"), language.alias("language")).where("language is not null").dropDuplicates(["file_id"])
    code = chunks.where("kind = 'code'").select("id", "revision_id", "ordinal", "text", F.col("locator.char_start").alias("char_start"), F.col("locator.line_start").alias("line_start"))
    most = code.agg(F.max("ordinal")).first()[0]
    own = code.join(live.select("_active", "language").dropDuplicates(["_active"]), F.col("revision_id") == F.col("_active")).drop("_active")
    found = reduced(blocks(own, ["language"]), (most or 0) + 1)
    return live.join(found.select("revision_id", "valid"), F.col("_active") == F.col("revision_id"), "left").select("file_id", "root_id", "language", F.coalesce("valid", F.lit(True)).alias("valid"))


def rates(verdicts_: DataFrame) -> DataFrame:
    """``(root_id, language, files, invalid, share)``."""
    wrong = F.sum(F.when(~F.col("valid"), 1).otherwise(0))
    return verdicts_.groupBy("root_id", "language").agg(F.count("*").alias("files"), wrong.alias("invalid"), (wrong / F.count("*")).alias("share"))
