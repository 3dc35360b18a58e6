"""Problem 8: mixing sources to target weights.

Method: iterative proportional fitting. Token weights of the cells source x language x topic are raked to the marginals of
source (the targets), language and topic (as in the corpus); a cell's weight per document is how often its documents are
expected to be used, at most the source's ``max_repeats``. Documents are then drawn systematically by these probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import VOCABULARY, token_sizes
from lodestar.operators.prefix import running_sum
from lodestar.plans.storage import written

#: Values of ``modality`` in the catalogue (fixed values); anything else is raked as "other".
TOPICS = ("text", "document", "presentation", "code", "image", "audio", "video")


def source_key(name):
    """Names that differ in case, outer spaces and separators are one source."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def rake(cells: pd.DataFrame, total: float, turns: int = 200) -> pd.DataFrame:
    """Adds ``weight``: expected uses of each document of the cell.

    ``cells``: ``source, lang, topic, tokens, share, cap``, at most sources x languages x topics rows. A source that
    cannot reach its share is used to its cap; what it lacks is spread over the others in proportion to their shares, as
    far as their caps go, so that the size of the mixture stays ``total`` where that is possible.
    """
    tokens, cap = cells["tokens"].to_numpy(float), cells["cap"].to_numpy(float)
    source, lang, topic = (pd.factorize(cells[c])[0] for c in ("source", "lang", "topic"))
    most = np.bincount(source, tokens * cap)
    share = np.zeros(len(most))
    share[source] = cells["share"].to_numpy(float)
    goal = np.minimum(share * total, most)
    for _ in range(len(goal) + 1):  # water-filling: at least one more source reaches its cap each time
        short, open_ = total - goal.sum(), (goal < most * (1 - 1e-12)) & (share > 0)
        if short <= 1e-9 * total or not open_.any():
            break
        goal = np.where(open_, np.minimum(goal + short * share / share[open_].sum(), most), goal)
    used = np.where(cap > 0, 1.0, 0.0)
    goals = [(topic, np.bincount(topic, tokens) / max(tokens.sum(), 1) * goal.sum()), (lang, np.bincount(lang, tokens) / max(tokens.sum(), 1) * goal.sum())]
    for _ in range(turns):
        for of, wanted in goals:
            now = np.bincount(of, tokens * used)
            used = used * np.where(now > 0, wanted / np.maximum(now, 1e-300), 1.0)[of]
        for _ in range(20):  # the source marginal last and exactly, within the caps
            free = used < cap
            fixed = np.bincount(source, tokens * np.where(free, 0, cap))
            now = np.bincount(source, tokens * np.where(free, used, 0))
            scale = np.where(now > 0, (goal - fixed) / np.maximum(now, 1e-300), 1.0)
            used = np.where(free, np.maximum(used * scale[source], 0), cap)
            if (used <= cap * (1 + 1e-12)).all():
                break
            used = np.minimum(used, cap)
    return cells.assign(weight=np.clip(used, 0, cap))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The drawn documents ``(doc_id, source, tokens, copies)`` and the report, one row per source of ``targets``.

    Report: ``source, target_share, max_repeats, documents, tokens, reachable, mixed_tokens, actual_share``. Documents of no
    named source count in the total size but are not drawn; so are null and empty texts, of no tokens. Equal texts under
    several ids each count. Unknown languages are raked together. With no tokens at all every share is 0 and nothing is drawn.
    Copies are spread over hash buckets within size classes, so that a source with a third of all rows is many tasks.
    """
    goals = targets.select("source", source_key(F.col("source")).alias("_key"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropDuplicates(["_key"])
    base = documents.select(F.col("doc_id").cast("long"), "text", F.coalesce(source_key(F.col("source")), F.lit("")).alias("_key"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.coalesce(F.lower(F.trim("modality")), F.lit("")).alias("topic"))
    base = base.withColumn("lang", F.when(F.col("lang").rlike("^[a-z]{2}$"), F.col("lang")).otherwise("und")).withColumn("topic", F.when(F.col("topic").isin(*TOPICS), F.col("topic")).otherwise("other"))
    sized = written(token_sizes(base, "text", ["doc_id", "_key", "lang", "topic"], vocabulary), "mix-sizes")
    cells = sized.groupBy("_key", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    # the rows that come to the driver: named sources x two-letter languages x eight topics, whatever the number of documents
    rows = cells.join(goals, "_key").select(F.col("_key").alias("source"), "lang", "topic", "tokens", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("tokens > 0").toPandas()
    raked = rake(rows.fillna({"share": 0.0, "cap": 0}), float(total)) if len(rows) else rows.assign(weight=[])
    spark = documents.sparkSession
    weights = spark.createDataFrame([tuple(x) for x in raked[["source", "lang", "topic", "weight"]].itertuples(index=False)], "_key string, lang string, topic string, weight double")
    drawn = sized.where("tokens > 0").join(F.broadcast(weights), ["_key", "lang", "topic"])
    # systematic draw: the running sum of the weights passes a whole number as often as the document is used
    block = F.floor(F.log2(F.col("tokens").cast("double")) * 2) * 4096 + F.pmod(F.xxhash64("doc_id"), F.lit(4096))
    block = F.when(F.col("tokens") > 0, block)
    drawn = running_sum(drawn, ["_key"], block, ["doc_id"], "weight", "_before")
    drawn = drawn.withColumn("copies", (F.floor(F.col("_before") + F.col("weight") + 0.5) - F.floor(F.col("_before") + 0.5)).cast("int"))
    drawn = written(drawn.where("copies > 0").select("doc_id", "_key", "tokens", "copies"), "mix-drawn")
    mixed = drawn.groupBy("_key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    sizes = cells.groupBy("_key").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("documents"))
    report = goals.join(sizes, "_key", "left").join(mixed, "_key", "left").na.fill({"tokens": 0, "documents": 0, "mixed_tokens": 0})
    whole = drawn.agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all"))
    report = report.join(F.broadcast(whole), how="left").withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0)))
    report = report.withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("target_share") * F.lit(total))
    named = drawn.join(F.broadcast(goals.select("_key", "source")), "_key").select("doc_id", "source", "tokens", "copies")
    return named, report.select("source", "target_share", "max_repeats", "documents", "tokens", "reachable", "mixed_tokens", "actual_share")
