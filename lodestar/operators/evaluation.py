"""Retrieval measures over ranked results and judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_judgments(judgments: DataFrame) -> DataFrame:
    """Judgments with paths in one spelling; rows delivered twice, and rows without a grade, left out."""
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(?:\./+)+", "")
    return judgments.select("query_id", path.alias("path"), F.col("grade").cast("int").alias("grade"), "locator").where("grade is not null and path is not null").distinct()


def metrics(results: DataFrame, judgments: DataFrame, queries: DataFrame, k: int, relevant: int = 2) -> DataFrame:
    """Per query precision (over k), recall, hit rate, reciprocal rank and nDCG at ``k``.

    ``results``: ``query_id, path, rank`` with each path once per query; ``judgments``: ``query_id, path, grade``, the highest
    grade of a path counting. Relevant are paths of grade ``relevant``, gains come from all grades. Queries without judgments
    or results have zeros, ``answerable`` tells whether any path is relevant.
    """
    graded = judgments.groupBy("query_id", "path").agg(F.max("grade").alias("grade"))
    head = results.where(F.col("rank") <= k).join(graded, ["query_id", "path"], "left")
    hit = F.col("grade") == relevant
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)
    got = head.groupBy("query_id").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "path"))
    ideal = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_n") + 1.0))
    ideal = graded.withColumn("_n", place).where(F.col("_n") <= k).groupBy("query_id").agg(ideal.alias("idcg"))
    best = graded.groupBy("query_id").agg(F.count_if(hit).alias("relevant")).join(ideal, "query_id", "left")
    out = queries.select("query_id").distinct().join(got, "query_id", "left").join(best, "query_id", "left").na.fill({"hits": 0, "relevant": 0, "dcg": 0.0, "idcg": 0.0})
    return out.select(
        "query_id",
        (F.col("relevant") > 0).alias("answerable"),
        (F.col("hits") / k).alias("precision"),
        F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall"),
        (F.col("hits") > 0).cast("int").alias("hit_rate"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def span_matches(actual: Column, expected: Column, has: Sequence[str] = ("page", "line_start")) -> Column:
    """Whether a passage covers a judged span: equal slide, section and page, overlapping lines, times and characters.

    ``has``: the fields that the judged span's struct has. What is null in it is not asked for; an expected end defaults to its
    start; what a passage lacks does not match.
    """
    out = F.lit(True)
    for c in ("slide", "section", "page"):
        if c in has:
            out = out & (expected[c].isNull() | actual[c].eqNullSafe(expected[c]))
    for a, b in (("line_start", "line_end"), ("start_ms", "end_ms"), ("char_start", "char_end")):
        if a in has:
            end = F.coalesce(expected[b], expected[a])
            out = out & (expected[a].isNull() | F.coalesce((actual[a] <= end) & (actual[b] >= expected[a]), F.lit(False)))
    return out


def evidence_recall(shown: DataFrame, judgments: DataFrame, has: Sequence[str] = ("page", "line_start"), relevant: int = 2) -> DataFrame:
    """``(query_id, evidence_recall)``: the share of a query's judged spans that some evidence of the result at the judged path covers.

    ``shown``: ``query_id, path, locator`` of the evidence of results; ``judgments`` with ``grade`` and ``locator``. Only spans of the grade
    ``relevant`` count; queries without any have no row.
    """
    spans = judgments.where((F.col("grade") == relevant) & F.col("locator").isNotNull()).select("query_id", "path", F.col("locator").alias("_span")).distinct()
    met = spans.join(shown.select("query_id", "path", F.col("locator").alias("_own")), ["query_id", "path"], "left")
    hit = met.groupBy("query_id", "path", "_span").agg(F.max(F.coalesce(span_matches(F.col("_own"), F.col("_span"), has), F.lit(False))).alias("_hit"))
    return hit.groupBy("query_id").agg(F.avg(F.col("_hit").cast("double")).alias("evidence_recall"))


def summary(per_query: DataFrame, groups: list[str]) -> DataFrame:
    """Means over answerable queries and the false-positive rate of the others: overall and for each group on its own, in one pass.

    ``per_query`` has the measures, ``answerable``, ``returned`` and the columns ``groups``.
    """
    sets = [[], *[[g] for g in groups]]
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), F.col(c))), 6).alias(c)
    return per_query.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in groups]).agg(
        F.count("*").alias("queries"),
        F.count_if("answerable").alias("answerable"),
        *(mean(c) for c in ("precision", "recall", "hit_rate", "mrr", "ndcg")),
        F.round(F.avg(F.when(~F.col("answerable"), (F.col("returned") > 0).cast("double"))), 6).alias("false_positive_rate"),
    )


def latency(df: DataFrame, column: str, by: str) -> DataFrame:
    """Exact median and 95th percentile with linear interpolation."""
    c = F.col(column)
    return df.groupBy(by).agg(F.count(c).alias("n"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("p95"))
