"""Ranked term search: postings, corpus statistics and BM25 over four weighted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import index_tokens, query_terms, split_identifiers
from lodestar.operators.catalog import once
from lodestar.plans.storage import written

FIELDS = ("text", "name", "path", "symbol")


def indexed_rows(chunks: DataFrame, revisions: DataFrame, files: DataFrame) -> DataFrame:
    """All index rows: every chunk of a file's active revision, whether or not the file is ready.

    Code is indexed with its names split as well, which counts its terms twice.
    """
    own = once(chunks.select("id", "revision_id", "kind", "text", "symbol"))
    held = files.where("active_revision_id is not null").select(F.col("active_revision_id").alias("revision_id"), "name", F.col("relative_path").alias("path"))
    text = F.when(F.col("kind") == "code", F.concat_ws(" ", "text", split_identifiers(F.col("text")))).otherwise(F.coalesce("text", F.lit("")))
    return own.join(held, "revision_id").select(F.col("id").alias("chunk_id"), text.alias("text"), "name", "path", split_identifiers(F.coalesce("symbol", F.lit(""))).alias("symbol"))


def postings(rows: DataFrame, weights: tuple[int, int, int, int] = (1, 3, 1, 4)) -> DataFrame:
    """``(term, chunk_id, f, n, dl)``: weighted and plain frequency of a term in a row, and the row's plain length.

    The length is counted before the terms are spread, so one shuffle builds all.
    """
    tokens = rows.select("chunk_id", *(index_tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FIELDS))
    tokens = tokens.withColumn("dl", sum((F.size(c) for c in FIELDS[1:]), F.size(FIELDS[0])))
    def weighted(c: str, w: int) -> Column:
        return F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    marked = F.concat(*(weighted(c, w) for c, w in zip(FIELDS, weights)))
    spread = tokens.select("chunk_id", "dl", F.explode(marked).alias("t"))
    return spread.groupBy(F.col("t.term").alias("term"), "chunk_id", "dl").agg(F.sum("t.w").alias("f"), F.count("*").alias("n"))


def corpus_stats(rows: DataFrame, postings_: DataFrame) -> DataFrame:
    """One row: number of index rows, of tokens, and mean length. The texts are not split again: the postings have counted them."""
    counted = rows.agg(F.count("*").alias("rows"))
    total = postings_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    mean = F.when(F.col("rows") > 0, F.col("tokens") / F.col("rows"))
    return counted.crossJoin(total).select("rows", "tokens", mean.alias("mean_length"))  # two tables of one row


def terms_of(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """``(query_id, term, terms)``: one row per term of each query, folded as the index is."""
    spread = queries.select(key, query_terms(F.col(text)).alias("ts")).select(key, F.size("ts").alias("terms"), F.explode("ts").alias("t"))
    folded = spread.select(key, "terms", F.explode(index_tokens(F.col("t"))).alias("term"))
    return folded.distinct()


def bm25(terms: DataFrame, postings_: DataFrame, stats: DataFrame, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, key: str = "query_id", per_salt: int = 250_000) -> DataFrame:
    """``(query_id, chunk_id, score, matched)``; lower is better. Statistics are of all index rows, whatever is eligible.

    ``allowed``: ``chunk_id`` and, if ``terms`` has a ``scope``, the row's own ``_own``; rows that are not eligible leave before anything is
    scored. A term in half of the rows or more keeps a small positive weight. Terms that no row has add nothing. A term that
    stands in very many rows is met in as many salted parts as the index has ``per_salt`` rows.
    """
    one = stats.first()  # one row
    salts = max(1, -(-int(one["rows"] or 0) // per_salt))
    wanted = postings_.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log((F.lit(one["rows"]) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    scoped = "scope" in terms.columns
    asked = terms.join(df, "term").select(key, "term", *(["scope"] if scoped else []), F.when(idf <= 0, 1e-6).otherwise(idf).alias("_idf"))
    asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if allowed is not None:
        wanted = wanted.join(allowed.select("chunk_id", "_own"), "chunk_id") if scoped else wanted.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    part = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.lit(float(one["mean_length"] or 1.0))))
    wanted = wanted.select("term", "chunk_id", *(["_own"] if scoped and allowed is not None else []), part.alias("_part"), F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int").alias("_salt"))
    hits = wanted.join(asked, ["term", "_salt"])
    if scoped and allowed is not None:
        hits = hits.where(F.col("scope").isNull() | (F.col("scope") == F.col("_own")))
    return hits.groupBy(key, "chunk_id").agg(F.round(-F.sum(F.col("_idf") * F.col("_part")), 9).alias("score"), F.count("*").alias("matched"))


def top(scored: DataFrame, k: int, key: str = "query_id", item: str = "chunk_id", best_first: str = "asc") -> DataFrame:
    """The k best per query with ``rank`` from 1; ties by id."""
    order = F.col("score").asc() if best_first == "asc" else F.col("score").desc()
    w = Window.partitionBy(key).orderBy(order, item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def classes(terms: DataFrame, scopes: DataFrame | None = None, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Queries of equal terms (and equal ``scope``) are one question: ``(query_id, class_id)`` and the terms of each class.

    A batch of searches repeats itself; each different question is scored once. ``class_id`` is the lowest id.
    """
    sets = terms.groupBy(key).agg(F.sort_array(F.collect_set("term")).alias("_ts"))
    sets = sets.withColumn("scope", F.lit(None).cast("string")) if scopes is None else sets.join(scopes.select(key, "scope"), key)
    sets = written(sets, "question-sets")
    lowest = sets.groupBy("_ts", "scope").agg(F.min(key).alias("class_id"))
    same = lowest.withColumnRenamed("_ts", "_t").withColumnRenamed("scope", "_s")
    members = sets.join(same, (F.col("_ts") == F.col("_t")) & F.col("scope").eqNullSafe(F.col("_s"))).select("class_id", "scope", key)
    return members, lowest.select(F.col("class_id").alias(key), "scope", F.explode("_ts").alias("term"))


def answers(queries: DataFrame, postings_: DataFrame, stats: DataFrame, allowed: DataFrame, k: int, scopes: DataFrame | None = None, order: str = "score", key: str = "query_id") -> DataFrame:
    """``(query_id, chunk_id, score, matched, rank)``: the k best eligible rows of each query by ``order`` (score or number of terms).

    ``allowed``: ``chunk_id`` and, with ``scopes`` (``query_id, scope``), its ``scope``; a null scope of a query allows all.
    """
    members, asked = classes(terms_of(queries), scopes)
    if scopes is None:
        hits = bm25(asked.select(key, "term"), postings_, stats, allowed)
    else:
        hits = bm25(asked, postings_, stats, allowed.select("chunk_id", F.col("scope").alias("_own")))
    by = hits if order == "score" else hits.withColumn("_s", F.col("score")).withColumn("score", -F.col("matched"))
    best = top(by, k)
    best = best if order == "score" else best.withColumn("score", F.col("_s")).drop("_s")
    best = best.withColumnRenamed(key, "class_id")
    return members.select("class_id", key).join(best, "class_id").drop("class_id")
