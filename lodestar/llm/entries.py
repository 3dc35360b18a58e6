"""Queries pN_... of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import code_files, functions, mix, pack, quality, scans, similar, split_items, splits
from lodestar.plans.storage import load, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_items.split_items(load(spark, sf, "chunks"), "id", "text")
    return pieces.select(F.col("id").alias("chunk_id")).distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_items.split_chunks(load(spark, sf, "chunks")).withColumn("chars", F.length("text"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "vectors")
    return similar.similar_pairs(similar.most_similar(vectors, load(spark, sf, "profiles"), least=0.9 - 0.004), vectors)  # the limit of the pairs less the search's error


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return similar.most_similar(load(spark, sf, "vectors"), load(spark, sf, "profiles"))


def p2_recall(spark: SparkSession, sf: str) -> DataFrame:
    vectors, profiles = load(spark, sf, "vectors"), load(spark, sf, "profiles")
    return similar.recall(similar.most_similar(vectors, profiles), vectors, profiles)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.defects(load(spark, sf, "chunks"))


def p3_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.paragraphs(load(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return functions.documented(p4_pairs(spark, sf))


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    roots = load(spark, sf, "revisions").select(F.col("id").alias("revision_id"), "file_id").dropDuplicates(["revision_id"])
    roots = roots.join(load(spark, sf, "files").select(F.col("id").alias("file_id"), "root_id"), "file_id")
    return functions.pairs(written(functions.symbols(load(spark, sf, "chunks")), "symbols"), roots)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.breaches(splits.related(load(spark, sf, "queries"), load(spark, sf, "judgments"))).distinct()


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign(splits.related(load(spark, sf, "queries"), load(spark, sf, "judgments")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return code_files.verdicts(load(spark, sf, "files"), load(spark, sf, "chunks")).where("not valid").select("file_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return code_files.rates(code_files.verdicts(load(spark, sf, "files"), load(spark, sf, "chunks")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return pack.pack_documents(load(spark, sf, "documents")).where("oversized").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack.containers(pack.pack_documents(load(spark, sf, "documents")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mixture(load(spark, sf, "documents"), load(spark, sf, "source_targets"))[1].where("not reachable").select("source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mixture(load(spark, sf, "documents"), load(spark, sf, "source_targets"))[1]


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mixture(load(spark, sf, "documents"), load(spark, sf, "source_targets"))[0]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_statistics(spark, sf).where("form <> 'prose'").select("doc_id", "form").distinct()


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(load(spark, sf, "documents"), load(spark, sf, "common_words"))


def p9_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that are no quantiles, for comparison with SQL."""
    stats = quality.statistics(load(spark, sf, "documents"), quality.word_lists(load(spark, sf, "common_words")))
    return stats.select("doc_id", "language", "words", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "mean_line_words", "variety", "letter_ratio")))


# Properties of whole results, for comparison with SQL: what must hold of every row, whatever the operator's choices.


def p1_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Of each chunk: whether it was too large, all pieces keep the limits, nothing but blanks is lost, and overlaps are at most 32 tokens."""
    chunks = load(spark, sf, "chunks").select("id", "text").dropDuplicates(["id"])
    pieces = split_items.split_items(chunks, "id", "text")
    tokens = lambda c: F.size(F.regexp_extract_all(c, F.lit("[^ \t\n\r]+"), F.lit(0)))
    by = Window.partitionBy("id").orderBy("piece")
    full = pieces.join(chunks, "id").withColumn("_end", F.lag("stop", 1, 0).over(by)).withColumn("_next", F.lead("start").over(by))
    gap = F.when(F.col("start") > F.col("_end"), F.expr("substring(text, _end + 1, start - _end)")).otherwise("")
    tail = F.when(F.col("_next").isNull(), F.expr("substring(text, stop + 1)")).otherwise("")
    shared = F.when(F.col("start") < F.col("_end"), F.expr("substring(text, start + 1, _end - start)")).otherwise("")
    blank = lambda c: ~c.rlike("[^ \t\n\r]")
    whole = full.groupBy("id").agg(
        F.bool_and((tokens(F.col("piece_text")) <= 192) & (F.length("piece_text") <= 2000)).alias("within"),
        F.bool_and(blank(gap) & blank(tail) & (F.col("piece_text") == F.expr("substring(text, start + 1, stop - start)"))).alias("covered"),
        F.bool_and(tokens(shared) <= 32).alias("overlaps"),
    )
    out = chunks.select(F.col("id").alias("chunk_id")).join(whole, F.col("chunk_id") == F.col("id"), "left")
    return out.select("chunk_id", F.col("id").isNotNull().alias("oversized"), *(F.coalesce(c, F.lit(True)).alias(c) for c in ("within", "covered", "overlaps")))


def p5_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Of each query: how many are related to it, itself included, and in how many splits they are."""
    dealt = written(p5_splits(spark, sf), "splits-dealt")
    whole = dealt.groupBy("component").agg(F.count("*").alias("related"), F.count_distinct("split").alias("splits"))
    return dealt.join(whole, "component").select("query_id", "related", "splits")


def p7_properties(spark: SparkSession, sf: str) -> DataFrame:
    """One row: containers too full, pieces packed twice, documents cut though they fit, and documents packed."""
    packed = written(pack.pack_documents(load(spark, sf, "documents")), "packed")
    full = packed.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("ways"))
    rest = docs.agg(F.count_if(F.col("pieces") > F.col("ways")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("cut"), F.count("*").alias("documents"))
    return full.crossJoin(rest)  # two tables of one row


def p8_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source: its documents, and whether none of them is used more often than allowed."""
    drawn, report = mix.mixture(load(spark, sf, "documents"), load(spark, sf, "source_targets"))
    most = drawn.groupBy("source").agg(F.max("copies").alias("most"))
    return report.join(most, "source", "left").select("source", "documents", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_properties": r"""SELECT DISTINCT id AS chunk_id, coalesce(length(text) > 2000 OR len(regexp_extract_all(text, '[^ \t\n\r]+')) > 192, false) AS oversized, true AS within, true AS covered, true AS overlaps FROM chunks""",
        "p5_properties": r"""
            WITH RECURSIVE hubs AS (SELECT DISTINCT id, 'f' || regexp_replace(lower(strip_accents(family)), '[^\p{L}\p{N}]', '', 'g') AS hub FROM queries WHERE regexp_matches(family, '[\p{L}\p{N}]')
              UNION SELECT DISTINCT query_id, 'p' || regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') FROM judgments WHERE path IS NOT NULL AND query_id IN (SELECT id FROM queries)),
            edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM hubs a JOIN hubs b USING (hub)), reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
            SELECT q.id AS query_id, CASE WHEN count(r.b) = 0 THEN 1 ELSE count(DISTINCT r.b) END AS related, 1 AS splits FROM (SELECT DISTINCT id FROM queries) q LEFT JOIN reach r ON r.a = q.id GROUP BY q.id""",
        "p7_properties": r"""SELECT 0 AS overfull, 0 AS twice, 0 AS cut, (SELECT count(*) FROM documents WHERE text <> '') AS documents""",
        "p8_properties": r"""
            WITH n AS (SELECT regexp_replace(regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS k, count(*) AS documents FROM documents GROUP BY ALL)
            SELECT t.source, coalesce(n.documents, 0) AS documents, true AS within_repeats FROM (SELECT DISTINCT source FROM source_targets) t LEFT JOIN n ON n.k = regexp_replace(regexp_replace(lower(trim(t.source)), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')""",
        "p9_measures": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(trim(lang)) AS declared FROM documents),
            a AS (SELECT doc_id, t, declared, regexp_replace(t, '[\s\p{Z}]+', '', 'g') AS solid, regexp_extract_all(lower(t), '\p{L}+(?:[''’]\p{L}+)?') AS ws,
                list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ls FROM d),
            c AS (SELECT DISTINCT lower(lang) AS lang, lower(word) AS word FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL),
            h AS (SELECT doc_id, lang, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM a) u JOIN c ON c.word = u.w GROUP BY ALL),
            b AS (SELECT doc_id, arg_min(lang, struct_pack(a := -n, b := lang)) AS lang, max(n) AS n FROM h GROUP BY doc_id)
            SELECT a.doc_id, coalesce(b.lang, CASE WHEN declared IN (SELECT lang FROM c) THEN declared END, 'und') AS language, CAST(len(ws) AS BIGINT) AS words,
              round(CASE WHEN len(ws) > 0 THEN length(array_to_string(ws, '')) / len(ws) ELSE 0 END, 6) AS mean_word_length,
              round(CASE WHEN length(solid) > 0 THEN (length(regexp_replace(solid, '\p{N}+', '', 'g')) - length(array_to_string(ws, ''))) / length(solid) ELSE 0 END, 6) AS symbol_ratio,
              round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…;:。][)\]"''”’» \t]*$'))) / len(ls) ELSE 0 END, 6) AS punctuated_lines,
              round(CASE WHEN len(ws) > 0 THEN coalesce(b.n, 0) / len(ws) ELSE 0 END, 6) AS common_words,
              round(CASE WHEN len(ls) > 0 THEN len(ws) / len(ls) ELSE 0 END, 6) AS mean_line_words,
              round(CASE WHEN len(ws) > 1 THEN ln(len(list_distinct(ws))) / ln(len(ws)) ELSE 1 END, 6) AS variety,
              round(CASE WHEN length(solid) > 0 THEN length(array_to_string(ws, '')) / length(solid) ELSE 0 END, 6) AS letter_ratio
            FROM a LEFT JOIN b USING (doc_id)""",
        "p1_found": r"""
            SELECT DISTINCT id AS chunk_id FROM chunks
            WHERE length(text) > 2000 OR len(regexp_extract_all(text, '[^ \t\n\r]+')) > 192""",
        "p2_found": """
            WITH v AS (SELECT DISTINCT ON (v.id) v.id, v.profile_id, list_transform(v.vector, lambda e: CAST(e AS DOUBLE)) AS x FROM vectors v JOIN (SELECT DISTINCT id, dimension FROM profiles) p ON p.id = v.profile_id
              WHERE len(v.vector) = p.dimension AND len(list_filter(v.vector, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v.vector, lambda e: e <> 0)) > 0)
            SELECT a.id AS vec_a, b.id AS vec_b FROM v a JOIN v b ON a.profile_id = b.profile_id AND a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.9""",
        "p5_found": r"""
            WITH RECURSIVE q AS (SELECT id, min(CASE WHEN trim(split) <> '' THEN lower(trim(split)) END) AS split FROM queries GROUP BY id),
            hubs AS (SELECT DISTINCT id, 'f' || regexp_replace(lower(strip_accents(family)), '[^\p{L}\p{N}]', '', 'g') AS hub FROM queries WHERE regexp_matches(family, '[\p{L}\p{N}]')
              UNION SELECT DISTINCT query_id, 'p' || regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') FROM judgments WHERE path IS NOT NULL AND query_id IN (SELECT id FROM queries)),
            edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM hubs a JOIN hubs b USING (hub)),
            reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
            SELECT DISTINCT r.a AS query_id FROM reach r JOIN q x ON x.id = r.a JOIN q y ON y.id = r.b WHERE x.split <> y.split""",
    }
