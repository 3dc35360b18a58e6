"""Batched search: filters, branches, floors, fusion, grouping, evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.numeric import hashed_vector, vector_state
from lodestar.functions.text import TOKEN, all_matches, location_label, query_terms, snippet
from lodestar.operators import catalog, fusion, lexical, vectors
from lodestar.plans.storage import load, written
from lodestar.schema import Settings


def term_share(query: Column, text: Column) -> Column:
    """The offline reranker: the share of a query's terms that a passage has."""
    terms = query_terms(query)
    return F.size(F.array_intersect(terms, query_terms(text))) / F.greatest(F.size(terms), F.lit(1))


@dataclass
class Index:
    """What a batch of searches reads: live chunks and files, postings of all rows, statistics, vectors of live chunks.

    Models are seams: ``encode_text`` and ``encode_vision`` make a query's vector for ``vectors`` and ``pictures``, ``score`` tells how well a
    passage fits a query. Those given are deterministic and need no files.
    """

    chunks: DataFrame
    files: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame
    pictures: DataFrame | None = None
    encode_text: Callable[[Column], Column] = hashed_vector
    encode_vision: Callable[[Column], Column] = partial(hashed_vector, dimension=64)
    score: Callable[[Column, Column], Column] = term_share


MODES, CHANNELS = ("lexical", "semantic", "hybrid"), ("all", "text", "vision")


@dataclass(frozen=True)
class Request:
    """How a batch of queries is answered. ``filters`` are those of ``catalog.filters``; they apply before any best are taken."""

    mode: str = "hybrid"
    channels: str = "all"
    rerank: bool = False
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.channels not in CHANNELS:
            raise ValueError(f"mode must be one of {MODES}, channels one of {CHANNELS}")


_built: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def terms_index(spark: SparkSession, sf_dir: str, weights: tuple[int, int, int, int] = Settings.field_weights) -> tuple[DataFrame, DataFrame]:
    """``(postings, statistics)`` of a catalogue, written once per application and shared by its searches.

    The tables they are made from are known by path and time of change, so a catalogue that is written anew is indexed anew.
    """
    jvm = spark._jvm
    stamps = []
    for table in ("chunks", "revisions", "files"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps.append((table, status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, sf_dir, weights, *stamps)
    if key not in _built:
        rows = lexical.indexed_rows(*(load(spark, sf_dir, t) for t in ("chunks", "revisions", "files")))
        posts = written(lexical.postings(rows, weights), "postings")
        _built[key] = posts, written(lexical.corpus_stats(rows, posts), "stats")
    return _built[key]


def build(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> Index:
    """The index of a catalogue, its parts written once; vectors are those of the offline encoder."""
    s = settings or Settings()
    files, revisions, roots, chunks = (load(spark, sf_dir, t) for t in ("files", "revisions", "roots", "chunks"))
    live = catalog.live_files(files, revisions, roots)
    own = written(catalog.live_chunks(chunks, live), "live-chunks")
    notes = catalog.once(revisions.select("id", "warnings")).withColumnRenamed("id", "active_revision_id")
    held = fusion.content_classes(live).select("file_id", "class_id", "copies")
    held = live.join(notes, "active_revision_id").join(held, "file_id", "left").select("file_id", "root_id", "name", "path", "relative_path", "extension", "modality", "mtime_ns", "size", "warnings", "class_id", F.coalesce("copies", F.lit(1)).alias("copies"))
    posts, stats = terms_index(spark, sf_dir, s.field_weights)
    vec = own.where(F.col("text").rlike(r"\S")).select("chunk_id", hashed_vector(F.col("text")).alias("v"))
    return Index(own, written(held, "live-files"), posts, stats, written(vec, "vectors"), _stored(spark, sf_dir, own))


def _stored(spark: SparkSession, sf_dir: str, live: DataFrame, modality: str = "image", dimension: int = 64) -> DataFrame | None:
    """Usable stored vectors of live chunks under the profiles of a modality and dimension; none without tables of them."""
    try:
        vectors_, profiles = (load(spark, sf_dir, t) for t in ("vectors", "profiles"))
    except AnalysisException:
        return None
    own = profiles.where((F.col("modality") == modality) & (F.col("dimension") == dimension)).select(F.col("id").alias("profile_id")).distinct()
    good = vectors_.where(F.size("vector") == dimension).join(F.broadcast(own), "profile_id").where(vector_state(F.col("vector"), F.lit(dimension)) == "ok")
    one = good.groupBy("chunk_id").agg(F.min_by("vector", "id").alias("v"))
    return written(one.join(live.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.transform("v", lambda x: x.cast("double")).alias("v")), "pictures")


def lexical_branch(index: Index, queries: DataFrame, s: Settings, allowed: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, matched, rank)``: candidates are eligible chunks only, statistics are of all rows."""
    ok = (allowed if allowed is not None else index.chunks).select("chunk_id")
    return lexical.answers(queries, index.postings, index.stats, ok, s.candidates)


def two_terms(branch: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """In hybrid search a query of several terms needs two of them, as they are written, in a passage or its names."""
    want = queries.select("query_id", query_terms(F.col("query")).alias("ts"))
    body = F.concat_ws(" ", "text", "name", "relative_path", "symbol")
    split = F.regexp_replace(body, "([a-z])([A-Z])", "$1 $2")
    have = F.array_distinct(F.transform(F.concat(all_matches(body, TOKEN), all_matches(split, TOKEN)), F.lower))
    full = branch.join(want, "query_id").join(chunks.select("chunk_id", have.alias("_have")), "chunk_id")
    return full.where((F.size("ts") <= 1) | (F.size(F.array_intersect("ts", "_have")) >= 2)).drop("ts", "_have")


def semantic_branch(index: Index, queries: DataFrame, s: Settings, allowed: DataFrame | None = None, vision: bool = False) -> DataFrame:
    """Exact nearest passages, or pictures, of each query above the floor, among the allowed ones."""
    encode, held, least = (index.encode_vision, index.pictures, s.vision_floor) if vision else (index.encode_text, index.vectors, s.text_floor)
    if allowed is not None:
        held = held.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    q = queries.select(F.lit(0).alias("group"), F.col("query_id").alias("id"), encode(F.col("query")).alias("v"))
    b = held.select(F.lit(0).alias("group"), F.col("chunk_id").alias("id"), "v")
    return vectors.floor(vectors.exact_neighbours(q, b, s.candidates), least).withColumnRenamed("item_id", "chunk_id")


def _ranked(branch: DataFrame) -> DataFrame:
    """Ranks without gaps, in the order of the ranks there are."""
    return branch.select("query_id", "chunk_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))


def search(index: Index, queries: DataFrame, request: Request = Request(), settings: Settings | None = None) -> DataFrame:
    """The results of a batch of searches, ``limit`` per query, one row each.

    ``queries``: ``query_id, query``. Rows: ``query_id, place, file_id, name, path, relative_path, extension, modality, mtime_ns, size, score,
    match_kind, ranking, evidence, class_id, copies, warnings``. ``evidence``: up to three ``(chunk_id, kind, snippet, label)``. Files of equal
    content are one result; its aliases are the files of ``class_id`` (``fusion.aliases``), which are not spread into each result.
    In hybrid mode a query of one term is answered by terms alone, stop words alone by meaning alone; a null query has no
    results. Pictures are asked unless the mode is lexical or the channel text; asking them alone needs them enabled.
    """
    s = settings or Settings()
    hybrid_ = request.mode == "hybrid"
    if request.channels == "vision" and (request.mode == "lexical" or not s.enable_vision or index.pictures is None):
        raise ValueError("VISION_DISABLED")
    text = request.channels != "vision"
    vision = s.enable_vision and index.pictures is not None and request.mode != "lexical" and request.channels != "text"
    # equal texts are asked once and their answers handed to each of the queries
    given = written(queries.where("query is not null").select("query_id", "query"), "queries")
    asked = written(given.groupBy("query").agg(F.min("query_id").alias("class_id")), "questions")
    q = asked.select(F.col("class_id").alias("query_id"), "query")
    one = F.size(query_terms(F.col("query"))) == 1
    wide = q.where(~one) if hybrid_ and text else q
    allowed = index.chunks
    if request.filters:
        allowed = written(index.chunks.where(catalog.filters(**request.filters)).select("chunk_id"), "eligible")
    empty = q.sparkSession.createDataFrame([], "query_id string, chunk_id long, score double, rank int").withColumn("query_id", F.col("query_id").cast(dict(q.dtypes)["query_id"]))
    branches: dict[str, DataFrame] = {}
    if text and request.mode != "semantic":
        words = lexical_branch(index, q, s, allowed)
        branches["terms"] = written(_ranked(two_terms(words, q, index.chunks) if hybrid_ else words), "branch-terms")
    if text and request.mode != "lexical":
        branches["meaning"] = written(_ranked(semantic_branch(index, wide, s, allowed if request.filters else None)), "branch-meaning")
    seen = written(_ranked(semantic_branch(index, wide, s, allowed if request.filters else None, vision=True)), "branch-vision") if vision else empty
    if hybrid_ and branches:
        ranking = lexical.top(fusion.rrf([(b, 1.0) for b in branches.values()], "chunk_id", s.rrf_k), 1 << 30, best_first="desc")
    else:
        ranking = next(iter(branches.values()), empty)
    ranking = ranking.select("query_id", "chunk_id", "score", "rank")
    if request.rerank and branches:
        full = ranking.join(q, "query_id").join(index.chunks.select("chunk_id", "text"), "chunk_id")
        head = full.where((F.col("rank") <= s.rerank_head) & F.col("text").rlike(r"\S")).select("query_id", "chunk_id", index.score(F.col("query"), F.col("text")).cast("double").alias("other"))
        both = ranking.join(head, ["query_id", "chunk_id"], "left")
        order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("other"), F.when(F.col("other").isNotNull(), F.col("chunk_id")), "rank")
        ranking = both.select("query_id", "chunk_id", F.coalesce("other", "score").alias("score"), F.row_number().over(order).alias("rank"))
    ranking = written(ranking, "ranking")
    # files: by their best passage, or, where pictures answer, by the sum over the branches of each file's rank
    in_file = index.chunks.select("chunk_id", "file_id")
    first = ranking.join(in_file, "chunk_id").groupBy("query_id", "file_id").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("_r"))
    plain = first.select("query_id", "file_id", "score", F.col("_r").cast("double").alias("_order"))
    if vision:
        pictured = seen.select("query_id").distinct()
        weight = 1.0 if request.filters.get("modality") in ("image", "video") else 0.35
        parts = [(ranking, float(max(1, len(branches))))] if request.rerank and branches else [(b, 1.0) for b in branches.values()]
        votes = [(fusion.by_file(b.select("query_id", "chunk_id", "rank"), in_file), w) for b, w in [*parts, (seen, weight)]]
        fused = fusion.rrf(votes, "file_id", s.rrf_k).join(pictured, "query_id", "left_semi")
        plain = plain.join(pictured, "query_id", "left_anti").unionByName(fused.select("query_id", "file_id", "score", (-F.col("score")).alias("_order")))
    order = Window.partitionBy("query_id").orderBy("_order", "file_id")
    files = plain.withColumn("rank", F.row_number().over(order)).join(index.chunks.select("file_id", "sha256").distinct(), "file_id")
    files = fusion.one_per_content(files)
    place = Window.partitionBy("query_id").orderBy("rank")
    files = written(files.withColumn("place", F.row_number().over(place)).where(F.col("place") <= s.limit), "results")
    # hits: passages in the order of the text ranking, then pictures in theirs
    hits = ranking.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.lit(True).alias("_text")).unionByName(seen.select("query_id", "chunk_id", (F.col("rank") + F.lit(1 << 40)).alias("rank"), F.lit(False).alias("_text")))
    hits = hits.join(index.chunks.select("chunk_id", "file_id", "text_hash", "kind"), "chunk_id").join(files.select("query_id", "file_id"), ["query_id", "file_id"], "left_semi")
    terms = branches.get("terms", empty).join(in_file, "chunk_id") if "terms" in branches else empty.withColumn("file_id", F.lit(None).cast("long"))
    kinds = fusion.match_kind(files, terms, hits.where("_text"))
    shown = fusion.evidence(hits, s.evidence).join(index.chunks.select("chunk_id", snippet(F.col("text"), s.snippet_chars).alias("snippet"), location_label(F.col("locator")).alias("label")), "chunk_id")
    shown = shown.groupBy("query_id", "file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "kind", "snippet", "label"))), lambda e: e.dropFields("place")).alias("evidence"))
    name = F.lit("reranked") if request.rerank and branches else F.when(F.lit(hybrid_ and text) & F.col("_one"), "lexical").otherwise(request.mode)
    if vision:
        name = F.when(F.col("_seen"), "multimodal_rrf").otherwise(name)
    marks = q.select("query_id", one.alias("_one")).join(seen.select("query_id", F.lit(True).alias("_seen")).distinct(), "query_id", "left")
    found = kinds.join(shown, ["query_id", "file_id"]).join(marks, "query_id").join(index.files, "file_id").withColumn("ranking", name).withColumnRenamed("query_id", "class_id_")
    each = given.join(asked.withColumnRenamed("class_id", "class_id_"), "query").select("class_id_", "query_id")
    return found.join(each, "class_id_").select("query_id", "place", "file_id", "name", "path", "relative_path", "extension", "modality", "mtime_ns", "size", "score", "match_kind", "ranking", "evidence", "class_id", "copies", "warnings")


def hybrid(index: Index, queries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Hybrid search over passages, in short: file, score, kind of match, number of evidence, first evidence."""
    found = search(index, queries, Request(channels="text"), settings)
    first = F.col("evidence")[0]
    return found.select("query_id", "place", "file_id", "relative_path", "score", "match_kind", F.size("evidence").alias("evidence"), first["chunk_id"].alias("chunk_id"), first["label"].alias("label"))
