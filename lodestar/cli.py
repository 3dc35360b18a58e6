"""python -m lodestar.cli CATALOG index FOLDER | forget FOLDER | search QUERY... | status | failures | evaluate QUERIES JUDGMENTS | unlock"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("catalog")
    parser.add_argument("command", choices=("index", "forget", "search", "status", "failures", "evaluate", "unlock"))
    parser.add_argument("words", nargs="*")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--verify", action="store_true")
    parser.add_argument("--forced", action="append", default=[], help="paths below the folder whose files are read even if size and time are unchanged")
    parser.add_argument("--mode", default="hybrid", choices=("lexical", "semantic", "hybrid"))
    parser.add_argument("--channels", default="all", choices=("all", "text", "vision"))
    parser.add_argument("--rerank", action="store_true")
    parser.add_argument("--limit", type=int, default=10)
    for name in ("modality", "extension", "path-prefix"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args(args)
    from lodestar.operators import catalog as ops
    from lodestar.operators import evaluation
    from lodestar.plans import ingest, search
    from lodestar.plans.generations import Generations
    from lodestar.plans.shipping import ship
    from lodestar.plans.storage import load
    from lodestar.schema import Settings
    from lodestar.sources import files as sources

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    held = Generations(spark, given.catalog)
    wanted = {k: v for k, v in {"modality": given.modality, "extension": given.extension, "path_prefix": given.path_prefix}.items() if v is not None}
    request, settings = search.Request(given.mode, given.channels, given.rerank, wanted), Settings(limit=given.limit)
    show = lambda df: [print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)) for r in df.collect()]
    if given.command == "index":
        print(json.dumps(ingest.index(spark, given.words[0], held, given.exclude, verify=given.verify, forced=given.forced)))
    elif given.command == "forget":
        print(json.dumps(ingest.forget(held, given.words[0])))
    elif given.command == "unlock":
        held.unlock()
    elif given.command == "search":
        queries = spark.createDataFrame([("q", " ".join(given.words))], "query_id string, query string")
        show(search.search(search.build(spark, held.folder()), queries, request, settings).orderBy("place"))
    elif given.command == "failures":
        show(ops.failures(held.read("files")).orderBy("relative_path"))
    elif given.command == "evaluate":
        queries = sources.json_lines(spark, given.words[0], "id string, query string, category string, split string").withColumnRenamed("id", "query_id")
        judged = sources.json_lines(spark, given.words[1], "query_id string, path string, grade int, locator struct<line_start int, line_end int, page int>")
        found = search.search(search.build(spark, held.folder()), queries, request, settings)
        results = found.select("query_id", F.col("relative_path").alias("path"), F.col("place").alias("rank"))
        measures = evaluation.metrics(results, evaluation.clean_judgments(judged), queries, given.limit)
        returned = results.groupBy("query_id").agg(F.count("*").alias("returned"))
        full = measures.join(queries.select("query_id", "category", "split"), "query_id").join(returned, "query_id", "left").na.fill({"returned": 0})
        show(evaluation.summary(full, ["category", "split"]).orderBy("category", "split"))
    else:
        live = ops.live_files(*(load(spark, held.folder(), t) for t in ("files", "revisions", "roots")))
        print(json.dumps({"generation": held.current(), "modalities": {r.modality: r.files for r in ops.modality_counts(live).collect()}}))


if __name__ == "__main__":
    main()
