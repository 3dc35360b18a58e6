"""Problem 5: splits that keep related records together.

Method: frontier breadth-first components. Records hang on hubs (families, judged files); the adjacency lists of the hubs
are hash-partitioned, many seeds expand at once, and where two expansions meet, their labels become an edge of a smaller
graph that is solved in the same way. Components are then dealt to the splits in the order of their hash.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lodestar.operators.prefix import running_sum
from lodestar.plans.storage import written


@pandas_udf(T.StringType())
def family_key(names: pd.Series) -> pd.Series:
    """Names without case, accents and all that is no letter or digit; nothing left: null."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        bare = unicodedata.normalize("NFD", unicodedata.normalize("NFC", name).casefold())
        return "".join(c for c in bare if c.isalnum()) or None

    return names.map(one, na_action="ignore")


def _smallest(df: DataFrame, by: str, what: str) -> DataFrame:
    """Per ``by`` the ``what`` of the smallest hash; hashing spreads seeds evenly over a chain of ordered ids."""
    return df.groupBy(by).agg(F.min(F.struct(F.xxhash64(what).alias("h"), F.col(what).alias("v")))["v"].alias(what))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is one of the component's nodes.

    Seeds are the nodes whose hash is smaller than all their neighbours'; every component has one, and about every
    (degree + 1)-th node is one. Loops, repeated edges and edges with a null end are ignored, except that the other end
    of such an edge is still a node. A hub of any degree is only ever joined and pre-aggregated, never gathered.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    nodes = both.select(F.explode(F.array("x", "y")).alias("node")).where("node is not null").distinct()
    adjacency = written(both.union(both.select("y", "x")).where("x is not null and y is not null and x <> y").distinct(), f"{name}-adjacency")
    nearest = _smallest(adjacency, "x", "y")
    mine = F.struct(F.xxhash64("x"), F.col("x"))
    seeds = nearest.where(mine < F.struct(F.xxhash64("y"), F.col("y"))).select(F.col("x").alias("node"), F.col("x").alias("label"))
    labelled = written(seeds, f"{name}-seeds")
    frontier, meetings, turn = labelled, [], 0
    while True:
        reach = frontier.join(adjacency, frontier["node"] == adjacency["x"]).select(F.col("y").alias("node"), "label")
        known = labelled.select("node", F.col("label").alias("_known"))
        reach = written(reach.distinct().join(known, "node", "left"), f"{name}-reach{turn}")
        fresh = written(_smallest(reach.where("_known is null").select("node", "label"), "node", "label"), f"{name}-front{turn}")
        taken = fresh.select("node", F.col("label").alias("_fresh"))
        met = reach.join(taken, "node", "left").select("label", F.coalesce("_known", "_fresh").alias("other")).where("label <> other")
        meetings.append(met.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")))
        if fresh.isEmpty():
            break
        labelled = written(labelled.unionByName(fresh), f"{name}-labels{turn}")
        frontier, turn = fresh, turn + 1
    small = meetings[0]
    for met in meetings[1:]:
        small = small.union(met)
    small = written(small.distinct(), f"{name}-small")
    if not small.isEmpty():
        merged = components(small, name=f"{name}-s").withColumnRenamed("node", "label")
        labelled = labelled.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    else:
        labelled = labelled.withColumnRenamed("label", "component")
    return nodes.join(labelled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def related(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """``(query_id, split, component)``, one row per query id.

    Rows delivered twice count once; of several rows of one id with different values every family relates and the smallest
    split stands. ``split`` is compared without case and outer spaces; null and blank are null. Families without a letter
    or digit, null paths and judgments of unknown queries relate nothing. Such a query is a component of its own.
    """
    rows = queries.select(F.col("id").alias("query_id"), "family", F.when(F.trim("split") != "", F.lower(F.trim("split"))).alias("split")).where("query_id is not null")
    each = rows.groupBy("query_id").agg(F.min("split").alias("split"))
    names = rows.select("family").distinct().withColumn("_hub", F.concat(F.lit("f:"), family_key("family")))
    families = rows.select("query_id", "family").join(names, "family").select("query_id", "_hub")
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^(?:\\./+)+", "")
    files = judgments.select("query_id", F.concat(F.lit("p:"), path).alias("_hub")).join(each.select("query_id"), "query_id", "left_semi")
    links = written(families.union(files).where("_hub is not null").distinct(), "splits-links")
    # one edge per further hub of a query: hubs of the same query belong together
    first = links.groupBy("query_id").agg(F.min("_hub").alias("_first"))
    found = written(components(links.join(first, "query_id").select(F.col("_first").alias("a"), F.col("_hub").alias("b"))), "splits-components")
    own = first.join(found, F.col("_first") == F.col("node")).select("query_id", "component")
    return each.join(own, "query_id", "left").select("query_id", "split", F.coalesce("component", F.concat(F.lit("q:"), "query_id")).alias("component"))


def breaches(related_: DataFrame) -> DataFrame:
    """``(query_id)`` of the queries with a split that are related to a query with another split."""
    torn = related_.where("split is not null").groupBy("component").agg(F.min("split").alias("_low"), F.max("split").alias("_high")).where("_low <> _high")
    return related_.where("split is not null").join(torn, "component", "left_semi").select("query_id")


def assign(related_: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, component, split)``: components dealt to the splits in hash order.

    Each component lies as a stretch of its size on a line in hash order and goes to the split in whose share of the line
    its middle falls; so shares are met up to the size of the components at the two borders.
    """
    shares = shares or {"train": 0.70, "validation": 0.15, "test": 0.15}
    related_ = written(related_, "splits-related")
    sizes = related_.groupBy("component").agg(F.count("*").alias("size")).withColumn("_h", F.xxhash64("component"))
    total = related_.count()
    # the hash's upper 12 bits are the block: at most 4,096 rows are summed in one task
    lined = running_sum(sizes, [], F.shiftright("_h", 52), ["_h", "component"], "size", "_before")
    middle = (F.col("_before") + F.col("size") / 2) / F.lit(max(total, 1))
    split, edge, names = None, 0.0, list(shares)
    for name in names[:-1]:
        edge += shares[name] / sum(shares.values())
        split = F.when(middle < edge, name) if split is None else split.when(middle < edge, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return related_.drop("split").join(lined.withColumn("split", split).select("component", "split"), "component").select("query_id", "component", "split")
