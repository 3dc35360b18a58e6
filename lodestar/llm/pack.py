"""Problem 7: filling fixed-capacity containers with items.

Method: sum-of-squares online packing. A level array counts the partly filled containers at each fill level; every item goes
to the level (or a new container) for which the sum of the squared counts grows least. Groups of items are packed
independently; containers left too empty are opened again and their items packed in ever fewer groups, so that only the
last, small group leaves containers with space.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import VOCABULARY, token_sizes
from lodestar.plans.storage import parts_for, written


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item in the order given; sizes lie in 1..capacity."""
    level = np.zeros(capacity + 1, dtype=np.int64)  # partly filled containers by level; level 0 stands for a new one
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    place = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for n, s in enumerate(sizes.tolist()):
        # change of the sum of squares when a container goes from level l to l + s; the full level and level 0 are not counted
        change = 1 - 2 * level[: capacity - s + 1]
        change[0] = 0
        change[: capacity - s] += 1 + 2 * level[s:capacity]
        change[1:][level[1 : capacity - s + 1] == 0] = 1 << 60
        at = int(change.argmin())
        best = change[at]
        if at == 0 and capacity - s > 0:  # ties go to the fullest container that takes the item
            ties = np.flatnonzero(change == best)
            at = int(ties[-1])
        if at:
            bin_ = held[at].pop()
            level[at] -= 1
        else:
            bin_, made = made, made + 1
        place[n] = bin_
        if at + s < capacity:
            held[at + s].append(bin_)
            level[at + s] += 1
    return place


def _pack_groups(items: DataFrame, capacity: int, prefix: str) -> DataFrame:
    """Items with ``container`` and its ``fill``; every ``_group`` is packed on its own, once with the largest items first
    and once in mixed order, and the packing with fewer containers stands."""
    schema = "doc_id long, piece int, tokens long, oversized boolean, container string, fill long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["tokens"].to_numpy()
        place, mixed = sum_of_squares(sizes, capacity), np.random.default_rng(len(sizes)).permutation(len(sizes))
        other = sum_of_squares(sizes[mixed], capacity)
        if other.max() < place.max():
            place = other[np.argsort(mixed)]
        fill = np.bincount(place, weights=pdf["tokens"].to_numpy()).astype(np.int64)
        group = int(pdf["_group"].iloc[0])
        out = pdf[["doc_id", "piece", "tokens", "oversized"]].copy()
        out["container"] = [f"{prefix}-{group}-{p}" for p in place.tolist()]
        out["fill"] = fill[place]
        return out

    return items.groupBy("_group").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, per_group: int = 20_000, full: float = 0.99) -> DataFrame:
    """One row ``(doc_id, piece, tokens, oversized, container, fill)`` per item, or per piece of an item above ``capacity``.

    Only sizes are moved, never texts. An item above the capacity fills whole containers with its first pieces, the rest is
    packed like any item. Null and empty texts have no tokens and are in no container; equal texts under several ids each
    count; rows delivered twice must be removed before. ``full``: containers filled less are opened again in the next round,
    in an eighth of the groups, until one group of about ``per_group`` items is left. Other columns are not read.
    """
    sizes = token_sizes(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], vocabulary)
    pieces = sizes.where("tokens > 0").select(
        "doc_id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int")), lambda k: F.least(F.lit(capacity).cast("long"), F.col("tokens") - k * F.lit(capacity).cast("long")))).alias("piece", "size"),
        (F.col("tokens") > capacity).alias("oversized"),
    )
    todo = written(pieces.select("doc_id", "piece", F.col("size").alias("tokens"), "oversized"), "pack-sizes")
    done: list[DataFrame] = [todo.where(F.col("tokens") == capacity).select("*", F.concat_ws("-", F.lit("whole"), "doc_id", "piece").alias("container"), F.lit(capacity).cast("long").alias("fill"))]
    todo = todo.where(F.col("tokens") < capacity)
    turn = 0
    left = todo.count()
    groups = parts_for(left, per_group)
    while left:
        grouped = todo.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)))
        packed = written(_pack_groups(grouped, capacity, f"r{turn}"), f"pack-round{turn}")
        if groups == 1:
            done.append(packed)
            break
        good = F.col("fill") >= full * capacity
        done.append(packed.where(good))
        todo = packed.where(~good).select("doc_id", "piece", "tokens", "oversized")
        left = todo.count()
        groups = min(max(1, groups // 8), parts_for(left, per_group))
        turn += 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per container: ``items``, ``tokens`` used and ``unused`` space. No text: no container."""
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))
