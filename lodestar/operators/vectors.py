"""Exact vector search in blocks, floors and checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_neighbours(queries: DataFrame, base: DataFrame, k: int, query_block: int = 4096, base_block: int = 32_768) -> DataFrame:
    """``(query_id, item_id, score)``: for each query the k items of the same ``group`` with the largest inner product.

    Both sides have ``group, id, v`` (array of doubles of one length per group). Queries and items meet block by block, each
    pair of blocks one task of bounded size; per block only the k best of a query go on. Ties by id. Null vectors have no row.
    """
    nq, nb = queries.count(), base.count()
    qb, bb = max(1, -(-nq // query_block)), max(1, -(-nb // base_block))
    kind, item = dict(queries.dtypes)["id"], dict(base.dtypes)["id"]

    def side(df: DataFrame, own: str, n: int, other: str, m: int, ask: bool) -> DataFrame:
        ids = F.col("id").alias("qid" if ask else "bid"), F.lit(None).cast(item if ask else kind).alias("bid" if ask else "qid")
        block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)
        return df.where("v is not null").select("group", "v", *ids, block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(ask).alias("q"))

    both = side(queries, "qb", qb, "bb", bb, True).unionByName(side(base, "bb", bb, "qb", qb, False))

    def meet(table: pa.Table) -> pa.Table:
        ask = table["q"].to_numpy()
        part = {}
        for flag in (True, False):
            t = table.filter(pa.array(ask == flag)).sort_by("qid" if flag else "bid").combine_chunks()
            part[flag] = t["qid" if flag else "bid"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else None
        (qid, q), (bid, b) = part[True], part[False]
        ids, items, scores = [], [], []
        if len(qid) and len(bid):
            for a in range(0, len(qid), 512):
                s = np.round(q[a : a + 512] @ b.T, 9)
                n, m = min(k, len(bid)), min(k + 32, len(bid))
                some = np.argpartition(-s, m - 1, axis=1)[:, :m]
                value = np.take_along_axis(s, some, 1)
                order = np.lexsort((some, -value), axis=1)[:, :n]  # items lie in the order of their ids
                best, score = np.take_along_axis(some, order, 1), np.take_along_axis(value, order, 1)
                # where more share the last score than were looked at, the lowest ids of all of them count
                for i in np.flatnonzero(value.min(axis=1) >= score[:, -1]) if m < len(bid) else ():
                    at = np.flatnonzero(s[i] >= score[i, -1])
                    best[i] = at[np.argsort(-s[i, at], kind="stable")[:n]]
                ids += np.repeat(qid[a : a + 512], n).tolist()
                items.append(bid[best].ravel())
                scores.append(np.take_along_axis(s, best, 1).ravel())
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(ids, table.schema.field("qid").type), "item_id": pa.array(join(items, object if not len(bid) else bid.dtype), pa.int64()), "score": pa.array(join(scores, float), pa.float64())})

    met = both.groupBy("group", "qb", "bb").applyInArrow(meet, f"query_id {kind}, item_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def floor(scored: DataFrame, least: float) -> DataFrame:
    """Only finite scores of at least ``least``, before any fusion."""
    s = F.col("score")
    return scored.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & (s >= least))
