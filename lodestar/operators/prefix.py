"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.storage import written


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before this row.

    Rows are ordered by ``block`` and within it by ``order``. Each block is one window partition, so that a key with
    a third of all rows is spread over as many tasks as it has blocks; only one row per block is summed per key.
    Nulls in ``value`` count as 0. An empty table gives an empty table.
    """
    df = df.withColumn("_rs_block", block).withColumn("_rs_value", F.coalesce(F.col(value), F.lit(0)))
    sums = df.groupBy(*keys, "_rs_block").agg(F.sum("_rs_value").alias("_rs_sum"))
    across = Window.orderBy("_rs_block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_rs_block").rowsBetween(Window.unboundedPreceding, -1) if keys else across
    sums = sums.withColumn("_rs_before", F.coalesce(F.sum("_rs_sum").over(across), F.lit(0))).drop("_rs_sum")
    for k in [*keys, "_rs_block"]:
        sums = sums.withColumnRenamed(k, f"_rs_k_{k}")
    joined = df.join(sums, on=[F.col(k).eqNullSafe(F.col(f"_rs_k_{k}")) for k in [*keys, "_rs_block"]], how="left")
    inside = Window.partitionBy(*keys, "_rs_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_rs_before") + F.coalesce(F.sum("_rs_value").over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("_rs_block", "_rs_value", "_rs_before", *[f"_rs_k_{k}" for k in [*keys, "_rs_block"]])


def dense_ids(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Adds ``out``: start + 1, start + 2, ... in the order of ``order``, whose values are unique.

    Rows are laid out by range and written once; only one count per range is summed across ranges.
    """
    laid = written(df.repartitionByRange(*map(F.col, order)).withColumn("_id_range", F.spark_partition_id()).withColumn("_id_one", F.lit(1)), "ids")
    numbered = running_sum(laid, [], F.col("_id_range"), order, "_id_one", "_id_before")
    return numbered.withColumn(out, (F.col("_id_before") + start + 1).cast("long")).drop("_id_range", "_id_one", "_id_before")
