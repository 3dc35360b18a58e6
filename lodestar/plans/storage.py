"""Reading catalogue tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``sf_dir``; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a local session gets a temporary one (tests); on
    a cluster there is no folder that all executors share, and it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Lineage ends here: an executor lost later costs no recomputation, unused columns stay unread, and the
    file sizes give the planner true statistics for its choice of joins.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}"
    if own not in _own and own.startswith("file:"):  # other stores expire what applications leave
        _own.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df_rows: int, per_part: int, least: int = 1) -> int:
    """Number of partitions so that each holds about ``per_part`` rows."""
    return max(least, -(-df_rows // per_part))
