"""Publishing tables as immutable generations with one pointer to the visible one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """A folder of ``gen=N`` folders. Readers pin a generation; publishing writes the next and then marks it as complete.

    A generation is visible once its mark exists, and the mark is one file created by one call of the folder's file system: readers
    see the old generation or the new one, never a mixture and never nothing; a failed publication leaves nothing visible. One
    writer at a time holds the folder's lock (see ``writing``).
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The complete generations, newest first."""
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted((int(n[5:]) for n in names if n.startswith("DONE=")), reverse=True)

    def current(self) -> dict | None:
        """The visible generation: its number, tables and row counts."""
        numbers = self._numbers()
        if not numbers:
            return None
        rows = self.spark.read.text(f"{self.root}/DONE={numbers[0]}").collect()  # one line
        return json.loads(rows[0][0])

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(generation)}/{table}.parquet")

    def folder(self, generation: int | None = None) -> str:
        """The folder of a generation, whose tables can be read as a catalogue."""
        n = generation if generation is not None else next(iter(self._numbers()), None)
        if n is None:
            raise LookupError("nothing is published")
        return f"{self.root}/gen={n}"

    def _create(self, name: str, text: str) -> None:
        """A new file with a text; it is an error if it exists."""
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Holds the lock of the only writer; INDEX_BUSY if another holds it. A lock left by a crash is removed by ``unlock``."""
        try:
            self._create("WRITER", self.spark.sparkContext.applicationId)
        except Exception as taken:
            raise RuntimeError("INDEX_BUSY: another writer holds the catalogue") from taken
        try:
            yield
        finally:
            self.unlock()

    def unlock(self) -> None:
        self._fs.delete(self._path("WRITER"), False)

    def publish(self, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None) -> int:
        """Writes all tables of the next generation, then makes it visible."""
        n = next(iter(self._numbers()), 0) + 1
        counts = {}
        for name, df in tables.items():
            path = f"{self.root}/gen={n}/{name}.parquet"
            keys = (by or {}).get(name)
            (df.repartition(*keys) if keys else df).write.mode("overwrite").parquet(path)
            counts[name] = self.spark.read.parquet(path).count()
        self._create(f"DONE={n}", json.dumps({"generation": n, "tables": counts}))
        return n

    def retire(self, keep: int = 2) -> list[int]:
        """Removes all but the newest ``keep`` generations, their marks first."""
        gone = sorted(self._numbers()[keep:])
        for n in gone:
            self._fs.delete(self._path(f"DONE={n}"), False)
            self._fs.delete(self._path(f"gen={n}"), True)
        return gone


def merged(old: DataFrame, fresh: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """Upsert without a table format: old rows whose key is neither replaced nor removed, and the fresh rows."""
    kept = old.join(fresh.select(key), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(rows, digest)`` that does not depend on order: sums of two 64-bit row hashes, so that equal rows do not cancel."""
    whole = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), whole(1), whole(2)), 256).alias("digest"))


def intact(df: DataFrame, columns: list[str], digest: str) -> bool:
    """Whether a stored table still is what its checksum was taken from."""
    return checksum(df, columns).first()["digest"] == digest
