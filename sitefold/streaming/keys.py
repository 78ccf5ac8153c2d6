"""Keys that streams wrote to a target, stored by hash prefix.

A batch needs to know which of its own keys are in the target. The store keeps keys alone, in
folders by query, batch and key prefix, so a batch reads the prefixes it touches and nothing
else of the target. Every ``COMPACT_AFTER`` batches of a query its earlier folders become one.

Safe to repeat: a batch replaces its own folder, and its own keys never count as seen. Only
batches before the current one are compacted, which are committed and never run again. If a run
ends between writing the compacted folder and removing the old ones, keys are there twice, which
changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = 256
COMPACT_AFTER = 16
_SCHEMA = "key string, query_id string, batch_id long, prefix string"
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def key_prefix(key: Column) -> Column:
    """Two hex digits of the key's hash, in front of a letter so that it never reads as a number."""
    digits = F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(PREFIXES))))
    return F.when(key.isNotNull(), F.concat(F.lit("p"), F.lpad(digits, 2, "0")))


class KeyStore:
    """The keys below ``target``, in a folder that readers of the target pass over."""

    def __init__(self, spark: SparkSession, target: str, key: str):
        self.spark, self.target, self.key = spark, target, key
        self.folder = f"{target}/_keys"

    def _batch_folder(self, query_id: str, batch_id: int) -> str:
        return f"{self.folder}/query_id={query_id}/batch_id={batch_id}"

    def _table(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() in _MISSING:
                return None
            raise

    def _import(self) -> None:
        """Keys of a target that was written before it had a store."""
        try:
            rows = self.spark.read.parquet(self.target)
        except AnalysisException as error:
            if error.getCondition() in _MISSING:
                return
            raise
        self._write(rows, "imported", 0)

    def _write(self, rows: DataFrame, query_id: str, batch_id: int) -> None:
        keys = rows.select(F.col(self.key).cast("string").alias("key"))
        keys = keys.where("key IS NOT NULL").distinct().withColumn("prefix", key_prefix(F.col("key")))
        keys.hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(
            self._batch_folder(query_id, batch_id)
        )

    def seen(self, rows: DataFrame, query_id: str, batch_id: int) -> DataFrame | None:
        """Keys of other batches in the prefixes that ``rows`` (settled) touch."""
        if self._table() is None:
            self._import()
        table = self._table()
        if table is None:
            return None
        touched = rows.select(key_prefix(F.col(self.key)).alias("prefix")).distinct().collect()
        prefixes = [r["prefix"] for r in touched if r["prefix"] is not None]
        own = (F.col("query_id") == query_id) & (F.col("batch_id") == batch_id)
        return table.where(F.col("prefix").isin(prefixes) & ~own).select(
            F.col("key").alias(self.key)
        )

    def add(self, rows: DataFrame, query_id: str, batch_id: int) -> None:
        self._write(rows, query_id, batch_id)
        self.compact(query_id, batch_id)

    def compact(self, query_id: str, batch_id: int) -> None:
        """Join the folders of the query's earlier batches once there are many.

        A compacted folder has the negated id of the batch that made it.
        """
        home = f"{self.folder}/query_id={query_id}"
        merged = -batch_id
        found = self._ids(home)
        earlier = [i for i in found if i < batch_id and i != merged]
        if len(earlier) < COMPACT_AFTER and not (merged < 0 and merged in found):
            return
        if not self._exists(f"{home}/batch_id={merged}/_SUCCESS"):
            table = self._table().where((F.col("query_id") == query_id) & F.col("batch_id").isin(earlier))
            self._write(table.select(F.col("key").alias(self.key)), query_id, merged)
        for old in earlier:
            self._remove(f"{home}/batch_id={old}")

    def _file_system(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _ids(self, home: str) -> list[int]:
        system, path = self._file_system(home)
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))

    def _exists(self, path: str) -> bool:
        system, target = self._file_system(path)
        return system.exists(target)

    def _remove(self, path: str) -> None:
        system, target = self._file_system(path)
        system.delete(target, True)
