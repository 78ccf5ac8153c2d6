"""Session defaults, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing is heavy per byte, so a scan has small splits,
    "spark.sql.files.maxPartitionBytes": "32m",
    # and small shuffle outputs still go to many tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "sitefold", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="sitefold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sitefold/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Cuts the lineage, so a lost executor costs a re-read and never a re-parse,
    and several readers share one computation with column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Settled data of one run, in a folder of its own below the shared folder.

    ``drop`` removes what no later step reads, ``close`` all but the frames named in
    ``keep`` (a lazy result still reads those; remove them with ``close()`` once it is written).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = new_path(spark, name)
        self.names: list[str] = []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.folder}/{name}")
            self.names.remove(name)

    def close(self, keep: tuple[str, ...] = ()) -> None:
        self.drop(*[n for n in self.names if n not in keep])
        if not keep:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        # The folder may be in any store that Spark reaches, so its file system API is used.
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def text_bytes(*columns: Column) -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))


def is_small(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Measure ``df`` (a settled frame) against the broadcast limit."""
    size = df.agg(F.coalesce(F.sum(row_bytes + 32), F.lit(0)).alias("n")).first()["n"]
    return size <= limit


def ordered_ids(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Rising BIGINT in the given order, by a range-partitioned sort.

    Ids rise with the order but are not dense; no single-task window is needed.
    Settle the result before using the ids twice.
    """
    return df.orderBy(*order).withColumn(name, F.monotonically_increasing_id())
