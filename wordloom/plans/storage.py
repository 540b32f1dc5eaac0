"""Where intermediate results live, and when a table is small enough to broadcast."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in a single process without a setting, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of this library's own once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows as Parquet in the shared folder, read back, and the folder to drop later.

    Cuts the lineage: a lost executor costs the tasks that were running, not the steps before.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused or random intermediate once; later stages read the copy."""
    return written(df)[0]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Text work is heavy per byte: a table in fewer splits than cores is spread over all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a dictionary has few rows and few bytes; at most `rows` + 1 rows are read for it."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dictionary whose size was checked; beyond the limits Spark joins by shuffle."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df
