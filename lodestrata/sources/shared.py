"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder if all runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out (by a key) ahead of slow work on each: a small file would be one task, and Spark joins small partitions."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def sort_joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables of rows: never a broadcast, which Spark would choose by the size of compressed files."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def removed(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in frames:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            deleted(df.sparkSession, folder)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)
