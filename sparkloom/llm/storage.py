"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """A folder of this application in the cluster's ``spark.checkpoint.dir``; where it is unset, a fresh local folder for a local master, as in tests, and else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: nothing that was read from them can be computed again after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows of some dozen bytes each, broadcast while they are at most so many; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
