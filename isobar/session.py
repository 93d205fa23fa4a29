"""Session helpers: where intermediate tables go, and how a small one is settled."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only in local mode."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isobar-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/isobar/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path for the intermediate output named ``label``, in the application's own folder."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the application's intermediate output, at the end of a job whose results are written.

    DataFrames that were made from it cannot be read any more.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for aggregates that are joined back to the rows they came from. Spark
    estimates an unmaterialised aggregate by the size of its input, so over a
    large table it plans a shuffle of *both* sides. Once the aggregate is a
    file, the planner knows its true size: it broadcasts below
    ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffled, skew-aware
    join above it. It also cuts the lineage: a lost executor does not bring
    back the scan behind the aggregate.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
