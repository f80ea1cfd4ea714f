"""Tables written to the folder that all executors share, in place of lineage.

``spark.checkpoint.dir`` names that folder.  Where it is unset (local tests), a folder of this
process is set as checkpoint directory and used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_UNSET = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where the setting is missing."""
    found = spark.sparkContext.getConf().get(_UNSET) or spark.conf.get(_UNSET, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"a cluster needs {_UNSET}: a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="sievector-")
    spark.conf.set(_UNSET, found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    """What this application stages."""
    return f"{shared_dir(spark)}/sievector/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{_own_dir(spark)}/{re.sub(r'[^A-Za-z0-9_-]', '_', tag)}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has staged.  Results that still read them must be written first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
