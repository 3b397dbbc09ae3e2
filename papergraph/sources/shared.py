"""The folder that driver and executors share, and tables that are kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, a local session (one machine) gets a temporary folder; on
    a cluster no folder of the driver's could be shared, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This cuts the lineage and survives lost executors; the table stays as long
    as the folder does, since results are read from it lazily.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
