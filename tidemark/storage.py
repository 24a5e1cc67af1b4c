"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of the warehouse, which a cluster shares too; a ``local`` master has one machine and
    one process, for which the system's temporary folder will do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and spark.sparkContext.master.split("[")[0] == "local":
        path = f"{tempfile.gettempdir()}/tidemark-{os.getpid()}"
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-work").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that what made it runs once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
