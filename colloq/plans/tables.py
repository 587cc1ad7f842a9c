"""Tables that cut lineage: written into the folder that the driver and all executors see, gone when the session ends."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="colloq-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in tests, a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = _temporary()
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which the file system deletes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table that outlives executors. What it holds is computed once, sampled ranges too."""
    path = f"{fresh(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
