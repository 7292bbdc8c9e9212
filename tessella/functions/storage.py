"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's folder in ``spark.checkpoint.dir``; the folder goes when Python ends.

    Only where that setting is unset, on one machine, is a temporary folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{_own(folder, spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _own(shared: str, app: str) -> str:
    from pyspark import SparkContext

    folder, sc = f"{shared.rstrip('/')}/tessella-lib-{app}", SparkContext._active_spark_context
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM is gone; what is left lies in the checkpoint folder
            pass

    atexit.register(remove)
    return folder
