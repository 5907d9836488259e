"""Tables that a plan writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []


def path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends. Where that is unset, a temporary folder for local masters; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    new = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, new))
    return new


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what follows repeats none of what led to it, also after an executor is lost."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@atexit.register
def _removed() -> None:
    for spark, at in _PATHS:
        try:
            found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
        except Exception:  # the session is gone; the folder is the cluster's to clean
            return
