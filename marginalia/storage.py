"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete shuffle files at the end of a query.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where it is unset and Spark is one local JVM, in a temporary folder, else an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that what uses it twice doesn't make it twice, and later plans know its size.

    What was shuffled for it is deleted at once, not when the driver's garbage
    happens to be collected.
    """
    path, conf = folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANS, "false")
    conf.set(CLEANS, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what ``kept`` has written as ``df``; for use once nothing reads it any more."""
    spark = df.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)
