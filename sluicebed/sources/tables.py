"""Tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own in local mode; elsewhere an error, since no other machine would see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back, so that later steps neither make it again nor plan it again: what a checkpoint keeps of its plan (bounds of columns) grows with every round of a loop. done: tables of earlier cuts that nothing reads after this one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    for t in done:
        old = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
    return made
