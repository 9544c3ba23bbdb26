"""Helpers the training-data operators share: the word rule, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once: as a lambda's variable it isn't copied wherever body mentions it."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; elsewhere an error, since no other machine would see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        folder = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Spark's setting that removes a query's shuffle files once the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation. free: its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() has written, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Tables between the steps of one operator; clear() removes them once its result no longer reads them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()

    def held_by(self, result: DataFrame) -> DataFrame:
        """The result, which reads these tables until release() removes them."""
        result._reads = self
        return result


def release(result: DataFrame) -> None:
    """Remove the tables that an operator's result reads, once it has been written."""
    if (held := getattr(result, "_reads", None)) is not None:
        held.clear()


def unused(name: str, docs: DataFrame) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
