"""Objects that arrive over time. An extension: the same extraction, stateless, and findings merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detectors


def tokens(objects: DataFrame) -> DataFrame:
    """Tokens of a stream of objects (object_key, content)."""
    return detectors.find(objects)


def start(objects: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's sums by fingerprint to a table, under the batch's number: a batch that runs again replaces its own rows."""
    from ..functions import values as V

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(V.fingerprint(F.col("value")).alias("fingerprint"), "kind").agg(F.count("*").alias("occurrences"), F.hll_sketch_agg(F.col("object_key").cast("string")).alias("objects"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return tokens(objects).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, table: str) -> DataFrame:
    """All batches together. objects is an estimate (of sketches merged over batches), so an object seen twice counts once."""
    return spark.read.parquet(table).groupBy("fingerprint", "kind").agg(F.sum("occurrences").alias("occurrences"), F.hll_sketch_estimate(F.hll_union_agg("objects")).alias("objects"))
