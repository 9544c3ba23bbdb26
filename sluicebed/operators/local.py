"""Which of the credentials found are also configured on this machine.

Settings are rows of (ord, label, name, value), given by the caller: nothing here reads an environment or runs a command. They
form one document of NAME=value lines, and a token belongs to the setting that its offset falls in. Only fingerprints leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from . import detectors


def environment(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document as an object, and spans: label, name, start, end. One machine's settings, so they are laid out together."""
    line = F.concat("name", F.lit("="), F.coalesce("value", F.lit("")), F.lit("\n"))
    rows = settings.withColumn("line", line).withColumn("size", F.octet_length("line"))
    before = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    spans = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).select("label", "name", "start", (F.col("start") + F.col("size")).alias("end"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "")
    return rows.agg(whole.cast("binary").alias("content")).select(F.lit("environment").alias("object_key"), "content"), spans


def configured(settings: DataFrame) -> DataFrame:
    """(fingerprint, source): distinct credentials among the settings and where each is set."""
    objects, spans = environment(settings)
    found = detectors.find(objects)
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    own = found.join(F.broadcast(spans), inside)  # one machine's settings
    return own.select(V.fingerprint(F.col("value")).alias("fingerprint"), F.concat_ws(" ", "label", "name").alias("source")).distinct()
