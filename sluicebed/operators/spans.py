"""Rows within spans of text, without pairs: one sweep over an object's spans and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def marked(rows: DataFrame, spans: DataFrame, group: tuple[str, ...] = ("object_key",), place: str = "offset", name: str = "inside") -> DataFrame:
    """The rows with a column that says whether their place is in a span of their group, [offset, end). Spans may overlap and nest.

    Spans and places lie in one table by position; the furthest end of the spans that start at or before a place says all, so an
    object takes linear time after its sort, however its spans lie. Null places and groups without spans are in none.
    """
    marks = spans.select(*group, F.col("offset").alias("_at"), F.col("end").alias("_to"), F.lit(0).alias("_own"), F.lit(None).cast(rows.schema).alias("_row"))
    places = rows.select(*group, F.col(place).cast("bigint").alias("_at"), F.lit(None).cast("bigint").alias("_to"), F.lit(1).alias("_own"), F.struct(*rows.columns).alias("_row"))
    reach = F.max("_to").over(W.partitionBy(*group).orderBy(F.asc_nulls_first("_at"), "_own").rowsBetween(W.unboundedPreceding, 0))
    laid = marks.union(places).withColumn("_inside", F.coalesce(reach > F.col("_at"), F.lit(False)))
    return laid.filter("_own = 1").select("_row.*", F.col("_inside").alias(name))


def outside(rows: DataFrame, spans: DataFrame, group: tuple[str, ...] = ("object_key",), place: str = "offset") -> DataFrame:
    """The rows whose place is in no span of their group."""
    return marked(rows, spans, group, place, "_within_span").filter(~F.col("_within_span")).drop("_within_span")
