"""Sharding by a k-d tree over metadata of the texts.

Coordinates of a text: the logarithm of its bytes, its share of bytes beyond one a character, its share of spaces. Each
node is split along the dimension in which its bytes spread widest, at the weighted median: the sums per bin find the bin
that holds it, a second pass over that bin orders its texts by hash. Both histograms have a fixed number of bins, so what
meets in one task or reaches the driver is bounded (15 cuts for 16 shards). Native: no Python runs on the executors.

Law: `bytes`. Equal texts have equal coordinates and hash, so they share a shard, unless the group alone is over TORN of a
shard's bytes: sizes couldn't be near equal with it whole, and no shard holds a group of a third of all rows. The copies of
such a group are dealt by id, and the column `torn` says so.

Defined results: null texts count as empty (1 byte); null ids are ordinary ids; repeated rows are dealt like other copies;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, materialize

DIMS = ("d_size", "d_wide", "d_space")
TIE_BINS = 16384
#: The share of a shard's bytes beyond which a group of equal texts is dealt over shards, as 1 / TORN.
TORN = 8


def coordinates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    octets, chars = F.octet_length("t"), F.char_length("t")
    some = F.greatest(octets, F.lit(1))
    return docs.select(
        "doc_id",
        (octets + 1).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.xxhash64("t").alias("h"),
        F.floor(F.log2(octets + 1.0) * 64).cast("int").alias("d_size"),
        F.floor((octets - chars) * 1023 / some).cast("int").alias("d_wide"),
        F.floor((chars - F.char_length(F.translate("t", " \n", ""))) * 1023 / some).cast("int").alias("d_space"),
    )


def _cuts(rows: DataFrame) -> list[tuple[int, str, int, int]]:
    """For each node: (node, dimension, bin, tie bin); rows below go left. rows: node, size, tie and the dimensions."""
    per_bin = (
        rows.select("node", "size", F.explode(F.map_from_arrays(F.array(*map(F.lit, DIMS)), F.array(*DIMS))).alias("dim", "bin"))
        .groupBy("node", "dim", "bin").agg(F.sum("size").alias("w"))
    )
    b, w = F.col("bin").cast("double"), F.col("w").cast("double")
    whole = W.partitionBy("node", "dim")
    cum = per_bin.withColumn("upto", F.sum("w").over(whole.orderBy("bin"))).withColumn("total", F.sum("w").over(whole)).withColumn("var", F.sum(w * b * b).over(whole) / F.sum(w).over(whole) - F.pow(F.sum(w * b).over(whole) / F.sum(w).over(whole), 2))
    middle = cum.filter((2 * F.col("upto") >= F.col("total")) & (2 * (F.col("upto") - F.col("w")) < F.col("total")))
    widest = middle.groupBy("node").agg(F.max_by(F.struct("dim", "bin", (F.col("upto") - F.col("w")).alias("below"), "total"), F.struct("var", "dim")).alias("m")).select("node", "m.*").collect()
    if not widest:
        return []
    inside, below, total = F, F, F
    for r in widest:
        inside = inside.when(F.col("node") == r["node"], F.col(r["dim"]) == r["bin"])
        below = below.when(F.col("node") == r["node"], F.lit(r["below"]))
        total = total.when(F.col("node") == r["node"], F.lit(r["total"]))
    ties = rows.filter(inside).groupBy("node", "tie").agg(F.sum("size").alias("w"))
    order = W.partitionBy("node").orderBy("tie")
    gap = F.abs(2 * (below + F.col("upto")) - total)
    best = ties.withColumn("upto", F.sum("w").over(order)).groupBy("node").agg(F.min_by(F.col("tie") + 1, F.struct(gap, F.col("tie"))).alias("cut")).collect()
    cut = {r["node"]: r["cut"] for r in best}
    return [(r["node"], r["dim"], r["bin"], cut[r["node"]]) for r in widest]


def _below(node: Column, cuts: list[tuple[int, str, int, int]]) -> Column:
    """The child of a node that a row falls to."""

    def child(n: Column) -> Column:
        right = F
        for k, dim, b, tie in cuts:
            right = right.when(n == k, F.when((F.col(dim) > b) | ((F.col(dim) == b) & (F.col("tie") >= tie)), 1).otherwise(0))
        return n * 2 + right.otherwise(0)

    return let(node, child) if cuts else node * 2


def kd_shards(docs: DataFrame, levels: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard in [0, 2^levels), slot, grown_shard (null under this law) and torn (the copies of this text are dealt over shards)."""
    rows = materialize(coordinates(docs, id_col, text_col), "shard-rows")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("w"), F.count("*").alias("n")).filter((F.col("w") > max(1, total // (TORN << levels))) & (F.col("n") > 1)).select("h", F.lit(True).alias("hot"))  # at most TORN * 2^levels groups are so large
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("tie", F.pmod(F.xxhash64("h", F.when(F.col("hot"), F.col("doc_id"))), F.lit(TIE_BINS)))
    node: Column = F.lit(0)
    for _ in range(levels):
        at = rows.withColumn("node", node)
        node = _below(node, _cuts(at))
    rows = rows.withColumn("node", node)
    buckets = max(16, n_rows // (20_000 << levels) + 1)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sizes = dealt.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("node", "bucket", (F.sum("n").over(W.partitionBy("node").orderBy("bucket")) - F.col("n")).alias("start"))
    place = W.partitionBy("node", "bucket").orderBy("doc_id", "h")
    return (
        dealt.withColumn("torn", F.coalesce("hot", F.lit(False))).withColumn("place", F.row_number().over(place)).join(starts, ["node", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"), (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "torn")
    )
