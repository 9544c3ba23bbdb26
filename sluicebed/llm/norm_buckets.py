"""Exact top-k search for the largest inner product, by norm-bucketed retrieval.

Components become integers floor(SCALE * x). Vectors are dealt by length, the longest first, into at most BUCKETS buckets, and
a bucket of more than BLOCK vectors into blocks. A query first gets a bound that its k-th best score can't be below: its k-th
best among SEEDS vectors (the longest ones, and others picked by a hash), which are sent to the tasks. Divided by the query's
length and a bucket's largest length, the bound is the bucket's local cosine threshold: above one, no vector of the bucket can
reach the bound, so a query goes to a prefix of the buckets only. A pair of a block and a block of at most about VISITS queries
is one group. If the middle of its queries' thresholds is at least COSINE, it is pruned by coordinates: a vector whose angle to
the query is small enough lies in an interval on each of the query's FOCUS largest coordinates. Else it is pruned by length:
vectors shorter than the bound divided by the query's length are left out. What is left is verified by exact integer products,
and k results a group are merged by query. Bounds in floating point are widened by SLACK, so nothing is lost to rounding.

Defined results: vectors that are null or hold null or non-finite components take no part; neither do null ids, vectors of
another length than the most common (ties to the shorter), nor vectors with an integer of LARGEST or more in size, whose scores
wouldn't fit a long. Zero and empty vectors take part. Rows that repeat an id are candidates each; a query's own id is none of
its candidates, and of a query id with several vectors the smallest asks. Ties go to smaller ids; fewer candidates than k are
all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .product_codes import common_length, integers, usable

SCALE = 1024
LARGEST = 1 << 27
BUCKETS, BLOCK, VISITS = 4096, 8192, 4096
SEEDS = 4096
FOCUS, COSINE, SLACK = 3, 0.6, 1e-9
#: Products that are computed at once.
CELLS = 1 << 21
FOUND = "query_id bigint, rank int, vec_id bigint, score bigint"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where every sum stays below 2^53, else in int64."""
    top = (int(np.abs(q).max(initial=0)) + 1) * (int(np.abs(x).max(initial=0)) + 1) * max(q.shape[1], 1)
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def bounds(q: np.ndarray, ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches; minus infinity without k seeds."""
    out = np.full(len(q), -np.inf)
    for lo in range(0, len(q), step := max(1, CELLS // max(1, len(seeds)))):
        scores = products(q[lo : lo + step], seeds).astype(np.float64)
        scores[ids[lo : lo + step, None] == seed_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out[lo : lo + step] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return out


def by_coordinates(unit: np.ndarray, order: np.ndarray, ranked: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    """Places of the unit vectors that may have a cosine with the unit vector q of at least `cosine`, above zero. order: by coordinate the places by value; ranked: the values in that order."""
    focus = np.argsort(-np.abs(q))[:FOCUS]
    rest = np.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0, 1 - q[focus] ** 2))
    low = np.where(q[focus] <= -cosine, -1.0, q[focus] * cosine - rest) - SLACK
    high = np.where(q[focus] >= cosine, 1.0, q[focus] * cosine + rest) + SLACK
    spans = [(np.searchsorted(ranked[f], a), np.searchsorted(ranked[f], b, side="right")) for f, a, b in zip(focus, low, high, strict=True)]
    least = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
    some = order[focus[least], spans[least][0] : spans[least][1]]
    for i, f in enumerate(focus):
        if i != least:
            some = some[(unit[some, f] >= low[i]) & (unit[some, f] <= high[i])]
    return some


def verified(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query id, ids and scores of each query's best k of a block that reach its bound."""
    size, own = lengths(x), lengths(q)
    order = np.argsort(-size, kind="stable")
    x, ids, size = x[order], ids[order], size[order]
    top = size[0] if len(size) else 0.0
    # with a bound of zero or less, or a zero query, lengths say nothing
    says = (bound > 0) & (own > 0) & np.isfinite(bound) & (top > 0)
    need = np.where(says, bound / np.where(own > 0, own, 1), 0.0) * (1 - SLACK)
    cosine = np.where(says, need / (top or 1), 0.0)
    live = np.flatnonzero(~((bound > 0) & ~says) & (cosine <= 1))
    if not len(live) or not len(x):
        return

    def best(i: int, some: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        ok = (scores >= bound[i]) & (ids[some] != q_ids[i])
        some, scores = some[ok], scores[ok]
        at = first_k(scores, ids[some], k)
        return (int(q_ids[i]), ids[some[at]], scores[at]) if len(at) else None

    if np.median(cosine[live]) >= COSINE:
        unit = x / np.where(size > 0, size, 1)[:, None]
        places = np.argsort(unit, axis=0).T
        ranked = np.take_along_axis(unit.T, places, axis=1)
        pruned = live[cosine[live] > 0]
        for i in pruned:
            some = by_coordinates(unit, places, ranked, q[i] / own[i], float(cosine[i]))
            some = some[size[some] >= need[i]]
            if len(some) and (got := best(i, some, products(q[i : i + 1], x[some])[0])):
                yield got
        live = live[cosine[live] <= 0]
    long_enough = np.searchsorted(-size, -need[live], side="right")
    live, long_enough = live[np.argsort(long_enough, kind="stable")], np.sort(long_enough)
    step = max(1, CELLS // len(x))
    for lo in range(0, len(live), step):
        some, most = live[lo : lo + step], int(long_enough[lo : lo + step][-1])
        if most:
            every = np.arange(most)
            for i, scores in zip(some, products(q[some], x[:most]), strict=True):
                if got := best(i, every, scores):
                    yield got


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([*flat, np.empty(0, np.int32)]).astype(np.int64).reshape(len(column), dims)


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best other rows. is_query: over the table's columns."""
    spark, scratch = rows.sparkSession, Scratch()
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vec"), scale, LARGEST))
    most = common_length(own, "vec")
    if most is None:
        return spark.createDataFrame([], FOUND)
    dims, n = most

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1), dims, scale)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), vec, b.column(2), pa.array((x.astype(np.float64) ** 2).sum(axis=1))], names=["id", "vec", "asks", "square"])

    kept = own.filter(F.size("vec") == dims).mapInArrow(whole, "id bigint, vec array<int>, asks boolean, square double")
    buckets = min(BUCKETS, -(-n // BLOCK))
    dealt = kept.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(buckets, F.desc("square"), F.xxhash64("row"))
    table = scratch.cut(dealt.withColumn("bucket", F.spark_partition_id()), "norm-buckets")
    ranges = table.groupBy("bucket").agg(F.max("square").alias("top"), F.count("*").alias("n")).orderBy("bucket").collect()  # at most one a shuffle partition
    tops = np.sqrt(np.array([r["top"] for r in ranges]))
    blocks = [-(-r["n"] // BLOCK) for r in ranges]

    longest = table.orderBy(F.desc("square"), "id", "row").select("id", "vec").limit(SEEDS // 2).toArrow()
    others = table.orderBy(F.xxhash64("row"), "row").select("id", "vec").limit(SEEDS // 2).toArrow()
    seeds = pa.concat_tables([longest, others])
    # a row may be in both halves; twice the same row would raise a bound too far
    ids, vecs = seeds.column(0).to_numpy(), _matrix(seeds.column(1), dims)
    _, first = np.unique(np.concatenate([ids[:, None], vecs], axis=1), axis=0, return_index=True)
    held = spark.sparkContext.broadcast((ids[first], vecs[first], tops))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seed_vecs, tops = held.value
        for b in batches:
            q, q_ids = _matrix(pa.chunked_array([b.column(1)]), dims), b.column(0).to_numpy()
            least, size = bounds(q, q_ids, seed_vecs, seed_ids, k), lengths(q)
            says = (least > 0) & (size > 0)
            need = np.where(says, least / np.where(size > 0, size, 1), 0.0) * (1 - SLACK)
            # buckets stand by falling length: those that reach the bound are a prefix
            last = np.searchsorted(-tops, -need, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.array(last.astype(np.int32))], names=["id", "vec", "bound", "last"])

    asked = table.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    asked = scratch.cut(asked.mapInArrow(bounded, "id bigint, vec array<int>, bound double, last int"), "norm-queries")
    ends = {r["last"]: r["count"] for r in asked.groupBy("last").count().collect()}  # at most one a bucket
    going = np.cumsum([ends.get(at, 0) for at in range(len(ranges) - 1, -1, -1)])[::-1].tolist()
    spread = [(r["bucket"], at, blocks[at], max(1, -(-going[at] // VISITS))) for at, r in enumerate(ranges) if going[at]]
    if not spread:
        return spark.createDataFrame([], FOUND)
    spread = F.broadcast(spark.createDataFrame(spread, "bucket int, place int, blocks int, visits int"))  # at most one a bucket

    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda x, c: F.pmod(F.xxhash64(x), F.col(c)).cast("int")
    left = table.join(spread, "bucket").select("bucket", part("row", "blocks").alias("block"), each("visits").alias("visit"), "id", "vec")
    right = asked.filter("last >= 0").select("id", "vec", "bound", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("place"))
    right = right.join(spread, "place").select("bucket", each("blocks").alias("block"), part("id", "visits").alias("visit"), "id", "vec", "bound")

    def met(x: pa.Table, q: pa.Table) -> pa.Table:
        found = list(verified(_matrix(x["vec"], dims), x["id"].to_numpy(), _matrix(q["vec"], dims), q["id"].to_numpy(), q["bound"].to_numpy(), k)) if len(x) and len(q) else []
        at = np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else []
        one = lambda i: np.concatenate([f[i] for f in found]) if found else []
        return pa.table({"query_id": pa.array(at, pa.int64()), "vec_id": pa.array(one(1), pa.int64()), "score": pa.array(one(2), pa.int64())})

    key = ["bucket", "block", "visit"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, "query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return scratch.held_by(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
