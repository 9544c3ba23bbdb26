"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

Nearness is the inner product in double precision. Vectors get one more coordinate, the root of the largest squared norm less
their own, so that the nearest by distance is the largest by inner product; a query's is zero.

Tree. Fitted on at most FIT_ROWS distinct vectors, chosen by a hash: each node is split by k-means into at most FAN children
until a leaf has at most LEAF_FIT vectors of the sample. Every distinct vector is then put into the leaf that descending by
nearest centre leads to.

Search. A query keeps the nodes it hasn't opened in a priority queue by their distance to it, opens the nearest, and so visits
leaves best bin first. How many, is calibrated: up to CALIBRATE of the queries are answered by brute force over all vectors,
and leaf visits widen, one at a time, until the share of their true neighbours in visited leaves reaches RECALL.

Distribution. Equal vectors are one row with their smallest k + 1 ids (no answer can hold more), found by a salted ranking.
Neighbouring leaves are grouped until they have about BLOCK vectors, and a query is sent once to each group that holds leaves
it visits, with their list. A leaf that alone has more is dealt into blocks, and so are a group's queries beyond VISITS: a task
meets bounded blocks and no leaf, however hot, meets in one. A query keeps its k + 1 best of each block. What is broadcast is
the tree, by the sample's bound, with the group of each leaf.

Defined results: vectors that are null, zero, of another length than the most common, or hold null or non-finite numbers take
no part, neither do null ids; repeated rows of one id count as one, and of an id with several vectors the one with the
smallest hash asks; ties go to the smaller id; fewer candidates than k are all
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FIT_ROWS = 50_000
FAN = 16
LEAF_FIT = 384
ROUNDS = 8
CALIBRATE = 256
RECALL = 0.94
BLOCK = 1024
VISITS = 8192
SALTS = 64
EMPTY = "query_id bigint, rank int, vec_id bigint, score double, leaf_visits int, calibrated_recall double"


def valid(vec: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part."""
    x = lambda e: e.cast("double")
    bad = F.exists(vec, lambda e: e.isNull() | F.isnan(x(e)) | (F.abs(x(e)) == float("inf")))
    ok = vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda e: x(e) != 0)
    return F.coalesce(ok & (F.size(vec) == dims) if dims else ok, F.lit(False))


class Tree:
    """Nodes by number; the root is 0. Children of a node are a range; a leaf has none and a leaf number."""

    def __init__(self, rows: np.ndarray, top: float, seed: int = 3) -> None:
        """rows: distinct vectors; top: the largest squared norm of all vectors."""
        self.top = top
        self.centres = [np.zeros(rows.shape[1] + 1)]
        self.span: list[tuple[int, int]] = [(0, 0)]
        rng = np.random.default_rng(seed)
        wide = self.widened(rows)
        waiting = [(0, np.arange(len(wide)))]
        while waiting:
            node, own = waiting.pop()
            if len(own) <= LEAF_FIT:
                continue
            centres, label = self._split(wide[own], max(2, min(FAN, len(own) // (LEAF_FIT // 4))), rng)
            if len(centres) < 2:
                continue
            first = len(self.centres)
            self.span[node] = first, first + len(centres)
            self.centres += list(centres)
            self.span += [(0, 0)] * len(centres)
            waiting += [(first + k, own[label == k]) for k in range(len(centres))]
        self.centre = np.array(self.centres)
        self.half = (self.centre**2).sum(axis=1) / 2
        self.span_of = np.array(self.span)
        is_leaf = self.span_of[:, 1] == 0
        self.leaf = np.where(is_leaf, np.cumsum(is_leaf) - 1, -1)
        self.leaves = int(is_leaf.sum())
        del self.centres, self.span

    def widened(self, x: np.ndarray) -> np.ndarray:
        """With the coordinate that makes all norms equal."""
        return np.concatenate([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Centres that have rows, and the label of each row."""
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        label = np.zeros(len(x), np.int64)
        for _ in range(ROUNDS):
            label = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            n = np.bincount(label, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        some = np.flatnonzero(np.bincount(label, minlength=len(centres)))
        return centres[some], np.searchsorted(some, label)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by descending to the nearest centre."""
        wide, node = self.widened(x), np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if self.span_of[0, 1] else np.empty(0, np.int64)
        while len(live):
            for own in np.unique(node[live]):
                at = live[node[live] == own]
                lo, hi = self.span_of[own]
                node[at] = lo + (wide[at] @ self.centre[lo:hi].T - self.half[lo:hi]).argmax(axis=1)
            live = live[self.span_of[node[live], 1] > 0]
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order in which best-bin-first search visits them."""
        wide = np.append(q, 0.0)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            lo, hi = self.span_of[node]
            if not hi:
                out.append(int(self.leaf[node]))
                continue
            for d, child in zip((self.half[lo:hi] - self.centre[lo:hi] @ wide).tolist(), range(lo, hi), strict=True):
                heapq.heappush(queue, (d, child))
        return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _best(scores: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the columns of its k largest numbers and of all that equal the last."""
    n = scores.shape[1]
    if n <= k:
        yield from (np.arange(n) for _ in scores)
        return
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    for row, bound in zip(scores, least, strict=True):
        yield np.flatnonzero(row >= bound)


def _grouped(counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The group of each leaf, and how many blocks each group's vectors are dealt into."""
    group_of, sizes = np.zeros(len(counts), np.int64), [0]
    for leaf, n in enumerate(counts.tolist()):
        if sizes[-1] and sizes[-1] + n > BLOCK:
            sizes.append(0)
        group_of[leaf] = len(sizes) - 1
        sizes[-1] += n
    return group_of, [max(1, -(-n // BLOCK)) for n in sizes]


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """h, vec and ids: the smallest k + 1 ids of each distinct vector."""
    ranked = rows.withColumn("h", F.xxhash64("vec")).withColumn("r", F.dense_rank().over(W.partitionBy("h", "vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")))
    return ranked.filter(F.col("r") <= k + 1).groupBy("h", "vec").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))


def _truth(rows: DataFrame, queries: np.ndarray, tree: Tree, k: int, dims: int) -> list[tuple[int, float, int]]:
    """(query, score, leaf) of each query's k nearest distinct vectors, by brute force in blocks: each task sends k for each of the bounded queries."""
    held = rows.sparkSession.sparkContext.broadcast((queries, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, t = held.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(qs)
        for b in batches:
            x = _matrix(b.column(0), dims)
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                leaf, scores = t.assign(part), qs @ part.T
                for i, at in enumerate(_best(scores, k)):
                    s, f = np.concatenate([best[i][0], scores[i, at]]), np.concatenate([best[i][1], leaf[at]])
                    top = np.argsort(-s, kind="stable")[:k]
                    best[i] = s[top], f[top]
        q = np.repeat(np.arange(len(qs)), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_pydict({"q": q, "score": np.concatenate([s for s, _ in best] or [np.empty(0)]), "leaf": np.concatenate([f for _, f in best] or [np.empty(0, np.int64)])})

    near = rows.select("vec").mapInArrow(run, "q bigint, score double, leaf bigint")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "leaf"))).filter(F.col("r") <= k)
    return [(r["q"], r["score"], r["leaf"]) for r in near.collect()]  # at most CALIBRATE * k


def calibrated(rows: DataFrame, queries: np.ndarray, tree: Tree, k: int, dims: int, recall: float = RECALL) -> tuple[int, float]:
    """How many leaves to visit, and the recall that gives on the calibration queries."""
    near = _truth(rows, queries, tree, k + 1, dims)  # one more: a query finds itself
    if not near or tree.leaves < 2:
        return tree.leaves, 1.0
    order = [{leaf: n for n, leaf in enumerate(tree.visits(q, tree.leaves), 1)} for q in queries]
    needed = np.sort([order[q][leaf] for q, _, leaf in near])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest other rows; leaf_visits and calibrated_recall say how many leaves were visited and what share of the calibration queries' neighbours that found. is_query: over the table's columns."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("id").isNotNull())
    rows = rows.filter(valid(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], EMPTY)
    dims = sizes["n"]
    number = "float" if rows.schema["vec"].dataType.elementType == T.FloatType() else "double"
    rows = rows.filter(F.size("vec") == dims).withColumn("vec", F.col("vec").cast(f"array<{number}>"))
    own = materialize(_distinct(rows, k), "ann-distinct")
    asked = rows.filter("is_query").select("id", F.xxhash64("vec").alias("h"), "vec")
    distinct_asked = materialize(asked.groupBy("h", "vec").agg(F.min("id").alias("q")).select("q", "h", "vec"), "ann-queries")

    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top, n = own.agg(F.max(squares), F.count("*")).first()
    few = F.pmod(F.xxhash64(F.lit(1), F.col("h")), F.lit(1 << 30)) <= int(min(1.0, 1.3 * fit_rows / n) * (1 << 30))
    fitted = own.filter(few).orderBy(F.xxhash64("h"), "h").select("vec").limit(fit_rows).toArrow()
    tree = Tree(_matrix(fitted.column(0).combine_chunks(), dims), top)
    trial = distinct_asked.orderBy(F.xxhash64("h"), "h").select("vec").limit(CALIBRATE).toArrow()
    if not trial.num_rows:
        return spark.createDataFrame([], EMPTY)
    visits, reached = calibrated(own, _matrix(trial.column(0).combine_chunks(), dims), tree, k, dims, recall)
    held = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.assign(_matrix(b.column(1), dims)), pa.int32()), *b.columns], names=["leaf", "h", "vec", "ids"])

    leafed = materialize(own.select("h", "vec", "ids").mapInArrow(placed, f"leaf int, h bigint, vec array<{number}>, ids array<bigint>"), "ann-leaves")
    counts = np.zeros(tree.leaves, np.int64)
    for r in leafed.groupBy("leaf").count().collect():  # one a leaf
        counts[r["leaf"]] = r["count"]
    group_of, row_blocks = _grouped(counts)
    grouped = spark.sparkContext.broadcast(group_of)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("group", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        for b in batches:
            out = []
            for q in _matrix(b.column(2), dims):
                by: dict[int, list[int]] = {}
                for leaf in held.value.visits(q, visits):
                    by.setdefault(int(grouped.value[leaf]), []).append(leaf)
                out.append([{"group": g, "leaves": leaves} for g, leaves in by.items()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=["q", "h", "vec", "groups"])

    probes = materialize(distinct_asked.mapInArrow(visited, f"q bigint, h bigint, vec array<{number}>, groups array<struct<group: int, leaves: array<int>>>"), "ann-visits")
    n_visits = {r["group"]: r["count"] for r in probes.select(F.explode("groups.group").alias("group")).groupBy("group").count().collect()}  # at most one a leaf
    blocks = [(g, n, -(-n_visits[g] // VISITS)) for g, n in enumerate(row_blocks) if g in n_visits]
    blocks = F.broadcast(spark.createDataFrame(blocks, "group int, row_blocks int, visit_blocks int"))
    leaf_groups = F.broadcast(spark.createDataFrame(list(enumerate(group_of.tolist())), "leaf int, group int"))

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    left = leafed.join(leaf_groups, "leaf").join(blocks, "group").select("group", mine("row_blocks").alias("rb"), each("visit_blocks").alias("vb"), F.array("leaf").alias("leaves"), F.lit(None).cast("bigint").alias("q"), "h", "vec", "ids")
    right = probes.select("q", "h", "vec", F.explode("groups").alias("g")).select("q", "h", "vec", "g.group", "g.leaves").join(blocks, "group").select("group", each("row_blocks").alias("rb"), mine("visit_blocks").alias("vb"), "leaves", "q", "h", "vec", F.lit(None).cast("array<bigint>").alias("ids"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a pair of blocks come before its queries."""
        now, xs, ids, leaves, held_x = None, [], [], [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            is_query = b.column(7).is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                part, key = b.slice(lo, hi - lo), tuple(keys[lo])
                if key != now:
                    now, xs, ids, leaves, held_x = key, [], [], [], None
                if not is_query[lo]:
                    xs.append(_matrix(part.column(6), dims))
                    ids += part.column(7).to_pylist()
                    leaves.append(part.column(3).flatten().to_numpy())
                    held_x = None
                    continue
                if not xs:
                    continue
                if held_x is None:
                    leaf = np.concatenate(leaves)
                    order = np.argsort(leaf, kind="stable")
                    held_x, ids, leaf = np.concatenate(xs)[order], [ids[i] for i in order], leaf[order]
                    own, first = np.unique(leaf, return_index=True)
                    spans = list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(leaf)], strict=True))
                    xs, leaves = [held_x], [leaf]
                for a in range(0, len(part), 1024):
                    some = part.slice(a, 1024)
                    q = _matrix(some.column(6), dims)
                    wanted = some.column(3)
                    asks = np.repeat(np.arange(len(some)), np.diff(wanted.offsets.to_numpy()))
                    asked_leaf = wanted.flatten().to_numpy()
                    scores = np.full((len(q), len(held_x)), -np.inf)
                    for leaf, f, t in spans:
                        who = asks[asked_leaf == leaf]
                        scores[who, f:t] = q[who] @ held_x[f:t].T
                    at = [o[row[o] > -np.inf] for o, row in zip(_best(scores, k + 1), scores, strict=True)]
                    exact = [np.einsum("ij,j->i", held_x[o], v) for o, v in zip(at, q, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(4), some.column(5), pa.array([[ids[i] for i in o] for o in at], schema.field(2).type), pa.array(exact, schema.field(3).type)], schema=schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 best vectors of each query from those of its blocks, which come one after another."""
        now, best, done = None, [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], pa.int64()) for i in (0, 1)] + [pa.array([[i for _, i in d[1]] for d in done], schema.field(2).type), pa.array([[-s for s, _ in d[1]] for d in done], schema.field(3).type)], schema=schema)

        for b in batches:
            for q, h, ids, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (q, h) != now:
                    if now:
                        done.append((now, best))
                    now, best = (q, h), []
                best = sorted([*best, *((-s, i) for s, i in zip(scores, ids, strict=True))])[: k + 1]
            if len(done) > 1000:
                yield rows()
                done = []
        if now:
            done.append((now, best))
            yield rows()

    schema = pa.schema([("q", pa.int64()), ("h", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64()))), ("scores", pa.list_(pa.float64()))])
    made = "q bigint, h bigint, ids array<array<bigint>>, scores array<double>"
    dealt = left.union(right).repartition("group", "rb", "vb").sortWithinPartitions("group", "rb", "vb", F.col("ids").isNull())
    found = dealt.mapInArrow(met, made).repartition("q", "h").sortWithinPartitions("q", "h").mapInArrow(merged, made)
    best = materialize(found, "ann-best")
    one = F.flatten(F.transform(F.arrays_zip("ids", "scores"), lambda e: F.transform(e["ids"], lambda i: F.struct((-e["scores"]).alias("less"), i.alias("vec_id")))))
    class_of = asked.join(distinct_asked.select("q", "h", "vec"), ["h", "vec"]).select("id", "q", "h")
    class_of = class_of.groupBy("id").agg(F.min(F.struct("h", "q")).alias("c")).select("id", "c.*")
    out = class_of.join(best, ["q", "h"]).select(F.col("id").alias("query_id"), F.slice(F.array_sort(F.filter(one, lambda e: e["vec_id"] != F.col("id"))), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.less")).alias("score"), F.lit(visits).alias("leaf_visits"), F.lit(reached).alias("calibrated_recall"))
