"""Vector code compression: product codes with integer codebooks.

A component x becomes the integer floor(SCALE * x), all floors going down; a vector is cut into PARTS consecutive parts, the
first ones one component longer where they can't be equal. Each part position has a codebook of ENTRIES entries, which starts
as that part of the first vectors by id. A round sends the codebooks to the tasks (their size doesn't depend on the table),
assigns every part to its nearest entry in Arrow batches (squared distances by norm expansion and exact int64 matrix products,
ties to the first), sums the parts of each entry in the task, and merges these sums, PARTS * ENTRIES rows a task, by a grouped
shuffle; the driver gets one row an entry. Vectors are read in each round and never shuffled.

Defined results: vectors that are null or hold null or non-finite components take no part; neither do vectors of another length
than the most common (ties to the shorter), nor those with a component whose integer is LARGEST or more in size, since errors
wouldn't fit a long; fewer vectors than ENTRIES make as many entries; the first vectors are those with the smallest ids, rows of
one id by their vector, null ids last; repeated rows count each time; null labels are one label; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 26
#: Vectors whose distances are computed at once.
AT_ONCE = 4096
CODED = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"


def usable(vec: Column, scale: int, largest: int) -> Column:
    """Whether a vector takes part: no component is null, non-finite or too large."""
    small = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < largest - 1, F.lit(False)))
    return F.coalesce(vec.isNotNull() & small, F.lit(False))


def common_length(rows: DataFrame, vec: str) -> tuple[int, int] | None:
    """The most common length of the vectors and how many have it; None without any."""
    most = rows.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return tuple(most) if most else None


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The integers of a batch of vectors, one row each."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(x * scale).astype(np.int64).reshape(len(column), dims)


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(dims), parts))]).tolist()
    return list(zip(ends, ends[1:], strict=False))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    d = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _sums(rows: DataFrame, books: list[np.ndarray], dims: int, scale: int) -> list[np.ndarray]:
    """For each part, by entry: how many parts are assigned to it, then the sums of their components."""
    spans = cuts(dims, len(books))
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(book), 1 + hi - lo), np.int64) for book, (lo, hi) in zip(held.value, spans, strict=True)]
        for b in batches:
            for first in range(0, b.num_rows, AT_ONCE):
                x = integers(b.column(0).slice(first, AT_ONCE), dims, scale)
                for sums, book, (lo, hi) in zip(total, held.value, spans, strict=True):
                    at, _ = nearest(x[:, lo:hi], book)
                    sums[:, 0] += np.bincount(at, minlength=len(book))
                    order = np.argsort(at, kind="stable")
                    entries, starts = np.unique(at[order], return_index=True)
                    sums[entries, 1:] += np.add.reduceat(x[order, lo:hi], starts, axis=0)
        cells = [(p, e, i, v) for p, sums in enumerate(total) for e in np.flatnonzero(sums[:, 0]).tolist() for i, v in enumerate(sums[e].tolist())]
        kinds = {"part": pa.int32(), "entry": pa.int32(), "place": pa.int32(), "value": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells, strict=True) if cells else [()] * 4, kinds.values(), strict=True)], names=list(kinds))

    merged = rows.select("vec").mapInArrow(run, "part int, entry int, place int, value bigint").groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    out = [np.zeros((len(book), 1 + hi - lo), np.int64) for book, (lo, hi) in zip(books, spans, strict=True)]
    for r in merged.collect():  # at most one a component of the codebooks
        out[r["part"]][r["entry"], r["place"]] = r["value"]
    held.unpersist()
    return out


def learn(rows: DataFrame, dims: int, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part; rows: id and vec, all usable and of one length."""
    first = rows.orderBy(F.asc_nulls_last("id"), "vec").select("vec").limit(entries).toArrow().column(0).combine_chunks()
    start = integers(first, dims, scale)
    books = [start[:, lo:hi].copy() for lo, hi in cuts(dims, parts)]
    for _ in range(rounds if len(start) else 0):
        for book, sums in zip(books, _sums(rows, books, dims, scale), strict=True):
            some = sums[:, 0] > 0
            book[some] = sums[some, 1:] // sums[some, :1]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def decode(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """The integers that codes stand for."""
    return np.concatenate([book[[int(c[2 * p : 2 * p + 2], 16) for c in codes]] for p, book in enumerate(books)], axis=1)


def encode(rows: DataFrame, books: list[np.ndarray], dims: int, scale: int = SCALE) -> DataFrame:
    """code (two hex digits a part) and error beside the other columns of rows, whose first is vec."""
    spans = cuts(dims, len(books))
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(first, AT_ONCE)
                x = integers(b.column(0), dims, scale)
                found = [nearest(x[:, lo:hi], book) for book, (lo, hi) in zip(held.value, spans, strict=True)]
                digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                width = 2 * len(spans)
                codes = pa.array([digits[i : i + width] for i in range(0, len(digits), width)], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], codes, pa.array(sum(e for _, e in found))], names=[*b.schema.names[1:], "code", "error"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{rest}, code string, error bigint")


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the errors of its label summed) and codebooks_sha256 of each vector that takes part."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("an index has two hex digits, so a codebook has 1 to 256 entries")
    own = rows.select(F.col(vec_col).alias("vec"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label")).filter(usable(F.col("vec"), scale, LARGEST))
    most = common_length(own, "vec")
    if most is None:
        return rows.sparkSession.createDataFrame([], CODED)
    dims = most[0]
    own = own.filter(F.size("vec") == dims)
    books = learn(own, dims, scale, parts, entries, rounds)
    coded = materialize(encode(own, books, dims, scale), "product-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
