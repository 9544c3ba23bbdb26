"""SimHash near-duplicates, with candidates from pigeonring filtering.

A 64-bit fingerprint is four segments of 16 bits in a ring. If two fingerprints differ in at most 3 bits, some segment
starts a chain in which 1, 2 and 3 consecutive segments differ in at most 0, 1 and 2 bits (the whole parts of 3/4, 6/4
and 9/4). Rows therefore meet on (ring position, first segment, second segment), where one side may also clear any one
set bit of its second segment; the third link of the chain prunes what meets before the full Hamming check.

Only different fingerprints are compared, so copies cost one row. A task that has the rows of some keys keeps a forest
of the links it has verified and emits that, at most one row a fingerprint, so no group is expanded into all its pairs.
Components come from the forests by alternating large-star and small-star steps, each written to the shared folder.

Defined results: null and blank texts have fingerprint zero, which links like any other; repeated rows are copies; an
empty table gives an empty result; a component of only null ids has a null component id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, unused

BITS = 3
SEGMENT = 16
SEED = 42


def fingerprint(tokens: list[bytes], n: int) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    if not tokens:
        return 0
    one = xxhash.xxh64_intdigest
    if len(tokens) <= n:
        return one(b" ".join(tokens), SEED)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(n)), strict=False))
    h = np.fromiter((one(s, SEED) for s in shingles), dtype=">u8", count=len(tokens) - n + 1)
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64) if len(h) < 4096 else sum(np.unpackbits(octets[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 4096))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed, for Spark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), words) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _ring_rows(fps: DataFrame) -> DataFrame:
    """key, fp, probe: each fingerprint under its own two segments, and as a probe with one set bit of the second cleared."""

    def at(i: int) -> Column:
        """Rows for the ring position i. A lambda here takes one argument: a second one would be the element's index."""
        turned = F.shiftleft("fp", SEGMENT * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - SEGMENT * i)) if i else F.col("fp")
        key = F.shiftrightunsigned(turned, 32).bitwiseOR(F.lit(i << 32))
        bits = F.array(*(F.lit(1 << b).cast("bigint") for b in range(SEGMENT)))
        cleared = F.transform(F.filter(bits, lambda b: key.bitwiseAND(b) != 0), lambda b: F.struct(key.bitwiseXOR(b).alias("key"), F.lit(True).alias("probe")))
        return F.concat(F.array(F.struct(key.alias("key"), F.lit(False).alias("probe"))), cleared)

    rows = [at(i) for i in range(4)]
    return fps.select("fp", F.explode(F.concat(*rows)).alias("r")).select("r.key", "fp", "r.probe")


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (p := self.up.setdefault(a, a)) != a:
            self.up[a] = a = self.up[p]
        return a

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _verified(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a fingerprint's own row and a later row with its key; rows are sorted by key, own rows before probes."""
    turn = (np.uint64(SEGMENT) * (key >> 32).astype(np.uint64)) % np.uint64(64)
    back = (np.uint64(64) - turn) % np.uint64(64)
    at, step = np.flatnonzero(~probe), 1
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        a, b = at, at + step
        x = fp[a] ^ fp[b]
        ring = (x << turn[a]) | np.where(back[a] > 0, x >> back[a], np.uint64(0))
        ok = (np.bitwise_count(ring >> np.uint64(SEGMENT)) <= 2) & (np.bitwise_count(x) <= bits) & (x != 0)
        if ok.any():
            yield fp[a[ok]], fp[b[ok]]
        step += 1


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: a forest for each task over the pairs within the distance, which may be up to BITS; fps: one column fp, distinct."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"candidates are complete for distances up to {BITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        rest = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))

        def new(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            found = [(x, y) for a, b in _verified(*cols, bits) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.link(x, y)]
            if found:
                both = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for b in batches:
            own = (b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
            rest = tuple(np.concatenate(x) for x in zip(rest, own, strict=True))
            if len(rest[0]):
                cut = int(np.searchsorted(rest[0], rest[0][-1]))
                yield from new(tuple(x[:cut] for x in rest))
                rest = tuple(x[cut:] for x in rest)
        yield from new(rest)

    return _ring_rows(fps).repartition("key").sortWithinPartitions("key", "probe").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """node, root: the smallest node reachable, of each node that has an edge; others are their own root, as callers add. cut: writes a table and reads it again.

    Both steps put one edge in an edge's place, with ends that are no greater. So if a round leaves as many edges, with the same sum of their ends, it has
    changed none of them, and all are stars.
    """
    both = lambda e: e.union(e.select("b", "a"))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        size = edges.agg(F.count("*"), *(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)) for c in "ab")).first()
        if size == before or not size[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = size
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(small, "edges")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", cut: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint as a number) and component_id (its smallest id)."""
    rows = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(own.select("fp"), bits), cut)
    known = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(known, "components")
    groups = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(groups, "root").select("fp", "root", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(numbered: DataFrame, groups: DataFrame, id_col: str, row: str, cut: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Of the rows with a number in the column `row` the one with the smallest id in each group, nulls last; groups: row, root."""
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    kept = groups.join(ids, "row").groupBy("root").agg(F.min(order)["row"].alias(row))
    return numbered.join(cut(kept.select(row), "kept"), row, "left_semi").drop(row)


def keep_one(docs: DataFrame, words: int = 3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with its smallest id, with all the columns it came with. Rows are told apart by a number, not by id."""
    steps, lasting = Scratch(), Scratch()
    row = unused("_row", docs)
    numbered = lasting.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, words, bits, row, text_col, steps.cut).select(F.col("doc_id").alias("row"), "root")
    out = one_of_each(numbered, groups, id_col, row, lasting.cut)
    steps.clear()
    return lasting.held_by(out)
