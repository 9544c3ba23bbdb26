"""Language-model scoring with a probabilistic suffix tree over words.

Tree. A context is the one to ORDER words before a position (starts of texts are marked). Every context that the training
texts hold twice or more is a candidate, whatever the size of the corpus, and every word is a symbol of its own. A candidate
stays if its next words diverge from what its suffix predicts: the log-likelihood gain over its tokens must exceed half the
logarithm of its count for each different next word. A state's distribution is smoothed towards that of its longest retained
suffix (PRIOR and GROWTH below), the empty context's is (c+1)/(N+V+1), and a position is scored in the state of its longest
retained suffix, so a text's score is the log10 of a proper probability. The prediction that a candidate is tested against
takes all candidates among its suffixes. The start of a text is kept as a context without a test.

Counts. Texts are dealt into chunks of whole texts, a row each, in which words are numbers. What contexts, their next words
and the tests need is always a sum by key over all chunks: a chunk sends one entry for each distinct key, packed by range of
the key's hash; a range is summed by one task, and each chunk gets the sums of its own keys back. So no word or context is hot
(a chunk sends it once), no table is broadcast, and what is gathered grows with the input.

Words are known by 64-bit hashes, longer runs by as many bits as the corpus has plus SPARE: one in 2^SPARE shares its counts
with another run, at every size.

Defined results: null and empty texts are one end token; null ids are hashed as the empty text; repeated rows are scored
alike and count each time; an empty table gives an empty result; without training rows every word is unseen; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize

ORDER = 2
#: A context of n tokens is smoothed with PRIOR * n ** GROWTH tokens: different next words grow as a power of n.
PRIOR, GROWTH = 2.0, 0.85
SPARE = 16
#: Tokens after which a task starts a new chunk.
CHUNK = 1 << 20
#: Keys that a range holds, about; and the least number of ranges.
RANGE, RANGES = 1 << 20, 256
#: The token after a text's words, which no word can be, and what stands before a text.
END, START = b"\n", np.uint64(0x9E3779B97F4A7C15)


def pack(x: np.ndarray) -> bytes:
    """How many numbers, then the planes of their bytes, compressed: small numbers leave runs of zeros, and a plane of few values takes few bits."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(x: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: ids, held, sizes of its texts in tokens, tokens (places in words) and words (hashes in order)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), count()

        def flush() -> pa.RecordBatch:
            seen = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            words, place = np.unique(seen, return_inverse=True)
            tokens = place.astype(np.uint32)[np.concatenate(texts)]
            cells = [pa.array([(part << 20) + next(made)]), pa.array([ids], pa.list_(kind)), pa.array([held]), pa.array([list(map(len, texts))], pa.list_(pa.int32())), pa.array([pack(tokens)], pa.binary()), pa.array([pack_sorted(words)], pa.binary())]
            return pa.record_batch(cells, names=["chunk", "ids", "held", "sizes", "tokens", "words"])

        number: dict[bytes, int] = defaultdict(count().__next__)
        ids, held, texts, size, kind = [], [], [], 0, None
        for b in batches:
            kind = b.column(0).type
            for i, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                words = [*(t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), END]
                ids.append(i.as_py())
                held.append(h.as_py())
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= CHUNK:
                    yield flush()
                    number, ids, held, texts, size = defaultdict(count().__next__), [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, f"chunk bigint, ids array<{id_type}>, held array<boolean>, sizes array<int>, tokens binary, words binary")


class Chunk:
    """A chunk's texts, and for each length of run its distinct keys and the place among them of the run that ends at a position."""

    def __init__(self, row: dict, longest: int, bits: int) -> None:
        self.id, self.ids, self.held = row["chunk"], row["ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        tokens, words = unpack(row["tokens"], np.uint32), unpack_sorted(row["words"])
        self.learnt = np.repeat(~self.held, self.sizes)
        self.keys, self.place = [words], [tokens.astype(np.int64)]
        own = words[tokens]
        run = own
        for _ in range(1, longest):
            run = mixed(self.before(run, START) * np.uint64(3) + own)
            keys, place = np.unique(run >> np.uint64(64 - bits), return_inverse=True)
            self.keys.append(keys)
            self.place.append(place)

    def before(self, x: np.ndarray, start: object) -> np.ndarray:
        """What x is one position earlier; start where texts begin."""
        out = np.roll(x, 1)
        out[self.first] = start
        return out


class Layout:
    """The tree's parameters, and how keys are dealt into ranges: a range's number holds the length of run and the high bits of the key."""

    def __init__(self, size: int, order: int, prior: float, growth: float) -> None:
        self.order, self.prior, self.growth = order, prior, growth
        self.bits = min(64, max(size, 1).bit_length() + SPARE)
        self.high = max(RANGES, size // RANGE).bit_length() - 1

    def dealt(self, length: int, keys: np.ndarray) -> np.ndarray:
        """How many of the sorted keys each range gets."""
        width = (64 if length == 1 else self.bits) - self.high
        return np.bincount((keys >> np.uint64(width)).astype(np.int64), minlength=1 << self.high)

    def send(self, chunk: int, length: int, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        sizes = self.dealt(length, keys)
        ends = np.cumsum(sizes)
        for b in np.flatnonzero(sizes).tolist():
            lo, hi = ends[b] - sizes[b], ends[b]
            yield chunk, (length << self.high) + b, pack_sorted(keys[lo:hi]), pack(values[lo:hi])


SENT = "chunk bigint, range bigint, keys binary, own binary"
#: For each row that was sent, the sums of its keys; and for single words tokens and distinct words of a range, in a row without chunk.
SUMS = "chunk bigint, range bigint, sums binary, tokens bigint, distinct bigint"


def _sent(rows: Iterator[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    c, r, k, v = zip(*got, strict=True) if (got := list(rows)) else ([], [], [], [])
    return pa.record_batch([pa.array(c, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["chunk", "range", "keys", "own"])


def _summed(sent: DataFrame, layout: Layout, tests: bool) -> DataFrame:
    """Sums by key over all chunks, back in the rows that were sent; of tests only whether the sum is above zero, with negative lengths in the range."""
    high = layout.high

    def merge(t: pa.Table) -> pa.Table:
        at, own = [unpack_sorted(x) for x in t["keys"].to_pylist()], [unpack(x, np.float32 if tests else np.uint32) for x in t["own"].to_pylist()]
        keys, place = np.unique(np.concatenate(at), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(own))
        back = np.split(sums[place], np.cumsum([len(x) for x in at])[:-1])
        ranges = t["range"].to_pylist()
        chunks, numbers = t["chunk"].to_pylist(), [-r for r in ranges] if tests else ranges
        made = [np.packbits(x > 0).tobytes() if tests else pack(x.astype(np.uint64)) for x in back]
        tokens, distinct = [None] * len(made), [None] * len(made)
        if not tests and ranges[0] >> high == 1:
            chunks, numbers, made = [*chunks, None], [*numbers, ranges[0]], [*made, None]
            tokens, distinct = [*tokens, int(sums.sum())], [*distinct, int((sums > 0).sum())]
        return pa.table([pa.array(chunks, pa.int64()), pa.array(numbers, pa.int64()), pa.array(made, pa.binary()), pa.array(tokens, pa.int64()), pa.array(distinct, pa.int64())], names=["chunk", "range", "sums", "tokens", "distinct"])

    return sent.groupBy("range").applyInArrow(merge, SUMS)


class Position:
    """A chunk with the counts over the corpus, and what each order of contexts says of each position."""

    def __init__(self, row: dict, back: pa.Table, layout: Layout, tokens: int, vocab: int, starts: int) -> None:
        self.chunk = Chunk(row, layout.order + 1, layout.bits)
        back = back.sort_by("range")
        numbers, packed = back["range"].to_numpy(), back["sums"].to_pylist()
        length = np.abs(numbers) >> layout.high
        self.n = [np.concatenate([unpack(packed[i], np.uint64) for i in np.flatnonzero((numbers > 0) & (length == k))]).astype(np.float64) for k in range(1, layout.order + 2)]
        self.tests = {k: [packed[i] for i in np.flatnonzero((numbers < 0) & (length == k))[::-1]] for k in range(1, layout.order + 1)}
        self.layout, self.starts, self.c = layout, starts, self.n[0][self.chunk.place[0]]
        self.root = (self.c + 1) / (tokens + vocab + 1)

    def candidates(self, k: int) -> np.ndarray:
        return self.n[k - 1] >= 2

    def steps(self, keep: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: it, the place of each position's context (-1: a text's start), its count, the count with the next word, whether it holds, and the prediction of the order before."""
        p = self.root
        for k in range(1, self.layout.order + 1):
            at = self.chunk.before(self.chunk.place[k - 1], -1)
            total = np.where(at < 0, self.starts, self.n[k - 1][at])
            both = self.n[k][self.chunk.place[k]]
            holds = np.where(at < 0, self.starts >= 2, keep[k - 1][at])
            yield k, at, total, both, holds, p
            prior = self.layout.prior * total**self.layout.growth
            p = np.where(holds, (both + prior * p) / np.maximum(total + prior, 1), p)
        self.last = p

    def tested(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """For each candidate what this chunk adds to its gain less its bar: a sum over positions, since each next word's share of the bar is dealt over its tokens."""
        for k, at, total, both, holds, p in self.steps([self.candidates(k) for k in range(1, self.layout.order + 1)]):
            use = holds & self.chunk.learnt & (at >= 0)
            gain = np.log(both[use] / total[use] / p[use]) - 0.5 * np.log(total[use] + 1) / both[use]
            sums = np.bincount(at[use], weights=gain, minlength=len(self.n[k - 1]))
            some = self.candidates(k)
            yield from self.layout.send(self.chunk.id, k, self.chunk.keys[k - 1][some], sums[some].astype(np.float32))

    def retained(self) -> list[np.ndarray]:
        out = []
        for k in range(1, self.layout.order + 1):
            some = self.candidates(k)
            keep = np.zeros(len(some), bool)
            sizes = self.layout.dealt(k, self.chunk.keys[k - 1][some])
            bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=s) for x, s in zip(self.tests[k], sizes[sizes > 0], strict=True)]
            keep[some] = np.concatenate(bits).astype(bool) if bits else False
            out.append(keep)
        return out


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, growth: float = GROWTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, one added) and score (the tree's), of whole texts; rows that are held out aren't learnt from."""
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = materialize(_chunks(docs, held_out if held_out is not None else is_held_out(F.col(id_col), 7, 2), id_col, text_col), "lm-chunks")
    size, starts = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    layout = Layout(size, order, prior, growth)

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk(b.slice(i, 1).to_pylist()[0], order + 1, layout.bits)
                for k, (keys, place) in enumerate(zip(c.keys, c.place, strict=True), 1):
                    yield _sent(layout.send(c.id, k, keys, np.bincount(place[c.learnt], minlength=len(keys)).astype(np.uint32)))

    sums = materialize(_summed(chunks.mapInArrow(count_runs, SENT), layout, False), "lm-counts", free=True)
    tokens, vocab = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    counts = sums.filter(F.col("chunk").isNotNull())
    by_chunk = chunks.groupBy("chunk")

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_sent(Position(left.to_pylist()[0], right, layout, tokens, vocab, starts).tested())])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Position(left.to_pylist()[0], right, layout, tokens, vocab, starts)
        for _ in p.steps(p.retained()):
            pass
        add, c = np.add.reduceat, p.chunk
        return pa.table(
            [pa.array(c.ids, left.schema.field("ids").type.value_type), pa.array(c.held), pa.array(c.sizes), pa.array(add((p.c > 0).astype(np.int64), c.first)), pa.array(add(np.log10(p.c + 1), c.first) - c.sizes * np.log10(tokens + vocab + 1)), pa.array(add(np.log10(p.last), c.first))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    tests = materialize(_summed(by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(test, SENT), layout, True), "lm-tests", free=True)
    made = by_chunk.cogroup(counts.union(tests).groupBy("chunk")).applyInArrow(final, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
