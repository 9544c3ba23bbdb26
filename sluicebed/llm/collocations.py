"""Phrase collocation mining: candidates from a sketch's upper bounds, exact counts from Aho-Corasick automata.

Texts are lower-cased (A-Z), split into pieces at PIECE_ENDS and the pieces into words at spaces and tabs. Pieces of one language
are dealt into shards of about SHARD words, a row each.

Sketch. Every run of 1 to `longest` words within a piece falls, by a hash of its language and words, on one of W counters; W is a
power of two that is at least the number of runs in the table, so the sketch grows with the table and what runs add to each
other's counters stays near one. A shard sends one count for each of its counters, packed by range of counters; a task sums a
range, and each shard gets back which of its counters reach the threshold. A counter is never below a run's own count, so no
phrase is lost. No table is broadcast.

Count. The candidates of a shard are its runs whose counters, and those of the runs within them, reach the threshold. They are
compiled into an automaton, each word with a delimiter before and after it, and the shard's text is scanned for all overlapping
matches. Counts are summed over shards by language and phrase, exactly: a shard packs its phrases by range of their hash, and a
task sums a range of a language; then the threshold holds, and only phrases that reach it are rows.

Scores are integers: floor(SCALE * a * n / (l * r)) of the lowest-scoring cut, in decimals of 38 digits, so counts may be up to
10^14. A candidate within a longer one that is (at least `share` hundredths) as frequent is dropped.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count each time; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .suffix_tree import mixed, pack, pack_sorted, unpack, unpack_sorted

LEAST, LONGEST, MOST, SHARE, SCALE = 100, 5, 2000, 100, 1000
#: The bytes that end a piece are read as the last one of them, which stands as a word between pieces.
PIECE_ENDS, BREAK = b".,;:!?\x0b\x0c\x0d\x0a", b"\n"
_ENDS = bytes.maketrans(PIECE_ENDS, BREAK * len(PIECE_ENDS))
_WORDS = re.compile(rb"[^ \t\n]+|\n")
#: Words after which a task starts new shards; counters of a range, at most, and the least number of ranges.
SHARD, RANGE, RANGES = 1 << 20, 1 << 24, 64
#: Words of the table for each range that phrases are summed in, about.
SUMMED = 1 << 22
SENT = "shard bigint, range int, keys binary, counts binary"


def _shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """A row for each shard: lang, n (words without breaks), words (distinct, joined by spaces; the first is the break) and tokens (places in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), count()
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (number, texts) in held.items():
                tokens = np.concatenate(texts)
                if n := int((tokens > 0).sum()):
                    cells = [pa.array([(part << 24) + next(made)]), pa.array([lang]), pa.array([n]), pa.array([b" ".join(number)], pa.binary()), pa.array([pack(tokens)], pa.binary())]
                    yield pa.record_batch(cells, names=["shard", "lang", "n", "words", "tokens"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                words = _WORDS.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(_ENDS))
                if (own := held.get(lang := lang.as_py())) is None:
                    own = held[lang] = (defaultdict(count().__next__), [])
                    own[0][BREAK]
                own[1].append(np.fromiter(map(own[0].__getitem__, words), np.uint32, len(words)))
                own[1].append(np.zeros(1, np.uint32))
                size += len(words)
                if size >= SHARD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "shard bigint, lang string, n bigint, words binary, tokens binary")


class Shard:
    """A shard's words, and the counter of the run of each length that ends at a position."""

    def __init__(self, row: dict, longest: int, bits: int) -> None:
        self.id, self.lang, self.longest = row["shard"], row["lang"], longest
        self.words, self.tokens = row["words"].split(b" "), unpack(row["tokens"], np.uint32)
        seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[self.tokens]
        at = np.arange(len(self.tokens))
        #: How many words of its piece stand up to a position.
        self.into = at - np.maximum.accumulate(np.where(self.tokens == 0, at, -1))
        run, self.counters = own, []
        for k in range(longest):
            if k:
                run = mixed(np.concatenate([own[:1], run[:-1]]) * np.uint64(3) + own)
            self.counters.append(run >> np.uint64(64 - bits))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The counters that the shard's runs fall on, sorted, and how many fall on each."""
        return np.unique(np.concatenate([c[self.into > k] for k, c in enumerate(self.counters)]), return_counts=True)

    def phrases(self, high: np.ndarray) -> list[bytes]:
        """The candidates: runs whose counters are all among `high` (sorted). Runs are told apart by the number of the run without its last word, and that word."""
        out: list[bytes] = []
        number, held, size = np.zeros(len(self.tokens), np.int64), np.ones(len(self.tokens), bool), 1
        for k, counters in enumerate(self.counters):
            before, was = np.concatenate([[0], number[:-1]]), np.concatenate([[False], held[:-1]])
            ok = held & (was if k else True) & (self.into > k)  # the run without its first word, and without its last
            at = np.flatnonzero(ok)
            place = np.minimum(np.searchsorted(high, counters[at]), max(len(high) - 1, 0))
            at = at[high[place] == counters[at]] if len(high) else at[:0]
            runs, first, of = np.unique((before[at] if k else np.zeros(len(at), np.int64)) * len(self.words) + self.tokens[at], return_index=True, return_inverse=True)
            out += [b" ".join([self.words[t] for t in self.tokens[e - k : e + 1]]) for e in at[first].tolist()]
            held, size = np.zeros(len(self.tokens), bool), len(runs)
            held[at], number[at] = True, of
            if not size:
                break
        return out

    def matches(self, phrases: list[bytes]) -> np.ndarray:
        """How often each phrase stands in the text, overlapping matches included. Bytes are read as characters of their own."""
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            automaton.add_word(f" {p.decode('latin-1')} ", i)
        automaton.make_automaton()
        text = b" %s " % b" ".join([self.words[t] for t in self.tokens.tolist()])
        found = np.fromiter(map(itemgetter(1), automaton.iter(text.decode("latin-1"))), np.int64)
        return np.bincount(found, minlength=len(phrases))


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k (words) and a of all runs of 1 to `longest` words that stand `least` times or more; and lang and n, all its words."""
    scratch = scratch or Scratch()
    shards = scratch.cut(_shards(docs, lang_col, text_col), "phrase-shards")
    size = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(12, (max(size, 1) * longest - 1).bit_length())
    high = max(RANGES, (1 << bits) // RANGE).bit_length() - 1
    width, parts = bits - high, max(RANGES, size // SUMMED)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], longest, bits)
                keys, n = shard.sums()
                ends = np.searchsorted(keys, np.arange(1, (1 << high) + 1, dtype=np.uint64) << np.uint64(width))
                spans = [(r, lo, hi) for r, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) if hi > lo]
                cells = [pa.array([shard.id] * len(spans), pa.int64()), pa.array([r for r, _, _ in spans], pa.int32()), pa.array([pack_sorted(keys[lo:hi]) for _, lo, hi in spans], pa.binary()), pa.array([pack(n[lo:hi].astype(np.uint32)) for _, lo, hi in spans], pa.binary())]
                yield pa.record_batch(cells, names=["shard", "range", "keys", "counts"])

    def reached(t: pa.Table) -> pa.Table:
        base = np.uint64(t["range"][0].as_py()) << np.uint64(width)
        sums = np.zeros(1 << width, np.int64)
        at = lambda x: (unpack_sorted(x.as_py()) - base).astype(np.int64)
        for k, n in zip(t["keys"], t["counts"], strict=True):
            sums[at(k)] += unpack(n.as_py(), np.uint32)
        full = sums >= least
        made = [np.packbits(full[at(k)]).tobytes() for k in t["keys"]]
        return pa.table({"shard": t["shard"], "range": t["range"], "reached": pa.array(made, pa.binary())})

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left.to_pylist()[0], longest, bits)
        keys, _ = shard.sums()
        right = right.sort_by("range")
        ends = np.searchsorted(keys, np.arange(1, (1 << high) + 1, dtype=np.uint64) << np.uint64(width)).tolist()
        sizes = [hi - lo for lo, hi in zip([0, *ends], ends, strict=False) if hi > lo]
        full = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(right["reached"].to_pylist(), sizes, strict=True)]).astype(bool)
        phrases = shard.phrases(keys[full])
        found = shard.matches(phrases) if phrases else np.empty(0, np.int64)
        of = np.fromiter((xxhash.xxh32_intdigest(p) for p in phrases), np.int64, len(phrases)) % parts
        rows = []
        for part in np.unique(of).tolist():
            own = np.flatnonzero(of == part)
            text = BREAK.join([phrases[i] for i in own.tolist()])
            rows.append((shard.lang, part, len(text), pa.compress(text, codec="zstd", asbytes=True), pack(found[own].astype(np.uint32))))
        kinds = {"lang": pa.string(), "part": pa.int32(), "size": pa.int64(), "phrases": pa.binary(), "counts": pa.binary()}
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds.values(), strict=True)], names=list(kinds))

    def summed(t: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        for size, text, n in zip(t["size"].to_pylist(), t["phrases"], t["counts"], strict=True):
            for p, k in zip(pa.decompress(text.as_py(), size, codec="zstd", asbytes=True).split(BREAK), unpack(n.as_py(), np.uint32).tolist(), strict=True):
                total[p] += k
        held = [(p, n) for p, n in total.items() if n >= least]
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(held), pa.string()), "phrase": pa.array([p.decode("utf-8", "replace") for p, _ in held], pa.string()), "k": pa.array([p.count(b" ") + 1 for p, _ in held], pa.int32()), "a": pa.array([n for _, n in held], pa.int64())})

    kept = scratch.cut(shards.mapInArrow(sketched, SENT).groupBy("range").applyInArrow(reached, "shard bigint, range int, reached binary"), "phrase-counters")
    seen = shards.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(matched, "lang string, part int, size bigint, phrases binary, counts binary")
    exact = seen.groupBy("lang", "part").applyInArrow(summed, "lang string, phrase string, k int, a bigint")
    return scratch.cut(exact, "phrase-counts"), shards.groupBy("lang").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first `most` phrases of 2 to `longest` words."""
    scratch = Scratch()
    known, totals = counts(docs, least, longest, lang_col, text_col, scratch)
    words = F.split("phrase", " ")
    phrases = known.filter("k > 1").select("lang", "phrase", "k", "a", words.alias("words"))
    part = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.size("words")).alias("tail"))
    count_of = lambda name, c: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(c))
    cuts = cuts.join(count_of("head", "l"), ["lang", "head"]).join(count_of("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.withColumn("up", (wide("a") * SCALE).cast("decimal(18,0)") * wide("n")).withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inner = phrases.filter("k > 2").select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return scratch.held_by(ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
