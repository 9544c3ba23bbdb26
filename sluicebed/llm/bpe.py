"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. For every adjacent pair a vectorised check runs the two tokens'
merges backwards: the pair is compatible if no merge across its border would have come before the merges that made the
tokens. A sequence in which every pair is compatible is what merging by rank gives; only words with a pair that fails
are merged by rank, a step of all words of one length at once. Tokens that merging can't reach from their own letters are never proposed.

Texts are cut at special tokens, then at white space and between a letter and a mark after it, and each distinct piece is
normalised (NFC, lower case) and encoded once per task while it stays in a bounded cache, which the task frees at its end. What
pieces stand for is put together by Arrow. Decoding joins token strings with one space, as a tokenizer without a decoder does.

Defined results: null and blank texts have no tokens and decode to the empty text; repeated rows are encoded alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces in each half of what a task remembers, about 230 bytes a piece; and the bytes and rows that are cut at once.
CACHE = 150_000
AT_ONCE, ROWS = 1 << 21, 1 << 12
#: Letters of a word that is merged beside others.
LONG = 64
END = "</w>"
#: The rank of what never merges.
NEVER = 1 << 30
LAST = 0x1000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file with byte letters, word ends and merges in the order of their ids."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in (self.vocab | self.special).items():
            self.tokens[i] = t
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1)
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = rank, made
            self.left[made], self.right[made], self.rank[made] = x, y, rank
        self.base = size
        keys = np.array([x * size + y for x, y in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.made = np.array([m for _, m in self.merges.values()], dtype=np.int64)[np.argsort([r for r, _ in self.merges.values()])]
        # a table by hash answers most pairs; of keys that share a place one stands there, and the others are searched for
        self.shift = np.uint64(64 - max(len(keys).bit_length() + 2, 10))
        place = self._place(self.keys)
        self.at, self.of = np.full(1 << int(64 - self.shift), -1, dtype=np.int64), np.full(1 << int(64 - self.shift), NEVER, dtype=np.int64)
        self.at[place], self.of[place] = self.keys, self.ranks
        self.shared = np.bincount(place.astype(np.int64), minlength=len(self.at)) > 1
        self.spot = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = None
        self.forget()
        self.letters = byte_letters()
        self.letter_of = "".join(self.letters)
        self.usable = {t: i for t, i in self.vocab.items() if self.rank[i] < 0 or self._merged(self._units(t)) == [i]}
        self.greedy = self._automaton()
        self.ends = np.array([t.endswith(END) and t != END for t in self.tokens])
        self.last = {c: chr(ord(c) + LAST) for c in self.letters}
        self.inner, self.final = (np.array([self.vocab.get(chr(c) + end, -1) for c in range(512)], dtype=np.int64) for end in ("", END))
        self.names, self.strings = pa.array(map(str, range(size)), pa.string()), pa.array(self.tokens, pa.string())

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or NEVER."""
        keys = x * self.base + y
        place = self._place(keys)
        hit = self.at[place] == keys
        out = np.where(hit, self.of[place], NEVER)
        rest = np.nonzero(~hit & self.shared[place])
        if len(rest[0]):
            own = keys[rest]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[rest] = np.where(self.keys[at] == own, self.ranks[at], NEVER)
        return out

    @staticmethod
    def _units(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END] if token != body and body else [*token]

    def _merged(self, units: list[str]) -> list[int]:
        """Merging by rank, one step at a time."""
        ids = list(map(self.vocab.__getitem__, units))
        if len(ids) < 2:
            return ids
        get, none = self.merges.get, (NEVER, 0)
        next_to = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while next_to and (best := min(next_to))[0] != NEVER:
            at = next_to.index(best)
            ids[at : at + 2] = [best[1]]
            del next_to[at]
            if at:
                next_to[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(next_to):
                next_to[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _automaton(self) -> ahocorasick.Automaton:
        """Usable tokens, for longest matches from the left. A word's last letter is moved up by LAST, so that only tokens with a word end match it and none runs into the next word."""
        out = ahocorasick.Automaton()
        for t, i in self.usable.items():
            body = t.removesuffix(END)
            out.add_word(body[:-1] + chr(ord(body[-1]) + LAST) if t != body and body else t, i)
        out.make_automaton()
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging leaves the border between them alone."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        bound = np.full(len(a), NEVER, dtype=np.int64)  # merges across the border before this step would have won
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.rank_of(x, y)
            wins = (rank != NEVER) & (rank < bound[live])
            good[live[wins]] = False
            # undo the later of the two tokens' own last merges; on a tie the left one came first, so undo the right
            rx, ry = self.rank[x], self.rank[y]
            on_left = rx > ry
            over = (rx < 0) & (ry < 0)
            bound[live] = np.where(on_left, rx, ry + 1)
            a[live] = np.where(on_left, self.right[x], x)
            b[live] = np.where(on_left, y, self.left[y])
            live = live[~wins & ~over]
        return good

    def _merged_alike(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merging by rank of words with as many letters each, a row a word: the ids in order, padded, and how many."""
        done, counts = np.empty(ids.shape, np.int64), np.empty(len(ids), np.int64)
        live, ranks = np.arange(len(ids)), self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(live):
            each, width = np.arange(len(live)), ids.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)  # the first of equal ones
            best = ranks[each, at] if width > 1 else np.full(len(live), NEVER)
            if len(stop := np.flatnonzero(best == NEVER)):
                done[live[stop], :width], counts[live[stop]] = ids[stop], width
                go = np.flatnonzero(best != NEVER)
                live, ids, ranks, at, best, each = live[go], ids[go], ranks[go], at[go], best[go], np.arange(len(go))
                if not len(go):
                    break
            ids = ids[np.arange(width) != at[:, None] + 1].reshape(len(live), width - 1)
            ids[each, at] = self.made[best]
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(live), width - 2)
            for rows, left in ((np.flatnonzero(at > 0), at - 1), (np.flatnonzero(at < width - 2), at)):
                ranks[rows, left[rows]] = self.rank_of(ids[rows, left[rows]], ids[rows, left[rows] + 1])
        return done, counts

    def _merged_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merging by rank: the ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        out, counts = self.inner[codes], sizes.copy()  # a word never has more ids than letters
        out[starts + sizes - 1] = self.final[codes[starts + sizes - 1]]
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            if n > LONG:
                for k in own.tolist():
                    w = words[k]
                    ids = self._merged([*w[:-1], w[-1] + END])
                    out[starts[k] : starts[k] + len(ids)], counts[k] = ids, len(ids)
            else:
                places = starts[own][:, None] + np.arange(n)
                out[places], counts[own] = self._merged_alike(out[places])
        return out[np.arange(len(out)) - np.repeat(starts, sizes) < np.repeat(counts, sizes)], counts

    def encode_words(self, words: list[str]) -> list[str]:
        """Ids of each word of byte letters, a tab, and its tokens."""
        last = self.last
        flat = np.fromiter((t for _, t in self.greedy.iter_long("".join([w[:-1] + last[w[-1]] for w in words]))), np.int64)
        owner = np.concatenate([[0], np.cumsum(self.ends[flat])[:-1]]) if len(flat) else flat
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
        counts = np.bincount(owner, minlength=len(words))
        fails = np.zeros(len(words), bool)
        fails[owner[bad]] = True
        if len(again := np.flatnonzero(fails)):
            merged, many = self._merged_words([words[k] for k in again.tolist()])
            counts[again] = many
            whole = np.empty(counts.sum(), np.int64)
            of = np.repeat(fails, counts)
            whole[of], whole[~of] = merged, flat[~fails[owner]]
            flat = whole
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        ids, tokens = (pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(pa.array(flat))), " ") for x in (self.names, self.strings))
        return pc.binary_join_element_wise(ids, tokens, "\t").to_pylist()

    def _words(self, piece: str) -> list[str]:
        if self.cut is None:
            import regex

            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            if piece.isalpha():
                return [codecs.charmap_decode(piece.encode(), "strict", self.letter_of)[0]]
        elif piece.isalpha():
            return [piece.lower()]
        elif piece[:-1].isalpha() and piece[-1] in ",.;:":
            return [piece[:-1].lower(), piece[-1]]
        return [codecs.charmap_decode(w.encode(), "strict", self.letter_of)[0] for w in self.cut.findall(piece.lower())]

    def learn(self, pieces: list[str]) -> list[str]:
        """The ids of each piece as text, a tab, and its tokens, of new ones too. Pieces used lately stay: the older half goes when the younger is full."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for p in pieces:
            if p not in young:
                if (known := old.get(p)) is not None:
                    young[p] = known
                else:
                    new.append(p)
        words = list(map(self._words, new))
        distinct = list({w for ws in words for w in ws})
        get = dict(zip(distinct, self.encode_words(distinct), strict=True)) if distinct else {}
        for p, ws in zip(new, words, strict=True):
            young[p] = get[ws[0]] if len(ws) == 1 else "\t".join(map(" ".join, zip(*[get[w].split("\t") for w in ws], strict=True))) if ws else "\t"
        for s in self.special:
            if s in young:
                young[s] = f"{self.special[s]}\t{s}"
        return list(map(young.__getitem__, pieces))

    def forget(self) -> None:
        """Free what a task has remembered; the tables, which the vocabulary bounds, stay."""
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        """Special tokens and what stands between white space, in order."""
        if self.spot and "<|" in text and self.spot.search(text):
            return [p for i, part in enumerate(self.spot.split(text)) for p in ([part] if i % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        return text.split() if not re.search("[\x1c-\x1f]", text) else [p for p in re.split("[ \t\n\x0b\x0c\r\x85\xa0  -     　]+", text) if p]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text; Arrow cuts where no text has a special token's beginning or a separator that isn't white space here."""
        if pc.any(pc.match_substring_regex(texts, "<\\||[\x1c-\x1f]")).as_py():
            return pa.array(map(self.pieces, texts.to_pylist()), pa.list_(pa.string()))
        return pc.utf8_split_whitespace(_apart(texts))

    def texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids of each text, and its tokens, both as text with one space between them."""
        cut = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        known = self.learn(coded.dictionary.to_pylist())
        full, at, offsets = np.array([k != "\t" for k in known], bool), coded.indices.to_numpy(), cut.offsets.to_numpy()
        if not full.all():  # what stands beside white space at a text's ends, and pieces without words
            keep = full[at]
            at, offsets = at[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        both = pc.split_pattern(pa.array(known, pa.string()), "\t", max_splits=1).flatten()
        offsets = pa.array(offsets, pa.int32())
        ids, tokens = (pc.binary_join(pa.ListArray.from_arrays(offsets, both.take(pa.array(2 * at.astype(np.int64) + i))), " ") for i in (0, 1))
        return ids, tokens


_BYTES = np.arange(256)
_UPPER, _MARK = (_BYTES >= 65) & (_BYTES <= 90), np.isin(_BYTES, list(b",.;:!?"))
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))


def _apart(texts: pa.Array) -> pa.Array:
    """Texts with a space between each letter and a mark right after it, where words are cut anyway, and capitals lower-cased if ASCII follows, so that nothing composes with them; so fewer pieces differ."""
    texts = pa.concat_arrays([texts])
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or starts[0] == starts[-1]:
        return texts
    b = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]].copy()
    starts = starts - starts[0]
    b[:-1] += np.uint8(32) * (_UPPER[b[:-1]] & (b[1:] < 128))
    cuts = np.flatnonzero(_LETTER[b[:-1]] & _MARK[b[1:]]) + 1
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((starts + np.searchsorted(cuts, starts)).astype(np.int32)), pa.py_buffer(np.insert(b, cuts, 32)))


@lru_cache(maxsize=2)
def _built(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def _spec(path: str) -> str:
    """The parts of a tokenizer file that the tables need, as text: bounded by the vocabulary."""
    whole = json.load(open(path))
    return json.dumps({"model": {k: whole["model"][k] for k in ("vocab", "merges")}, "added_tokens": whole["added_tokens"]})


def _count(ids: pa.Array) -> pa.Array:
    return pc.add(pc.count_substring(ids, " "), pc.not_equal(ids, "").cast(pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string."""

    def columns(ids: pa.Array, tokens: pa.Array) -> list[pa.Array]:
        each = pc.split_pattern(ids.filter(pc.not_equal(ids, "")), " ").flatten().cast(pa.int32())
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_count(ids).to_numpy())]), pa.int32()), each), tokens]

    return _run(docs, path, id_col, text_col, "ids array<int>, decoded string", columns)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the decoded text, made where the text is encoded."""

    def columns(ids: pa.Array, tokens: pa.Array) -> list[pa.Array]:
        return [_count(ids).cast(pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in c.cast(pa.binary()).to_pylist()], pa.string()) for c in (ids, tokens))]

    return _run(docs, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, made: str, columns: Callable[[pa.Array, pa.Array], list[pa.Array]]) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))
    names = ["doc_id", *(x.split()[0] for x in made.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(spec.value)
        try:
            for b in batches:
                texts = b.column(1).cast(pa.string()).fill_null("")
                size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
                lo = 0
                while lo < b.num_rows:
                    hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + AT_ONCE)) + 1
                    hi = min(hi, lo + ROWS, b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns(*bpe.texts(texts.slice(lo, hi - lo)))], names=names)
                    lo = hi
        finally:
            bpe.forget()  # workers are used again by other stages

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {made}")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column decoded made anew from their ids."""
    spec = json.loads(_spec(path))
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    held = encoded.sparkSession.sparkContext.broadcast(names)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array(["" if x is None else " ".join(held.value[i] for i in x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", text(F.col(ids_col)))
