"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of 6 bytes slide over every byte of a text. Their rectified responses are max-pooled over chunks of 256
bytes that overlap by half; a chunk's pooled responses pass a small rectified layer; its units, max-pooled and averaged
over all chunks, and combined by a logistic unit, give one probability. A filter is a table of 256 weights for each of
its bytes, so a response is a sum of looked-up rows. Texts of a batch are laid out together, each padded to whole blocks
with WIDTH - 1 zero bytes at least; windows that reach into the next text are left out, so a score is a text's own.

It is fitted by Adam on a bounded sample of labelled rows (fit_rows of each class, of at most fit_bytes each), chosen by
a hash of the id; labels, language, source and id are never inputs. Everything else is scored, whole.

Defined results: null and empty texts are one block of zero bytes and get its score; equal texts get equal scores;
without labelled rows of both classes every score is 1/2; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
WIDTH = 6
FILTERS = 12
UNITS = 12
FIT_ROWS = 1000
FIT_BYTES = 65536
EPOCHS = 10
#: Bytes that are convolved at once.
AT_ONCE = 1 << 18

Model = dict[str, np.ndarray]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each padded with WIDTH - 1 zeros or more to whole blocks, and the first block of each."""
    blocks = np.array([-(-(len(t) + WIDTH - 1) // BLOCK) for t in texts], dtype=np.int64)
    out = np.frombuffer(b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)) + bytes(WIDTH - 1), dtype=np.uint8)
    return out, np.concatenate([[0], np.cumsum(blocks)[:-1]])


def _pooled(model: Model, data: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each block's largest response of each filter, and where in the block it is."""
    table, n = model["table"], len(data) - WIDTH + 1
    last = np.append(first[1:], n // BLOCK) - 1
    best, at = [], []
    for lo in range(0, n, AT_ONCE):
        size = min(AT_ONCE, n - lo)
        z = np.take(table[0], data[lo : lo + size], axis=0)
        part = np.empty_like(z)
        for j in range(1, WIDTH):
            np.take(table[j], data[lo + j : lo + j + size], axis=0, out=part)
            z += part
        z = z.reshape(-1, BLOCK, FILTERS)
        z[last[(last >= lo // BLOCK) & (last < lo // BLOCK + len(z))] - lo // BLOCK, BLOCK - WIDTH + 1 :] = -np.inf  # these read the next text
        if where:
            at.append(z.argmax(axis=1))
        best.append(z.max(axis=1))
    return np.concatenate(best) + model["bias"], np.concatenate(at) if where else None


def _chunks(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk is a block and the next of the same text; whether the next one gave a filter's maximum."""
    after = np.concatenate([blocks[1:], np.full((1, blocks.shape[1]), -np.inf, blocks.dtype)])
    after[np.append(first[1:], len(blocks)) - 1] = -np.inf
    return np.maximum(blocks, after), after > blocks


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in the same order for every number of rows, as matrix libraries don't."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out += x[:, k : k + 1] * w[k]
    return out


def _forward(model: Model, blocks: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    c, later = _chunks(blocks, first)
    p = np.maximum(c, 0)
    h = np.maximum(_times(p, model["w"]) + model["c"], 0)
    count = np.diff(np.append(first, len(blocks)))
    top, mean = np.maximum.reduceat(h, first, axis=0), np.add.reduceat(h, first, axis=0) / count[:, None]
    z = _times(np.concatenate([top, mean], axis=1), model["v"][:, None])[:, 0] + model["d"]
    return {"c": c, "later": later, "p": p, "h": h, "top": top, "mean": mean, "count": count, "prob": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}


def fit(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model | None:
    """None if a class is missing."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    model: Model = {
        "table": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "w": rng.normal(0, 0.4, (FILTERS, UNITS)).astype(np.float32), "c": np.full(UNITS, 0.1, np.float32),
        "v": rng.normal(0, 0.3, 2 * UNITS).astype(np.float32), "d": np.zeros(1, np.float32),
    }
    m, v, t = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            data, first = _laid_out([texts[i] for i in own])
            blocks, at = _pooled(model, data, first, where=True)
            f = _forward(model, blocks, first)
            g = ((f["prob"] - y[own]) * weight[own] / len(own)).astype(np.float32)
            grad = {"v": np.concatenate([f["top"], f["mean"]], axis=1).T @ g, "d": g.sum(keepdims=True)}
            gx = g[:, None] * model["v"]
            doc = np.repeat(np.arange(len(own)), f["count"])
            is_top = f["h"] == f["top"][doc]
            gh = (gx[doc, :UNITS] * is_top / np.maximum(np.add.reduceat(is_top, first, axis=0, dtype=np.int64), 1)[doc] + gx[doc, UNITS:] / f["count"][doc, None]) * (f["h"] > 0)
            grad |= {"w": f["p"].T @ gh, "c": gh.sum(axis=0)}
            gc = (gh @ model["w"].T) * (f["c"] > 0)
            gb = np.where(f["later"], 0, gc)
            gb[1:] += np.where(f["later"], gc, 0)[:-1]
            grad["bias"] = gb.sum(axis=0)
            place = np.arange(len(blocks))[:, None] * BLOCK + at
            table = np.empty_like(model["table"])
            column = np.broadcast_to(np.arange(FILTERS), place.shape)
            for j in range(WIDTH):
                table[j] = np.bincount((data[place + j].astype(np.int64) * FILTERS + column).ravel(), gb.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grad["table"] = table
            t += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, x in grad.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                model[k] = (model[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def score(model: Model | None, texts: list[bytes]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    data, first = _laid_out(texts)
    return _forward(model, _pooled(model, data, first)[0], first)["prob"].astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, octets: int = FIT_BYTES) -> Model | None:
    """Fit on at most `rows` labelled rows of each class whose texts have at most `octets` bytes. labels: one row an id."""
    named = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    chosen = [named.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1]).dropDuplicates(["_id"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.filter(F.octet_length(text) <= octets).join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select("_id", "_y", text.alias("_t"))
    texts = [(r["_t"].encode("utf-8", "surrogatepass"), r["_y"]) for r in found.orderBy("_id", "_t").limit(2 * rows).collect()]
    return fit([t for t, _ in texts], [y for _, y in texts])


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _groups(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(score(held.value, texts))], names=["doc_id", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about AT_ONCE bytes, and where each starts."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(column):
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= AT_ONCE or i + 1 == len(column):
            yield start, texts
            texts, start, size = [], i + 1, 0


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score `least` or more, with their columns; scored where they are read, in runs of bounded bytes, without a shuffle. Without a model all rows stay."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _groups(b.column(place)):
                yield b.slice(start, len(texts)).filter(pa.array(score(held.value, texts) >= least))

    return docs.mapInArrow(run, docs.schema)
