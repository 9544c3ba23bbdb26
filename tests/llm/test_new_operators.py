"""Product codes, collocations and norm buckets against brute force, with the rows that break things."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebed.llm import collocations, norm_buckets, product_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, part string, bucket string, `rank` string"


def vectors(n=400, dims=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32) * r.choice([0.1, 0.3, 1.0, 5.0], size=(n, 1)).astype(np.float32)
    x[5:60] = x[4]  # copies
    x[70] = 0
    return x


def rows_of(x):
    odd = [(9000, None), (9001, []), (9002, [NAN] * 16), (9003, [1.0]), (9004, [None] + [1.0] * 15), (9005, [INF] * 16), (9006, [3e30] * 16)]
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 5) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd] + [(10, x[10].tolist(), 3)]
    return [(*r, "p", "b", "r") for r in rows]


def brute_codes(ids, x, labels, parts=8, entries=16, rounds=6):
    q = np.array([[int(np.floor(float(v) * 4096)) for v in row] for row in x], dtype=object)
    width = q.shape[1] // parts
    order = sorted(range(len(q)), key=lambda i: (ids[i], list(x[i])))[:entries]
    cut = lambda row, p: [int(v) for v in row[p * width : (p + 1) * width]]
    books = [[cut(q[i], p) for i in order] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            at = [nearest(cut(row, p), book)[0] for row in q]
            for e in set(at):
                own = [cut(q[i], p) for i in range(len(q)) if at[i] == e]
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(cut(row, p), books[p]) for p in range(parts)] for row in q]
    errors = [sum(d for _, d in f) for f in found]
    by = Counter()
    for label, error in zip(labels, errors, strict=True):
        by[label] += error
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((i, "".join(f"{at:02x}" for at, _ in f), e, by[label], sha) for i, f, e, label in zip(ids, found, errors, labels, strict=True))


def test_product_codes_equal_brute_force(spark):
    rows = rows_of(vectors())
    own = [r for r in rows if r[0] < 9000]
    want = brute_codes([r[0] for r in own], [r[1] for r in own], [r[2] for r in own])
    for parts in (1, 5):
        got = product_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(parts))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect())) == want


def test_product_codes_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(2, [0.5, -0.25, 1.0], None), (1, [0.0, 0.0, 0.0], None), (None, [0.5, -0.25, 1.0], 4)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in product_codes.compress(few).collect()}
    assert got.keys() == {1, 2, None} and {r["error"] for r in got.values()} == {0}
    assert got[1]["code"] == "00" * 8 and len(got[2]["code"]) == 16 and got[2]["code"] == got[None]["code"]  # three components, eight parts
    assert product_codes.compress(few.filter("vec_id = 9")).count() == 0
    assert product_codes.compress(few.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_codes_decode_to_the_entries():
    books = [np.array([[1, 2], [3, 4]]), np.array([[5], [6]])]
    assert product_codes.decode(["0001", "0100"], books).tolist() == [[1, 2, 6], [3, 4, 5]]
    at, d = product_codes.nearest(np.array([[2, 3], [3, 4]]), books[0])
    assert at.tolist() == [0, 1] and d.tolist() == [2, 0]  # the first of two equally near


def brute_top(rows, step, k=10, scale=1024):
    q = [(i, np.array([int(np.floor(float(v) * scale)) for v in vec], dtype=object)) for i, vec in rows]
    asks = {}
    for (i, v), (_, vec) in zip(q, rows, strict=True):
        if i % step == 0 and (i not in asks or list(vec) < asks[i][1]):
            asks[i] = (v, list(vec))
    out = []
    for i, (v, _) in asks.items():
        best = sorted((-int((v * w).sum()), j) for j, w in q if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["mixed", "near", "low"])
def test_norm_buckets_equal_brute_force(spark, monkeypatch, shape):
    """Lengths of four orders; a tight cone, where coordinates prune; few dimensions, with blocks and bounds made small."""
    monkeypatch.setattr(norm_buckets, "BLOCK", 64)
    monkeypatch.setattr(norm_buckets, "VISITS", 16)
    monkeypatch.setattr(norm_buckets, "SEEDS", 60)
    x = vectors()
    if shape == "near":
        x = (vectors(seed=3)[0] + 0.05 * vectors(seed=4)).astype(np.float32)
    rows = rows_of(x) if shape != "low" else [(i, v[:2].tolist(), 1, "p", "b", "r") for i, v in enumerate(x)]
    rows += [(20, (x[30] * 2)[: len(rows[0][1])].tolist(), 1, "p", "b", "r"), (None, rows[0][1], 1, "p", "b", "r")]
    own = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] < 9000]
    got = norm_buckets.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(own, 10)


def test_norm_buckets_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [-0.5, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, norm_buckets.search(few, F.col("vec_id") % 100 == 0).collect())) == [(100, 1, 2, 0), (100, 2, 1, -512 * 1024)]
    assert norm_buckets.search(few, F.col("vec_id") == 7).count() == 0
    assert norm_buckets.search(few.filter("vec_id = 9"), F.col("vec_id") % 100 == 0).count() == 0


def test_coordinates_prune_and_lose_nothing():
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 12))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    order = np.argsort(unit, axis=0).T
    ranked = np.take_along_axis(unit.T, order, axis=1)
    for q, cosine in [(unit[0], 0.99), (unit[1], 0.7), (-unit[2], 0.5), (unit[3], 1.0)]:
        some = norm_buckets.by_coordinates(unit, order, ranked, q, cosine)
        assert set(np.flatnonzero(unit @ q >= cosine - 1e-12)) <= set(some.tolist()) and len(some) < 2000
    assert len(norm_buckets.by_coordinates(unit, order, ranked, unit[0], 0.99)) < 100


def test_products_are_exact_beyond_doubles():
    x = np.array([[2**26 - 1, 2**26 - 3], [1, -1]])
    assert norm_buckets.products(x, x).tolist() == [[int((a.astype(object) * b).sum()) for b in x] for a in x]


def brute_phrases(docs, least, longest=5, most=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    made = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            made[lang, p] = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
    inside = Counter()
    for lang, p in made:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], f[lang, p])
    out = []
    for lang in n:
        left = sorted((-s, -f[g, p], " ".join(p).encode(), lo, r) for (g, p), (s, _, lo, r) in made.items() if g == lang and inside[g, p] < f[g, p])
        out += [(lang, i, p.decode(), -a, lo, r, n[lang], -s) for i, (s, a, p, lo, r) in enumerate(left[:most], 1)]
    return sorted(out)


def phrases_corpus():
    r = np.random.default_rng(2)
    vocab = ["alpha", "Beta", "ga", "ga-ga", "δέλτα", "Ä", "ä", "x\x1cy", " ", "漢字", "a", "aa", "the", "the"]
    docs = []
    for i in range(120):
        words = [vocab[j] for j in r.integers(0, len(vocab), 40)]
        seps = [[" ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", " ; "][j] for j in r.choice(9, 40, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.025, 0.025, 0.025, 0.025])]
        docs.append((("en", "fr", None, "")[i % 4], "".join(a + b for a, b in zip(words, seps, strict=True))))
    docs += [("en", None), ("en", ""), ("zz", " \t. , "), ("en", "new york city hall stands here. " * 30), ("en", "a a a a a a a a " * 20), ("fr", "New York City " * 12), (None, "und und und")]
    return docs


def test_collocations_equal_brute_force(spark, monkeypatch):
    docs = phrases_corpus()
    for least, shard, parts in ((5, 1 << 20, 1), (12, 150, 5)):
        monkeypatch.setattr(collocations, "SHARD", shard)
        made = spark.createDataFrame([(lang, text, "k", 1) for lang, text in docs], "lang string, text string, k string, a int").repartition(parts)
        got = sorted(map(tuple, collocations.mine(made, least=least).collect()))
        assert got == brute_phrases(docs, least) and len(got) > 20
    got = sorted(map(tuple, collocations.mine(made, least=4, longest=3, most=3).collect()))
    assert got == brute_phrases(docs, 4, 3, 3)


def test_collocations_of_one_word_texts_and_none(spark):
    docs = spark.createDataFrame([("en", "word"), (None, None)], "lang string, text string")
    assert collocations.mine(docs, least=1).count() == 0
    assert collocations.mine(docs.filter("lang = 'no'")).count() == 0


def test_a_long_text_is_counted_whole(spark):
    docs = [("en", "left right " * 30_000 + "and " + "one two three " * 200)]
    assert sorted(map(tuple, collocations.mine(spark.createDataFrame(docs, "lang string, text string")).collect())) == brute_phrases(docs, 100)
