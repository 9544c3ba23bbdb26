import os
import tracemalloc

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sluicebed.llm import byte_cnn, common, shingle_pairs, simhash

SF = "/root/testdata/sf0.001"
ROWS = [(1, None, None, None, 0), (None, "", "en", "s", 0), (3, " ".join(f"word{i}" for i in range(300)), "en", "s", 0), (3, " ".join(f"word{i}" for i in range(300)), "en", "s", 0), (4, "x " * 40_000, "en", "s", 0)]


def test_stages_take_odd_rows_and_none(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for own in (docs, docs.filter("doc_id = -1")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, SF)
            n = out.count()
            assert n <= own.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name


def test_run_is_its_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    own = sorted(map(str, docs.collect()))
    assert own == sorted(map(str, corpus_pipeline.run(spark, SF).collect())) and own


def test_copies_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.rules(spark, docs, SF)
    one = corpus_pipeline.near_duplicates(spark, good, SF)
    assert one.count() == one.select("text").distinct().count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert corpus_pipeline.rules(spark, clean, SF).count() >= 0.95 * clean.count()
    model = byte_cnn.fit([b"a plain text of words", b"## $$ !!"] * 10, [1, 0] * 10, epochs=1)
    assert byte_cnn.keep_good(clean, model, least=0.0).count() == clean.count()
    assert one.filter(F.col("text").isNull()).count() <= 1


def _edited(text, shared, n):
    """A text of n words whose five-word shingles are about as similar as `shared` says: its tail is other words."""
    same = round(2 * shared / (1 + shared) * n)
    return " ".join(text.split()[:same] + [f"other{text.split()[0]}{i}" for i in range(n - same)])


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_duplicates_finds_what_is_eight_tenths_alike(spark):
    rows = []
    for k in range(60):
        text = " ".join(f"w{k}x{i * i % 9973}" for i in range(400))
        rows += [(3 * k, text), (3 * k + 1, _edited(text, (0.82, 0.9, 0.95)[k % 3], 400)), (3 * k + 2, _edited(text, 0.7, 400))]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    texts = dict(rows)
    alike = lambda a, b: len(_sets(texts[a]) & _sets(texts[b])) / len(_sets(texts[a]) | _sets(texts[b])) >= 0.8
    expected = set()
    for k in range(0, 180, 3):
        linked = {k}
        while more := {j for j in range(k, k + 3) if j not in linked and any(alike(i, j) for i in linked)}:
            linked |= more
        rest = {k, k + 1, k + 2} - linked
        expected |= {k} | ({min(rest)} if len(rest) == 1 or (rest and alike(*rest)) else rest)
    assert kept == expected and len(kept) < 180 and all(3 * k + 1 not in kept for k in range(60))


def test_near_duplicates_that_only_link_through_others(spark):
    """b is near a, c near b but not near a; the star of a key may start at any of them."""
    base = [f"v{i}" for i in range(300)]
    rows = [(k, " ".join(base[9 * k :] + [f"v{300 + i}" for i in range(9 * k)])) for k in range(12)]
    one = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert [r["doc_id"] for r in one] == [0]


def test_blocks_count_what_sets_share_in_bounded_memory(monkeypatch):
    r = np.random.default_rng(1)
    every = r.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(r.choice(every, r.integers(1, 400))) for _ in range(40)]
    for k in range(0, 40, 4):
        sets[k + 1] = np.unique(np.concatenate([sets[k][: int(0.95 * len(sets[k]))], every[:5]]))
    alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    names, roots = list(range(100, 140)), list(range(40))
    for cells in (1 << 22, 500):
        monkeypatch.setattr(shingle_pairs, "CELLS", cells)
        for split in (0, 13):
            want = {(i, j) for i in range(40) for j in range(i) if alike(sets[i], sets[j]) and (not split or j < split <= i)}
            got = {(max(a, b) - 100, min(a, b) - 100) for a, b in shingle_pairs.linked(names, roots, sets, split, (4, 5))}
            assert want and got == want
    large = [every] + [r.integers(0, 2**63, 60_000, dtype=np.uint64) for _ in range(48)]
    tracemalloc.start()
    assert not list(shingle_pairs.linked(list(range(49)), list(range(49)), [np.unique(x) for x in large], 0, (4, 5)))
    assert tracemalloc.get_traced_memory()[1] < 49 * 60_000 * 8 * 10
    tracemalloc.stop()
    assert not list(shingle_pairs.linked([], [], [], 0, (4, 5)))


def test_keys_with_large_sets_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(shingle_pairs, "STAR", 2)
    base = [f"v{i}" for i in range(300)]
    rows = [(k, " ".join(base[9 * k :] + [f"v{300 + i}" for i in range(9 * k)])) for k in range(12)]
    one = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert [r["doc_id"] for r in one] == [0]


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, None, 9, None)], "doc_id long, text string, _row long, root string")
    for keep in (shingle_pairs.keep_one, simhash.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns and sorted((r["doc_id"], r["_row"], r["root"]) for r in out.collect()) == [(1, 7, "x"), (3, 9, None)]
        read = [t._written_at for t in out._reads.tables]
        common.release(out)
        assert read and not any(os.path.exists(p) for p in read)


def test_components_end_only_where_nothing_changes(spark):
    """A path, and four others chosen so that the hashes of all edges have one sum before and after a round that isn't the last."""
    paths = [[1, 2, 3, 4], *([x, x + 1, x + 2] for x in (1019477395, 2002695488, 3020156691, 4020166669))]
    edges = spark.createDataFrame([(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(n, p[0]) for p in paths for n in p}
    negative = spark.createDataFrame([(k, k - 1) for k in range(5, -6, -1)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(negative).collect()} == {(n, -6) for n in range(-6, 6)}
