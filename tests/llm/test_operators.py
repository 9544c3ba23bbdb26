"""The numbered operators against brute force, round trips and held-out accuracy, with the rows that break things."""

import base64
import hashlib
import io
import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sluicebed.llm import bpe, byte_cnn, html_extract, kmeans_tree, layouts, mixing, quality_rules, queries, sharding, shingle_pairs, simhash, suffix_tree, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c"), (4, "a b c"), (None, "null id"), (7, "word " * 30_000), (8, "ÄÖ ümlaut — 漢字 \x00 🙂")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", "extra") for i, t in ODD], "doc_id long, text string, score string, shard string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def test_kmeans_tree_recall_and_ties(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5:40] = x[4]  # copies: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0]), (5004, [None] + [1.0] * 7), (None, [1.0] * 8), (10, x[10].tolist())]
    got = kmeans_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    by: dict[int, list] = {}
    for g in sorted(got, key=lambda g: g["rank"]):
        by.setdefault(g["query_id"], []).append(g)
    d = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 3000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = sorted(range(3000), key=lambda i: (-round(s[i], 10), i))[:20]
        mine = [g["vec_id"] for g in by[q]]
        assert [g["rank"] for g in by[q]] == list(range(1, 21)) and q not in mine
        assert all(abs(g["score"] - s[g["vec_id"]]) < 1e-9 for g in by[q])
        hits, total = hits + len(set(best) & set(mine)), total + 20
    assert hits / total >= 0.9
    assert [g["vec_id"] for g in by[20]][:19] == [*range(4, 20), 21, 22, 23]
    assert set(by) == set(range(0, 3000, 20))


def test_kmeans_tree_few_rows(spark):
    few = kmeans_tree.search(spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in few] == [(20, 1, 1, 0.5)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kmeans_tree.search(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_suffix_tree_counts_and_beats_unigrams(spark):
    got = {r["doc_id"]: r for r in queries.op2_suffix_tree(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    own = {d["doc_id"]: (d["text"] or "").encode().lower().split() for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    c = Counter(w for i, ws in own.items() if not held[i] for w in [*ws, b"\n"])
    n, v = sum(c.values()), len(c)
    for i, ws in own.items():
        toks = [*ws, b"\n"]
        assert got[i]["held_out"] == held[i] and got[i]["n_tokens"] == len(toks) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(c[w] > 0 for w in toks)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), rel_tol=1e-9)
    out = [i for i in own if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)


def brute_suffix_tree(texts, held, order=2):
    """Scores from dictionaries of exact runs; texts: lists of tokens that end with the end token, start marks are None."""
    runs = [Counter() for _ in range(order + 2)]
    padded = [[None] * order + t for t in texts]
    for p, h in zip(padded, held, strict=True):
        for i in range(order, len(p)):
            for k in range(order + 2):
                if not h:
                    runs[k][tuple(p[i - k + 1 : i + 1])] += 1
    follow = [{} for _ in range(order + 1)]  # contexts and their next words
    for k in range(1, order + 1):
        for p, h in zip(padded, held, strict=True):
            for i in range(order, len(p)):
                if not h:
                    follow[k].setdefault(tuple(p[i - k : i]), Counter())[p[i]] += 1
    n, v = sum(runs[1].values()), len(runs[1])

    def predict(context, word, keep):
        q = (runs[1][(word,)] + 1) / (n + v + 1)
        for k in range(1, len(context) + 1):
            own = follow[k].get(tuple(context[len(context) - k :]))
            if own and keep(k, tuple(context[len(context) - k :]), own):
                prior = suffix_tree.PRIOR * sum(own.values()) ** suffix_tree.GROWTH
                q = (own[word] + prior * q) / (sum(own.values()) + prior)
        return q

    candidate = lambda k, context, own: sum(own.values()) >= 2
    kept = set()
    for k in range(1, order + 1):
        for context, own in follow[k].items():
            total = sum(own.values())
            gain = sum(c * math.log(c / total / predict(context[1:], w, candidate)) for w, c in own.items())
            if total >= 2 and (context[-1] is None or gain > 0.5 * len(own) * math.log(total + 1)):
                kept.add(context)
    return [sum(math.log10(predict(p[i - order : i], p[i], lambda k, context, own: context in kept)) for i in range(order, len(p))) for p in padded]


def test_suffix_tree_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d["doc_id"], d["text"]) for d in docs]
    ids = [i for i, _ in rows]
    texts = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    want = dict(zip(ids, brute_suffix_tree(texts, [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]), strict=True))
    for chunk, parts in ((1 << 20, 1), (500, 5)):  # one chunk, and many
        monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
        made = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score(made).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_suffix_tree_grows_with_the_corpus(spark):
    """A passage of words that nothing else holds is learnt from two copies, however large the rest is."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i * 7919))
    rare = " ".join(word(i) for i in range(60))
    rest = [(i, " ".join(word(1000 + (i * 31 + j * j) % 5000) for j in range(100))) for i in range(3000)]
    learnt = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = [*rest, (learnt[0], rare), (learnt[1], rare), (learnt[2], " ".join(word(100_000 + i) for i in range(60)))]
    got = {r["doc_id"]: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gain = {i: got[i]["score"] - got[i]["base_score"] for i in learnt}
    assert gain[learnt[0]] == gain[learnt[1]] > 60 > abs(gain[learnt[2]]) * 5


def test_suffix_tree_odd_rows(odd, none):
    got = suffix_tree.score(odd).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) for r in got)
    assert suffix_tree.score(none).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, library, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    extra = spark.createDataFrame([(9, "<|endoftext|> a<|startoftext|>b don't I'LL naïve İ ŉ Σσς 12 3.4 ###!!")], "doc_id long, text string")
    got = bpe.encode(docs.union(extra), queries.tokenizer_path())
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"], r["decoded"]) for r in got.collect())
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *((lambda e: (e.ids, library.decode(e.ids, skip_special_tokens=False)))(library.encode(r["text"] or "", add_special_tokens=False)))) for r in docs.union(extra).collect())
    assert rows == texts
    again = bpe.decode(got.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "was"), queries.tokenizer_path())
    assert again.filter("was <> decoded").count() == 0
    assert bpe.digests(none, queries.tokenizer_path()).count() == 0


def test_bpe_digests(spark, library):
    r = bpe.digests(spark.createDataFrame([(1, "Hello, wörld")], "doc_id long, text string"), queries.tokenizer_path()).first()
    e = library.encode("Hello, wörld", add_special_tokens=False)
    assert r["n_tokens"] == len(e.ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_merges_many_words_at_once(library):
    """Words whose longest matches fail are merged together by rank; marks, capitals and what composes with them are cut as the library does."""
    r = np.random.default_rng(5)
    made = ["".join(r.choice(list("abdeinorstßéÃ"), int(n))) for n in r.integers(1, 20, 3000)] + ["qu" * 90, "a" * 5000, "H\u0331, A\u030a. I\u0307!", "don't,x;Y", "a.B:C?D!"]
    texts = [" ".join(made[k : k + 7]) for k in range(0, len(made), 7)] + ["", " a", "B", ",c ", "\x1ca\x1d,"]
    b = bpe._built(bpe._spec(queries.tokenizer_path()))
    one = b._merged  # a word at a time: only for long words
    b._merged = lambda units: one(units) if len(units) > bpe.LONG else pytest.fail("a short word was merged alone")
    try:
        whole = pa.array(["", *texts[:5], *texts], pa.string()).slice(6)
        ids, tokens = b.texts(whole)
        again = [x.to_pylist() for x in b.texts(whole.slice(0, len(texts) - 1))]  # without the last one Arrow cuts
    finally:
        b._merged = one
        b.forget()
    assert again == [ids.to_pylist()[:-1], tokens.to_pylist()[:-1]]
    for t, i, d in zip(texts, ids.to_pylist(), tokens.to_pylist(), strict=True):
        e = library.encode(t, add_special_tokens=False)
        assert (i, d) == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ b\r\nX: y", "<p>one"), (2, None, "<p>one"), (3, "http://c/", "<p>ö" * 50_000), (4, "http://d/", None), (5, "http://e/", ""), (None, "http://f/", "<p>one"), (6, "http://g/", "z"), (6, "http://g/", "z")]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, record_type string")), payloads=True).collect()
    assert all(r["verified"] for r in got) and len(got) == len(pages)
    for i, _, html in pages:
        mine = [r for r in got if r["record_id"] == (None if i is None else str(i))]
        body = (html or "").encode()
        assert all(r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() for r in mine)
        assert all(r["payload"] == body for r in mine if r["record_type"] == "response")
    kinds = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {"1": ("revisit", "2"), "2": ("response", None), "3": ("response", None), "4": ("revisit", "5"), "5": ("response", None), None: ("revisit", "2"), "6": ("response", None)}
    assert {r["url"] for r in got if r["record_id"] == "1"} == {"http://a/%20b%0D%0AX:%20y"}
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_reader_finds_damage():
    good = warc.record(b"abc", 1, "http://x/", None, False) + warc.record(b"abc", 2, "http://x/", 1, True)
    assert [r["record_type"] for r in warc.read_records(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    member = zlib.decompress(warc.record(b"abc", 1, "http://x/", None, False), 31).replace(b"abc\r\n", b"abd\r\n")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert [r["verified"] for r in warc.read_records(io.BytesIO(z.compress(member) + z.flush()))] == [False]


def test_warc_damage_is_an_error_unless_asked_for(spark, tmp_path):
    member = zlib.decompress(warc.record(b"abc", 1, "http://x/", None, False), 31).replace(b"abc\r\n", b"abd\r\n")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.warc.gz").write_bytes(z.compress(member) + z.flush())
    listed = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), str(tmp_path))], "path string, folder string")
    row = warc.read_archives(listed, strict=False).first()
    assert not row["verified"] and row["payload_digest"] == base64.b32encode(hashlib.sha1(b"abd").digest()).decode()
    with pytest.raises(Exception, match="digests of record 1"):
        warc.read_archives(listed).collect()


def test_shards_keep_equal_texts_together(spark):
    """Groups of copies below the bound share a shard; one with a third of all rows is dealt, and says so."""
    rows = [(i, f"copy {i % 40} " + "w" * 200) for i in range(800)] + [(800 + i, " ".join(f"own{i}x{j}" for j in range(40))) for i in range(1500)] + [(5000 + i, "hot text " * 20) for i in range(1100)]
    d = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    of = d.assign(text=d.doc_id.map(dict(rows))).groupby("text")
    assert all(g.shard.nunique() == 1 for t, g in of if not g.torn.iloc[0])
    assert set(d[d.torn].doc_id) == set(range(5000, 6100)) and d[d.torn].shard.nunique() > 1
    size = d.groupby("shard")["size"].sum()
    assert size.max() / size.mean() < 1.2 and size.min() / size.mean() > 0.8


def test_salted_roles_equal_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"own{i}") for i in range(60)], "page_id long, url string, html string")
    pick = lambda: sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    few = pick()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert pick() == few


@pytest.fixture(scope="module")
def labeller():
    return html_extract.fit(layouts.pages(500), epochs=4)


def test_labeller_held_out(labeller):
    pages = layouts.pages(120, seed=77)
    right = [(p >= 0.5) == y for (page, y_) in pages for (_, p), y in zip(html_extract.label(labeller, [page])[0], y_, strict=True)]
    assert np.mean(right) >= 0.97


def test_blocks_of_odd_pages():
    cut = lambda page: [t for _, t, _ in html_extract.blocks(page, html_extract.Paths())]
    assert cut("") == [] and cut("plain  text\n x") == ["plain text x"]
    assert cut("<p>a<p>b<br>c <b>d</p>e&amp;&lt;") == ["a", "b c d", "e&<"]
    assert cut("<script>var t='</p>';</script><style>p{}</style><title>t</title><p>x < y") == ["x < y"]
    assert cut('<p title="a>b">x</p><!-- <p>no --><p class=\'q>r\'>y') == ["x", "y"]
    assert cut("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "c", "1", "2", "3"]
    assert cut('<a "' * 2000)  # unclosed quotes end


def test_blocks_after_many_unclosed_tags_and_heads():
    cut = lambda page: [t for _, t, _ in html_extract.blocks(page, html_extract.Paths())]
    paths = html_extract.Paths()
    stray = "<p>a < b</p>" * 60
    found = html_extract.blocks(stray + '<p class="post-body article" title="x>y">text', paths)
    assert [t for _, t, _ in found] == ["a < b"] * 60 + ["text"] and (0, "p", "post-body article") in paths.known
    unclosed = '<i title="o>' * 61 + "<p>t<p title='c>d'>u"  # an odd number of quotes: the last tag's doesn't end
    assert cut(unclosed)[-2:] == ["t", "u"]
    assert cut("<html><head><title>t</title><p>one<p>two") == ["one", "two"]
    assert cut("<head><meta charset=x><h1>T</h1>x") == ["T", "x"] and cut("<head><title>t</title> text <b>more</b>") == ["text more"]
    assert cut("<head> <title>t</title> </head><body><p>x") == ["x"] == cut("<head><link><script>s</script><body><p>x")
    start = time.process_time()
    for page in ('<a "' * 150_000, "<a " * 150_000, "<a '\"" * 150_000 + "'", "</ " * 150_000 + ">"):
        html_extract.blocks(page, html_extract.Paths())
    assert time.process_time() - start < 20


def test_tag_ends_as_the_pattern_has_them():
    r = np.random.default_rng(1)
    for _ in range(3000):
        page = "".join(r.choice(list("<<a \"'>="), 25))
        ends = html_extract._Ends(page)
        for at in [i for i, c in enumerate(page) if c == "<"]:
            if m := html_extract.NAME.match(page, at):
                whole = html_extract.TAG.match(page, at)
                assert ends.follow(m.end()) == (whole.end() - 1 if whole else -1), (page, at)


def test_extract_odd_rows(spark, labeller):
    pages = [(1, "u", None), (2, "u", ""), (None, None, "<article><h1>T</h1><p>One  two.</p></article><footer>f</footer>"), (3, "u", "<article><p>" + "long text " * 50_000 + "</article>")]
    got = html_extract.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int"), model=labeller).collect()
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == "" and by[None]["text"] == "T\nOne two." and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model=labeller).count() == 0


def test_raking_meets_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else f"s{i % 9}", "en" if i % 2 else "de") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")}
    d = mixing.mixed(docs, targets=targets, fraction=0.5).select("lang", "_mix.*").toPandas()
    assert d.weight.between(0, 1).all()
    mass = (d.tokens * d.weight).groupby(d.iloc[:, 0]).sum()
    assert abs(mass["en"] / mass.sum() - 0.5) < 0.02
    assert abs((d.tokens * d.kept).sum() / (d.tokens * d.weight).sum() - 1) < 0.15


def test_mixing_odd_rows(spark, none):
    rows = [(i, t, None, "en") for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ODD) and all(r["_mix"]["weight"] is not None for r in got)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs.filter("doc_id = -1")).count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_byte_cnn(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(out) > 50 and np.mean([r["predicted"] == y for r, y in out]) >= 0.85
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_classifier_odd_rows(spark, odd, none):
    assert {r["score"] for r in byte_cnn.scored(odd, None).collect()} == {0.5}
    model = byte_cnn.fit([b"good text here", b"!!!! ####"] * 20, [1, 0] * 20, epochs=1)
    got = byte_cnn.scored(odd, model).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert byte_cnn.scored(none, model).count() == 0 and byte_cnn.fit([b"a"], [1]) is None
    assert byte_cnn.keep_good(odd, None).count() == len(ODD)


def test_classifier_scores_a_text_alike_in_any_batch():
    model = byte_cnn.fit([b"good text here", b"!!!! ####"] * 20, [1, 0] * 20, epochs=2)
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 122, 123, 124, 127, 128, 129, 251, 252, 256, 1000, 5000, 1 << 19, (1 << 19) + 124)]
    alone = [byte_cnn.score(model, [t])[0] for t in texts]
    for _ in range(8):
        order = r.permutation(len(texts))
        assert byte_cnn.score(model, [texts[i] for i in order]).tolist() == [alone[i] for i in order]


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in base] + [(1000 + k, (base[k]["text"] or "") + " tail") for k in range(40)] + [(2000, None), (2001, " "), (2002, "x")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: _fingerprint(t) for i, t in rows}
    up = {i: i for i in fp}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    for i in ids:
        assert got[i]["fp"] & (2**64 - 1) == fp[i] and got[i]["component_id"] == root(i)


def test_simhash_pigeonring_loses_no_link(spark):
    r = np.random.default_rng(4)
    start = r.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for s in start for k in (1, 2, 3)]
    fps = sorted({int(s) for s in start} | set(near))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    of = {x["node"] & (2**64 - 1): x["root"] for x in found}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                assert of[a] == of[b]


def test_simhash_distances_beyond_its_candidates_are_refused(spark):
    fps = spark.createDataFrame([(1,), (2,)], "fp long")
    with pytest.raises(ValueError, match="up to 3"):
        simhash.links(fps, 4)
    assert simhash.links(fps, 1).count() == 0 and simhash.links(fps, 2).count() == 1


def test_shingle_links_equal_brute_force_over_blocks(spark, monkeypatch):
    """Copies of one text with few and many edits: a hot key, in blocks of five members."""
    monkeypatch.setattr(shingle_pairs, "MEMBERS", 5)
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in r.choice(120, int(r.integers(0, 12)), replace=False):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    got = {x["row"]: x["root"] for x in shingle_pairs.roots(spark.createDataFrame(rows, "row long, text string"), 5, (4, 5)).collect()}
    sets = [set(shingle_pairs.shingles(t, 5).tolist()) for _, t in rows]
    up = list(range(60))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(60):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {k: root(k) for k in range(60)} and 1 < len(set(got.values())) < 60


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["fp"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 1
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_tells_rows_with_one_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    rows = [(None, text(k)) for k in range(30)] + [(7, text(30)), (7, text(31))]  # different texts, whatever their ids
    copies = [(None, text(3)), (5, text(32)), (5, text(32)), (None, text(32))]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    for keep in (simhash.keep_one, shingle_pairs.keep_one):
        kept = keep(docs).collect()
        assert sorted(r["text"] for r in kept) == sorted(text(k) for k in range(33))
        assert {r["doc_id"] for r in kept if r["text"] == text(32)} == {5}


def _measures(text):
    text = text or ""
    ws = text.encode().split()
    win = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if win[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(99, "a b c d e f g h i a b c d e f g h\nq\nq\n")], "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.measure_and_judge(docs, names).collect()
    got = sorted((r["text"] or "", *(r["_m"][n] for n in names)) for r in judged)
    assert got == sorted((r["text"] or "", *_measures(r["text"])) for r in docs.collect())
    kept = quality_rules.keep(docs).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in judged if r["_rejected_by"] is None)
    assert quality_rules.keep(none).count() == 0 and quality_rules.measure_and_judge(none, names).count() == 0


def test_cascade_orders_by_what_is_left():
    rules = quality_rules.RULES[:3]
    # the second rejects all that the first does, and the third other rows
    order = quality_rules.greedy(rules, [0.02, 0.02, 0.08], {0b000: 50, 0b011: 30, 0b010: 10, 0b100: 10})
    assert [e.rule.name for e in order] == [rules[1].name, rules[2].name, rules[0].name]
    assert [round(e.share, 3) for e in order] == [0.4, 0.167, 0.0]
    tied = quality_rules.greedy(rules, [0.02] * 3, {0b111: 5, 0: 5})
    assert [e.rule.name for e in tied] == [r.name for r in rules]


def test_cascade_measures_nothing_that_it_needs_not(spark):
    """A measure that fails: only rows that reach its rule may ask for it."""
    boom = quality_rules.Rule("boom", ("n_boom",), lambda m: m["n_boom"] > 0)
    rules = [quality_rules.RULES[0], boom]
    get = lambda n: F.raise_error(F.lit("measured")).cast("long") if n == "n_boom" else F.size(F.split("t", " ")).cast("long")
    short = spark.createDataFrame([("a b",), ("c",)], "t string")
    assert [r[0] for r in short.select(quality_rules.verdict(get, rules)).collect()] == ["few_words"] * 2
    with pytest.raises(Exception, match="measured"):
        spark.createDataFrame([("w " * 30,)], "t string").select(quality_rules.verdict(get, rules)).collect()


def test_cascade_order_is_stable_on_a_clear_case(spark):
    docs = spark.createDataFrame([(i, "x" if i % 2 else " ".join(f"w{j}" for j in range(400))) for i in range(2000)], "doc_id long, text string")
    first = {quality_rules.plan_order(docs)[0].rule.name for _ in range(3)}
    assert first == {"few_words"}


def test_shards(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    d = sharding.kd_shards(docs).toPandas()
    size = d.groupby("shard")["size"].sum()
    assert len(d) == docs.count() and sorted(size.index) == list(range(16)) and size.max() / size.mean() < 1.15 and size.min() / size.mean() > 0.85
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in d.groupby("shard"))
    assert (d["size"].sum(), set(d["law"])) == (sum(len((r["text"] or "").encode()) + 1 for r in docs.collect()), {"bytes"})
    assert sharding.kd_shards(odd).count() == len(ODD) and sharding.kd_shards(none).count() == 0
