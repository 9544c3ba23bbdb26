"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, collocations, html_extract, kmeans_tree, mixing, norm_buckets, product_codes, quality_rules, sharding, simhash, suffix_tree, warc
from .common import is_held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    d = quality_rules.measure_and_judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), names)
    m = F.col("_m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return d.select("doc_id", *(m[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & F.col("_rejected_by").isNull()).alias("kept"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, md5(array_to_string(ws[i:i+7], ' ')) AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2),
cov AS (SELECT rid, sum(least(8, i - prev)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS prev FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      len(string_split(t, chr(10))) AS n_lines, len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_exclaimed
      FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words
       OR word_chars > 14 * n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_exclaimed > 3 * n_words) AS kept
FROM m
"""


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file is; set SLUICEBED_TOKENIZERS to a folder to take it from there."""
    folder = os.environ.get("SLUICEBED_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    model = byte_cnn.learn(docs.filter(~held_out), _table(spark, sf_dir, "labels").filter(~held_out))
    return byte_cnn.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"), is_held_out(F.col("doc_id"), 7, 2))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return d.select("doc_id", "source", "lang", "_mix.topic", "_mix.tokens", "_mix.weight", "_mix.kept")


def _op6_sql() -> str:
    n = lambda chars: f"(n - length(regexp_replace(t, '[{chars}]', '', 'g')))"
    parts = [
        f"""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
m AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
  CASE WHEN n = 0 THEN 'empty' WHEN 10 * {n("0-9")} > n THEN 'numbers' WHEN 50 * {n("{}\\[\\]<>;=#*$%&_")} > n THEN 'markup'
  WHEN 100 * {n("|\\t")} > n THEN 'table' WHEN 20 * {n("\\n")} > n THEN 'lines' WHEN n > 4000 THEN 'long' ELSE 'prose' END AS topic FROM d)""",
        f"s00 AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, {mixing.FRACTION}::DOUBLE AS p FROM m GROUP BY ALL)",
        *(f"w_{d} AS (SELECT {d} AS v, pow(sum(tokens), {mixing.TEMPER}) / sum(pow(sum(tokens), {mixing.TEMPER})) OVER () * sum(sum(tokens)) OVER () * {mixing.FRACTION} AS want FROM s00 GROUP BY {d})" for d in mixing.DIMS),
    ]
    last = "s00"
    for sweep in range(1, mixing.SWEEPS + 1):
        for k, d in enumerate(mixing.DIMS):
            now = f"s{sweep}{k}"
            parts.append(f"{now} AS (SELECT source, lang, topic, tokens, round(least(1.0, p * CASE WHEN have > 0 THEN want / have ELSE 1.0 END), 9) AS p FROM (SELECT *, sum(tokens * p) OVER (PARTITION BY {d}) AS have FROM {last}) JOIN w_{d} ON {d} IS NOT DISTINCT FROM v)")
            last = now
    return f"""WITH {", ".join(parts)},
p AS (SELECT source, lang, topic, round(p, {mixing.PLACES}) AS p FROM {last})
SELECT doc_id, m.source, m.lang, m.topic, tokens, p AS weight, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang AND m.topic = p.topic"""


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(_table(spark, sf_dir, "embeddings"))


_USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(parts: int = 8, width: int = 8) -> str:
    """For vectors of parts * width components."""
    key = "place"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q, embedding FROM embeddings WHERE {_USABLE_SQL}),
p AS (SELECT rid, k AS {key}, q[k * {width} + 1 : k * {width} + {width}] AS x FROM v, range({parts}) AS t(k)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM v QUALIFY e < 16),
b0 AS (SELECT {key}, e, x AS c FROM p JOIN s USING (rid))"""
    ]
    for k in range(7):
        steps.append(
            f"""d{k} AS (SELECT rid, {key}, arg_min(e, o) AS e, min(o) // 64 AS d FROM (
  SELECT rid, {key}, e, list_sum(list_transform(range(1, {width} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * 64 + e AS o FROM p JOIN b{k} USING ({key})) GROUP BY ALL)"""
        )
        if k < 6:
            steps.append(
                f"""m{k} AS (SELECT {key}, e, i, sum(x[i])::HUGEINT AS t, count(*) AS n FROM p JOIN d{k} USING (rid, {key}), range(1, {width} + 1) AS r(i) GROUP BY ALL),
w{k} AS (SELECT {key}, e, list((t - ((t % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM m{k} GROUP BY ALL),
b{k + 1} AS (SELECT {key}, e, coalesce(w{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN w{k} USING ({key}, e))"""
            )
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY {key}, e)) AS codebooks_sha256 FROM b6),
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY {key}) AS code, sum(d)::BIGINT AS error FROM d6 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (rid), h"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def _op12_sql(least: int = 100, longest: int = 5, most: int = 2000) -> str:
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {longest + 1}) AS r(k)) GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND a >= {least}),
x AS (SELECT c.lang, c.phrase, c.k, c.a, j, array_to_string(w[1 : j], ' ') AS p, array_to_string(w[j + 1 :], ' ') AS q FROM c, range(1, {longest}) AS r(j) WHERE j < c.k),
s AS (SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, n, (1000 * x.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS score FROM x JOIN n USING (lang)
  JOIN g AS l ON l.lang = x.lang AND l.phrase = x.p JOIN g AS r ON r.lang = x.lang AND r.phrase = x.q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[f : f + m - 1], ' ') AS phrase, max(a) AS above FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS f FROM c, range(2, {longest}) AS r(m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b LEFT JOIN i USING (lang, phrase) WHERE above IS NULL OR 100 * above < 100 * a QUALIFY rank <= {most}"""


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE_SQL}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) AS a JOIN v AS b ON a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_kmeans_tree": op1_kmeans_tree, "op9_quality_rules": op9_quality_rules, "op10_kd_shards": op10_kd_shards, "op8_simhash": op8_simhash, "op3_bpe": op3_bpe, "op7_byte_cnn": op7_byte_cnn, "op2_suffix_tree": op2_suffix_tree, "op4_warc": op4_warc, "op5_block_labeller": op5_block_labeller, "op6_mixing": op6_mixing, "op11_product_codes": op11_product_codes, "op12_collocations": op12_collocations, "op13_norm_buckets": op13_norm_buckets}


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": OP9_SQL, "op4_warc": OP4_SQL, "op6_mixing": _op6_sql(), "op11_product_codes": _op11_sql(), "op12_collocations": _op12_sql(), "op13_norm_buckets": OP13_SQL}
