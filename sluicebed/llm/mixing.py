"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking starts from one keeping probability for all cells and moves
the expected tokens of each value of a marginal to its target in turn, source, language, topic, for a fixed number of sweeps;
no probability passes 1, so a target that a marginal hasn't the tokens for is met as far as they go. Documents are then
sampled by the probability of their cell: a document stays if the hash of its id, as a number in [0, 1), is below it.

Targets default to tempered shares: a value's share of tokens to the power TEMPER, scaled to sum to one, times FRACTION of all
tokens. Given targets are rows of (value, share); a value that a given table lacks keeps nothing.

Only cells are raked, a table as large as there are combinations; documents are never shuffled whole: each task sums its own
cells before the shuffle, so a source with a third of all rows is a few rows. Each sweep is written to the shared folder. The
cells come back to the documents by a join that Spark broadcasts where it knows the cells to be few and
splits where one is hot. Native: no Python runs on the executors.

Defined results: null and blank texts have no tokens and form cells like others (topic `empty`); null sources, languages and
ids are values like any other; repeated rows share their fate; a cell without tokens has the mean of its marginals' ratios; an
empty table gives an empty result; extra columns are kept, but for _m, _mix, _p and _p_source, _p_lang, _p_topic, the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

SWEEPS = 8
TEMPER = 0.7
FRACTION = 0.8
#: Decimal places of a probability.
PLACES = 6
DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """What a text is made of, by shares of its characters: empty, numbers, markup, table, lines (short ones), long, or prose."""

    def named(t: Column) -> Column:
        n = F.char_length(t)
        without = lambda chars: n - F.char_length(F.translate(t, chars, ""))
        return (
            F.when(n == 0, "empty")
            .when(10 * without("0123456789") > n, "numbers")
            .when(50 * without("{}[]<>;=#*$%&_") > n, "markup")
            .when(100 * without("|\t") > n, "table")
            .when(20 * without("\n") > n, "lines")
            .when(n > 4000, "long")
            .otherwise("prose")
        )

    return let(F.coalesce(text, F.lit("")), named)


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION, sweeps: int = SWEEPS) -> DataFrame:
    """cells with their keeping probability p; cells: source, lang, topic, tokens. targets: (value, tokens wanted) by dimension."""
    for dim in DIMS:
        want = targets[dim].select(F.col("value").alias("_v"), F.col("want").alias(f"want_{dim}"))
        cells = cells.join(want, F.col(dim).eqNullSafe(F.col("_v")), "left").drop("_v")
    kept = [*DIMS, "tokens", *(f"want_{d}" for d in DIMS)]
    now = materialize(cells.withColumn("p", F.lit(float(fraction))), "mix-cells")
    for _ in range(sweeps):
        for dim in DIMS:
            have = now.groupBy(F.col(dim).alias("_v")).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
            factor = F.when(F.col("have") > 0, F.coalesce(f"want_{dim}", F.lit(0.0)) / F.col("have")).otherwise(1.0)
            now = now.join(have, F.col(dim).eqNullSafe(F.col("_v"))).select(*kept, F.round(F.least(F.lit(1.0), F.col("p") * factor), 9).alias("p"))
        now = materialize(now, "mix-cells")
    return now.select(*DIMS, "tokens", F.round("p", PLACES).alias("p"))


def tempered(cells: DataFrame, dim: str, fraction: float = FRACTION, temper: float = TEMPER) -> DataFrame:
    """value and want: the tokens that a value should have, from its share to the power `temper`."""
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("n"))
    both = own.agg(F.sum(F.pow("n", F.lit(temper))).alias("scale"), F.sum("n").alias("total"))
    return own.join(F.broadcast(both)).select("value", (F.pow("n", F.lit(temper)) / F.col("scale") * F.col("total") * fraction).alias("want"))  # one row, broadcast


def shares(targets: DataFrame, cells: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """value and want from given rows of (value, share)."""
    both = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    return targets.join(F.broadcast(both)).select("value", (F.col("share") * F.col("total") * fraction).alias("want"))


def _cell(source_col: str, lang_col: str, text_col: str) -> list[Column]:
    return [F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), topic_of(F.col(text_col)).alias("topic")]


def _joined(docs: DataFrame, cells: DataFrame, id_col: str, targets: dict[str, DataFrame] | None, fraction: float, temper: float, sweeps: int) -> DataFrame:
    """docs, which have a struct _m of their cell, with weight and kept in it. cells: source, lang, topic, tokens."""
    cells = materialize(cells.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    wanted = {d: materialize(shares(targets[d], cells, fraction) if targets and d in targets else tempered(cells, d, fraction, temper), f"mix-{d}") for d in DIMS}
    p = rake(cells, wanted, fraction, sweeps).select(*(F.col(d).alias(f"_p_{d}") for d in DIMS), F.col("p").alias("_p"))
    same = F.col("_m.source").eqNullSafe(F.col("_p_source")) & F.col("_m.lang").eqNullSafe(F.col("_p_lang")) & (F.col("_m.topic") == F.col("_p_topic"))
    both = docs.join(p, same, "left").withColumn("_mix", F.struct("_m.*", F.col("_p").alias("weight"), (chance(F.col(id_col)) < F.col("_p")).alias("kept")))
    return both.drop("_m", "_p", *(f"_p_{d}" for d in DIMS))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, temper: float = TEMPER, sweeps: int = SWEEPS
) -> DataFrame:
    """The documents without their text, with a struct _mix: source, lang, topic, tokens, weight (the probability) and kept. Texts are read once."""
    measured = docs.withColumn("_m", F.struct(*_cell(source_col, lang_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("tokens"))).drop(text_col)
    measured = materialize(measured, "mix-measured")
    return _joined(measured, measured.select("_m.*"), id_col, targets, fraction, temper, sweeps)


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, temper: float = TEMPER, sweeps: int = SWEEPS
) -> DataFrame:
    """The documents that stay, with their columns. Texts are read twice: for the cells' tokens, and for each document's cell."""
    cells = docs.select(*_cell(source_col, lang_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("tokens"))
    own = docs.withColumn("_m", F.struct(*_cell(source_col, lang_col, text_col)))
    return _joined(own, cells, id_col, targets, fraction, temper, sweeps).filter("_mix.kept").drop("_mix")
