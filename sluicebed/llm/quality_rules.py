"""Quality rules as a short-circuit cascade.

Each rule is a column that is true where a text is rejected. On a random sample over the whole table the cascade times
every rule and counts what the rules reject together, puts first the rule that rejects most per second, then the one that
does so among the rows it leaves, and so on, and evaluates them as one CASE expression: a text that an early rule rejects
never reaches the later, dearer ones, and what only those measure isn't measured. The order changes the cost of a verdict,
never the verdict. Native: no Python runs on the executors.

Defined results: null and blank texts have no words and zero measures, and are rejected; repeated rows are judged row by
row; rules that tie in rejections per cost keep their order; an empty table gives an empty result; extra columns are kept,
but for _j, _m and _rejected_by, the operator's own.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize, words

WINDOW = 8
#: Rows, about, on which costs and selectivities are estimated; the partitions they are dealt into; runs of each rule; the least cost in seconds.
SAMPLE_ROWS, SAMPLE_PARTS, REPEATS, STEP = 2048, 8, 3, 0.02


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the text, the first included."""
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs again, from the hashes in order of position."""
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    return F.aggregate(
        let(by_hash, twins),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )


#: From a text without null and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: word_chars(w),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")).cast("long"),
    "n_exclaimed": lambda t, w: F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long"),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}


@dataclass(frozen=True)
class Rule:
    """A name, the measures that the rule reads, and when it rejects, given a struct of them."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Column], Column]


#: The cascade reorders these by what it measures.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda m: 10 * m["n_dup_lines"] > 4 * m["n_lines"]),
    Rule("shouting", ("n_words", "n_exclaimed"), lambda m: 10 * m["n_exclaimed"] > 3 * m["n_words"]),
)


#: What a measure is, from a text without null and its words; measures that are known already can stand in for these.
Get = Callable[[str], Column]


def verdict(get: Get, order: list[Rule]) -> Column:
    """The first rule in the order that rejects, by name; null if none does. CASE stops there: what only later rules ask for isn't measured."""
    out = F
    for r in order:
        out = out.when(let(F.struct(*(get(n).alias(n) for n in r.needs)), r.reject), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def with_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of a text without null and its words; the text is split once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: body(t, w)))


def rejects(text: Column, rule: Rule) -> Column:
    return with_words(text, lambda t, w: let(F.struct(*(MEASURES[n](t, w).alias(n) for n in rule.needs)), rule.reject))


@dataclass(frozen=True)
class Estimate:
    """Of one rule: seconds on the sample beyond splitting the texts, and the share that it rejects of what the rules before it leave."""

    rule: Rule
    cost: float
    share: float


def greedy(rules: tuple[Rule, ...], costs: list[float], masks: dict[int, int]) -> list[Estimate]:
    """Rules by rejections per cost, each judged on the rows that those before it leave. masks: how many rows each set of rules rejects, as bits."""
    left, out = list(range(len(rules))), []
    while left:
        open_rows = sum(masks.values())
        gone = {k: sum(n for m, n in masks.items() if m >> k & 1) for k in left}
        best = max(left, key=lambda k: (gone[k] / costs[k], -costs[k], -k))
        out.append(Estimate(rules[best], costs[best], gone[best] / max(open_rows, 1)))
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
        left.remove(best)
    return out


def plan_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The cascade's order, from a sample of about sample_rows rows spread over the whole table.

    A rule's cost is the shortest of REPEATS runs over the sample less that of a run that only splits the texts, rounded to
    a power of two of STEP, so that noise doesn't reorder rules of like cost. What rules reject is counted jointly.
    """
    n = df.count()
    if not n:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    share = min(1.0, sample_rows / n)
    own = df.select(F.col(text).alias("_text"))
    sample = materialize((own.sample(False, share, 11) if share < 1 else own).repartition(SAMPLE_PARTS), "rules-sample")

    def seconds(rejected: Column) -> float:
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            sample.agg(F.count_if(rejected)).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    base = seconds(with_words(F.col("_text"), lambda t, w: F.size(w) < 0))
    costs = [STEP * 2 ** round(math.log2(max(seconds(rejects(F.col("_text"), r)) - base, STEP) / STEP)) for r in rules]
    bits = reduce(lambda a, b: a + b, (F.when(rejects(F.col("_text"), r), 1 << k).otherwise(0) for k, r in enumerate(rules)))
    masks = {r["mask"]: r["count"] for r in sample.groupBy(bits.alias("mask")).count().collect()}  # at most a row for each set of rules
    discard(sample)
    return greedy(rules, costs, masks)


def measure_and_judge(df: DataFrame, names: tuple[str, ...], text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns, a struct _m of the named measures, and _rejected_by, null where a row is kept. Rules read named measures as they are; others are made in the cascade, where a row gets that far."""
    order = [e.rule for e in plan_order(df, text, rules, sample_rows)]

    def both(t: Column, w: Column) -> Column:
        ready = F.struct(*(MEASURES[n](t, w).alias(n) for n in names))
        return let(ready, lambda m: F.struct(m.alias("m"), verdict(lambda n: m[n] if n in names else MEASURES[n](t, w), order).alias("by")))

    return df.withColumn("_j", with_words(F.col(text), both)).select(*df.columns, F.col("_j.m").alias("_m"), F.col("_j.by").alias("_rejected_by"))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns. Nothing is measured before the cascade asks for it."""
    order = [e.rule for e in plan_order(df, text, rules, sample_rows)]
    return df.filter(with_words(F.col(text), lambda t, w: verdict(lambda n: MEASURES[n](t, w), order)).isNull())
