"""What to do about a finding: ordered steps as rows, from what its kind and its state say.

kinds: kind, provider_name, revoke_page, revocable, revoke_note, audit_note, unlocks_label, unlocks_none; nulls and empty texts say
nothing. Every step is an expression over a finding's row; only unlocks are aggregated, by finding and target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V

#: How many files of a target are named, and how many targets; the rest is counted.
FILES, TARGETS = 3, 1000
#: Texts of the steps.
PENDING, DONE = " accepted the revocation and is still processing it; run again with --verify to confirm", ", {} rejects it now"
LOCAL = ("still configured in ", "; replace it there after revoking")


def unlocks_text(unlocks: DataFrame, files: int = FILES, targets: int = TARGETS) -> DataFrame:
    """fingerprint and text: by target how many files name the key, and the first of them with what they say. unlocks: target, fingerprint, path, detail, one row a file."""
    entry = F.concat("path", F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    nth = F.row_number().over(W.partitionBy("fingerprint", "target").orderBy("path"))
    counted = unlocks.groupBy("fingerprint", "target").agg(F.count("*").alias("n"))
    first = unlocks.select("fingerprint", "target", "path", entry.alias("entry")).withColumn("_n", nth).filter(F.col("_n") <= files)
    first = first.groupBy("fingerprint", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "entry"))), lambda x: x["entry"]).alias("some"))
    more = F.when(F.col("n") > files, F.concat(F.lit(", +"), (F.col("n") - files).cast("string"), F.lit(" more"))).otherwise("")
    said = F.concat("target", F.lit(": "), F.col("n").cast("string"), F.when(F.col("n") == 1, " file (").otherwise(" files ("), F.array_join("some", ", "), more, F.lit(")"))
    by_target = counted.join(first, ["fingerprint", "target"]).select("fingerprint", "target", said.alias("said"))
    listed = by_target.withColumn("_n", F.row_number().over(W.partitionBy("fingerprint").orderBy("target"))).filter(F.col("_n") <= targets)
    texts = listed.groupBy("fingerprint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "said"))), lambda x: x["said"]), " · ").alias("text"))
    beyond = by_target.groupBy("fingerprint").agg((F.count("*") - targets).alias("_more")).filter("_more > 0")
    rest = F.when(F.col("_more").isNotNull(), F.concat(F.lit(" · +"), F.col("_more").cast("string"), F.lit(" more"))).otherwise("")
    return texts.join(beyond, "fingerprint", "left").select("fingerprint", F.concat("text", rest).alias("text"))


def _said(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))


def revoke_text() -> Column:
    """Where to revoke by hand, and how it can be done otherwise or what stands against it; null if nothing is known."""
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    where = F.concat(F.when(active, "at ").otherwise("if it is still valid, at "), _said("revoke_page"), F.coalesce(F.concat(F.lit(" under "), _said("app")), F.lit("")))
    can = F.coalesce("revocable", F.lit(False))
    how = F.when(can & active, "or run again with --revoke").when(can & ~F.coalesce("opaque", F.lit(False)), "or with --verify --revoke").otherwise(_said("revoke_note"))
    return F.nullif(F.concat_ws("; ", where, how), F.lit(""))


def steps(found: DataFrame, kinds: DataFrame, unlocks: DataFrame) -> DataFrame:
    """fingerprint, ord, label and text: unlocks, revoke, local, audit; a credential that its provider rejects needs no revocation.

    found: fingerprint, kind, status, app, opaque, revocation (pending, done or null), local (where this machine has it).
    """
    rows = found.join(F.broadcast(kinds), "kind", "left")  # a row a kind, whatever the data
    rows = rows.join(unlocks_text(unlocks).withColumnRenamed("text", "_opens"), "fingerprint", "left")
    dead = F.coalesce(F.col("status") == "revoked", F.lit(False))
    who = F.coalesce("provider_name", "kind")
    revoke = F.when(F.col("revocation") == "pending", F.concat(who, F.lit(PENDING))).when(F.col("revocation") == "done", F.concat(F.lit("done"), F.format_string(DONE.replace("{}", "%s"), who))).when(~dead, revoke_text())
    local = F.when((F.size(F.coalesce("local", F.array().cast("array<string>"))) > 0) & ~dead, F.concat(F.lit(LOCAL[0]), F.array_join("local", ", "), F.lit(LOCAL[1])))
    opens = F.when(_said("unlocks_label").isNotNull(), F.coalesce("_opens", _said("unlocks_none")))
    step = lambda label, text: F.struct(label.alias("label"), text.alias("text"))
    all_ = F.array(step(F.col("unlocks_label"), opens), step(F.lit("revoke"), revoke), step(F.lit("local"), local), step(F.lit("audit"), _said("audit_note")))
    return rows.select("fingerprint", F.posexplode(F.filter(all_, lambda s: s["text"].isNotNull())).alias("ord", "s")).select("fingerprint", "ord", "s.label", "s.text")


def status_line() -> Column:
    """One line for a target: a mark, what was read, and how many credentials were found, or why it was skipped or failed.

    Columns: target, files, skipped, error, scanned, bytes, duration (a text), refs, orphaned, rewrites, skipped_large, findings.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    many = lambda c, one: F.concat(n(c).cast("string"), F.lit(f" {one}"), F.when(n(c) == 1, "").otherwise("s"))
    some = lambda c, text: F.when(n(c) > 0, text)
    files = F.coalesce("files", F.lit(False))
    thing = lambda c, adjective="": F.when(files, many(c, f"{adjective}file")).otherwise(many(c, f"{adjective}object"))
    read = F.concat_ws(
        " · ", thing("scanned"), V.format_size(n("bytes")), "duration", some("refs", many("refs", "ref")), some("orphaned", F.concat(F.col("orphaned").cast("string"), F.lit(" orphaned commits"))),
        some("rewrites", F.concat(F.col("rewrites").cast("string"), F.lit(" rewritten commits fetched"))), some("skipped_large", F.concat(thing("skipped_large", "large "), F.lit(" skipped"))),
    )
    skipped, failed = F.coalesce("skipped", F.lit(False)), F.col("error").isNotNull()
    said = F.when(skipped, F.concat(F.lit("skipped: "), F.coalesce("error", F.lit("")))).when(failed, F.concat(F.lit("failed: "), "error")).otherwise(read)
    mark = F.when(skipped, "–").when(failed, "✘").when(n("findings") > 0, "!").otherwise("✔")
    return F.concat(F.format_string("%s %-32s ", mark, F.coalesce("target", F.lit(""))), said, F.coalesce(some("findings", F.concat(F.lit(" · "), many("findings", "credential"))), F.lit("")))
