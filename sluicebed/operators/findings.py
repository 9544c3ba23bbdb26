"""From tokens to findings: distinct credentials with everything known about them.

Every aggregation is keyed by target and value, or by fingerprint, with partial sums before the shuffle. Locations are rows,
distinct (object, line) pairs (locations()); a finding counts them all and nests the first LISTED, which are cut from each
task's rows before the shuffle, so a value that leaks into a third of all objects isn't gathered into one row. A caller that
needs all of them nested asks for every one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V

#: Locations that a finding lists; locations() has all of them as rows.
LISTED = 1000
#: Ranges of time that cache entries are ranked in, at least and at most, and entries of a range, about.
RANGES, MOST_RANGES, RANGE_ROWS = 64, 4096, 1 << 20


def ignored(tokens: DataFrame, ignore: DataFrame | None) -> DataFrame:
    """Without tokens whose fingerprint or kind is on the list. ignore: a column value."""
    if ignore is None:
        return tokens
    out = tokens.withColumn("_f", V.fingerprint(F.col("value"))) if "fingerprint" not in tokens.columns else tokens.withColumn("_f", F.col("fingerprint"))
    for name in ("_f", "kind"):
        out = out.join(ignore.select(F.col("value").alias(name)).distinct(), name, "left_anti")
    return out.drop("_f").select(*tokens.columns)


def locations(tokens: DataFrame) -> DataFrame:
    """target, fingerprint, object_key, line and hits: a row for each place of each value."""
    return tokens.groupBy("target", V.fingerprint(F.col("value")).alias("fingerprint"), "object_key", "line").agg(F.count("*").alias("hits"))


def findings(tokens: DataFrame, public: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """One row for each target and value. tokens: target, object_key, line, provider, kind, value, offset, checksum_verified, attribution and, if there is one, secret.

    Kind and attribution are those of the occurrence with the longest secret, ties going to the smaller kind and then to the
    smaller object and offset. occurrences counts hits, n_locations distinct places, of which locations lists the first LISTED, or every one.
    """
    if "secret" not in tokens.columns:
        tokens = tokens.withColumn("secret", F.lit(None).cast("string"))
    n = F.length(F.coalesce("secret", F.lit("")))
    own = [c for c in ("provider", "kind", "attribution", "secret", "checksum_verified", "encrypted", "expires") if c in tokens.columns]
    best = F.min_by(F.struct(*own), F.struct(-n, "kind", "object_key", "offset"))
    per_line = tokens.groupBy("target", "value", "object_key", "line").agg(F.count("*").alias("hits"), best.alias("best"), F.min(F.struct((-n).alias("n"), "kind", "object_key", "offset")).alias("first"))
    sums = F.min_by("best", "first").alias("best"), F.sum("hits").alias("occurrences"), F.count("*").alias("n_locations")
    nested = F.array_sort(F.collect_list(F.struct("object_key", "line"))).alias("locations")
    if every:
        whole = per_line.groupBy("target", "value").agg(*sums, nested)  # tokens are read once
    else:
        place = W.partitionBy("target", "value").orderBy("object_key", "line")
        some = tokens.select("target", "value", "object_key", "line").distinct().withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= LISTED)
        whole = per_line.groupBy("target", "value").agg(*sums).join(some.groupBy("target", "value").agg(nested), ["target", "value"])
    return whole.select("target", "best.provider", "best.kind", V.fingerprint(F.col("value")).alias("fingerprint"), V.redact(F.col("value"), F.col("best.kind").isin(*public) if public else False).alias("redacted"), *(f"best.{c}" for c in own if c not in ("provider", "kind")), "value", "occurrences", "n_locations", "locations")


def rank(status: Column, opaque: Column) -> Column:
    """Live ones first, then what nothing has rejected, then what nothing can verify, then rejected ones."""
    return F.when(status == "active", 0).when(status == "revoked", 3).when(opaque, 2).otherwise(1)


def order_of(found: DataFrame) -> Column:
    """By rank, passphrase-protected ones last, then kind and fingerprint."""
    col = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in found.columns else F.lit(d)
    return F.struct(rank(col("status", ""), col("opaque", False)).alias("rank"), col("encrypted", False).alias("encrypted"), F.col("kind"), F.col("fingerprint"))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(order_of(found))


def merged(found: DataFrame, every: bool = False) -> DataFrame:
    """One row for each fingerprint over all targets, in the order of targets: occurrences and n_locations summed, the longest secret's attribution, the first verdict, and the locations that the findings of the first LISTED targets list, at most LISTED. every: all locations that all findings list."""
    n = F.length(F.coalesce("secret", F.lit("")))
    status = F.col("status") if "status" in found.columns else F.lit(None).cast("string")
    nested = F.array_sort(F.collect_list(F.struct("target", "locations"))).alias("by_target")
    sums = (
        F.min_by("kind", "target").alias("kind"),
        F.min_by("redacted", "target").alias("redacted"),
        F.min_by("attribution", F.struct(-n, "target")).alias("attribution"),
        F.sum("occurrences").alias("occurrences"),
        F.count("*").alias("targets"),
        F.sum("n_locations").alias("n_locations"),
        F.min_by(status, F.when(status.isNotNull(), F.col("target"))).alias("status"),
    )
    if every:
        out = found.groupBy("fingerprint").agg(*sums, nested)
    else:
        nth = F.row_number().over(W.partitionBy("fingerprint").orderBy("target"))
        listed = found.select("fingerprint", "target", "locations").withColumn("_n", nth).filter(F.col("_n") <= LISTED).groupBy("fingerprint").agg(nested)
        out = found.groupBy("fingerprint").agg(*sums).join(listed, "fingerprint")
    flat = F.flatten(F.transform("by_target", lambda t: F.transform(t["locations"], lambda x: F.struct(t["target"].alias("target"), x["object_key"].alias("object_key"), x["line"].alias("line")))))
    return out.withColumn("locations", flat if every else F.slice(flat, 1, LISTED)).drop("by_target")


def summary(results: DataFrame, found: DataFrame) -> DataFrame:
    """One row: targets, failed, skipped, objects, bytes, findings (distinct), active. results: target, files, error, skipped, objects, bytes."""
    runs = results.agg(
        F.count_if(~F.col("files") & F.col("error").isNull() & ~F.col("skipped")).alias("repositories"), F.count_if(F.col("files") & F.col("error").isNull() & ~F.col("skipped")).alias("file_targets"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("skipped")).alias("skipped"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
    status = F.col("status") if "status" in found.columns else F.lit(None).cast("string")
    one = found.groupBy("fingerprint").agg(F.min_by(status, "target").alias("status"))
    return runs.join(F.broadcast(one.agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "active").alias("active"))))  # one row each


def across_instances(checks: DataFrame) -> DataFrame:
    """fingerprint, status, detail: live if one instance accepts it, revoked if every one rejects it, else unknown. checks: fingerprint, ord, instance, status, detail."""
    said = F.when((F.col("status") == "revoked") & (F.coalesce("detail", F.lit("")) == ""), F.concat(V.host_of(F.col("instance")), F.lit(" rejects it"))).otherwise(F.coalesce("detail", F.lit("")))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("said")))), lambda x: x["said"])
    out = checks.groupBy("fingerprint").agg(F.bool_or(F.col("status") == "active").alias("a"), F.bool_and(F.col("status") == "revoked").alias("r"), F.min_by(F.coalesce("detail", F.lit("")), F.when(F.col("status") == "active", F.col("ord"))).alias("live"), all_.alias("all"))
    return out.select("fingerprint", F.when(F.col("a"), "active").when(F.col("r"), "revoked").otherwise("unknown").alias("status"), F.when(F.col("a"), F.col("live")).otherwise(F.array_join("all", "; ")).alias("detail"))


def bound(found: DataFrame, instances: DataFrame) -> DataFrame:
    """Findings with the server addresses that belong to their provider: those named in their own objects first, then the rest, each sorted. found: provider, fingerprint, object_key rows; instances: provider, object_key, origin."""
    pairs = found.select("provider", "fingerprint", "object_key").distinct()
    far = instances.select("provider", "origin").distinct()
    near = pairs.join(instances.select("provider", "object_key", "origin").distinct(), ["provider", "object_key"]).groupBy("provider", "fingerprint").agg(F.array_sort(F.collect_set("origin")).alias("near"))
    every = far.groupBy("provider").agg(F.array_sort(F.collect_set("origin")).alias("far"))  # servers named, by provider
    out = pairs.select("provider", "fingerprint").distinct().join(near, ["provider", "fingerprint"], "left").join(every, "provider", "left")
    none = F.array().cast("array<string>")
    near_, far_ = F.coalesce("near", none), F.coalesce("far", none)
    return out.select("provider", "fingerprint", F.concat(near_, F.array_except(far_, near_)).alias("instances"))


def unlocked(found: DataFrame, sightings: DataFrame) -> DataFrame:
    """What a credential opens: (fingerprint, path, detail) for each file that names one of its identifiers. found: fingerprint, identifier; sightings: identifier, path, detail, ord."""
    seen = sightings.filter(F.col("path").isNotNull()).groupBy("identifier", "path").agg(F.min_by("detail", F.when(F.coalesce("detail", F.lit("")) != "", F.col("ord"))).alias("detail"))
    both = found.select("fingerprint", "identifier").distinct().join(seen, "identifier")
    return both.groupBy("fingerprint", "path").agg(F.coalesce(F.min("detail"), F.lit("")).alias("detail"))


def with_local(found: DataFrame, local: DataFrame) -> DataFrame:
    """Findings with the sources on this machine that hold the same credential. local: fingerprint, source."""
    return found.join(local.groupBy("fingerprint").agg(F.array_sort(F.collect_set("source")).alias("local")), "fingerprint", "left")


def classified(found: DataFrame) -> DataFrame:
    """Private keys in PEM form that stand where SSH keys stand are SSH keys. found: kind, path."""
    base = F.substring_index("path", "/", -1)
    ssh = (base.startswith("id_") & ~base.endswith(".pub")) | F.col("path").contains(".ssh/")
    return found.withColumn("kind", F.when((F.col("kind") == "tls-private-key") & ssh, "ssh-private-key").otherwise(F.col("kind")))


def evicted(entries: DataFrame, budget: int) -> DataFrame:
    """Cache entries that go, oldest first, until the rest fits the budget; held ones stay. entries: path, size, mtime, held.

    An entry goes if what is newer than it, with itself, is over the budget left by the held ones. Entries are cut into ranges
    of time, more for more entries, whose sums are a few rows; only within a range are they ranked.
    """
    held = entries.agg(F.coalesce(F.sum(F.when(F.col("held"), F.col("size"))), F.lit(0)).alias("held_bytes"))
    own = entries.filter(~F.col("held"))
    ranges = min(MOST_RANGES, max(RANGES, own.count() // RANGE_ROWS))
    bounds = own.agg(F.percentile_approx("mtime", [k / ranges for k in range(1, ranges)]).alias("bounds"))
    own = own.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("bounds", lambda b: b < F.col("mtime")))).drop("bounds")
    sums = own.groupBy("_range").agg(F.sum("size").alias("n"))
    after = sums.alias("a").join(F.broadcast(sums.select(F.col("_range").alias("r"), F.col("n").alias("m"))), F.col("r") > F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("_newer"))  # at most MOST_RANGES rows
    newer = W.partitionBy("_range").orderBy(F.desc("mtime"), F.desc("path")).rowsBetween(W.unboundedPreceding, 0)
    free = own.withColumn("_within", F.sum("size").over(newer)).join(F.broadcast(after), "_range").withColumn("kept_bytes", F.col("_within") + F.col("_newer")).join(F.broadcast(held))
    return free.filter(F.col("kept_bytes") + F.col("held_bytes") > budget).select("path", "size", "mtime")


def exposure(found: DataFrame) -> DataFrame:
    """Counts by provider and kind with their totals. An extension."""
    return found.cube("provider", "kind").agg(F.count("*").alias("findings"), F.sum("occurrences").alias("occurrences"))
