"""The whole job: objects to findings.

objects have target, object_key, object_type, path, size and content. Only blobs and files are observed for what keys open;
every object is searched. Contents stay in the passes that read them; what follows is as small as the hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import attribution, detectors, documents, findings, hosts, nearest, peers, sightings, spans
from ..sources.tables import cut
from . import advice, verdicts

MAX_OBJECT = 10 << 20
#: Fixed value: the label of the step that says what a key opens.
OPENS = "unlocks"


@dataclass
class Result:
    tokens: DataFrame
    findings: DataFrame
    results: DataFrame
    instances: DataFrame
    unlocks: DataFrame
    seen: DataFrame


def scanned(objects: DataFrame, max_object: int = MAX_OBJECT) -> DataFrame:
    """Blobs, commits, tags and files of at most max_object bytes (0: of any size)."""
    small = objects.filter(F.col("object_type").isin("blob", "commit", "tag", "file") & F.col("content").isNotNull())
    return small.filter(F.col("size") <= max_object) if max_object else small


def stats(objects: DataFrame, max_object: int = MAX_OBJECT) -> DataFrame:
    """Objects, scanned ones, those left out for their size, and bytes, by target."""
    large = (F.col("size") > max_object) if max_object else F.lit(False)
    return objects.groupBy("target").agg(F.count("*").alias("objects"), F.count_if(~large).alias("scanned"), F.count_if(large).alias("skipped_large"), F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("bytes"))


def free(tokens: DataFrame, hits: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Tokens without a registry's that stand in base64 text which was read as logins, and private keys in service account documents."""
    of = F.when(F.col("provider") == "gcp", "privatekey").otherwise("oci")
    held = hits.filter(F.col("cls") == "span").select(*group, "offset", "end", of.alias("provider"))
    may = (F.col("provider") == "oci") & F.col("encoded").isNull() | (F.col("provider") == "privatekey")
    may = F.coalesce(may & F.col("within").isNull(), F.lit(False))
    return tokens.filter(~may).unionByName(spans.outside(tokens.filter(may), held, (*group, "provider")))


def run(objects: DataFrame, ignore: DataFrame | None = None, max_object: int = MAX_OBJECT, history: dict[str, DataFrame] | None = None, listing: DataFrame | None = None, now: Column | None = None) -> Result:
    """Tokens with their companions, findings by target, counts, server addresses, and the files that name a key's public half.

    Contents are read by two narrow passes, for tokens and for addresses, and go no further: what is shuffled are hits. history: the tables of sources.trees.history,
    with target as repo; with it, tokens get path, commit, refs and how they can be reached. listing: the objects without their contents, from which
    the counts are taken where it is given. now: the clock that expiries are told against.
    """
    own = scanned(objects, max_object)
    sha = F.sha2("content", 256)
    hits = cut(detectors.hits(own.withColumn("sha", sha), detectors.SHAPES, documents.FORMATS + sightings.FORMATS, nearest.COMPANIONS, keep=("target", "object_key", "object_type", "path", "sha"), now=now))
    group = ("target", "object_key", "sha")
    hits = cut(documents.with_receivers(hits, group), hits)
    found = cut(free(documents.rescanned(hits, group), hits, group))
    said = nearest.all_companions(hits, group).withColumnsRenamed({"secret": "_secret", "attribution": "_said"})
    tokens = found.join(said, [*group, "offset", "value", "kind"], "left").filter((F.col("kind") != "azure-storage-account-key") | F.col("_said").isNotNull())
    within = F.when(F.col("within").isNotNull(), F.col("attribution"))
    tokens = tokens.withColumns({"attribution": F.coalesce(within, "_said", "attribution"), "secret": F.coalesce("_secret", "secret")})
    inside = found.filter(F.col("kind") == "gcp-oauth-user-credentials").select(*group, "value", F.lit("gcp-oauth-refresh-token").alias("kind"))
    tokens = tokens.join(inside, [*group, "value", "kind"], "left_anti")  # a refresh token in a document is the document's
    # each of the next steps reads its input several times, and would make all that is above anew each time
    tokens = peers.with_peers(cut(documents.once(tokens, group), found))
    tokens = tokens.select("target", "object_key", "object_type", "path", "provider", "kind", "value", "offset", "line", "checksum_verified", "attribution", "secret", "encrypted", "expires")
    tokens = findings.ignored(findings.classified(tokens), ignore)
    if history:
        tokens = located(tokens, history)
    tokens = cut(tokens)
    public = sightings.of_hits(hits.filter(F.col("object_type").isin("blob", "file")), ("target", "object_key", "path"))
    if history:
        public = attribution.with_paths(public.withColumnsRenamed({"target": "repo", "path": "_path"}), history["object_paths"]).withColumn("path", F.coalesce("path", "_path")).withColumnRenamed("repo", "target")
    seen = own.filter(F.col("object_type").isin("blob", "file"))
    text = V.bytes_view(F.col("content"))
    none = F.array().cast("array<struct<provider:string,origin:string>>")

    def named_servers(p: str) -> Column:
        """The servers of one provider. The lambda takes one argument: a second one would be the element's index."""
        found_ = F.transform(hosts.instances(text, p), lambda o: F.struct(F.lit(p).alias("provider"), o.alias("origin")))
        return F.when(F.contains("content", F.lit(f"{p}.".encode())), found_).otherwise(none)

    origins = F.concat(*map(named_servers, hosts.VENDORS))
    named = seen.select("target", "object_key", F.explode(origins).alias("o")).select("target", "object_key", "o.provider", "o.origin")
    return Result(tokens, findings.findings(tokens), stats(objects if listing is None else listing, max_object), named, sightings.unlocks(tokens, public), public)


def located(tokens: DataFrame, history: dict[str, DataFrame]) -> DataFrame:
    """Tokens with path, commit, refs and reachable: where each came from and how it can still be reached."""
    hits = tokens.withColumnRenamed("target", "repo").withColumnRenamed("path", "_path")
    hits = attribution.with_commits(attribution.with_paths(hits, history["object_paths"]), history["object_intro"], history["commits"])
    wanted = hits.filter(F.col("commit").isNotNull()).select("repo", F.col("commit.sha").alias("sha")).distinct()
    refs = attribution.refs_containing(history["commits"], history["refs"], wanted)
    hits = hits.join(refs.withColumnRenamed("sha", "_sha"), (hits["repo"] == refs["repo"]) & (F.col("commit.sha") == F.col("_sha")), "left").drop(refs["repo"]).drop("_sha")
    lost = hits.filter(F.col("commit").isNotNull() & F.col("refs").isNull()).select("repo", F.col("commit.sha").alias("sha")).distinct()
    rewrite = attribution.rewrites_of(lost, history["commits"], history["rewrites"]) if "rewrites" in history else lost.withColumn("rewrite", F.lit(None).cast("string"))
    hits = hits.join(rewrite.withColumnRenamed("sha", "_sha").withColumnRenamed("repo", "_repo"), (hits["repo"] == F.col("_repo")) & (F.col("commit.sha") == F.col("_sha")), "left").drop("_sha", "_repo")
    how = attribution.reachability(F.col("object_type"), F.col("commit").isNotNull(), F.col("refs").isNull(), F.col("rewrite"), F.coalesce("refs", F.array().cast("array<string>")), F.col("object_type") == "file")
    return hits.withColumns({"path": F.coalesce("path", "_path"), "reachable": how}).drop("_path", "rewrite").withColumnRenamed("repo", "target")


@dataclass
class Completed:
    findings: DataFrame
    steps: DataFrame


def completed(out: Result, answers: DataFrame | None = None, local: DataFrame | None = None, published: DataFrame | None = None, kinds: DataFrame | None = None, now: Column | None = None) -> Completed:
    """Findings with all that is known of them, and the steps that follow.

    findings: those of the job with status and detail (from recorded answers, and from expiries), opaque, local (where this machine
    has them), matches (whose published key they are, which the attribution says too) and servers (addresses of their provider's
    servers in their own objects, the first LISTED by name). steps: advice.steps() of each fingerprint, as its first target has it.
    answers: fingerprint, http_status, error; local: fingerprint, source; published: login, identifier, ord; kinds: what advice.steps takes.
    """
    spark, found = out.findings.sparkSession, out.findings
    none = lambda ddl: spark.createDataFrame([], ddl)
    matches = sightings.committers(out.tokens, out.seen, published if published is not None else none("login string, identifier string, ord int"))
    found = found.join(matches, ["target", "fingerprint"], "left").withColumn("attribution", F.concat_ws(", ", F.nullif("attribution", F.lit("")), "matches"))
    found = findings.with_local(found, local if local is not None else none("fingerprint string, source string"))
    found = verdicts.verified(found, answers if answers is not None else none("fingerprint string, http_status int, error string"), now)
    own = out.tokens.select("target", "provider", "object_key", V.fingerprint(F.col("value")).alias("fingerprint")).distinct()
    near = own.join(out.instances, ["target", "provider", "object_key"]).select("target", "fingerprint", "origin").distinct()
    nth = F.row_number().over(W.partitionBy("target", "fingerprint").orderBy("origin"))
    near = near.withColumn("_n", nth).filter(F.col("_n") <= findings.LISTED).groupBy("target", "fingerprint").agg(F.array_sort(F.collect_list("origin")).alias("servers"))
    dimension = verdicts.kinds(spark)
    found = found.join(near, ["target", "fingerprint"], "left").join(F.broadcast(dimension.select("provider", "kind", "opaque")), ["provider", "kind"], "left")  # a row a kind
    said = dimension.select("kind", "provider_name", F.lit(None).cast("string").alias("revoke_page"), (F.col("revocable") == "yes").alias("revocable"), *(F.lit(None).cast("string").alias(c) for c in ("revoke_note", "audit_note")), F.when(F.col("provider").isin("privatekey", "sops"), OPENS).alias("unlocks_label"), F.lit(None).cast("string").alias("unlocks_none"))
    one = found.groupBy("fingerprint").agg(F.min_by(F.struct("kind", "status", "opaque", "local"), "target").alias("f")).select("fingerprint", "f.*")
    one = one.withColumns({"app": F.lit(None).cast("string"), "revocation": F.lit(None).cast("string")})
    return Completed(found, advice.steps(one, kinds if kinds is not None else said, out.unlocks))


def shown(found: DataFrame, show_secrets: bool = False) -> DataFrame:
    """Findings without values and secrets, unless these are asked for."""
    return found if show_secrets else found.drop("value", "secret")


def report(found: DataFrame, show_secrets: bool = False) -> DataFrame:
    """Findings as JSON texts, one a row."""
    rows = shown(found, show_secrets)
    return rows.select("target", "fingerprint", F.to_json(F.struct(*rows.columns)).alias("json"))


def document(results: DataFrame, found: DataFrame, show_secrets: bool = False) -> DataFrame:
    """ord and line of one JSON document {"summary": ..., "results": [...]}: the summary's counts, then each target with its own, and after it its findings in the order of findings.ordered().

    A line is one finding, or the head or tail of a target or of the document, so nothing is gathered: written by ranges of ord,
    the files one after another are the document. results: target, files, error, skipped, objects, bytes.
    """
    rows = shown(found, show_secrets)
    place = findings.order_of(found)
    own = rows.select("target", F.struct(F.lit(1).alias("part"), place.alias("place")).alias("at"), F.to_json(F.struct(*(c for c in rows.columns if c != "target"))).alias("line"))
    none = F.lit(None).cast(own.schema["at"].dataType["place"].dataType)
    first = own.groupBy("target").agg(F.min("at").alias("first"))
    own = own.join(first, "target").select("target", "at", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), "line").alias("line"))
    least = results.agg(F.min("target").alias("_least"))
    own_results = results.join(F.broadcast(least))  # one row
    head = F.to_json(F.struct(*results.columns))
    opened = F.concat(F.when(F.col("target") == F.col("_least"), "").otherwise(","), F.left(head, F.length(head) - 1), F.lit(',"findings":['))
    heads = own_results.select("target", F.struct(F.lit(0).alias("part"), none.alias("place")).alias("at"), opened.alias("line"))
    tails = own_results.select("target", F.struct(F.lit(2).alias("part"), none.alias("place")).alias("at"), F.lit("]}").alias("line"))
    lines = heads.unionByName(own.join(results.select("target"), "target", "left_semi")).unionByName(tails).select(F.struct(F.lit(1).alias("part"), "target", "at").alias("ord"), "line")
    counts = findings.summary(results, found)
    edge = lambda part: F.struct(F.lit(part).alias("part"), F.lit(None).cast("string").alias("target"), F.lit(None).cast(lines.schema["ord"].dataType["at"].dataType).alias("at")).alias("ord")
    top = counts.select(edge(0), F.concat(F.lit('{"summary":'), F.to_json(F.struct(*counts.columns)), F.lit(',"results":[')).alias("line"))
    return top.unionByName(lines).unionByName(counts.select(edge(2), F.lit("]}").alias("line")))


def write_document(lines: DataFrame, path: str, parts: int = 200) -> None:
    """The lines of document() as text files whose names are in their order."""
    lines.repartitionByRange(parts, "ord").sortWithinPartitions("ord").select("line").write.text(path)


def exit_code(findings_: int, failed: int) -> int:
    """1 with findings, 2 if targets failed and nothing was found, else 0."""
    return 1 if findings_ else 2 if failed else 0
