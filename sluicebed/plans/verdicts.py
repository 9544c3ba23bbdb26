"""Whether a credential is live, from recorded answers; and what a revocation would ask of whom.

Nothing here asks a server. Answers are rows that something else has recorded; the tables below say what an answer means for a
provider, the first row that fits deciding, anything else being unknown. Revocation is a plan only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provider, kinds (a pattern), HTTP status (0: any), pattern of the error code or text, verdict. In order.
ANSWERS = [
    ("github", "github-refresh", 0, "", "unverifiable"), ("github", "", 200, "", "active"), ("github", "", 401, "", "revoked"),
    ("gitlab", "gitlab-(ci-job|pipeline-trigger|feed|incoming-mail|agent|oauth-app|feature-flag|scim).*", 0, "", "unverifiable"),
    ("gitlab", "gitlab-pat", 200, "revoked|inactive", "revoked"), ("gitlab", "gitlab-pat", 403, "", "active"), ("gitlab", "gitlab-runner-token", 403, "", "revoked"), ("gitlab", "", 200, "", "active"), ("gitlab", "", 401, "", "revoked"),
    ("slack", "slack-refresh-token", 0, "", "unverifiable"), ("slack", "slack-webhook", 400, "invalid_payload|no_text", "active"), ("slack", "slack-webhook", 404, "no_service|no_team", "revoked"), ("slack", "slack-webhook", 403, "invalid_token", "revoked"),
    ("slack", "slack-(app|config)-token", 200, "not_allowed_token_type", "active"), ("slack", "slack-(bot|user|app|config)-token", 200, "invalid_auth|token_revoked|account_inactive", "revoked"), ("slack", "slack-(bot|user|app|config)-token", 200, "ok", "active"),
    ("aws", "", 200, "", "active"), ("aws", "", 403, "InvalidClientTokenId", "revoked"), ("aws", "aws-temporary-access-key", 403, "ExpiredToken.*", "revoked"),
    ("gcp", "gcp-oauth-access-token", 400, "invalid_token", "revoked"), ("gcp", "gcp-service-account-key", 400, "invalid_grant.*(signature|not found|disabled).*", "revoked"), ("gcp", "gcp-oauth-(refresh-token|user-credentials)", 400, "invalid_grant.*", "revoked"),
    ("gcp", "gcp-api-key", 403, "", "active"), ("gcp", "gcp-api-key", 400, ".*API key not valid.*", "revoked"), ("gcp", "", 200, "", "active"),
    ("azure", "azure-client-secret", 0, "AADSTS(7000215|7000222)", "revoked"), ("azure", "azure-storage-account-key", 403, "AuthenticationFailed", "revoked"), ("azure", "azure-storage-account-key", 404, "", "revoked"), ("azure", "azure-sas-token", 403, "AuthenticationFailed", "revoked"), ("azure", "azure-sas-token", 403, "Authorization.*", "active"), ("azure", "", 200, "", "active"),
    ("sops", "", 0, "", "unverifiable"),
    ("anthropic", "anthropic-oauth-refresh-token", 0, "", "unverifiable"), ("anthropic", "", 200, "", "active"), ("anthropic", "", 401, "authentication_error", "revoked"), ("anthropic", "", 403, "permission_error", "active"),
    ("openai", "", 200, "", "active"), ("openai", "", 401, "invalid_api_key", "revoked"),
    ("grafana", "", 200, "", "active"), ("grafana", "", 401, "", "revoked"), ("grafana", "", 403, "", "active"),
    ("pagerduty", "pagerduty-routing-key", 0, "", "unverifiable"), ("pagerduty", "", 200, "", "active"), ("pagerduty", "", 401, "", "revoked"),
    ("npm", "", 200, "", "active"), ("npm", "", 401, "", "revoked"),
    ("kubernetes", "kubernetes-secret-manifest", 0, "", "unverifiable"), ("kubernetes", "", 403, "anonymous", "revoked"), ("kubernetes", "", 403, "", "active"), ("kubernetes", "", 200, "", "active"), ("kubernetes", "", 401, "", "revoked"),
    ("privatekey", "(tls|cosign)-private-key", 0, "", "unverifiable"), ("privatekey", "ssh-private-key", 200, "", "active"), ("privatekey", "ssh-private-key", 0, "unable to authenticate", "revoked"),
    ("oci", "", 200, "anonymous", "unknown"), ("oci", "", 403, "anonymous", "revoked"), ("oci", "", 403, "", "active"), ("oci", "", 200, "", "active"), ("oci", "", 401, "", "revoked"),
]
#: Kinds that an interface can revoke, those that it can with an administrator's key, by provider.
REVOCABLE = {
    "github": ("github-pat", "github-fine-grained-pat", "github-oauth", "github-user-to-server", "github-refresh"), "gitlab": ("gitlab-pat",), "slack": ("slack-bot-token", "slack-user-token", "slack-refresh-token"), "aws": ("aws-access-key",),
    "gcp": ("gcp-oauth-user-credentials", "gcp-oauth-access-token", "gcp-oauth-refresh-token"), "npm": ("npm-access-token", "npm-legacy-token"), "oci": ("docker-hub-pat",),
}
WITH_ADMIN = {"anthropic": ("anthropic-api-key",), "openai": ("openai-project-key", "openai-service-account-key", "openai-admin-key")}
BATCH = 1000
#: Digits of a fingerprint that make a range.
RANGE = 3


def verdict(provider: Column, kind: Column, http_status: Column, error: Column) -> Column:
    out = F
    for p, kinds, status, pattern, said in ANSWERS:
        fits = provider == p
        if kinds:
            fits = fits & kind.rlike(f"^(?:{kinds})\\z")
        if status:
            fits = fits & (http_status == status)
        if pattern:
            fits = fits & F.coalesce(error, F.lit("")).rlike(f"^(?:{pattern})\\z")
        out = out.when(F.coalesce(fits, F.lit(False)), F.lit(said))
    return out.otherwise("unknown")


#: Kinds that nothing accepts past their expiry, and what is said of them then, after the day.
EXPIRING = {"kubernetes-client-certificate": "; no API server accepts an expired certificate", "kubernetes-service-account-token": "; a bound token is not accepted past its expiry", "azure-sas-token": "; no storage service accepts an expired signature"}


def expired(kind: Column, expires: Column, now: Column) -> Column:
    """Why a credential is revoked offline, past the expiry (in seconds) that it states itself; null if it isn't."""
    past, day = F.timestamp_seconds(expires) < now, F.date_format(F.timestamp_seconds(expires), "yyyy-MM-dd")
    return F.coalesce(*(F.when((kind == k) & past, F.concat(F.lit("expired on "), day, F.lit(said))) for k, said in EXPIRING.items()))


def verified(found: DataFrame, answers: DataFrame, now: Column | None = None) -> DataFrame:
    """Findings with a status and, where it is known without asking, a detail; without an answer the status is what the kind alone says, else unknown. answers: fingerprint, http_status, error; now: the clock."""
    out = found.join(answers.select("fingerprint", "http_status", "error"), "fingerprint", "left")
    status = verdict(F.col("provider"), F.col("kind"), F.coalesce("http_status", F.lit(-1)), F.col("error"))
    past = expired(F.col("kind"), F.col("expires"), now if now is not None else F.current_timestamp()) if "expires" in found.columns else F.lit(None).cast("string")
    return out.withColumns({"status": F.when(past.isNotNull(), "revoked").otherwise(status), "detail": past}).drop("http_status", "error")


def revocable(kind: Column, admin: bool = False) -> Column:
    return kind.isin([k for d in (REVOCABLE, *([WITH_ADMIN] if admin else [])) for v in d.values() for k in v])


def revocation_plan(found: DataFrame, admin: bool = False, batch: int = BATCH) -> DataFrame:
    """What would be asked: provider, request (numbered), credentials in it and their fingerprints. Live or unchecked revocable ones; nothing is sent."""
    from pyspark.sql import Window as W

    own = found.filter(revocable(F.col("kind"), admin) & (F.coalesce("status", F.lit("unknown")) != "revoked")) if "status" in found.columns else found.filter(revocable(F.col("kind"), admin))
    own = own.select("provider", "fingerprint").distinct().withColumn("_range", F.left("fingerprint", F.lit(RANGE)))
    # numbered in order by ranges of the fingerprint: how many come before a range is a sum over at most 16^RANGE rows a provider
    sizes = own.groupBy("provider", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("provider").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy("provider", "_range").orderBy("fingerprint"))
    ranked = own.withColumn("_nth", nth).join(sizes.select("provider", "_range", before.alias("_before")), ["provider", "_range"])
    ranked = ranked.select("provider", "fingerprint", F.floor((F.col("_before") + F.col("_nth") - 1) / batch).alias("request"))
    return ranked.groupBy("provider", "request").agg(F.count("*").alias("credentials"), F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))


def after_request(before: Column, after: Column) -> Column:
    """Outcome of a request, from the status asked for afterwards: revoked, or pending; an unknown answer keeps the earlier status."""
    return F.when(after == "revoked", "revoked").when(after == "unknown", F.coalesce(before, F.lit("pending"))).otherwise("pending")


def kinds(spark: SparkSession) -> DataFrame:
    """The kinds dimension: provider, provider_name, kind, description, checksum (its shape is verified offline), opaque (nothing can verify it), revocable (no, yes, admin)."""
    from ..operators import detectors, documents, names

    checked = {(s.provider, s.kind): s.checksum for s in detectors.SHAPES}
    every = {(s.provider, s.kind): False for s in detectors.SHAPES} | {k: False for k in documents.KINDS}
    rows = []
    for provider, kind in every:
        opaque = any(p == provider and said == "unverifiable" and not status and re.fullmatch(kinds_ or ".*", kind) for p, kinds_, status, _, said in ANSWERS)
        how = "yes" if kind in REVOCABLE.get(provider, ()) else "admin" if kind in WITH_ADMIN.get(provider, ()) else "no"
        rows.append((provider, names.PROVIDERS.get(provider, provider), kind, names.KINDS.get(kind, kind), checked.get((provider, kind), False), opaque, how))
    return spark.createDataFrame(sorted(rows), "provider string, provider_name string, kind string, description string, checksum boolean, opaque boolean, revocable string")


def answers_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ANSWERS)], "ord int, provider string, kinds string, http_status int, pattern string, status string")
