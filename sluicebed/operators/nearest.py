"""Companions of a credential: the candidate of the same object that most likely belongs to it.

Candidates are rows of the pass that found the credential (detectors.hits): the helpers below look for them only in objects
with a token of their provider. A key's best candidate is always the nearest before or the nearest after it within a class of
candidates, so no pairs are formed: keys and candidates lie in one table by position, and two windows carry the last and
the next candidate of each class to each key. That is linear in an object with thousands of candidates, where a join on the
object would be quadratic. An object is the unit of work, bounded by its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .detectors import WINDOW, Companions, Row

GUID = rb"(?<![A-Za-z0-9_])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
#: The words that a tenant, a client id, or a storage account stands behind, and how far.
TENANT = ("tenant", "microsoftonline.com/", "sts.windows.net/")
CLIENT = ("client_id", "clientid", "client-id", "appid", "app_id", "app-id", "applicationid", "application_id", "application-id")
ACCOUNT = ("accountname", "account_name", "account-name", "storage_account", "storageaccount", "storage-account")
STORAGE_HOSTS = "blob|dfs|file|queue|table|web"
BEHIND, BEFORE = 120, 48
#: What findings say about their companions.
SAID = {
    "no secret": ", key id only, secret not found nearby", "pair": ", key pair", "session": ", key pair with session token", "no session": ", key pair, session token not found nearby",
    "app": "app ", "in tenant": " in tenant ", "no tenant": ", tenant id not found nearby", "tenant": "tenant ", "no client": ", client id not found nearby", "neither": "tenant and client id not found nearby",
    "account": "storage account ", "user": "user ", "no user": "username not found nearby", "username": "username ", "registry": "in an .npmrc for ", "default": "the default registry",
}
DEPLOY_USER = re.compile(rb"gitlab\+deploy-token-[0-9]{1,20}(?![A-Za-z0-9])")
_RUN = re.compile(rb"[A-Za-z0-9/+]+")
_HEX = re.compile(rb"[0-9A-Fa-f]+")
_GUID = re.compile(GUID)
_HOST = re.compile(rf"(?<![A-Za-z0-9_-])([a-z0-9]{{3,24}})\.(?i:(?:{STORAGE_HOSTS})\.core\.windows\.net)".encode())
_NAMED = re.compile(rb"[A-Za-z0-9_-]{0,80}+[ \t=:\"'>]{0,80}+([a-z0-9]{3,24})(?![A-Za-z0-9])")
_USER = re.compile(rb"(?<![A-Za-z0-9])(?:(?i:username|user)(?![A-Za-z0-9])|-[uU] )[ \t:=\"']{0,64}+([A-Za-z0-9_.@-]{1,128})")
_REGISTRY = re.compile(rb"//([^\s\"']*?)/?:\Z")


def _candidate(cls: str, start: int, end: int, value: bytes, keyword: bool = False) -> Row:
    return {"cls": cls, "offset": start, "end": end, "value": value.decode("latin-1"), "keyword": keyword}


def key_candidates(content: bytes) -> Iterator[Row]:
    """Runs that are secret keys or session tokens by their letters, and whether their line names them before."""
    for m in _RUN.finditer(content):
        n = m.end() - m.start()
        if n == 40 and re.search(b"[A-Z]", m[0]) and re.search(b"[a-z]", m[0]) and not _HEX.fullmatch(m[0]) or n >= 100:
            before = content[max(0, m.start() - BEFORE) : m.start()].rpartition(b"\n")[2].lower()
            cls, word = ("aws-secret", b"secret") if n == 40 else ("aws-session", b"session")
            end = m.end() if n == 40 else re.compile(b"=*").match(content, m.end()).end()
            yield _candidate(cls, m.start(), end, content[m.start() : end], word in before)


def _ends(lower: bytes, words: tuple[str, ...]) -> list[int]:
    """Where each of the words ends, in order. Plain searches: a pattern of alternatives in any case is tried at every byte."""
    out = []
    for w in map(str.encode, words):
        at = lower.find(w)
        while at >= 0:
            out.append(at + len(w))
            at = lower.find(w, at + 1)
    return sorted(out)


def principal_candidates(content: bytes) -> Iterator[Row]:
    """The first GUID behind each word for a tenant or a client, and the accounts of storage hosts and settings."""
    lower = content.lower()
    for cls, words in (("tenant", TENANT), ("client", CLIENT)):
        seen = set()
        for end in _ends(lower, words):
            g = _GUID.search(content, end, end + BEHIND + 36)
            if g and g.start() - end < BEHIND and g.start() not in seen:
                seen.add(g.start())
                yield _candidate(f"azure-{cls}", g.start(), g.end(), g[0])
    hosts = [m for m in _HOST.finditer(content)] if b".core.windows.net" in lower else []
    named = [m for end in _ends(lower, ACCOUNT) if (m := _NAMED.match(content, end))]
    for start, value in {m.start(1): m[1] for m in (*hosts, *named)}.items():
        yield _candidate("azure-account", start, start + len(value), value)


def user_candidates(content: bytes) -> Iterator[Row]:
    lower, done = content.lower(), 0
    for at in sorted(m.start() for text in (b"user", b"-u ") for m in re.finditer(text, lower)):
        if at >= done and (m := _USER.match(content, at)):
            done = m.end()
            if not m[1].startswith(b"dckr_"):
                yield _candidate("hub-user", m.start(), m.end(), m[1])


def deploy_users(content: bytes) -> Iterator[Row]:
    """The first user name of a deploy token."""
    if m := DEPLOY_USER.search(content):
        yield _candidate("deploy-user", m.start(), m.end(), m[0])


def registries(content: bytes) -> Iterator[Row]:
    """The registry, with its scheme, that the line of each setting names before it; none for the default one."""
    for m in re.finditer(rb"_authToken[ \t]{0,4}=[ \t]{0,4}[\"']?", content):
        before = content[content.rfind(b"\n", 0, m.start()) + 1 : m.start()]
        host = _REGISTRY.search(before[before.rfind(b"//") :]) if b"//" in before else None
        yield _candidate("npm-registry", m.end(), m.end(), b"https://" + host[1] if host and host[1] else b"")


COMPANIONS: Companions = {"aws": key_candidates, "azure": principal_candidates, "oci": user_candidates, "gitlab": deploy_users, "npm": registries}


def paired(hits: DataFrame, is_key: Column, classes: dict[str, list[Column]], rank: Callable[[Column, Column], Column], start: str = "offset", end: str = "end", group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """The keys among hits with a struct for each name of `classes` (null if there is none): the nearest candidate before or after with the largest rank.

    classes: for each name the conditions of candidates that are kept apart. rank: a struct over k (a key) and c (a
    candidate), compared field by field; on equal ranks the candidate that starts first wins. start, end: a key's columns.
    """
    conds = [c for cs in classes.values() for c in cs]
    is_key = F.coalesce(is_key, F.lit(False))
    wanted = is_key
    for c in conds:
        wanted = wanted | F.coalesce(c, F.lit(False))
    item = F.struct(F.col("offset").alias("start"), "end", "line", "value", "keyword")
    laid = hits.filter(wanted).withColumns({"_key": is_key.cast("int"), "_cand": item})
    # what follows is what precedes in the other order: frames that grow take linear time, frames that shrink don't
    place = ("offset", "_key", "kind", "value")
    orders = (("b", [F.asc(c) for c in place]), ("a", [F.desc(c) for c in place]))
    sides = {f"_n{i}{side}": F.last(F.when(c, F.col("_cand")), ignorenulls=True).over(W.partitionBy(*group).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)) for side, by in orders for i, c in enumerate(conds)}
    out = laid.withColumns(sides).filter(F.col("_key") == 1)
    key = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), "line")
    at, best = 0, {}
    for name, cs in classes.items():
        near = F.filter(F.array(*(F.col(f"_n{i}{s}") for i in range(at, at + len(cs)) for s in "ba")), lambda c: c.isNotNull())
        best[name] = F.array_max(F.transform(near, lambda c: F.struct(rank(key, c).alias("r"), (-c["start"]).alias("s"), c.alias("c"))))["c"]
        at += len(cs)
    return out.withColumns(best).drop("_key", "_cand", *sides)


def after_first(k: Column, c: Column) -> Column:
    """Named by its keyword first; then on the key's line or the next; then the closest, what stands before counting double."""
    after = c["start"] >= k["end"]
    near = after & (c["line"] - k["line"] <= 1)
    return F.struct(c["keyword"].cast("int").alias("kw"), near.cast("int").alias("near"), F.when(after, k["end"] - c["start"]).otherwise(-2 * (k["start"] - c["end"])).alias("gap"))


def before_first(k: Column, c: Column) -> Column:
    """The closest, what stands after counting double."""
    return F.struct(F.when(c["start"] >= k["end"], -2 * (c["start"] - k["end"])).otherwise(-F.abs(k["start"] - c["end"])).alias("gap"))


def _by_keyword(cls: str) -> list[Column]:
    own = F.col("cls") == cls
    return [own & F.col("keyword"), own & ~F.col("keyword")]


def _made(out: DataFrame, group: tuple[str, ...], secret: Column, said: Column, *more: str) -> DataFrame:
    return out.select(*group, "offset", "line", "kind", "value", *more, secret.alias("secret"), said.alias("attribution"))


def key_pairs(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Access key ids with secret and attribution: the secret key and, for temporary ones, the session token found near."""
    out = paired(hits, (F.col("cls") == "token") & (F.col("provider") == "aws"), {"_secret": _by_keyword("aws-secret"), "_session": _by_keyword("aws-session")}, after_first, group=group)
    temporary, secret, session = F.col("kind") == "aws-temporary-access-key", F.col("_secret"), F.col("_session")
    said = F.when(secret.isNull(), SAID["no secret"]).when(~temporary, SAID["pair"]).when(session.isNotNull(), SAID["session"]).otherwise(SAID["no session"])
    both = F.when(temporary & session.isNotNull(), F.concat("_secret.value", F.lit("\n"), "_session.value")).otherwise(F.col("_secret.value"))
    return _made(out, group, both, F.concat("attribution", said))


def principals(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Client secrets with the tenant and application nearest to them."""
    out = paired(hits, F.col("kind") == "azure-client-secret", {"_t": [F.col("cls") == "azure-tenant"], "_c": [F.col("cls") == "azure-client"]}, before_first, end="offset", group=group)
    out = out.withColumns({"tenant": F.col("_t.value"), "client": F.col("_c.value")})
    t, c = F.col("tenant"), F.col("client")
    lit = lambda k: F.lit(SAID[k])
    said = F.when(t.isNotNull() & c.isNotNull(), F.concat(lit("app"), c, lit("in tenant"), t)).when(c.isNotNull(), F.concat(lit("app"), c, lit("no tenant"))).when(t.isNotNull(), F.concat(lit("tenant"), t, lit("no client"))).otherwise(lit("neither"))
    return _made(out, group, F.to_json(F.struct("tenant", "client")), said, "tenant", "client")


def storage_accounts(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Storage keys with the account named nearest to them; keys without one are dropped: lock files are full of hashes of that shape."""
    out = paired(hits, F.col("kind") == "azure-storage-account-key", {"_a": [F.col("cls") == "azure-account"]}, before_first, group=group).filter(F.col("_a").isNotNull())
    return _made(out, group, F.col("_a.value"), F.concat(F.lit(SAID["account"]), "_a.value"))


def registry_users(hits: DataFrame, group: tuple[str, ...] = ("object_key",), window: int = WINDOW) -> DataFrame:
    """Hub tokens with the username written nearest to them, within a window on either side; a login's are its user's."""
    gap = lambda k, c: F.greatest(k["start"] - c["start"], c["start"] - k["end"], F.lit(0))
    out = paired(hits, F.col("kind").isin("docker-hub-pat", "docker-hub-oat") & F.col("encoded").isNull(), {"_u": [F.col("cls") == "hub-user"]}, lambda k, c: F.struct((-gap(k, c)).alias("gap")), group=group)
    far = F.greatest(F.col("offset") - F.col("_u.start"), F.col("_u.start") - F.col("end"))
    user = F.when(far <= window, F.col("_u.value"))
    return _made(out, group, user, F.coalesce(F.concat(F.lit(SAID["user"]), user), F.lit(SAID["no user"])))


def deploy_tokens(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Deploy tokens with the user name that their object has first."""
    out = paired(hits, F.col("kind") == "gitlab-deploy-token", {"_u": [F.col("cls") == "deploy-user"]}, before_first, group=group)
    return _made(out, group, F.col("_u.value"), F.coalesce(F.concat(F.lit(SAID["username"]), "_u.value"), F.lit(SAID["no user"])))


def registry_tokens(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Package tokens in settings, with their line's registry (null for the default one)."""
    out = paired(hits, F.col("kind").isin("npm-access-token", "npm-legacy-token"), {"_r": [F.col("cls") == "npm-registry"]}, before_first, group=group)
    out = out.filter(F.col("_r.start") == F.col("offset"))
    named = F.when(F.col("_r.value") != "", F.col("_r.value"))
    return _made(out, group, named, F.concat(F.lit(SAID["registry"]), F.coalesce(F.regexp_extract(named, "^https://([^/]+)", 1), F.lit(SAID["default"]))))


def all_companions(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Secret and attribution of every token that has a companion or could have one: group columns, offset, value."""
    parts = [f(hits, group).select(*group, "offset", "value", "kind", "secret", "attribution") for f in (key_pairs, principals, storage_accounts, registry_users, deploy_tokens, registry_tokens)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
