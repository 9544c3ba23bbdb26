"""Public halves that content names, and the keys that they belong to.

A sighting is a row of the pass over contents with cls "sighting": provider, value (the identifier that a private key is named
by) and attribution (what was seen). FORMATS takes part in detectors.hits like the document formats, so looking for sightings
reads nothing again. What follows are joins of distinct identifiers.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import detectors
from .documents import BECH32, COMMON, ORGANIZATION, _bech32_sum, _child, _scalar, _values, _yaml_documents, blocks, key_said, read_certificate, secrets_of

Row = detectors.Row

#: The algorithms of SSH public keys, the longest comment that is read, and how many names of a certificate are told.
SSH_TYPES = ("ssh-ed25519", "ssh-rsa", "ssh-dss", "ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521", "sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com")
MAX_COMMENT, MAX_NAMES = 128, 3
#: Identifiers in certificates (names, authority).
ALT_NAMES, CONSTRAINTS = bytes.fromhex("0603551d11"), bytes.fromhex("0603551d13")
#: Fixed value: how what is said of a PEM public key begins; keys without a public half of their own adopt such keys beside them.
PUBLIC_KEY = "public key ("


def _seen(provider: str, identifier: str, said: str, at: int) -> Row:
    return {"cls": "sighting", "shape": -1, "provider": provider, "value": identifier, "offset": at, "end": at, "attribution": said}


_SSH = re.compile(rb"(?<![A-Za-z0-9_.@/-])(" + b"|".join(re.escape(t.encode()) for t in SSH_TYPES) + rb")[ \t]{1,16}([A-Za-z0-9+/=]{1,65536})(?![A-Za-z0-9])[ \t]{0,16}([^\x00-\x1f\"'\\`\x7f]{0,128})")


def ssh_public_keys(content: bytes) -> Iterator[Row]:
    """Keys whose blob names the algorithm before it, by the fingerprint of the blob; what follows up to the end of the line or string is their comment."""
    for m in _SSH.finditer(content):
        try:
            blob = base64.b64decode(m[2], validate=True)
        except (binascii.Error, ValueError):
            continue
        n = int.from_bytes(blob[:4], "big")
        if blob[4 : 4 + n] != m[1] or len(blob) <= 4 + n:
            continue
        comment = m[3].decode("utf-8", "replace").strip()
        name = "SHA256:" + base64.b64encode(hashlib.sha256(blob).digest()).decode().rstrip("=")
        yield _seen("privatekey", name, "ssh public key" + (f", comment {comment}" if comment else ""), m.start())


def _extension(tbs: list[tuple[int, bytes, bytes]], which: bytes) -> bytes | None:
    for tag, body, _ in tbs:
        if tag == 0xA3:
            for _, one, _ in _values(_values(body)[0][1]):
                parts = _values(one)
                if parts[0][2] == which:
                    return parts[-1][1]
    return None


def certificate(der: bytes, now: datetime) -> tuple[str, str]:
    """The hash of a certificate's SubjectPublicKeyInfo, and what it is for: names, expiry, issuer. ValueError or IndexError if it is none."""
    known = read_certificate(der)
    tbs = known.tbs
    names: list[str] = []
    alt = _extension(tbs, ALT_NAMES)
    if alt is not None:
        own = _values(_values(alt)[0][1])
        for wanted in (0x82, 0x87, 0x81, 0x86):
            names += [_address(v) if wanted == 0x87 else v.decode("utf-8", "replace") for t, v, _ in own if t == wanted]
    names = names or [n for n in [known.name(COMMON)] if n]
    more = f", +{len(names) - MAX_NAMES} more" if len(names) > MAX_NAMES else ""
    basic = _extension(tbs, CONSTRAINTS)
    authority = basic is not None and any(t == 1 and v != b"\0" for t, v, _ in _values(_values(basic)[0][1]))
    who = known.issuer(COMMON) or known.issuer(ORGANIZATION)
    said = ("CA certificate" if authority else "certificate") + (f" for {', '.join(names[:MAX_NAMES])}{more}" if names else "")
    said += f", {'expired' if known.until < now else 'expires'} {known.until:%Y-%m-%d}"
    said += ", self-signed" if known.self_signed else f", issuer {who}" if who else ""
    return hashlib.sha256(known.spki).hexdigest(), said


def _address(raw: bytes) -> str:
    import ipaddress

    return str(ipaddress.ip_address(raw))


def pinned_by(content: bytes) -> str:
    """The image policy that content's public keys belong to; empty if it is none."""
    if b"verifyImages" not in content and b"ClusterImagePolicy" not in content:
        return ""
    for _, root, _ in _yaml_documents(content, b"Policy"):
        kind = _scalar(_child(root, "kind"))
        if kind == "ClusterImagePolicy" or (kind in ("ClusterPolicy", "Policy") and b"verifyImages" in content):
            name = _scalar(_child(_child(root, "metadata"), "name"))
            return f", pinned by {'' if kind == 'ClusterImagePolicy' else 'Kyverno '}{kind}" + (f" {name}" if name else "")
    return ""


def pem_blocks(content: bytes, now: datetime | None = None) -> Iterator[Row]:
    """Public keys and certificates by the hash of their SubjectPublicKeyInfo, which private keys are named by. now: what expiry is told against."""
    now, pinned = now or datetime.now(UTC), None
    for m, stop in blocks(content, rb"-----BEGIN (CERTIFICATE|PUBLIC KEY)-----"):
        try:
            body = content[m.end() : stop].replace(b"\\r", b"").replace(b"\\n", b"\n")
            der = base64.b64decode(re.sub(rb"[\s\"']+", b"", body), validate=True)
            if m[1] == b"CERTIFICATE":
                yield _seen("privatekey", *certificate(der, now), m.start())
            else:
                said = key_said(der)
                pinned = pinned_by(content) if pinned is None else pinned
                yield _seen("privatekey", hashlib.sha256(der).hexdigest(), f"{PUBLIC_KEY}{said}){pinned}", m.start())
        except (ValueError, IndexError):
            continue


def recipients(content: bytes) -> Iterator[Row]:
    """Recipients and fingerprints that encrypted files, or the rules for making them, list; each once."""
    if not (b"ENC[" in content or b"creation_rules" in content or (b"sops:" in content and (b"age:" in content or b"pgp:" in content))):
        return
    known: set[str] = set()
    for m in re.finditer(rb"(?<![A-Za-z0-9])age1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{58}(?![A-Za-z0-9])", content):
        one = m[0].decode()
        if one not in known and _bech32_sum("age", [BECH32.index(c) for c in one[4:]]) == 1:
            known.add(one)
            yield _seen("sops", one, "", m.start())
    if b"pgp" in content:
        for m in re.finditer(rb"(?<![A-Za-z0-9])[0-9A-Fa-f]{40}(?![A-Za-z0-9])", content):
            one = m[0].decode().upper()
            if one not in known:
                known.add(one)
                yield _seen("sops", one, "", m.start())


def in_secrets(content: bytes) -> Iterator[Row]:
    """What the plaintext values of Secret manifests name, at the place of the value. Values that stand in clear are seen twice, with the same identifier."""
    for v in secrets_of(content):
        if not v["sops"] and v["value"] is not None:
            for observe in (ssh_public_keys, pem_blocks, recipients):
                for r in observe(v["value"]):
                    yield r | {"offset": v["offset"], "end": v["end"]}


FORMATS: tuple[detectors.Format, ...] = (
    (SSH_TYPES, lambda content, tokens_in: ssh_public_keys(content)), (("-----BEGIN CERTIFICATE-----", "-----BEGIN PUBLIC KEY-----"), lambda content, tokens_in: pem_blocks(content)),
    (("ENC[", "creation_rules", "sops:"), lambda content, tokens_in: recipients(content)),
    (("Secret",), lambda content, tokens_in: in_secrets(content)),
)


def observed(objects: DataFrame, content: str = "content", keep: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """A row for each sighting in each object: the kept columns, provider, identifier, detail and offset."""
    return of_hits(detectors.hits(objects, (), FORMATS, content=content, keep=keep), keep)


def of_hits(hits: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return hits.filter(F.col("cls") == "sighting").select(*keep, "provider", F.col("value").alias("identifier"), F.col("attribution").alias("detail"), "offset")


def identifiers(tokens: DataFrame) -> DataFrame:
    """target, fingerprint, kind, path and the identifier that a private key or an identity is known by; other tokens have none."""
    own = F.when(F.col("provider") == "privatekey", F.col("value")).when(F.col("kind") == "age-identity", F.regexp_extract(F.coalesce("attribution", F.lit("")), r"recipient (age1\w+)", 1))
    named = tokens.select("target", V.fingerprint(F.col("value")).alias("fingerprint"), "kind", "path", own.alias("identifier"))
    return named.filter(F.col("identifier") != "").distinct()


def _folder(path: str) -> Column:
    return F.regexp_replace(path, r"[^/]*\z", "")


def with_adjacent(named: DataFrame, seen: DataFrame) -> DataFrame:
    """target, fingerprint and identifier; a cosign key, which doesn't say its public half, is also known by the PEM public keys in its folder."""
    keys = named.filter((F.col("kind") == "cosign-private-key") & F.col("path").isNotNull()).select("target", "fingerprint", _folder("path").alias("_in")).distinct()
    beside = seen.filter(F.col("path").isNotNull() & F.startswith("detail", F.lit(PUBLIC_KEY))).select("target", _folder("path").alias("_in"), "identifier").distinct()
    return named.select("target", "fingerprint", "identifier").union(keys.join(beside, ["target", "_in"]).select("target", "fingerprint", "identifier")).distinct()


def unlocks(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """target, fingerprint, path and detail: a row for each file that names a public half of a finding's key, with the first of what is said there.

    tokens: target, path, provider, kind, value, attribution; seen: target, path, identifier, detail. Files without a path are left out.
    """
    known = with_adjacent(identifiers(tokens), seen)
    said = seen.filter(F.col("path").isNotNull()).groupBy("target", "identifier", "path").agg(F.min(F.when(F.col("detail") != "", F.col("detail"))).alias("detail"))
    return known.join(said, ["target", "identifier"]).groupBy("target", "fingerprint", "path").agg(F.coalesce(F.min("detail"), F.lit("")).alias("detail"))


def committers(tokens: DataFrame, seen: DataFrame, published: DataFrame) -> DataFrame:
    """target, fingerprint and matches: whose published key a finding belongs to; of several logins with a key the first. published: login, identifier, ord."""
    owner = published.groupBy("identifier").agg(F.min_by("login", "ord").alias("login"))
    known = with_adjacent(identifiers(tokens), seen)
    said = F.concat(F.lit("matches "), "login", F.lit("'s GitHub SSH key"))
    return known.join(owner, "identifier").groupBy("target", "fingerprint").agg(F.array_join(F.array_sort(F.collect_set(said)), "; ").alias("matches"))
