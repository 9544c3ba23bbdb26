"""Credentials inside documents: Secret manifests, cluster configurations, service account keys, registry logins, PEM blocks.

These formats need a parser. Each helper takes the bytes of one object and gives its rows; Spark deals the objects. FORMATS
names the needles of each, so that detectors.hits reads documents in the pass that finds tokens, and only objects that have a
needle are parsed. Content is untrusted: what doesn't parse or has a field of another type costs its own document only, and no
helper's work is more than linear in an object's size but for nested documents of MAX_JSON bytes.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import parse_qs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from . import detectors, nodes
from .registries import REGISTRIES, registry_logins

#: The longest manifest value and PEM block, and how far around its marker a JSON document may reach.
MAX_VALUE, MAX_BLOCK, MAX_JSON = 1 << 20, 1 << 20, 32 << 10
Row = detectors.Row


_child, _scalar = nodes.child, nodes.scalar


def _yaml_documents(content: bytes, kind: bytes) -> Iterator[tuple[int, nodes.Node, np.ndarray]]:
    """(byte offset, root node, byte offset of each character) of each document that spells the kind and parses."""
    for at, part, root, where in nodes.documents(content):
        if kind in part:
            yield at, root, where


def _json(text: str) -> object:
    """What JSON text stands for; None if it isn't JSON, or is nested too deeply."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _field(doc: object, name: str) -> str:
    """A field's text; empty if it is none."""
    s = doc.get(name) if isinstance(doc, dict) else None
    return s if isinstance(s, str) else ""


def _decoded(value: object, encoded: bool) -> tuple[bytes | None, str]:
    """A manifest value's bytes, or why it has none."""
    if getattr(value, "id", "") != "scalar":
        return None, "templated"
    s = value.value
    if not s:
        return None, "empty"
    if "ENC[" in s:
        return None, "encrypted"
    if "{{" in s or "${" in s or ".Values" in s:
        return None, "templated"
    out = s.encode("utf-8", "replace")
    if encoded:
        plain = re.sub(r"[\r\n\s]", "", s)
        try:
            out = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None, "not base64"
    if len(out) > MAX_VALUE:
        return None, "too large"
    return out, ""


def secrets_of(content: bytes) -> Iterator[Row]:
    """Every value of every Secret manifest, lists expanded: namespace, name, type, key, offset, end, value or skipped, offset of the kind."""
    for at, root, where in _yaml_documents(content, b"Secret"):
        for doc in (root, *(nodes.items(_child(root, "items")) if _scalar(_child(root, "kind")).endswith("List") else ())):
            kind = _child(doc, "kind")
            if _scalar(kind) != "Secret":
                continue
            meta = _child(doc, "metadata")
            sops = _child(doc, "sops") is not None
            for field, encoded in (("data", True), ("stringData", False)):
                for k, v in nodes.items(_child(doc, field), "mapping"):
                    value, why = _decoded(v, encoded)
                    if value is not None and len(value) <= 64 and re.fullmatch(rb"<.*>|[xX]+|\*+|(?i:replace[-_ ]?me|change[-_ ]?me|change[-_ ]?it|placeholder|todo|tbd|fixme|dummy)|(?:REPLACE|CHANGE|YOUR|TODO|FIXME)_[^a-z]*", value):
                        value, why = None, "placeholder"
                    yield {"namespace": _scalar(_child(meta, "namespace")), "name": _scalar(_child(meta, "name")), "type": _scalar(_child(doc, "type")), "sops": sops, "key": _scalar(k), "offset": at + int(where[k.start]), "end": at + int(where[v.end]), "value": value, "skipped": why or None, "kind_offset": at + int(where[kind.start])}


SECRET_FIELDS = [("namespace", pa.string()), ("name", pa.string()), ("type", pa.string()), ("sops", pa.bool_()), ("key", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("skipped", pa.string()), ("kind_offset", pa.int64())]
SECRET_DDL = "namespace string, name string, type string, sops boolean, key string, offset bigint, end bigint, value binary, skipped string, kind_offset bigint"


def _rows(objects: DataFrame, helper: Callable[[bytes], Iterator[Row]], needles: tuple[str, ...], fields: list, ddl: str, content: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each of the helper's rows in each object with one of the needles, beside the kept columns."""
    some = objects.filter(F.exists(F.array(*(F.lit(n.encode()) for n in needles)), lambda n: F.contains(F.col(content), n))).select(*keep, F.col(content).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(helper(b.column(len(keep))[i].as_py()))
                if found:
                    own = [pa.array([b.column(k)[i].as_py()] * len(found), b.column(k).type) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r.get(n) for r in found], t) for n, t in fields)], names=[*keep, *(n for n, _ in fields)])

    kept = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in keep)
    return some.mapInArrow(run, f"{kept}, {ddl}")


def secret_values(objects: DataFrame, content: str = "content", keep: tuple[str, ...] = ("object_key",)) -> DataFrame:
    return _rows(objects, secrets_of, ("Secret",), SECRET_FIELDS, SECRET_DDL, content, keep)


def manifest_rows(content: bytes, tokens_in: Callable[[bytes], list[Row]]) -> Iterator[Row]:
    """A token for each named Secret with plaintext, and the tokens inside its values: one level of decoding, at the key's place."""
    named: dict[tuple, list[str]] = {}
    for v in secrets_of(content):
        if v["sops"] or v["value"] is None:
            continue
        ref = (v["namespace"] + "/" if v["namespace"] else "") + v["name"]
        if v["name"]:
            named.setdefault((v["kind_offset"], ref, v["type"]), []).append(v["key"])
        for t in tokens_in(v["value"]):
            yield t | {"offset": v["offset"], "end": v["end"], "within": f"in Secret {ref}, key {v['key']}", "s_offset": v["offset"], "s_end": v["end"]}
    for (at, ref, kind), keys in named.items():
        yield {"cls": "token", "shape": -1, "provider": "kubernetes", "kind": "kubernetes-secret-manifest", "value": ref, "offset": at, "end": at, "attribution": (f"type {kind}, " if kind else "") + "keys " + ", ".join(keys)}


def rescanned(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Tokens with those inside plaintext Secret values, attributed to the Secret.

    A token that stands in clear within the value's span is the same one: it keeps its place and gets the Secret's context.
    Tokens are written once, since the joins read them several times, and each reading would search the contents again.
    """
    from ..sources.tables import cut

    tokens = cut(hits.filter(F.col("cls") == "token"))
    inner = tokens.filter(F.col("within").isNotNull()).withColumn("attribution", F.concat("within", F.when(F.coalesce("attribution", F.lit("")) != "", F.concat(F.lit(" ("), "attribution", F.lit(")"))).otherwise("")))
    clear = tokens.filter(F.col("within").isNull())
    same = [*group, "kind", "value"]
    spans = inner.select(*same, F.col("s_offset").alias("_from"), F.col("s_end").alias("_to"), F.col("attribution").alias("_said"))
    place = F.col("offset").between(F.col("_from"), F.col("_to") - 1)
    marks = clear.select(*same, "offset").join(spans, same).filter(place).groupBy(*same, "offset").agg(F.min("_said").alias("_said"))
    marked = clear.join(marks, [*same, "offset"], "left").withColumn("attribution", F.coalesce("_said", "attribution")).drop("_said")
    known = inner.join(clear.select(*same, F.col("offset").alias("_at")), same).filter(F.col("_at").between(F.col("s_offset"), F.col("s_end") - 1)).select(*same, "s_offset").distinct()
    new = inner.join(known, [*same, "s_offset"], "left_anti").dropDuplicates([*same, "s_offset"])
    return marked.unionByName(new.select(*marked.columns))


def secret_manifests(objects: DataFrame, content: str = "content") -> DataFrame:
    """A finding for each named Secret with plaintext: value ns/name, keys in order."""
    plain = secret_values(objects, content).filter(~F.col("sops") & F.col("value").isNotNull() & (F.col("name") != ""))
    keys = plain.groupBy("object_key", "namespace", "name", "type", "kind_offset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "key"))), lambda x: x["key"]), ", ").alias("keys"))
    ref = F.concat(F.when(F.col("namespace") != "", F.concat("namespace", F.lit("/"))).otherwise(""), "name")
    return keys.select("object_key", F.lit("kubernetes").alias("provider"), F.lit("kubernetes-secret-manifest").alias("kind"), ref.alias("value"), F.col("kind_offset").alias("offset"), F.concat(F.when(F.col("type") != "", F.concat(F.lit("type "), "type", F.lit(", "))).otherwise(""), F.lit("keys "), "keys").alias("attribution"))


def _token(provider: str, kind: str, value: str, offset: int, attribution: str = "", secret: str | None = None, encrypted: bool = False, verified: bool = False, expires: int | None = None) -> Row:
    return {"provider": provider, "kind": kind, "value": value, "offset": offset, "checksum_verified": verified, "attribution": attribution, "secret": secret, "encrypted": encrypted, "expires": expires}


def _braces(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How deep in braces each brace stands (a pair has one number), their places, and which of them open; by depth, then place."""
    data = np.frombuffer(content, np.uint8)
    at = np.flatnonzero((data == 0x7B) | (data == 0x7D))
    opens = data[at] == 0x7B
    deep = np.cumsum(np.where(opens, 1, -1)) + ~opens
    order = np.lexsort((at, deep))
    return deep[order], at[order], opens[order]


_TYPE = re.compile(rb'\\{0,8}"type\\{0,8}"\s{0,64}:\s{0,64}\\{0,8}"(service_account|authorized_user)["\\]')


def cloud_documents(content: bytes) -> Iterator[Row]:
    """Service account keys and user credentials: JSON objects around their type, also where they stand escaped in a string."""
    marks = list(_TYPE.finditer(content))
    if not marks:
        return
    deep, at, opens = _braces(content)
    # in the order of places, how deep a place is in braces
    by_place = np.sort(at)
    depth = np.concatenate([[0], np.cumsum(np.where(np.frombuffer(content, np.uint8)[by_place] == 0x7B, 1, -1))])
    size = len(content) + 1
    code = deep.astype(np.int64) * size + at
    known: set[int] = set()
    for m in marks:
        level = int(depth[np.searchsorted(by_place, m.start())])
        k = int(np.searchsorted(code, level * size + m.start())) - 1
        # braces of one depth open and close in turn, so the next one closes this
        if k < 0 or k + 1 >= len(code) or not opens[k] or deep[k] != level or deep[k + 1] != level or k in known:
            continue
        start, end = int(at[k]), int(at[k + 1]) + 1
        if m.start() - start > MAX_JSON or end - start > MAX_JSON:
            continue
        known.add(k)
        text = content[start:end].decode("utf-8", "replace")
        doc = _json(text)
        if doc is None and isinstance(inner := _json(f'"{text}"'), str):
            doc = _json(inner)
        if _field(doc, "type") != m[1].decode():
            continue
        if m[1] == b"service_account":
            mail, key, name, project = (_field(doc, f) for f in ("client_email", "private_key", "private_key_id", "project_id"))
            if mail and key:
                yield _token("gcp", "gcp-service-account-key", f"{mail}/{name}" if name else mail, start, f"project {project}" if project else "", json.dumps(doc))
                yield {"cls": "span", "provider": "gcp", "value": "", "offset": start, "end": end}
        elif token := _field(doc, "refresh_token"):
            yield _token("gcp", "gcp-oauth-user-credentials", token, start, "ADC for OAuth client " + _field(doc, "client_id").split("-")[0], json.dumps(doc))


def _der_length(der: bytes, at: int) -> tuple[int, int]:
    n = der[at]
    if n < 128:
        return n, at + 1
    k = n & 127
    return int.from_bytes(der[at + 1 : at + 1 + k], "big"), at + 1 + k


def kubeconfigs(content: bytes) -> Iterator[Row]:
    """Users of cluster configurations with a certificate and key, a token, or a login; their cluster is that of the first context that names them."""
    if b"users" not in content:
        return
    for at, root, where in _yaml_documents(content, b"Config"):
        if _scalar(_child(root, "kind")) != "Config":
            continue
        items = lambda key: nodes.items(_child(root, key))  # noqa: B023, E731
        servers = {_scalar(_child(n, "name")): _scalar(_child(_child(n, "cluster"), "server")) for n in items("clusters")}
        cluster_of: dict[str, str] = {}
        for n in items("contexts"):
            if user := _scalar(_child(_child(n, "context"), "user")):
                cluster_of.setdefault(user, _scalar(_child(_child(n, "context"), "cluster")))
        for n in items("users"):
            own = {k: _scalar(_child(_child(n, "user"), k)) for k in ("client-certificate-data", "client-key-data", "token", "username", "password")}
            server = servers.get(cluster_of.get(_scalar(_child(n, "name")), ""), "")
            place, said = at + int(where[n.start]), f", server {server}" if server else ""
            secret = json.dumps({"server": server} | {k: v for k, v in own.items() if v})
            if own["client-certificate-data"] and own["client-key-data"]:
                (_, cert), (label, key) = _pem(own["client-certificate-data"]), _pem(own["client-key-data"])
                try:
                    known = read_certificate(cert)
                except (ValueError, IndexError):
                    continue
                spki = spki_of(label, key)
                if not key or (spki is not None and spki != known.spki):
                    continue  # a certificate without its key is no credential
                who = f"CN={known.name(COMMON)}" + (" groups=" + ",".join(known.names(ORGANIZATION)) if known.names(ORGANIZATION) else "") + (f" issuer {known.issuer(COMMON)}" if known.issuer(COMMON) else "")
                yield _token("kubernetes", "kubernetes-client-certificate", hashlib.sha256(cert).hexdigest(), place, who + said, secret, verified=spki is not None, expires=int(known.until.timestamp()))
            elif own["token"]:
                account, issuer, expires = _claims(own["token"])
                kind = "kubernetes-service-account-token" if account else "kubernetes-token"
                yield _token("kubernetes", kind, own["token"], place, (f"serviceaccount {account}" if account else f"JWT issued by {issuer}" if issuer else "bearer token") + said, secret, expires=expires)
            elif own["username"] and own["password"]:
                host = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://|/.*$", "", server)
                yield _token("kubernetes", "kubernetes-basic-auth", (host + "/" if host else "") + own["username"], place, f"user {own['username']}" + said, secret)


def _pem(data: str) -> tuple[str, bytes]:
    """Label and bytes of the first block of base64 data that holds PEM; empty if there is none."""
    try:
        m = re.search(rb"-----BEGIN ([^-]+)-----([^-]+)-----END", base64.b64decode(re.sub(r"\s", "", data), validate=True))
        return (m[1].decode("ascii", "replace"), base64.b64decode(re.sub(rb"\s", b"", m[2]), validate=True)) if m else ("", b"")
    except (binascii.Error, ValueError):
        return "", b""


#: Identifiers of names in certificates.
COMMON, ORGANIZATION = bytes.fromhex("0603550403"), bytes.fromhex("060355040a")


@dataclass(frozen=True)
class Certificate:
    """The parts of a certificate's body, and until when it holds."""

    tbs: list[tuple[int, bytes, bytes]]
    first: int
    until: datetime

    def _names(self, at: int, which: bytes) -> list[str]:
        pairs = [_values(pair)[:2] for _, entry, _ in _values(self.tbs[self.first + at][1]) for _, pair, _ in _values(entry)]
        return [text[1].decode("utf-8", "replace") for kind, text in pairs if kind[2] == which]

    def names(self, which: bytes) -> list[str]:
        return self._names(4, which)

    def name(self, which: bytes) -> str:
        return next(iter(self.names(which)), "")

    def issuer(self, which: bytes) -> str:
        return next(iter(self._names(2, which)), "")

    @property
    def self_signed(self) -> bool:
        return self.tbs[self.first + 2][2] == self.tbs[self.first + 4][2]

    @property
    def spki(self) -> bytes:
        return self.tbs[self.first + 5][2]


def read_certificate(der: bytes) -> Certificate:
    """ValueError or IndexError if it is none."""
    tbs = _values(_values(_values(der)[0][1])[0][1])
    first = 0 if tbs[0][0] == 0xA0 else -1  # without a version
    tag, end, _ = _values(tbs[first + 4][1])[1]
    text = end.decode("ascii")
    if tag == 0x17:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return Certificate(tbs, first + 1, datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC))


def _claims(token: str) -> tuple[str, str, int | None]:
    """Namespace and name of the service account that a signed token states, its issuer, and its expiry in seconds; empty if it states none."""
    try:
        part = token.split(".")[1]
        claims = _json(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)).decode("utf-8", "replace"))
    except (IndexError, ValueError):
        return "", "", None
    m = re.fullmatch("system:serviceaccount:([^:]+):([^:]+)", _field(claims, "sub"))
    expires = claims.get("exp") if isinstance(claims, dict) else None
    return "/".join(m.groups()) if m else "", _field(claims, "iss"), int(expires) if isinstance(expires, int | float) and 0 < expires < 1e11 else None


#: The parameters of a shared access signature; a bare one starts with one of them.
SAS = ("sv", "ss", "srt", "sp", "se", "st", "spr", "sig", "sr", "si", "sip", "sdd", "skoid", "sktid", "skt", "ske", "sks", "skv")
_QUERY = re.compile(rb"[A-Za-z0-9%&=._~:/+?@!$*-]*+")
_IN_QUERY = bytes(c for c in range(128) if _QUERY.fullmatch(bytes([c])))
_BARE = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(SAS) + ")=")


def _instant(text: str) -> int | None:
    """The seconds of a time with or without seconds, or of a day; None if it is none."""
    for layout in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%MZ", "%Y-%m-%d"):
        try:
            at = datetime.strptime(text, layout)
            return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())
        except (ValueError, OverflowError):
            continue
    return None


def signatures(content: bytes) -> Iterator[Row]:
    """Shared access signatures: a query with version, expiry and signature, bare or behind its address."""
    done = 0
    for m in re.finditer(rb"(?<![A-Za-z0-9_])sig=", content):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (before := content[max(done, start - 4096) : start]):
            start -= len(before) - len(left := before.rstrip(_IN_QUERY))
            if left:
                break
        done = _QUERY.match(content, m.start()).end()
        raw = content[start:done].rstrip(b".,;:").decode()
        address, mark, query = raw.partition("?")
        if not mark or "://" not in address:
            first = _BARE.search(raw)
            address, query = "", raw[first.start() :] if first else ""
            start, raw = start + (first.start() if first else 0), query
        try:
            fields = parse_qs(query, errors="replace")
        except ValueError:
            continue
        if all(fields.get(k) for k in ("sv", "se", "sig")):
            place = re.sub(r"^[^:]*://", "", address)
            expires = _instant(fields["se"][0])
            said = [f"resource {place}" if place else "bare token, resource unknown", *(["permissions " + fields["sp"][0]] if fields.get("sp") else []), *(["expiry unreadable"] if expires is None else [])]
            yield _token("azure", "azure-sas-token", fields["sig"][0], start, ", ".join(said), raw, expires=expires)


#: Fixed value: the letters of Bech32.
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _bech32_sum(prefix: str, data: list[int]) -> int:
    total = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *data]:
        top = total >> 25
        total = (total & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            total ^= g if top >> i & 1 else 0
    return total


def _regrouped(data: list[int], width: int, wanted: int) -> list[int]:
    """Numbers of `width` bits as numbers of `wanted` bits; what is left is padding."""
    bits = "".join(f"{x:0{width}b}" for x in data)
    bits += "0" * (-len(bits) % wanted) if width > wanted else ""
    return [int(bits[i : i + wanted], 2) for i in range(0, len(bits) - wanted + 1, wanted)]


def x25519_public(secret: bytes) -> bytes:
    """The public half of a secret scalar: the base point times it, on the curve's u coordinate (RFC 7748)."""
    p, k = 2**255 - 19, int.from_bytes(secret, "little") & (1 << 255) - 8 | 1 << 254
    x1, x2, z2, x3, z3 = 9, 1, 0, 9, 1
    for t in range(254, -1, -1):
        bit = k >> t & 1
        if bit:
            x2, z2, x3, z3 = x3, z3, x2, z2
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        da, cb, aa, bb = d * a % p, c * b % p, a * a % p, b * b % p
        e = aa - bb
        x3, z3, x2, z2 = (da + cb) ** 2 % p, x1 * (da - cb) ** 2 % p, aa * bb % p, e * (aa + 121665 * e) % p
        if bit:
            x2, z2, x3, z3 = x3, z3, x2, z2
    return (x2 * pow(z2, p - 2, p) % p).to_bytes(32, "little")


def age_identities(content: bytes) -> Iterator[Row]:
    """Identities whose checksum holds, with the recipient that they stand for."""
    for m in re.finditer(rb"(?<![A-Za-z0-9])AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Za-z0-9])", content):
        data = [BECH32.index(c) for c in m[1].decode().lower()]
        if _bech32_sum("age-secret-key-", data) != 1:
            continue
        public = _regrouped(list(x25519_public(bytes(_regrouped(data[:-6], 5, 8)))), 8, 5)
        check = _bech32_sum("age", [*public, *[0] * 6]) ^ 1
        recipient = "age1" + "".join(BECH32[x] for x in [*public, *(check >> 5 * (5 - i) & 31 for i in range(6))])
        yield _token("sops", "age-identity", m[0].decode(), m.start(), "recipient " + recipient, verified=True)


def _values(der: bytes) -> list[tuple[int, bytes, bytes]]:
    """(tag, content, whole) of each DER value that stands in der one after another."""
    out, at = [], 0
    while at < len(der):
        n, start = _der_length(der, at + 1)
        out.append((der[at], der[start : start + n], der[at : start + n]))
        at = start + n
    return out


def _der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


#: The identifiers of RSA and elliptic-curve public keys.
RSA_ID, EC_ID = bytes.fromhex("06092a864886f70d010101"), bytes.fromhex("06072a8648ce3d0201")


#: The identifiers of another algorithm and of curves.
ED25519_ID = bytes.fromhex("06032b6570")
CURVES = {bytes.fromhex("06082a8648ce3d030107"): "P-256", bytes.fromhex("06052b81040022"): "P-384", bytes.fromhex("06052b81040023"): "P-521"}


def key_said(spki: bytes) -> str:
    """The algorithm and size of a public key. ValueError or IndexError if it is none."""
    algorithm, bits = _values(_values(spki)[0][1])[:2]
    parts = _values(algorithm[1])
    if parts[0][2] == RSA_ID:
        return f"RSA {int.from_bytes(_values(_values(bits[1][1:])[0][1])[0][1], 'big').bit_length()}"
    if parts[0][2] == EC_ID:
        return f"ECDSA {CURVES[parts[1][2]]}" if parts[1][2] in CURVES else "unknown algorithm"
    return "ed25519" if parts[0][2] == ED25519_ID else "unknown algorithm"


def spki_of(label: str, der: bytes) -> bytes | None:
    """The SubjectPublicKeyInfo of an unencrypted key: RSA, or of a curve where the key holds its public half; None otherwise."""
    try:
        inner = _values(_values(der)[0][1])
        if label == "PRIVATE KEY":
            algorithm = _values(inner[1][1])
            kind, curve, inner = algorithm[0][2], algorithm[1][2] if len(algorithm) > 1 else b"", _values(_values(inner[2][1])[0][1])
        else:
            kind, curve = (RSA_ID, b"") if label == "RSA PRIVATE KEY" else (EC_ID, b"")
        if kind == RSA_ID and len(inner) >= 9:
            return _der(0x30, _der(0x30, RSA_ID, b"\x05\x00"), _der(0x03, b"\0", _der(0x30, inner[1][2], inner[2][2])))
        if kind == EC_ID:
            parts = {t: v for t, v, _ in inner}
            curve = parts.get(0xA0, curve)
            return _der(0x30, _der(0x30, EC_ID, curve), _values(parts[0xA1])[0][2]) if curve and 0xA1 in parts else None
    except (IndexError, ValueError):
        pass
    return None


def _is_sequence(der: bytes) -> bool:
    """One DER sequence, nothing missing."""
    if len(der) < 2 or der[0] != 0x30:
        return False
    n, at = _der_length(der, 1)
    return at + n <= len(der)


def blocks(content: bytes, begin: bytes) -> Iterator[tuple[re.Match[bytes], int]]:
    """Each BEGIN line (its group is the label), and where its END line stands: the first thereafter of its label, within MAX_BLOCK and before the next BEGIN line, whose dashes no block may hold."""
    started = list(re.finditer(begin, content))
    if not started:
        return
    ends: dict[bytes, list[int]] = {}
    for e in re.finditer(rb"-----END ([A-Z0-9 ]{0,64})-----", content):
        ends.setdefault(e[1], []).append(e.start())
    follows = [x.start() for x in re.finditer(rb"-----BEGIN ", content)]
    for m in started:
        own = ends.get(m[1], [])
        k, after = bisect.bisect_left(own, m.end()), bisect.bisect_left(follows, m.end())
        if k < len(own) and own[k] <= m.end() + MAX_BLOCK and (after == len(follows) or own[k] < follows[after]):
            yield m, own[k]


def _fields(blob: bytes) -> list[bytes]:
    """The strings of a blob, one after another, each behind its length; ends where one isn't whole."""
    out, at = [], 0
    while at + 4 <= len(blob):
        n = int.from_bytes(blob[at : at + 4], "big")
        if at + 4 + n > len(blob):
            break
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


#: SSH algorithms by name, and how many fields of each stand in a private key before its comment.
_SSH_NAMES = {"ssh-ed25519": "ed25519", "ssh-rsa": "RSA", "ssh-dss": "DSA", "ecdsa-sha2-nistp256": "ECDSA P-256", "ecdsa-sha2-nistp384": "ECDSA P-384", "ecdsa-sha2-nistp521": "ECDSA P-521"}
_SSH_FIELDS = {"ssh-ed25519": 2, "ssh-rsa": 6, "ssh-dss": 5, "ecdsa-sha2-nistp256": 3, "ecdsa-sha2-nistp384": 3, "ecdsa-sha2-nistp521": 3}


def _ssh_said(public: bytes) -> str:
    """The algorithm and size of a public key's blob."""
    fields = _fields(public)
    name = fields[0].decode("ascii", "replace") if fields else ""
    number = {"ssh-rsa": 2, "ssh-dss": 1}.get(name)
    size = f" {int.from_bytes(fields[number], 'big').bit_length()}" if number and len(fields) > number else ""
    return _SSH_NAMES.get(name, name) + size


def _ssh_comment(private: bytes) -> str:
    """The comment in an unencrypted private section, behind two check numbers, the algorithm and the key's fields."""
    fields = _fields(private[8:])
    n = _SSH_FIELDS.get(fields[0].decode("ascii", "replace")) if fields else None
    return fields[n + 1].decode("utf-8", "replace") if n and len(fields) > n + 1 else ""


def _pem_said(label: str, spki: bytes | None, locked: bool) -> str:
    """The algorithm of a PEM key as far as it can be told, and whether it is encrypted."""
    if label.startswith("ENCRYPTED"):
        return "PKCS#8, encrypted, algorithm unknown"
    name = {"RSA PRIVATE KEY": "RSA", "EC PRIVATE KEY": "ECDSA", "DSA PRIVATE KEY": "DSA"}.get(label, "PKCS#8")
    try:
        name = key_said(spki) if spki else name
    except (ValueError, IndexError):
        pass
    return name + (", encrypted" if locked else ", unencrypted")


def _locked(kdf: str, cipher: str) -> str:
    """What is said of an encrypted signing key."""
    return "encrypted" + (f" with {kdf}/{cipher}" if kdf and cipher else "") + ", public key not derivable"


def private_keys(content: bytes) -> Iterator[Row]:
    """PEM private keys. OpenSSH keys are named by the fingerprint of the public half they contain, others by the hash of their SubjectPublicKeyInfo, as certificates are, or where that can't be read by a hash of their block."""
    for m, stop in blocks(content, rb"(?:(?<![A-Za-z0-9-])|(?<=\\[nr]))-----BEGIN ([A-Z0-9 ]{0,53}PRIVATE KEY)-----"):
        label, offset = m[1].decode(), m.start()
        body = content[m.end() : stop].replace(b"\\r", b"").replace(b"\\n", b"\n")
        lines = body.split(b"\n")
        headers, rest = b"\n".join(x for x in lines if b":" in x), b"\n".join(x for x in lines if b":" not in x)
        try:
            raw = base64.b64decode(re.sub(rb"[\s\"']+", b"", rest), validate=True)
        except (binascii.Error, ValueError):
            continue
        if not raw:
            continue
        block = "sha256:" + hashlib.sha256(raw).hexdigest()
        if label == "OPENSSH PRIVATE KEY":
            if not raw.startswith(b"openssh-key-v1\0"):
                continue
            parts, at = [], 15
            try:
                for _ in range(3):
                    n = int.from_bytes(raw[at : at + 4], "big")
                    parts.append(raw[at + 4 : at + 4 + n])
                    at += 4 + n
                n = int.from_bytes(raw[at + 4 : at + 8], "big")
                public, rest_at = raw[at + 8 : at + 8 + n], at + 8 + n
            except IndexError:
                continue
            if not public:
                continue
            locked = parts[0] != b"none"
            comment = "" if locked else _ssh_comment(raw[rest_at + 4 : rest_at + 4 + int.from_bytes(raw[rest_at : rest_at + 4], "big")])
            said = _ssh_said(public) + (", encrypted" if locked else ", unencrypted") + (f", comment {comment}" if comment else "")
            yield _token("privatekey", "ssh-private-key", "SHA256:" + base64.b64encode(hashlib.sha256(public).digest()).decode().rstrip("="), offset, said, None, locked, True)
        elif "SIGSTORE" in label or "COSIGN" in label:
            doc = _json(raw.decode("utf-8", "replace"))
            if _field(doc, "ciphertext"):
                yield _token("privatekey", "cosign-private-key", block, offset, _locked(_field(doc.get("kdf"), "name"), _field(doc.get("cipher"), "name")), None, True)
        elif _is_sequence(raw) or b"ENCRYPTED" in headers:
            locked = label.startswith("ENCRYPTED") or b"ENCRYPTED" in headers
            spki = None if locked else spki_of(label, raw)
            yield _token("privatekey", "ssh-private-key" if label.startswith("DSA") else "tls-private-key", hashlib.sha256(spki).hexdigest() if spki else block, offset, _pem_said(label, spki, locked), None, locked)


def _whole(helper: Callable[[bytes], Iterator[Row]]) -> Callable[[bytes, object], Iterator[Row]]:
    """A helper that searches no values, as rows of the pass."""
    return lambda content, tokens_in: ({"cls": "token", "shape": -1, "end": r["offset"]} | r for r in helper(content))


#: The setting that holds a receiver's keys, and the names of these.
RECEIVER, RECEIVER_KEYS = "pagerduty_configs", ("routing_key", "service_key")


def receiver_leaves(content: bytes, tokens_in: object) -> Iterator[Row]:
    """The scalars of documents with receivers, as rows: path (as kind), value, place, and the document's offset."""
    for at, path, value, start, end in nodes.leaves(content, RECEIVER.encode()):
        yield {"cls": "leaf", "shape": -1, "provider": "pagerduty", "kind": path, "value": value, "offset": start, "end": end, "s_offset": at}


def once(tokens: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Tokens without the registry's own that stand where a login of the same object has them as its password."""
    own = F.col("provider") == "oci"
    first = F.row_number().over(W.partitionBy(*group, "kind", "value").orderBy(F.col("encoded").isNull(), "offset"))
    return tokens.filter(~own).unionByName(tokens.filter(own).withColumn("_n", first).filter("_n = 1").drop("_n"))


def receivers(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """The keys of receivers in alerting configurations, with the receiver's name; the columns of hits."""
    leaves = hits.filter(F.col("cls") == "leaf")
    key = rf"^(.*)/{RECEIVER}/[0-9]+/({'|'.join(RECEIVER_KEYS)})\z"
    keys = leaves.filter(F.col("kind").rlike(key) & F.col("value").rlike(r"^[0-9a-f]{32}\z")).withColumns({"_at": F.regexp_extract("kind", key, 1), "_key": F.regexp_extract("kind", key, 2)})
    names = leaves.filter(F.endswith("kind", F.lit("/name"))).select(*group, "s_offset", F.regexp_replace("kind", r"/name\z", "").alias("_at"), F.col("value").alias("_name"))
    said = F.concat("_key", F.lit(" of receiver "), F.coalesce("_name", F.lit("")), F.lit(" in Alertmanager config"))
    quoted = F.col("end") - F.col("offset") == 34  # a value in quotes starts after the first
    made = keys.join(names, [*group, "s_offset", "_at"], "left").withColumns({"cls": F.lit("token"), "kind": F.lit("pagerduty-routing-key"), "attribution": said, "offset": F.col("offset") + quoted.cast("int"), "s_offset": F.lit(None).cast("bigint")})
    return made.select(*hits.columns)


def with_receivers(hits: DataFrame, group: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Hits with the keys of receivers; in an object a key is one token, the receiver's before those under a name, these in the order of names and places."""
    routing = (F.col("cls") == "token") & (F.col("kind") == "pagerduty-routing-key") & F.col("within").isNull()
    rest, named = hits.filter(~F.coalesce(routing, F.lit(False)) & (F.col("cls") != "leaf")), hits.filter(routing)
    first = F.row_number().over(W.partitionBy(*group, "value").orderBy(F.col("shape") >= 0, "shape", "offset"))
    return rest.unionByName(receivers(hits, group).unionByName(named).withColumn("_n", first).filter("_n = 1").drop("_n"))


#: The kinds that the formats and the windowed runs give.
KINDS = (
    ("gcp", "gcp-service-account-key"), ("gcp", "gcp-oauth-user-credentials"), *(("oci", k) for k, _ in REGISTRIES), ("oci", "registry-login"), ("oci", "quay-robot-token"), ("oci", "quay-oauth-token"),
    *(("privatekey", k) for k in ("ssh-private-key", "tls-private-key", "cosign-private-key")), *(("kubernetes", f"kubernetes-{k}") for k in ("secret-manifest", "client-certificate", "token", "basic-auth")), ("azure", "azure-sas-token"), ("sops", "age-identity"),
)
#: Needles and helpers of all document formats.
FORMATS: tuple[detectors.Format, ...] = (
    (("service_account", "authorized_user"), _whole(cloud_documents)), (("auths", "dockerconfigjson", "eyJhdXRocyI6", "Basic "), _whole(registry_logins)), (("PRIVATE KEY",), _whole(private_keys)),
    (("Secret",), manifest_rows), (("Config",), _whole(kubeconfigs)), (("sig=",), _whole(signatures)), (("AGE-SECRET-KEY-1",), _whole(age_identities)), ((RECEIVER,), receiver_leaves),
)


def find(objects: DataFrame, content: str = "content", keep: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """Tokens of all document formats but Secret manifests; the columns of detectors.find, and secret and encrypted."""
    found = detectors.hits(objects, (), tuple(f for f in FORMATS if f[1] not in (manifest_rows, receiver_leaves)), content=content, keep=keep)
    return found.filter(F.col("cls") == "token").select(*keep, "provider", "kind", "value", "offset", "line", "checksum_verified", "attribution", "secret", "encrypted")


def fingerprinted(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("fingerprint", V.fingerprint(F.col("value")))
