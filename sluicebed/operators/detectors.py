"""Credential detectors: shapes found in one pass over contents, then verified as Spark expressions.

A shape is a regular expression for one kind of value with what may not stand before and after it, and, where the issuer
computes one, a checksum. Contents are searched where they are read: the scanner finds the shapes' needles in whole batches,
a shape is matched only where its needle stands, and only matches leave, with byte offset and line. Checksums, signed tokens
and attributions are expressions over those rows. The same pass reads document formats and, where a credential was found,
the values that may belong to it (operators/nearest.py), so contents are read once and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import scanner

ALNUM, WORD, URL64, TOKEN = "[A-Za-z0-9]", "[A-Za-z0-9_]", "[A-Za-z0-9_-]", "[A-Za-z0-9_-]"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Fixed value: how many bytes around a value count as near it.
WINDOW = 512


@dataclass(frozen=True)
class Shape:
    """One kind: a needle, how far before it a match may start, the value's pattern, and what may not precede or follow it."""

    provider: str
    kind: str
    needle: str
    body: str
    left: str = ""
    right: str = ""
    back: tuple[int, ...] = (0,)
    verify: Callable[[Column], Column] | None = None
    attribution: Callable[[Column], Column] | None = None
    checksum: bool = False
    name: str = ""  # a pattern from the needle to the value, where the value stands behind a name
    says: str = ""  # an attribution with the whole name in it
    marker: str = ""  # the whole content must match this, in any case

    @cached_property
    def pattern(self) -> re.Pattern[bytes]:
        """The value is the group."""
        left = f"(?<!{self.left})" if self.left else ""
        right = f"(?!{self.right})" if self.right else ""
        return re.compile(f"{left}{self.name}({self.body}){right}".encode())


def _group(fmt: str, pattern: str, n: int) -> Callable[[Column], Column]:
    """fmt with the pattern's groups in place of %s."""
    return lambda v: F.format_string(fmt, *(F.regexp_extract(v, pattern, k + 1) for k in range(n)))


def _routable(v: Column) -> Column:
    """Payload length and checksum at the end of a routable token hold."""
    b64 = F.regexp_extract(v, r"-([A-Za-z0-9_-]+)\.", 1)
    length = F.substring(F.right(v, F.lit(9)), 1, 2)
    return (F.right(v, F.lit(7)) == V.base36_crc(F.left(v, F.length(v) - 7))) & (F.lower(F.lpad(F.conv(F.length(b64).cast("string"), 10, 36), 2, "0")) == length)


def _classic(v: Column) -> Column:
    return F.right(v, F.lit(6)) == V.base62_crc(F.substring(v, 5, 30))


def _account(v: Column) -> Column:
    return F.concat(F.lit("account "), V.account_of(v))


def _hook(v: Column) -> Column:
    return F.concat(F.lit("team "), F.regexp_extract(v, "/(T[^/]+)/", 1), F.when(v.rlike("/workflows/T[^/]+/A"), F.concat(F.lit(", app "), F.regexp_extract(v, "/T[^/]+/(A[^/]*)/", 1))).otherwise(""))


def _json_has(*names: str) -> Callable[[Column], Column]:
    """The base64 after an optional prefix is JSON with these fields set."""
    return lambda v: reduce(lambda a, b: a & b, (F.coalesce(F.get_json_object(V.unbase64url(F.regexp_replace(v, "^glc_", "")), f"$.{n}"), F.lit("")) != "" for n in names))


def _cloud(v: Column) -> Column:
    at = lambda path: F.get_json_object(V.unbase64url(F.regexp_replace(v, "^glc_", "")), path)
    return F.concat_ws(", ", F.concat(F.lit("org "), at("$.o")), F.concat(F.lit("token "), F.when(at("$.n") != "", at("$.n"))), F.concat(F.lit("region "), F.when(at("$.m.r") != "", at("$.m.r"))))


def _legacy_key(v: Column) -> Column:
    at = lambda path: F.get_json_object(V.unbase64url(v), path)
    return F.concat(F.lit("key "), at("$.n"), F.lit(", org id "), F.coalesce(at("$.id"), F.lit("0")))


def jwt_part(v: Column, part: int) -> Column:
    """A part of a signed token as JSON text, null if it isn't an object."""
    text = V.unbase64url(F.split_part(v, F.lit("."), F.lit(part)))
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def _is_jwt(v: Column) -> Column:
    return jwt_part(v, 1).isNotNull() & jwt_part(v, 2).isNotNull()


def _service_account(v: Column) -> Column:
    """Namespace and name of a cluster's service account, in the projected or the legacy form of claims; null if there are none."""
    c = jwt_part(v, 2)
    legacy = F.regexp_extract(c, r'"kubernetes\.io/serviceaccount/namespace"\s*:\s*"([^"]*)"', 1), F.regexp_extract(c, r'"kubernetes\.io/serviceaccount/service-account\.name"\s*:\s*"([^"]*)"', 1)
    subject = F.regexp_extract(F.get_json_object(c, "$.sub"), r"^system:serviceaccount:([^:]+:[^:]+)\z", 1)
    return F.when(subject != "", F.translate(subject, ":", "/")).when((legacy[0] != "") & (legacy[1] != ""), F.concat(legacy[0], F.lit("/"), legacy[1]))


def _pod(v: Column) -> Column:
    """The pod that a cluster's token is bound to."""
    name = F.get_json_object(jwt_part(v, 2), "$['kubernetes.io']['pod']['name']")
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(", bound to pod "), name)).otherwise("")


def expiry_of(v: Column) -> Column:
    """When a signed token's claims say that it expires, in seconds; null if they don't."""
    return F.get_json_object(jwt_part(v, 2), "$.exp").try_cast("double").cast("bigint")


def expiry_text(expires: Column, now: Column) -> Column:
    """What is said of an expiry in seconds: its day, and whether that is past at the clock given; empty if there is none."""
    at = F.timestamp_seconds(expires)
    return F.when(expires.isNull(), "").otherwise(F.concat(F.when(at < now, ", expired ").otherwise(", expires "), F.date_format(at, "yyyy-MM-dd")))


#: What stands in the middle of one issuer's keys, and the prefixes and names that the shapes have.
KEY_MARKER = "T3BlbkFJ"
_GITHUB = {"p": "github-pat", "o": "github-oauth", "u": "github-user-to-server", "s": "github-server-to-server", "r": "github-refresh"}
_GITLAB_FIXED = {  # kind, prefix after gl, body
    "gitlab-pat": ("pat-", "{20}"), "gitlab-deploy-token": ("dt-", "{20}"), "gitlab-feed-token": ("ft-", "{20}"), "gitlab-incoming-mail-token": ("imt-", "{25}"), "gitlab-agent-token": ("agent-", "{50}"),
    "gitlab-oauth-app-secret": ("oas-", "{64}"), "gitlab-feature-flag-client-token": ("ffct-", "{20}"), "gitlab-scim-token": ("soat-", "{20}"),
}
_HOOKS = "https://hooks.slack.com/"
_ROUTE = "T[A-Za-z0-9]{8,11}/"
ROUTING_NAMES = ("routing_key", "ROUTING_KEY", "service_key", "SERVICE_KEY", "integration_key", "INTEGRATION_KEY")

SHAPES: tuple[Shape, ...] = (
    *(Shape("github", kind, f"gh{c}_", f"gh{c}_{ALNUM}{{36}}", "", ALNUM, verify=_classic, checksum=True) for c, kind in _GITHUB.items()),
    Shape("github", "github-fine-grained-pat", "github_pat_", f"github_pat_{ALNUM}{{22}}_{ALNUM}{{59}}", "", WORD),
    *(Shape("gitlab", kind, f"gl{p}", f"gl{p}{TOKEN}{n}", WORD, TOKEN) for kind, (p, n) in _GITLAB_FIXED.items()),
    *(Shape("gitlab", kind, p, rf"{p}{TOKEN}{{27,300}}\.(?:[0-9a-z]{{2}}\.)?[0-9a-z]{{9}}", WORD, TOKEN, verify=_routable, checksum=True) for kind, p in (("gitlab-pat", "glpat-"), ("gitlab-runner-token", "glrt-"))),
    Shape("gitlab", "gitlab-runner-token", "glrt-", rf"glrt-(?!t\d_){TOKEN}{{20}}", WORD, TOKEN),
    Shape("gitlab", "gitlab-ci-job-token", "glcbt-", f"glcbt-{ALNUM}{{1,5}}_{TOKEN}{{20}}", WORD, TOKEN),
    Shape("gitlab", "gitlab-pipeline-trigger-token", "glptt-", "glptt-[0-9a-f]{40}", WORD, TOKEN),
    Shape("slack", "slack-bot-token", "xoxb-", rf"xoxb-(?:\d{{10,13}}-){{2}}{ALNUM}{{24}}", "", ALNUM, attribution=_group("team %s, bot %s", r"^xoxb-(\d+)-(\d+)", 2)),
    Shape("slack", "slack-user-token", "xoxp-", rf"xoxp-(?:\d{{10,13}}-){{3}}{ALNUM}{{28,34}}", "", ALNUM, attribution=_group("team %s, user %s", r"^xoxp-(\d+)-(\d+)", 2)),
    Shape("slack", "slack-app-token", "xapp-1-A", r"xapp-1-A[A-Z0-9]{8,12}-\d{10,13}-[0-9A-Fa-f]{64}", "", ALNUM, attribution=_group("app A%s", r"^xapp-1-A([A-Z0-9]+)", 1)),
    Shape("slack", "slack-refresh-token", "xoxe-1-", f"xoxe-1-{URL64}{{40,1024}}", "", URL64),
    Shape("slack", "slack-config-token", "xoxe.xox", rf"xoxe\.xox[bp]-1-{URL64}{{40,1024}}", "", URL64),
    Shape("slack", "slack-webhook", _HOOKS + "services/", rf"{re.escape(_HOOKS)}services/{_ROUTE}B[A-Za-z0-9]{{8,11}}/{ALNUM}{{24}}", "", "[A-Za-z0-9/]", attribution=_group("team %s, bot %s", "/services/(T[^/]+)/(B[^/]+)", 2)),
    *(Shape("slack", "slack-webhook", _HOOKS + r + "/", rf"{re.escape(_HOOKS)}{r}/{_ROUTE}(?:{ALNUM}{{1,65}}+/){{1,2}}+{ALNUM}{{20,64}}+", "", "[A-Za-z0-9/]", attribution=_hook) for r in ("workflows", "triggers")),
    *(Shape("aws", "aws-temporary-access-key" if p[1] == "S" else "aws-access-key", p, f"{p}{'[A-Z0-9]' if len(p) == 3 else ''}[A-Z2-7]{{16}}", ALNUM, ALNUM, attribution=_account) for p in ("AKIA", "ASIA", "ABIA", "ACCA", "A3T")),
    Shape("gcp", "gcp-oauth-access-token", "ya29.", r"ya29\.[A-Za-z0-9_.-]{59,249}[A-Za-z0-9_-](?=\.*(?![A-Za-z0-9_.-]))", WORD, URL64),
    Shape("gcp", "gcp-oauth-refresh-token", "1//0", f"1//0{URL64}{{40,120}}", WORD, URL64),
    Shape("gcp", "gcp-api-key", "AIza", f"AIza{URL64}{{35}}", WORD, URL64),
    Shape("azure", "azure-client-secret", "Q~", r"[A-Za-z0-9_~.]{3}\dQ~(?:[A-Za-z0-9_~.-]{34}(?=\.)|[A-Za-z0-9_~.-]{31,34}(?![A-Za-z0-9_~.-]))", WORD, "", (4,)),
    Shape("azure", "azure-storage-account-key", "==", "[A-Za-z0-9+/]{86}==", "[A-Za-z0-9+/]", "[A-Za-z0-9+/=]", (86,)),
    *(Shape("anthropic", kind, "sk-ant-" + p, f"sk-ant-{p}{body}", WORD, URL64) for kind, p, body in (("anthropic-api-key", "api03-", f"{URL64}{{93}}AA"), ("anthropic-admin-api-key", "admin01-", f"{URL64}{{93}}AA"), ("anthropic-oauth-token", "oat01-", f"{URL64}{{80,120}}"), ("anthropic-oauth-refresh-token", "ort01-", f"{URL64}{{80,120}}"))),
    *(Shape("openai", kind, KEY_MARKER, f"{p}(?:{URL64}{{74}}|{URL64}{{58}}){KEY_MARKER}(?:{URL64}{{74}}|{URL64}{{58}})", WORD, URL64, (len(p) + 74, len(p) + 58)) for kind, p in (("openai-project-key", "sk-proj-"), ("openai-service-account-key", "sk-svcacct-"), ("openai-admin-key", "sk-admin-"))),
    Shape("openai", "openai-legacy-key", KEY_MARKER, f"sk-{ALNUM}{{20}}{KEY_MARKER}{ALNUM}{{20}}", WORD, URL64, (23,)),
    Shape("grafana", "grafana-service-account-token", "glsa_", f"glsa_{ALNUM}{{32}}_[0-9a-f]{{8}}", WORD, ALNUM, verify=lambda v: F.right(v, F.lit(8)) == V.little_endian_crc(F.left(v, F.lit(37))), checksum=True),
    Shape("grafana", "grafana-cloud-access-policy-token", "glc_", r"glc_[A-Za-z0-9+/_-]{32,400}+={0,3}+", WORD, ALNUM, verify=_json_has("o", "k"), attribution=_cloud),
    Shape("grafana", "grafana-legacy-api-key", "eyJrIjoi", r"eyJrIjoi[A-Za-z0-9+/]{32,392}+={0,3}+", WORD, ALNUM, verify=_json_has("k", "n"), attribution=_legacy_key),
    Shape("pagerduty", "pagerduty-api-key", "y_", f"y_{TOKEN}{{18}}", "[A-Za-z0-9_+/-]", "[A-Za-z0-9_+/=-]", marker="pagerduty|pd_|token token="),
    Shape("pagerduty", "pagerduty-api-key", "u+", r"u\+[A-Za-z0-9_+/-]{18}", "[A-Za-z0-9_+/-]", "[A-Za-z0-9_+/=-]"),
    *(Shape("pagerduty", "pagerduty-routing-key", n, "[0-9a-f]{32}", "", ALNUM, name=rf"{n}[\"']?[ \t\r\n]{{0,8}}[:=][ \t\r\n]{{0,8}}[\"']?", says="under {}") for n in ROUTING_NAMES),
    Shape("npm", "npm-access-token", "npm_", f"npm_{ALNUM}{{36}}", WORD, WORD),
    Shape("npm", "npm-legacy-token", "_authToken", UUID, "", ALNUM, name=r"_authToken[ \t]{0,4}=[ \t]{0,4}[\"']?"),
    Shape("kubernetes", "kubernetes-service-account-token", "eyJ", r"eyJ[A-Za-z0-9_-]{1,4096}+\.[A-Za-z0-9_-]{1,4096}+\.[A-Za-z0-9_-]{1,4096}+", "[A-Za-z0-9_.-]", "[A-Za-z0-9_.=-]", verify=lambda v: _is_jwt(v) & _service_account(v).isNotNull(), attribution=lambda v: F.concat(F.lit("serviceaccount "), _service_account(v), _pod(v))),
    *(Shape("oci", f"docker-hub-{k}", f"dckr_{k}_", f"dckr_{k}_{URL64}{{24,40}}", WORD, URL64) for k in ("pat", "oat")),
)
#: Runs of letters and digits that are tokens by length and by what stands near them: a robot's name, the registry's.
ROBOT, OAUTH = 64, 40
_ROBOT_NAME = re.compile(rb"(?<![A-Za-z0-9+/=-])(?<![a-z0-9_])[a-z0-9_]+\+[a-z0-9_]+(?![A-Za-z0-9+/=-])(?![a-z0-9_])")

PROVIDERS = ("github", "gitlab", "slack", "aws", "gcp", "azure", "sops", "anthropic", "openai", "grafana", "pagerduty", "npm", "kubernetes", "privatekey", "oci")


#: What the pass gives for each place: a token of a shape or of a document format, or a candidate (cls) for another token's companion.
FIELDS = [("cls", pa.string()), ("shape", pa.int32()), ("provider", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("keyword", pa.bool_()), ("checksum_verified", pa.bool_()), ("attribution", pa.string()), ("secret", pa.string()), ("encrypted", pa.bool_()), ("encoded", pa.bool_()), ("expires", pa.int64()), ("within", pa.string()), ("s_offset", pa.int64()), ("s_end", pa.int64())]
DDL = "cls string, shape int, provider string, kind string, value string, offset bigint, end bigint, line int, keyword boolean, checksum_verified boolean, attribution string, secret string, encrypted boolean, encoded boolean, expires bigint, within string, s_offset bigint, s_end bigint"
Row = dict[str, object]
#: Needles that content must have, and a helper that gives the rows of one object. The helper may search values for tokens itself.
Format = tuple[tuple[str, ...], Callable[[bytes, Callable[[bytes], list[Row]]], Iterator[Row]]]
#: By provider: a helper that gives the candidates for companions in an object with a token of that provider.
Companions = dict[str, Callable[[bytes], Iterator[Row]]]
#: Kinds that are nothing without a candidate of a class in their object, where companions are looked for: lock files are full of hashes of their shape.
NEEDED = {"azure-storage-account-key": "azure-account"}


_WORD_BEFORE = re.compile(rb"[A-Za-z0-9_]*+\Z")


class Finder:
    """Every match of the shapes in the contents of a batch."""

    def __init__(self, shapes: tuple[Shape, ...], formats: tuple[Format, ...] = (), companions: Companions | None = None) -> None:
        self.shapes, self.formats, self.companions = shapes, formats, companions or {}
        self.of: dict[str, list[tuple[int, Shape]]] = {}
        for i, s in enumerate(shapes):
            self.of.setdefault(s.needle, []).append((i, s))
        self.read_by: dict[str, list[int]] = {}
        for i, (needles, _) in enumerate(formats):
            for n in needles:
                self.read_by.setdefault(n, []).append(i)
        self.names = list(dict.fromkeys([*self.of, *self.read_by]))
        self.needles = scanner.Needles([n.encode() for n in self.names])
        self.sizes = np.array([len(n.encode()) for n in self.names], np.int64)
        self.runs = any(s.provider == "oci" for s in shapes)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
        """(content's number, positions, needle numbers) by content; -length stands for a run."""
        at, which = self.needles.find(data)
        sizes = self.sizes[which]
        if self.runs:
            start, length = scanner.runs(data, offsets, (ROBOT, OAUTH))
            at, which, sizes = np.concatenate([at, start]), np.concatenate([which, -length]), np.concatenate([sizes, length])
            order = np.argsort(at, kind="stable")
            at, which, sizes = at[order], which[order], sizes[order]
        return scanner.by_value(at, sizes, offsets, which)

    def tokens(self, content: bytes, at: list[int], which: list[int]) -> list[Row]:
        found: list[Row] = []
        marked: dict[str, bool] = {}
        for p, w in zip(at, which, strict=True):
            if w < 0:
                found += _run_token(content, p, -w)
                continue
            for i, s in self.of.get(self.names[w], ()):
                for back in s.back:
                    m = s.pattern.match(content, p - back) if p >= back else None
                    if m is None:
                        continue
                    if s.marker and s.marker not in marked:
                        marked[s.marker] = re.search(s.marker.encode(), content, re.I) is not None
                    if not s.marker or marked[s.marker]:
                        row = {"cls": "token", "shape": i, "provider": s.provider, "kind": s.kind, "value": m[1].decode("latin-1"), "offset": m.start(1), "end": m.end(1)}
                        found.append(row | {"attribution": s.says.format(_WORD_BEFORE.search(content, max(0, p - 128), p)[0].decode() + self.names[w])} if s.says else row)
        return found

    def inside(self, content: bytes) -> list[Row]:
        """The tokens of one value."""
        data = np.frombuffer(content, np.uint8)
        return [t for _, at, which in self.places(data, np.array([0, len(data)])) for t in self.tokens(content, at, which)]

    def rows(self, column: pa.Array) -> Iterator[tuple[int, list[Row]]]:
        """(content's number, its rows with their lines) for each content that has any."""
        data, offsets = scanner.flat(column)
        for r, at, which in self.places(data, offsets):
            content = data[offsets[r] : offsets[r + 1]].tobytes()
            found = self.tokens(content, at, which)
            for i in sorted({i for w in set(which) if w >= 0 for i in self.read_by.get(self.names[w], ())}):
                found += total(self.formats[i][1](content, self.inside), ", ".join(self.formats[i][0]))
            for provider in sorted({t["provider"] for t in found if t["cls"] == "token"} & set(self.companions)):
                found += total(self.companions[provider](content), provider)
            lacking = set(NEEDED) - {k for k, cls in NEEDED.items() if "azure" not in self.companions or any(t["cls"] == cls for t in found)}
            if lacking:
                found = [t for t in found if t.get("kind") not in lacking or t.get("within")]
            found.sort(key=lambda t: t["offset"])
            last, n = 0, 1
            for t in found:
                n += content.count(b"\n", last, t["offset"])
                last, t["line"] = t["offset"], n
            if found:
                yield r, found


def total(rows: Iterator[Row], reader: str) -> list[Row]:
    """A helper's rows as columns can hold them. What a helper fails at ends its rows of this object, and is counted by a row of cls "malformed"; texts that no encoding has get question marks."""
    out: list[Row] = []
    try:
        for r in rows:
            out.append({k: v.encode("utf-8", "replace").decode() if isinstance(v, str) and not v.isascii() else v for k, v in r.items()})
            if any(not isinstance(v, kind) for k, v in r.items() if v is not None and (kind := _TYPES.get(k))):
                raise TypeError(f"a row's {', '.join(r)} don't fit their columns")
    except Exception as wrong:  # content is untrusted: one object must not end the pass over all
        if out and any(not isinstance(v, kind) for k, v in out[-1].items() if v is not None and (kind := _TYPES.get(k))):
            out.pop()
        out.append({"cls": "malformed", "shape": -1, "kind": reader, "value": type(wrong).__name__, "offset": 0, "end": 0})
    return out


_TYPES = {n: str if t == pa.string() else bool if t == pa.bool_() else int for n, t in FIELDS}


def _run_token(content: bytes, at: int, length: int) -> list[Row]:
    """A token of a registry that has no prefix: by its letters, and by what is named within the window."""
    run = content[at : at + length]
    if content[at - 1 : at] == b"_" or content[at + length : at + length + 1] == b"_" or re.fullmatch(b"[0-9A-Fa-f]+", run):
        return []
    near = content[max(0, at - WINDOW) : at + length + WINDOW]
    row = {"cls": "token", "shape": -1, "provider": "oci", "value": run.decode(), "offset": at, "end": at + length, "checksum_verified": False}
    if length == ROBOT and run == run.upper() and (robot := _ROBOT_NAME.search(near)):
        return [row | {"kind": "quay-robot-token", "secret": robot[0].decode(), "attribution": "robot " + robot[0].decode()}]
    if length == OAUTH and re.search(b"[A-Z]", run) and re.search(b"[a-z]", run) and b"quay.io" in near.lower():
        return [row | {"kind": "quay-oauth-token", "attribution": ""}]
    return []


def hits(objects: DataFrame, shapes: tuple[Shape, ...] = SHAPES, formats: tuple[Format, ...] = (), companions: Companions | None = None, content: str = "content", keep: tuple[str, ...] = ("object_key",), now: Column | None = None) -> DataFrame:
    """A row for each verified match, document token and candidate in each object: the kept columns and FIELDS. Null content has none. now: the clock that expiries are told against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shapes, formats, companions)
        for b in batches:
            own, at = [], []

            def made() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())  # noqa: B023
                kept = [b.column(k).take(rows) for k in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(n) for r in own], t) for n, t in FIELDS)], names=[*keep, *(n for n, _ in FIELDS)])  # noqa: B023

            for r, found in finder.rows(b.column(len(keep))):
                own += found
                at += [r] * len(found)
                if len(own) >= 10_000:
                    yield made()
                    own, at = [], []
            if own:
                yield made()

    some = objects.select(*keep, F.col(content).alias("_content"))
    kept = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in keep)
    rows = some.select(*keep, "_content").mapInArrow(run, f"{kept}, {DDL}")
    good, said = _judged(shapes)
    checked = [i for i, s in enumerate(shapes) if s.checksum]
    shaped = F.col("shape") >= 0
    verified = F.when(shaped, F.col("shape").isin(checked)).otherwise(F.coalesce("checksum_verified", F.lit(False)))
    signed = F.coalesce(F.col("kind") == "kubernetes-service-account-token", F.lit(False))
    # as a lambda's body, for the same reason as in _judged
    claimed = F.when(signed, F.transform(F.array("value"), expiry_of)[0])
    rows = rows.filter(good).withColumns({"checksum_verified": verified, "attribution": F.coalesce("attribution", F.when(shaped, said)), "encrypted": F.coalesce("encrypted", F.lit(False)), "expires": F.coalesce("expires", claimed)})
    legacy = F.when(signed & F.col("expires").isNull() & shaped, ", no expiry (legacy token)").otherwise("")
    return rows.withColumn("attribution", F.concat("attribution", legacy, expiry_text(F.col("expires"), now if now is not None else F.current_timestamp())))


@lru_cache(maxsize=8)
def _judged(shapes: tuple[Shape, ...]) -> tuple[Column, Column]:
    """Whether a row's value passes its shape's check, and its attribution. The expressions name only columns of the pass, so one making serves every table."""

    def by(attribute: str, otherwise: Column) -> Column:
        def case(t: Column) -> Column:
            out = F
            for made in dict.fromkeys(getattr(s, attribute) for s in shapes if getattr(s, attribute)):
                out = out.when(t["n"].isin([i for i, s in enumerate(shapes) if getattr(s, attribute) is made]), made(t["v"]))
            return otherwise if out is F else out.otherwise(otherwise)

        # a lambda's body is interpreted: there are few matches, and generated code would be larger than a method may be
        made = F.transform(F.array(F.struct(F.col("value").alias("v"), F.col("shape").alias("n"))), case)[0]
        return F.when(F.col("shape").isin([i for i, s in enumerate(shapes) if getattr(s, attribute)]), made).otherwise(otherwise)

    return F.coalesce(by("verify", F.lit(True)), F.lit(False)), by("attribution", F.lit(""))


def find(objects: DataFrame, shapes: tuple[Shape, ...] = SHAPES, content: str = "content", keep: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """A row for each match in each object: the kept columns, provider, kind, value (a byte view), offset, line, checksum_verified, attribution.

    Null content has no matches. Line is one more than the line feeds before the offset.
    """
    return hits(objects, shapes, content=content, keep=keep).select(*keep, "provider", "kind", "value", "offset", "line", "checksum_verified", "attribution")


def line(content: Column, offset: Column) -> Column:
    """1 for the first line."""
    before = F.decode(F.substring(content, F.lit(1), offset.cast("int")), "ISO-8859-1")
    return (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("int")
