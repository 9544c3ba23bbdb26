"""Spans, hints, peers, servers, endings, registry logins, receivers, and helpers on odd and hostile content."""

import base64
import hashlib
import ipaddress
import json
import random
import time
import zlib
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import In, LessThanOrEqual, StringEndsWith

from sluicebed import queries
from sluicebed.operators import attribution, detectors, documents, findings, hints, nearest, nodes, peers, registries, servers, sightings, spans
from sluicebed.plans import scan, verdicts
from sluicebed.sources import tables, trees
from tests.test_engine import body, classic

b64 = lambda s: base64.b64encode(s.encode()).decode()
FORMATS = documents.FORMATS + sightings.FORMATS


def objects(spark, *contents):
    return spark.createDataFrame([(i, c if isinstance(c, bytes) else c.encode()) for i, c in enumerate(contents)], "object_key long, content binary")


def test_spans_sweep_equals_pairs(spark):
    rng = random.Random(4)
    held = [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(40)) for _ in range(60)] + [(None, 5, 9)]
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(-5, 240), i) for i in range(300)] + [("a", None, 300)]
    got = spans.marked(spark.createDataFrame(rows, "object_key string, offset long, n int"), spark.createDataFrame(held, "object_key string, offset long, end long"))
    want = {(k, p, n, p is not None and any(k == g and s <= p < e for g, s, e in held)) for k, p, n in rows}
    assert set(map(tuple, got.collect())) == want and {w[3] for w in want} == {True, False}
    none = spark.createDataFrame([], "object_key string, offset long, end long")
    assert spans.outside(spark.createDataFrame(rows, "object_key string, offset long, n int"), none).count() == 301


def test_hints_match_one_key_or_none(spark):
    long = "sk-ant-api03-" + "x" * 60
    values = spark.createDataFrame([("f1", "p", "abcdef"), ("f2", "p", "abxxef"), ("f3", "p", long), ("f4", "q", "abcdef"), ("f5", "p", "ab"), ("f1", "p", "abcdef")], "fingerprint string, provider string, value string")
    keys = [("k1", "p", "abc…ef"), ("k2", "p", "ab...ef"), ("k3", "p", f"{long[:40]}…{long[-30:]}"), ("k4", "p", f"{long[:40]}y…{long[-30:]}"), ("k5", "p", "abc…"), ("k6", "p", "no hint"), ("k7", "p", None), ("k8", "q", "abcde…def")]
    got = hints.matched(values, spark.createDataFrame(keys, "key_id string, provider string, hint string"), ("provider",))
    rows = {r["fingerprint"]: (r["matches"], r["key_id"]) for r in got.collect()}
    assert rows == {"f1": (2, None), "f2": (1, "k2"), "f3": (1, "k3"), "f4": (0, None), "f5": (0, None)}
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert hints.matched(values, spark.createDataFrame([], "key_id string, provider string, hint string")).filter("matches = 0 and key_id is null").count() == 5


def test_account_tokens_by_what_is_most_certain(spark):
    values = spark.createDataFrame([("f1", "tok-1234", "a", None), ("f2", "zzz", "a", "u3"), ("f3", "zzz", "b", None), ("f4", "zzz", "c", None), ("f5", "zzz", "d", None)], "fingerprint string, value string, account string, token_id string")
    listed = [("a", 1, "u1", "tok…34", True, 0), ("a", 2, "u2", "tok-1234", True, 0), ("a", 3, "u3", "", True, 0), ("b", 1, "u4", "", True, 900), ("b", 2, "u5", "", False, 990), ("c", 1, "u6", "", True, 100), ("c", 2, "u7", None, True, 990), ("d", 1, "u8", None, True, 1), ("d", 2, "u9", None, True, 2)]
    rows = spark.createDataFrame(listed, "account string, ord int, key_id string, token string, active boolean, at long").withColumn("last_used", F.timestamp_seconds("at"))
    got = {r["fingerprint"]: (r["key_id"], r["how"]) for r in hints.account_tokens(values, rows, F.timestamp_seconds(F.lit(1000))).collect()}
    assert got == {"f1": ("u1", "listed"), "f2": ("u3", "listed"), "f3": ("u4", "active"), "f4": ("u7", "recent"), "f5": (None, "none")}


def test_registry_logins_in_every_form(spark):
    entry = {"auth": b64("user:pass word")}
    config = json.dumps({"credsStore": "x", "auths": {"https://index.docker.io/v1/": entry, "ghcr.io": {"username": "me", "password": "${P}"}, "bad": {"password": 7}, "none": {}, "also": ["x"], "q": {"auth": "*"}}})
    hub = f"dckr_pat_{body(30)}"
    contents = [
        config,
        'x: "' + config.replace('"', '\\"') + '"',
        f"  .dockerconfigjson: {b64(config)}\n",
        f'dockerconfigjson": |\n    "{b64(json.dumps({"auths": {"h": {"auth": b64(f"u:{hub}")}, "docker.io": {"auth": b64(f"u:{hub}")}}}))}"',
        f"curl -H 'Authorization: Basic {b64('a:b')}' https://r.example.com:5000/v2/_catalog",
        f"authorization: Basic {b64('a:b')}\nGET my.quay.io/x",
        f"authorization: Basic {b64('a:b')}\nGET nothing",
        f"Basic {b64('a:b')} ghcr.io",
        '{"auths": {"x": 1}, "auths": {"ghcr.io": {"username": "u", "password": "p"}}}',
        '{"auths": ' * 3000,
    ]
    rows = detectors.hits(objects(spark, *contents), formats=FORMATS).filter("cls = 'token' and provider = 'oci' and kind like '%login'").collect()
    got = {k: sorted((r["kind"], r["value"], r["secret"], r["offset"]) for r in rows if r["object_key"] == k) for k in range(len(contents))}
    at = contents[0].index('"https')
    assert got[0] == [("docker-hub-login", "index.docker.io/user", "pass word", at)]
    assert got[1] == [("docker-hub-login", "index.docker.io/user", "pass word", 3 + at)]
    assert got[2] == [("docker-hub-login", "index.docker.io/user", "pass word", contents[2].index(": ") + 2)]
    assert [g[:3] for g in got[3]] == [("registry-login", "h/u", hub)]
    assert got[4] == [("registry-login", "r.example.com:5000/a", "b", contents[4].index("Basic"))] and [g[1] for g in got[5]] == ["my.quay.io/a"]
    assert got[6] == got[7] == got[9] == [] and [g[1] for g in got[8]] == ["ghcr.io/u"]


def test_scan_leaves_out_tokens_in_decoded_text_and_names_peers(spark):
    npm, hub = f"npm_{body(36)}", f"dckr_pat_{body(30)}"
    blob = b64(json.dumps({"auths": {"ghcr.io": {"auth": b64(f"u:{npm}")}, "docker.io": {"auth": b64(f"h:{hub}")}}}))
    texts = [f".dockerconfigjson: {blob}", json.dumps({"auths": {"docker.io": {"username": "h", "password": hub}, "r.io": {"username": "x", "password": npm}}})]
    rows = [("t", str(i), "file", f"f{i}", len(t), t.encode()) for i, t in enumerate(texts)]
    out = scan.run(spark.createDataFrame(rows, "target string, object_key string, object_type string, path string, size long, content binary"))
    got = sorted((r["object_key"], r["kind"], r["value"]) for r in out.tokens.collect())
    assert got == [("0", "docker-hub-pat", hub), ("0", "ghcr-login", "ghcr.io/u"), ("0", "npm-access-token", npm), ("1", "docker-hub-pat", hub), ("1", "npm-access-token", npm), ("1", "registry-login", "r.io/x")]
    said = {(r["object_key"], r["kind"]): r["attribution"] for r in out.tokens.collect()}
    assert said["1", "registry-login"] == "r.io, user x, password is a npm access token, reported separately" and said["0", "docker-hub-pat"] == "docker.io, user h"


def test_peers_are_whole_values(spark):
    values = spark.createDataFrame([(classic(),), (classic() + " ",), ("x",), (None,), ("",), (classic(),)], "v string")
    assert [(r["value"], r["kind"]) for r in peers.peers(values, "v").collect()] == [(classic(), "github-pat")]


def test_receivers_come_before_names(spark):
    key, other = body(32, "k", "0123456789abcdef"), body(32, "o", "0123456789abcdef")
    config = f"receivers:\n- name: a/b\n  pagerduty_configs:\n  - routing_key: '{key}'\n  - routing_key: {key}\n- pagerduty_configs: [{{service_key: {other}}}, x, {{routing_key: [1]}}]\n"
    hits = detectors.hits(objects(spark, config + f"---\nmy_routing_key = {other}\nROUTING_KEY: {key}\n", f"xrouting_key: {key}\nservice_key: {key}\n"), formats=FORMATS)
    got = {(r["object_key"], r["value"]): (r["attribution"], r["offset"]) for r in documents.with_receivers(hits).filter("kind = 'pagerduty-routing-key'").collect()}
    assert got == {
        (0, key): ("routing_key of receiver a/b in Alertmanager config", config.index(key)),
        (0, other): ("service_key of receiver  in Alertmanager config", config.index(other)),
        (1, key): ("under xrouting_key", 14),
    }


ADDRESSES = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.256", "01.2.3.4", "::", "::1", "1::", "fe80::1", "2001:db8:0:0:1::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "1::2::3", ":::", "12345::", "g::", "", "host", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4.5", "FE80::A"]


def test_addresses_are_read_as_the_library_reads_them(spark):
    def want(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        return (b"\0" * 10 + b"\xff\xff" + ip.packed if ip.version == 4 else ip.packed).hex()

    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", servers.ip_hex(F.col("a")).alias("h")).collect()
    assert {r["a"]: r["h"] for r in rows} == {a: want(a) for a in ADDRESSES}


def test_longest_prefix_holds(spark):
    nets = ("10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/48", "::/0")
    rng = random.Random(1)
    ips = [f"10.{rng.randrange(3)}.{rng.randrange(5)}.{rng.randrange(256)}" for _ in range(60)] + [f"2001:db8:{rng.randrange(3)}::{rng.randrange(9)}" for _ in range(30)] + ["8.8.8.8", "fe80::1", "none", None]

    def want(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        own = [n for n in map(ipaddress.ip_network, nets) if n.version == ip.version and ip in n] or [n for n in map(ipaddress.ip_network, nets) if str(n) == "::/0"]
        return str(max(own, key=lambda n: n.prefixlen)) if own else None

    got = servers.longest_prefix(spark.createDataFrame([(a,) for a in ips], "a string"), "a", servers.networks(spark, nets)).collect()
    assert len(got) == len(ips) and {r["a"]: r["cidr"] for r in got} == {a: want(a) if a else None for a in ips}


def test_servers_on_private_networks_are_not_asked(spark):
    names = ["https://a.com", "https://b.com:8443/x?y", "http://a.com", "https://10.0.0.1", "https://[::1]:80", "https://gone.com", "ftp", "https://u@a.com#f", "https://mixed.com", "https://"]
    s = spark.createDataFrame([(n,) for n in names], "server string")
    answers = spark.createDataFrame([("a.com", "8.8.8.8", None), ("b.com", "192.168.1.1", None), ("gone.com", None, "timeout"), ("mixed.com", "8.8.8.8", None), ("mixed.com", "fe80::1", None)], "host string, ip string, error string")
    rows = {r["server"]: (r["admitted"], r["detail"]) for r in servers.admitted(s, answers, servers.networks(spark)).collect()}
    assert [n for n in names if rows[n][0]] == ["https://a.com", "https://u@a.com#f"]
    assert rows["https://gone.com"][1] == "gone.com not reachable from here: timeout" and rows["ftp"][1] == "server URL ftp does not parse" and "private network" in rows["https://mixed.com"][1]
    assert {r["server"] for r in servers.admitted(s, answers, servers.networks(spark), allow_private=True).filter("admitted").collect()} == set(names) - {"http://a.com", "ftp", "https://"}


def test_public_endings(spark):
    rules = servers.ending_rules(spark, ["// list", "", "com", "uk", "co.uk", "*.ck", "!www.ck", "github.io"])
    want = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", None), "x.y.ck": ("y.ck", "x.y.ck"), "y.ck": ("y.ck", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "A.COM": ("com", "a.com"), "x.unlisted": ("unlisted", "x.unlisted"), "me.github.io": ("github.io", "me.github.io"), "a.com.": ("com", "a.com"), "uk": ("uk", None)}
    got = servers.public_endings(spark.createDataFrame([(h,) for h in want], "h string"), "h", rules).collect()
    assert {r["h"]: (r["ending"], r["registrable"]) for r in got} == want


BAD = [
    '{"auths": {"ghcr.io": {"username": "u", "password": 123456}}}', '{"auths": {"ghcr.io": {"auth": ["x"]}}}', '{"auths": {"ghcr.io": {"username": "\\ud800", "password": "p"}}}', '{"auths":' + "[" * 50_000,
    '{"type": "service_account", "a": ' + "[" * 20_000, '{"type": "authorized_user", "refresh_token": 5}', '{"type": "service_account", "client_email": [1], "private_key": {}}',
    "-----BEGIN ENCRYPTED COSIGN PRIVATE KEY-----\n" + b64('[{"ciphertext": 1}]') + "\n-----END ENCRYPTED COSIGN PRIVATE KEY-----", "-----BEGIN ENCRYPTED COSIGN PRIVATE KEY-----\n" + b64('{"ciphertext": "x", "kdf": "text", "cipher": [1]}') + "\n-----END ENCRYPTED COSIGN PRIVATE KEY-----",
    "kind: Secret\na: " + "[" * 30_000, "kind: Secret\n" + "".join(" " * i + f"a{i}:\n" for i in range(300)), "kind: Secret\nmetadata: &a {b: *a}\ndata: *a\nstringData: {? [1] : x}", "kind: Secret\ndata: {a: *nothing}", "kind: Secret\ndata: [1, {a: b}]\nitems: 5",
    "kind: Config\nusers: {a: b}\nclusters: [1, [2]]\ncontexts: [{context: 5}]", f"kind: Config\nusers:\n- {{name: a, user: {{token: x.{b64('[' * 9000)}.y}}}}", "kind: List\nitems: [kind: Secret]\nkind: Secret", "pagerduty_configs: " + "[" * 20_000, "pagerduty_configs: &x [*x, {routing_key: *x}]",
    "AGE-SECRET-KEY-1" + "Q" * 58, "x?sv=1&se=2&sig=%ff%zz", "sig=" * 2000, "￾ kind: Secret", "-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----", "ssh-ed25519 AAAA", "sops: age: pgp: ENC[",
]


def test_one_odd_object_costs_only_its_own_rows(spark):
    good = classic()
    rows = [("t", str(i), "file", f"f{i}", len(c), c.encode("utf-8", "surrogatepass")) for i, c in enumerate([good, *BAD, good])]
    out = scan.run(spark.createDataFrame(rows, "target string, object_key string, object_type string, path string, size long, content binary"))
    assert {r["object_key"] for r in out.tokens.filter(F.col("value") == good).collect()} == {"0", str(len(BAD) + 1)}


HELPERS = {
    "cloud": documents.cloud_documents, "logins": registries.registry_logins, "keys": documents.private_keys, "secrets": documents.secrets_of, "kubeconfigs": documents.kubeconfigs, "signatures": documents.signatures, "identities": documents.age_identities,
    "leaves": lambda c: documents.receiver_leaves(c, None), "ssh": sightings.ssh_public_keys, "pem": sightings.pem_blocks, "recipients": sightings.recipients, "inside": sightings.in_secrets, **{p: f for p, f in nearest.COMPANIONS.items()},
}


@pytest.mark.parametrize("name", HELPERS)
def test_helpers_take_what_is_bad_and_mutated(name):
    """No helper fails, and all its rows fit their columns."""
    rng = random.Random(name)
    seeds = [c.encode("utf-8", "surrogatepass")[:3000] for c in BAD]
    tried = list(seeds)
    for _ in range(10_000):
        x = bytearray(rng.choice(seeds)[: rng.randrange(1, 400)])
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(3)] = rng.choice([b"", b'"', b"{", b"}", b"\\", b"\xff", b"\n", b"---\n", b"[", b":", b"0", bytes([rng.randrange(256)])])
            x = x or bytearray(b"x")
        tried.append(bytes(x))
    for c in tried:
        made = HELPERS[name](c)
        rows = detectors.total(iter(list(made) and []) if name == "secrets" else made, name)  # a Secret's values are bytes, which only other helpers read
        assert not any(r.get("cls") == "malformed" for r in rows), c


def test_what_a_helper_fails_at_is_counted():
    def broken(rows):
        yield from rows
        raise KeyError("x")

    assert [r["cls"] for r in detectors.total(broken([{"cls": "token", "value": "\ud800"}]), "x")] == ["token", "malformed"]
    assert [r["cls"] for r in detectors.total(iter([{"cls": "token", "value": 5}]), "x")] == ["malformed"]


@pytest.mark.parametrize("part", [b'"type": "service_account" ', b'"service_account" ', b'{"type":"service_account","a":', b"-----BEGIN CERTIFICATE-----\n", b"-----BEGIN RSA PRIVATE KEY-----\nAAAA\n", b"kind of a Secret\n", b'"auths":{', b'{"auths":{"a":{"auth":"YTpi"}}} ', b"sig=", b"Basic YTpi "])
def test_bad_content_takes_linear_time(part):
    content = part * (2_000_000 // len(part))
    began = time.perf_counter()
    for helper in HELPERS.values():
        for _ in helper(content):
            pass
    assert time.perf_counter() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12))
def test_leaves_are_the_scalars_of_json(doc):
    text = json.dumps({"pagerduty_configs": doc}, ensure_ascii=True)
    found = {path: (value, start, end) for _, path, value, start, end in nodes.leaves(text.encode(), b"pagerduty_configs")}

    def scalars(path, x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from scalars(path + "/" + k.replace("~", "~0").replace("/", "~1"), v)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from scalars(f"{path}/{i}", v)
        else:
            yield path, x

    want = dict(scalars("/pagerduty_configs", doc))
    if found:  # YAML refuses some characters that JSON may have
        assert found.keys() == want.keys()
        assert all(json.loads(text[start:end]) == want[p] for p, (_, start, end) in found.items())


def test_reachability_takes_few_rounds_over_many_merges(spark, monkeypatch):
    """A mainline with a merged side branch at every tenth commit; against what a plain search finds."""
    parents, prev = {}, None
    for n in range(4000):
        k = n % 10
        parents[n] = [] if n == 0 else [n - 6, n - 1] if k == 0 else [n - 1]
    commits = spark.createDataFrame([("r", f"c{n}", [f"c{p}" for p in ps]) for n, ps in parents.items()], "repo string, sha string, parents array<string>")
    refs = spark.createDataFrame([("r", f"refs/heads/{n}", f"c{n}") for n in (3997, 1204, 7)], "repo string, refname string, sha string")
    wanted = [0, 4, 6, 8, 1203, 1206, 2500, 3994, 3998, 3999]
    rounds = []
    real = tables.cut
    monkeypatch.setattr(tables, "cut", lambda *a: rounds.append(1) or real(*a))
    got = attribution.refs_containing(commits, refs, spark.createDataFrame([("r", f"c{n}") for n in wanted], "repo string, sha string")).collect()
    want: dict[str, list[str]] = {}
    for tip in (3997, 1204, 7):
        todo, seen = [tip], set()
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += parents[at]
        for n in wanted:
            if n in seen:
                want.setdefault(f"c{n}", []).append(f"refs/heads/{tip}")
    assert {r["sha"]: r["refs"] for r in got} == {k: sorted(v) for k, v in want.items()}
    assert len(rounds) < 40 and prev is None


def _mainline(spark, n: int):
    parents = {k: [] if k == 0 else [k - 6, k - 1] if k % 10 == 0 else [k - 1] for k in range(n)}
    return parents, spark.createDataFrame([("r", f"c{k}", [f"c{p}" for p in ps]) for k, ps in parents.items()], "repo string, sha string, parents array<string>")


def _search(parents: dict, heads: dict[str, tuple[str, int]]) -> dict[tuple[str, int], list[str]]:
    out: dict[tuple[str, int], list[str]] = {}
    for name, at in sorted(heads.items()):
        todo, seen = [at], set()
        while todo:
            if (one := todo.pop()) not in seen:
                seen.add(one)
                out.setdefault(one, []).append(name)
                todo += parents.get(one, ())
    return out


def test_merged_branches_without_refs_are_left_out(spark, monkeypatch):
    """What is walked from wanted commits goes with refs and wanted commits, not with the merges above them."""
    monkeypatch.setattr(attribution, "WALKED", 400)
    parents, commits = _mainline(spark, 3000)
    heads, wanted = {f"refs/tags/t{k}": k for k in range(7, 3000, 500)}, [6, 333, 1333, 2006, 2999]
    starts = spark.createDataFrame([("r", n, f"c{k}") for n, k in heads.items()], "repo string, start string, sha string")
    asked = spark.createDataFrame([("r", f"c{k}") for k in wanted], "repo string, sha string")
    assert attribution.contracted(commits, starts, asked).count() <= 200
    monkeypatch.setattr(attribution, "furthest", lambda *a: pytest.fail("by chains"))
    got = {r["sha"]: r["starts"] for r in attribution.containing(commits, starts, asked).collect()}
    want = _search(parents, heads)
    assert got == {f"c{k}": want[k] for k in wanted if k in want} and len(got) == 4


def test_listed_histories_are_shortened_where_they_lie(spark, monkeypatch):
    """Rows that lie near their parents take two passes, not a round for each halving; what is left is walked though it is over four times WALKED."""
    monkeypatch.setattr(attribution, "WALKED", 100)
    monkeypatch.setattr(attribution, "furthest", lambda *a: pytest.fail("by chains"))
    rounds = []
    real = tables.cut
    monkeypatch.setattr(tables, "cut", lambda *a: rounds.append(1) or real(*a))
    parents, commits = _mainline(spark, 6000)
    heads, wanted = {f"refs/tags/t{k}": k for k in range(7, 6000, 50)}, range(6, 6000, 50)
    refs = spark.createDataFrame([("r", n, f"c{k}") for n, k in heads.items()], "repo string, refname string, sha string")
    asked = spark.createDataFrame([("r", f"c{k}") for k in wanted], "repo string, sha string")
    got = {r["sha"]: r["refs"] for r in attribution.refs_containing(commits, refs, asked, ",").collect()}
    want = _search(parents, heads)
    assert got == {f"c{k}": ",".join(want[k]) for k in wanted if k in want} and len(got) > 100
    assert len(rounds) < 16


@pytest.mark.parametrize("order", ["rand(7)", "id", "-id"])
def test_rows_in_any_order_are_shortened_to_the_same(spark, monkeypatch, order):
    """Two repositories with the same names, commits with several rows, parents that aren't there, a circle."""
    monkeypatch.setattr(attribution, "WALKED", 60)
    monkeypatch.setattr(attribution, "STILL", 100)
    rng = random.Random(5)
    parents = {(r, k): sorted({(r, rng.randrange(max(0, k - 5), k)) for _ in range(rng.choice((1, 1, 1, 2)))}) if k else [(r, -1)] for r in range(2) for k in range(400)}
    rows = [(r, k, ps[j : j + 1] if k % 11 == 3 else ps) for (r, k), ps in parents.items() for j in range(len(ps) if k % 11 == 3 else 1)]
    rows += [(r, k, [(r, k + 1 if k == 500 else 500)]) for r in range(2) for k in (500, 501)]
    commits = spark.createDataFrame([(n, str(r), f"c{k}", [f"c{p}" for _, p in ps]) for n, (r, k, ps) in enumerate(rows)], "id long, repo string, sha string, parents array<string>").orderBy(F.expr(order)).coalesce(1).drop("id")
    heads = {f"{r}/{k}": (r, k) for r in range(2) for k in (399 - r, 250, 40)}
    starts = spark.createDataFrame([(n.partition("/")[0], n, f"c{k}") for n, (_, k) in heads.items()], "repo string, start string, sha string")
    want = {(str(r), f"c{k}"): names for (r, k), names in _search(parents, heads).items()}
    asked = [k for n, k in enumerate(sorted(want)) if n % 9 == 0] + [("0", "c-1"), ("1", "nowhere")]
    got = {(r["repo"], r["sha"]): r["starts"] for r in attribution.containing(commits, starts, spark.createDataFrame(asked, "repo string, sha string")).collect()}
    assert got == {k: v for k, v in want.items() if k in asked} and ("0", "c-1") in got
    left = attribution.shortened(commits, starts)
    assert (left is None) == (order == "rand(7)") and (left is None or left.count() < len(rows) / 2)


@pytest.mark.parametrize(("walked", "said"), [(1 << 17, 5), (3, 3)])
def test_every_way_of_walking_reaches_the_same(spark, monkeypatch, walked, said):
    """Repositories of several sizes, with merges, several starts at a commit, parents that aren't there and commits that nothing reaches."""
    monkeypatch.setattr(attribution, "WALKED", walked)
    monkeypatch.setattr(attribution, "SAID", said)
    rng = random.Random(4)
    parents = {(r, k): sorted({(r, rng.randrange(max(0, k - 6), k)) for _ in range(rng.choice((1, 1, 1, 2, 3)))}) if k else [("gone", r)] for r in range(3) for k in range(1 + 8 * r)}
    name = lambda c: f"c{c[1]}" if c[0] != "gone" else "gone"
    commits = spark.createDataFrame([(str(r), f"c{k}", [name(p) for p in ps]) for (r, k), ps in parents.items()], "repo string, sha string, parents array<string>")
    tips = {f"{r}/{j}": (r, max(0, 8 * r - 3 * (j // 2))) for r in range(3) for j in range(4)}
    starts = spark.createDataFrame([(n.partition("/")[0], n, name(c)) for n, c in tips.items()], "repo string, start string, sha string")
    want = {(str(c[0] if c[0] != "gone" else c[1]), name(c)): names for c, names in _search(parents, tips).items()}
    for asked in (None, [k for n, k in enumerate(sorted(want)) if n % 3 == 0] + [("0", "nowhere"), ("9", "c1")]):
        wanted = None if asked is None else spark.createDataFrame(asked, "repo string, sha string")
        got = {(r["repo"], r["sha"]): r["starts"] for r in attribution.containing(commits, starts, wanted).collect()}
        assert got == {k: v for k, v in want.items() if asked is None or k in asked}
    lost = {(r["repo"], r["sha"]) for r in attribution.orphans(commits, starts.withColumnRenamed("start", "refname")).collect()}
    assert lost == {(str(r), f"c{k}") for r, k in parents} - want.keys()


@pytest.fixture
def many(spark, monkeypatch):
    """Two hundred repositories of twelve commits with a head two before the last, a rewrite of each of the last, and the tables that are written."""
    written: list[int] = []
    real = tables.cut
    monkeypatch.setattr(tables, "cut", lambda *a: written.append(1) or real(*a))
    commits = spark.createDataFrame([(f"r{r}", f"c{r}-{k}", [f"c{r}-{k - 1}"] if k else []) for r in range(200) for k in range(12)], "repo string, sha string, parents array<string>")
    refs = spark.createDataFrame([(f"r{r}", "refs/heads/main", f"c{r}-9") for r in range(200)], "repo string, refname string, sha string")
    rewrites = spark.createDataFrame([(f"r{r}", f"c{r}-11", 1, "gone") for r in range(200)], "repo string, before string, ord int, text string")
    return commits, refs, rewrites, written


def test_refs_of_many_repositories_take_no_rounds(many):
    commits, refs, _, written = many
    assert attribution.refs_containing(commits, refs).count() == 2000 and len(written) <= 1


def test_orphans_of_many_repositories_take_no_rounds(many):
    commits, refs, _, written = many
    assert attribution.orphans(commits, refs).count() == 400 and len(written) <= 1


def test_rewrites_of_many_repositories_take_no_rounds(many):
    commits, refs, rewrites, written = many
    got = attribution.rewrites_of(attribution.orphans(commits, refs).select("repo", "sha"), commits, rewrites)
    assert got.filter("rewrite = 'gone'").count() == 400 and len(written) <= 2


def test_rewrites_make_the_orphans_once(many):
    """The orphans' own walk isn't made again for each step that reads them."""
    commits, refs, rewrites, _ = many
    got = attribution.rewrites_of(attribution.orphans(commits, refs).select("repo", "sha"), commits, rewrites)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_many_repositories_in_parts_go_to_a_table(spark, many, monkeypatch):
    commits, refs, _, written = many
    monkeypatch.setattr(attribution, "SAID", 3)
    want = {(f"r{r}", f"c{r}-{k}"): ["refs/heads/main"] for r in range(200) for k in range(10)}
    for listed, tables_ in ((1000, 0), (7, 1)):
        monkeypatch.setattr(attribution, "LISTED", listed)
        written.clear()
        assert {(r["repo"], r["sha"]): r["refs"] for r in attribution.refs_containing(commits, refs).collect()} == want
        assert len(written) == tables_


@pytest.mark.parametrize("name", ["rewritten_commits", "reachability", "orphan_commits"])
def test_a_history_is_ordered_once(spark, name):
    """What is read of the ordered history is a written table, so no step orders it again."""
    assert "Window" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("walked", "said"), [(1 << 17, 1 << 24), (1 << 17, 5), (3, 3)])
def test_refs_that_stand_in_commits_reach_the_same(spark, monkeypatch, walked, said):
    """Names of refs in a column of the commits; none, one or two at a commit, and a repository without any."""
    monkeypatch.setattr(attribution, "WALKED", walked)
    monkeypatch.setattr(attribution, "SAID", said)
    parents = {(r, k): [(r, p) for p in ([k - 1] if k else []) + ([k - 3] if k % 5 == 4 else [])] for r in range(3) for k in range(2 + 9 * r)}
    heads = {f"{r}/{n}{k}": (r, k) for r, k in parents if r for n in "ab" if k % (4 if n == "a" else 8) == 3}
    names = {c: [n for n, at in heads.items() if at == c] or ([] if c[1] % 2 else None) for c in parents}
    commits = spark.createDataFrame([(str(r), f"c{k}", [f"c{p}" for _, p in ps], names[r, k]) for (r, k), ps in parents.items()], "repo string, sha string, parents array<string>, starts array<string>")
    got = {(r["repo"], r["sha"]): r["refs"] for r in attribution.refs_containing(commits, None).collect()}
    want = {(str(r), f"c{k}"): v for (r, k), v in _search(parents, heads).items()}
    assert got == want
    wanted = spark.createDataFrame([(str(r), f"c{k}") for r, k in parents if k % 3 == 0], "repo string, sha string")
    got = {(r["repo"], r["sha"]): r["refs"] for r in attribution.refs_containing(commits, None, wanted).collect()}
    assert got == {k: v for k, v in want.items() if int(k[1][1:]) % 3 == 0}


def test_refs_of_the_history_take_no_rows_of_their_own(spark):
    """One branch reads the ordered history: the refs are in its commits' rows."""
    assert "Union" not in queries.QUERIES["reachability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("walked", "said"), [(1 << 17, 1 << 24), (1 << 17, 2), (3, 3)])
def test_the_walk_leaves_what_nothing_reaches(spark, monkeypatch, walked, said):
    """Also in a repository without refs, with parents that aren't there, and where commits name each other as parents."""
    monkeypatch.setattr(attribution, "WALKED", walked)
    monkeypatch.setattr(attribution, "SAID", said)
    rows = [("a", f"c{k}", [f"c{k - 1}"] if k else ["gone"], ["x", "y"] if k == 5 else ["z"] if k == 2 else None) for k in range(9)]
    rows += [("b", "c0", [], None), ("b", "c1", ["c0", "gone"], []), ("d", "c0", ["c1"], None), ("d", "c1", ["c0"], None), ("d", "c2", [], ["x"])]
    commits = spark.createDataFrame(rows[:11] if walked == 3 else rows, "repo string, sha string, parents array<string>, starts array<string>")
    want = [("a", "c6"), ("a", "c7"), ("a", "c8"), ("b", "c0"), ("b", "c1")] + ([] if walked == 3 else [("d", "c0"), ("d", "c1")])
    refs = commits.select("repo", F.explode("starts").alias("refname"), "sha")
    for at in (None, refs):
        assert sorted(map(tuple, attribution.unreached(commits, at).collect())) == want
        assert sorted((r["repo"], r["sha"]) for r in attribution.orphans(commits, at).collect()) == want


def test_orphans_of_the_history_are_not_joined(spark):
    """The walk tells which commits nothing reaches; commits aren't shuffled again to be joined with the others."""
    assert "Join" not in queries.QUERIES["orphan_commits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_contents_are_searched_once_for_what_is_in_secrets(spark):
    text = "---\nkind: Secret\nmetadata: {namespace: n, name: s}\ndata:\n  a: " + base64.b64encode(("npm_" + body(36)).encode()).decode() + "\n"
    got = documents.rescanned(detectors.hits(spark.createDataFrame([(1, text.encode())], "object_key long, content binary"), formats=documents.FORMATS))
    assert "mapinarrow" not in got._jdf.queryExecution().toString().lower()
    assert [r["attribution"] for r in got.filter("provider = 'npm'").collect()] == ["in Secret n/s, key a"]


def test_the_job_makes_no_step_again(spark, monkeypatch):
    """Steps that read their input several times read written tables: the plan of the tokens has few shuffles."""
    plans = []
    real = tables.cut
    monkeypatch.setattr(scan, "cut", lambda df, *done: plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or real(df, *done))
    text = '{"auths": {"ghcr.io": {"username": "u", "password": "npm_' + body(36) + '"}}}'
    rows = [("t", "o", "blob", None, len(text), text.encode())]
    out = scan.run(spark.createDataFrame(rows, "target string, object_key string, object_type string, path string, size long, content binary"))
    assert {(r["kind"], "password is a npm" in r["attribution"]) for r in out.tokens.collect()} == {("ghcr-login", True), ("npm-access-token", False)}
    assert max(plans) < 40


@pytest.mark.parametrize("n", range(40))
def test_users_are_found_as_one_pattern_finds_them(n):
    rng = random.Random(n)
    parts = ["user", "USER", "username", "UserName", "-u ", "-U ", "=", ": ", '"', "a", "u", "x.y", "dckr_pat", " ", "\n", "9", "-"]
    text = "".join(rng.choice(parts) for _ in range(300)).encode()
    want = [(m.start(), m.end(), m[1].decode()) for m in nearest._USER.finditer(text) if not m[1].startswith(b"dckr_")]
    assert [(r["offset"], r["end"], r["value"]) for r in nearest.user_candidates(text)] == want


def test_completed_findings_say_what_is_known(spark):
    token, grafana = classic(), "glsa_" + body(32)
    crc = zlib.crc32(grafana.encode()).to_bytes(4, "little").hex()
    texts = [f"{token} https://gitlab.corp.example.com/x", f"{grafana}_{crc} see http://grafana.corp.example.com:3000 and https://grafana.example.org"]
    rows = [("t", str(i), "file", f"f{i}", len(t), t.encode()) for i, t in enumerate(texts)]
    out = scan.run(spark.createDataFrame(rows, "target string, object_key string, object_type string, path string, size long, content binary"))
    print_of = {r["kind"]: r["fingerprint"] for r in out.findings.collect()}
    answers = spark.createDataFrame([(print_of["github-pat"], 401, "")], "fingerprint string, http_status int, error string")
    local = spark.createDataFrame([(print_of["grafana-service-account-token"], "env"), ("other", "env")], "fingerprint string, source string")
    done = scan.completed(out, answers, local)
    got = {r["kind"]: (r["status"], r["local"], r["servers"], r["matches"], r["opaque"]) for r in done.findings.collect()}
    servers_ = ["http://grafana.corp.example.com:3000", "https://grafana.example.org"]
    assert got == {"github-pat": ("revoked", None, None, None, False), "grafana-service-account-token": ("unknown", ["env"], servers_, None, False)}
    assert [(r["fingerprint"], r["label"]) for r in done.steps.collect()] == [(print_of["grafana-service-account-token"], "local")]


def test_revocations_are_numbered_in_order(spark):
    rows = [("npm" if i % 3 else "github", "npm-access-token" if i % 3 else "github-pat", hashlib.sha256(str(i % 170).encode()).hexdigest()[:16]) for i in range(200)]
    got = verdicts.revocation_plan(spark.createDataFrame(rows, "provider string, kind string, fingerprint string"), batch=7).orderBy("provider", "request").collect()
    for provider in ("github", "npm"):
        own = [f for r in got if r["provider"] == provider for f in r["fingerprints"]]
        assert own == sorted({f for p, _, f in rows if p == provider})
        assert all(r["credentials"] == 7 for r in got if r["provider"] == provider and r["request"] < len(own) // 7)


def _s(b):
    return len(b).to_bytes(4, "big") + b


def test_keys_say_their_algorithm_state_and_comment():
    public = _s(b"ssh-rsa") + _s(b"\x01\x00\x01") + _s(b"\x00" + b"\xff" * 256)
    private = bytes(8) + _s(b"ssh-rsa") + b"".join(_s(b"x") for _ in range(6)) + _s(b"me@host") + b"\x01"
    raw = lambda cipher: b"openssh-key-v1\0" + _s(cipher) + _s(b"none") + _s(b"") + bytes([0, 0, 0, 1]) + _s(public) + _s(private)
    pem = lambda label, der: b"-----BEGIN %s-----\n%s\n-----END %s-----\n" % (label, base64.b64encode(der), label)
    said = lambda c: [(r["attribution"], r["encrypted"]) for r in documents.private_keys(c)]
    assert said(pem(b"OPENSSH PRIVATE KEY", raw(b"none"))) == [("RSA 2048, unencrypted, comment me@host", False)]
    assert said(pem(b"OPENSSH PRIVATE KEY", raw(b"aes256-ctr"))) == [("RSA 2048, encrypted", True)]
    assert said(pem(b"ENCRYPTED PRIVATE KEY", b"\x30\x00")) == [("PKCS#8, encrypted, algorithm unknown", True)]
    cosign = json.dumps({"kdf": {"name": "scrypt"}, "cipher": {"name": "nacl/secretbox"}, "ciphertext": "x"}).encode()
    assert said(pem(b"ENCRYPTED SIGSTORE PRIVATE KEY", cosign)) == [("encrypted with scrypt/nacl/secretbox, public key not derivable", True)]


def _cert(spki, until, name="me", org=(b"system:masters", b"dev"), issuer="ca"):
    der = documents._der
    rdn = lambda oid, text: der(0x31, der(0x30, oid, der(0x0C, text)))
    names = lambda cn, o: der(0x30, *(rdn(documents.ORGANIZATION, x) for x in o), rdn(documents.COMMON, cn.encode()))
    tbs = der(0x30, der(0xA0, der(0x02, b"\x02")), der(0x02, b"\x01"), der(0x30), names(issuer, ()), der(0x30, der(0x17, b"200101000000Z"), der(0x17, until)), names(name, org), spki)
    return der(0x30, tbs, der(0x30), der(0x03, b"\0"))


def test_client_certificates_need_their_key_and_say_until_when(spark):
    der = documents._der
    key = der(0x30, *(der(0x02, bytes([k])) for k in (0, 55, 3, 27, 5, 11, 3, 7, 1)))
    other = der(0x30, *(der(0x02, bytes([k])) for k in (0, 57, 3, 27, 5, 11, 3, 7, 1)))
    cert = _cert(documents.spki_of("RSA PRIVATE KEY", key), b"250601000000Z")
    pem = lambda label, raw: b64(f"-----BEGIN {label}-----\n{base64.b64encode(raw).decode()}\n-----END {label}-----\n")
    config = lambda k: f"kind: Config\nclusters: [{{name: c, cluster: {{server: 'https://h:6443'}}}}]\ncontexts: [{{context: {{cluster: c, user: u}}}}]\nusers:\n- name: u\n  user:\n    client-certificate-data: {pem('CERTIFICATE', cert)}\n    client-key-data: {pem('RSA PRIVATE KEY', k)}\n"
    for now, word in (("2025-01-01", "expires"), ("2026-01-01", "expired")):
        clock = F.lit(now).cast("timestamp")
        hits = detectors.hits(objects(spark, config(key), config(other)), (), documents.FORMATS, now=clock).filter("cls = 'token' and provider = 'kubernetes'")
        got = [(r["object_key"], r["value"], r["attribution"], r["checksum_verified"]) for r in hits.collect()]
        assert got == [(0, hashlib.sha256(cert).hexdigest(), f"CN=me groups=system:masters,dev issuer ca, server https://h:6443, {word} 2025-06-01", True)]
    said = [r["d"] for r in hits.select(verdicts.expired(F.col("kind"), F.col("expires"), clock).alias("d")).collect()]
    assert said == ["expired on 2025-06-01; no API server accepts an expired certificate"]
    assert sightings.certificate(cert, datetime(2026, 1, 1, tzinfo=UTC))[1] == "certificate for me, expired 2025-06-01, issuer ca"


def test_signed_tokens_say_until_when_and_for_which_pod(spark):
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = lambda **c: f"{part({'alg': 'RS256'})}.{part({'sub': 'system:serviceaccount:ns:sa'} | c)}.{body(43)}"
    pod = {"kubernetes.io": {"pod": {"name": "p-1"}}}
    hits = detectors.hits(objects(spark, token(exp=1748736000), token(exp=1748736000.5, **pod), token(), token(exp="x")), now=F.lit("2025-05-01").cast("timestamp"))
    got = {r["object_key"]: (r["attribution"], r["expires"]) for r in hits.collect()}
    assert got == {0: ("serviceaccount ns/sa, expires 2025-06-01", 1748736000), 1: ("serviceaccount ns/sa, bound to pod p-1, expires 2025-06-01", 1748736000), 2: ("serviceaccount ns/sa, no expiry (legacy token)", None), 3: ("serviceaccount ns/sa, no expiry (legacy token)", None)}


def test_filters_are_pushed_into_the_listing(spark, tmp_path):
    for name, text in (("a.env", "x"), ("b.txt", "y" * 50), (".c.env", "z")):
        (tmp_path / name).write_text(text)
    reader = trees.PushedTreeReader({"path": str(tmp_path)})
    other = LessThanOrEqual(("content",), b"x")
    assert list(reader.pushFilters([LessThanOrEqual(("size",), 10), StringEndsWith(("path",), ".env"), In(("object_type",), ("blob", "file")), other])) == [other]
    assert sorted(i[1] for p in reader.partitions() for i in p.items) == [".c.env", "a.env"]
    trees.register(spark)
    load = lambda: spark.read.format("filetree").option("path", str(tmp_path)).load()
    objects = load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small = spark.read.format("filetree").option("path", str(tmp_path)).option("pushdown", "true").load().filter("size <= 10 and object_type in ('file', 'blob') and path like '%.env' and content is not null")
    assert sorted(r["path"] for r in small.collect()) == [".c.env", "a.env"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r["path"] for r in objects.filter("size <= 10 and object_type in ('file', 'blob') and path like '%.env'").collect()) == [".c.env", "a.env"]
    listing = spark.read.format("filetree").option("path", str(tmp_path)).option("contents", "false").load()
    assert listing.filter("content is null and not skipped").count() == 3
    assert [r["bytes"] for r in scan.run(objects, listing=listing).results.collect()] == [52]
    assert [r["object_key"] for r in trees.missing(spark.createDataFrame([("a.env",), ("gone",)], "object_key string"), listing).collect()] == ["gone"]


def test_activity_pages_give_rewrites_in_order(spark, tmp_path):
    row = lambda kind, before, after, login="me": {"activity_type": kind, "before": before, "after": after, "ref": "refs/heads/x", "timestamp": "2024-05-06T07:08:09Z", "actor": {"login": login}}
    pages = [[row("push", "c1", "c2"), row("force_push", "c3", "c4")], [row("branch_deletion", "c5", "0" * 40), row("force_push", "0" * 40, "c6"), row("force_push", "", "c7"), row("force_push", "c3", "c8", None)]]
    for i, page in enumerate(pages):
        (tmp_path / f"{i:03}.json").write_text(json.dumps(page))
    (tmp_path / "009.json").write_text("[]")
    rows = trees.activity(spark, str(tmp_path), "r").orderBy("ord").collect()
    assert [(r["before"], r["after"], r["text"]) for r in rows] == [("c3", "c4", "force-pushed over by me on 2024-05-06"), ("c5", "", "branch deleted by me on 2024-05-06"), ("c3", "c8", "force-pushed over on 2024-05-06")]
    commits = spark.createDataFrame([("r", "c3", ["c2"]), ("r", "c5", ["c2"]), ("r", "c2", [])], "repo string, sha string, parents array<string>")
    lost = spark.createDataFrame([("r", "c2"), ("r", "c5")], "repo string, sha string")
    got = {r["sha"]: r["rewrite"] for r in attribution.rewrites_of(lost, commits, trees.activity(spark, str(tmp_path), "r")).collect()}
    assert got == {"c2": "force-pushed over by me on 2024-05-06", "c5": "branch deleted by me on 2024-05-06"}


def test_the_report_is_one_document(spark, tmp_path):
    results = spark.createDataFrame([("t2", False, None, False, 3, 30), ("t1", False, None, False, 1, 10), ("t3", True, "gone", False, 0, 0)], "target string, files boolean, error string, skipped boolean, objects long, bytes long")
    found = spark.createDataFrame([(f"t{1 + i % 2}", f"f{i:02}", "npm-access-token" if i % 3 else "github-pat", ["active", "revoked", None][i % 3], "v", 'say "x"') for i in range(20)], "target string, fingerprint string, kind string, status string, value string, attribution string")
    scan.write_document(scan.document(results, found), str(tmp_path / "out"), 5)
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert [t["target"] for t in doc["results"]] == ["t1", "t2", "t3"] and doc["summary"]["findings"] == 20 and doc["summary"]["failed"] == 1
    for t in doc["results"]:
        want = [r["fingerprint"] for r in findings.ordered(found.filter(F.col("target") == t["target"])).collect()]
        assert [f["fingerprint"] for f in t["findings"]] == want and all("value" not in f for f in t["findings"])
