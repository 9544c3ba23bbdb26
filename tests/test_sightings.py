"""Public halves in content, and the keys that they belong to."""

from __future__ import annotations

import base64
import hashlib
from datetime import UTC, datetime

from sluicebed.operators import sightings
from sluicebed.operators.documents import BECH32, RSA_ID, _bech32_sum, _der, private_keys
from sluicebed.plans import scan

NOW = datetime(2026, 1, 1, tzinfo=UTC)
MODULUS = int.from_bytes(hashlib.sha512(b"modulus").digest() * 2, "big") | 1 << 1023


def number(n: int) -> bytes:
    return _der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


SPKI = _der(0x30, _der(0x30, RSA_ID, b"\x05\x00"), _der(3, b"\0", _der(0x30, number(MODULUS), number(65537))))
PRIVATE = _der(0x30, number(0), number(MODULUS), number(65537), *(number(7) for _ in range(6)))


def pem(label: str, der: bytes, newline: str = "\n") -> str:
    text = base64.b64encode(der).decode()
    return newline.join([f"-----BEGIN {label}-----", *(text[i : i + 64] for i in range(0, len(text), 64)), f"-----END {label}-----", ""])


def name(common: str) -> bytes:
    return _der(0x30, _der(0x31, _der(0x30, bytes.fromhex("0603550403"), _der(0x0C, common.encode()))))


def cert(issuer: str, subject: str, until: str, names: list[tuple[int, bytes]] = (), authority: bool = False) -> bytes:
    more = [_der(0x30, bytes.fromhex("0603551d13"), _der(4, _der(0x30, b"\x01\x01\xff")))] if authority else []
    more += [_der(0x30, bytes.fromhex("0603551d11"), _der(4, _der(0x30, *(_der(t, v) for t, v in names))))] if names else []
    ext = [_der(0xA3, _der(0x30, *more))] if more else []
    tbs = _der(0x30, _der(0xA0, number(2)), number(5), _der(0x30, RSA_ID), name(issuer), _der(0x30, _der(0x17, b"200101000000Z"), _der(0x17, until.encode())), name(subject), SPKI, *ext)
    return _der(0x30, tbs, _der(0x30, RSA_ID), _der(3, b"\0sig"))


def ssh(kind: str, seed: bytes, says: str | None = None) -> str:
    says = kind if says is None else says
    return base64.b64encode(len(says).to_bytes(4, "big") + says.encode() + (32).to_bytes(4, "big") + hashlib.sha256(seed).digest()).decode()


def test_ssh_keys_say_their_comment_and_must_be_of_their_type():
    key = ssh("ssh-ed25519", b"a")
    want = "SHA256:" + base64.b64encode(hashlib.sha256(base64.b64decode(key)).digest()).decode().rstrip("=")
    text = f'ssh-ed25519 {key} me@here\nkey = "ssh-ed25519 {key}"\nssh-rsa {key} wrong\nxssh-ed25519 {key}\nssh-ed25519 AAAA\nssh-ed25519 {key[:-2]}!'
    got = [(r["value"], r["attribution"]) for r in sightings.ssh_public_keys(text.encode())]
    assert got == [(want, "ssh public key, comment me@here"), (want, "ssh public key")]


def test_certificates_and_public_keys_are_named_as_their_private_keys():
    own = next(private_keys(pem("RSA PRIVATE KEY", PRIVATE).encode()))["value"]
    names = [(0x82, b"a.example"), (0x82, b"b.example"), (0x87, bytes([10, 0, 0, 1])), (0x81, b"x@y.example")]
    text = pem("CERTIFICATE", cert("Root", "host", "300101000000Z", names)) + pem("CERTIFICATE", cert("Root", "Root", "250101000000Z", authority=True), "\\n") + pem("PUBLIC KEY", SPKI) + pem("CERTIFICATE", b"\x30\x03abc") + "-----BEGIN CERTIFICATE-----\n"
    got = [(r["value"], r["attribution"]) for r in sightings.pem_blocks(text.encode(), NOW)]
    assert got == [(own, "certificate for a.example, b.example, 10.0.0.1, +1 more, expires 2030-01-01, issuer Root"), (own, "CA certificate for Root, expired 2025-01-01, self-signed"), (own, "public key (RSA 1024)")]


def test_public_keys_of_an_image_policy_name_it():
    text = "apiVersion: v1\nkind: ClusterPolicy\nmetadata:\n  name: signed\nspec:\n  verifyImages:\n  - key: |\n" + "".join(f"      {x}\n" for x in pem("PUBLIC KEY", SPKI).split("\n"))
    assert [r["attribution"] for r in sightings.pem_blocks(text.encode(), NOW)] == ["public key (RSA 1024), pinned by Kyverno ClusterPolicy signed"]


def test_recipients_count_only_in_encrypted_files_and_rules():
    data = [i % 32 for i in range(52)]
    check = _bech32_sum("age", [*data, *[0] * 6]) ^ 1
    one = "age1" + "".join(BECH32[x] for x in [*data, *(check >> 5 * (5 - i) & 31 for i in range(6))])
    wrong, print_ = one[:-1] + ("q" if one[-1] != "q" else "p"), "ab" * 20
    text = f"creation_rules:\n- age: {one},{wrong},{one}\n  pgp: {print_} {print_}0"
    assert [r["value"] for r in sightings.recipients(text.encode())] == [one, print_.upper()]
    assert not list(sightings.recipients(f"age: {one}".encode()))


def test_scan_says_which_files_name_a_key(spark):
    cosign = pem("ENCRYPTED SIGSTORE PRIVATE KEY", b'{"kdf":{"name":"scrypt"},"cipher":{"name":"box"},"ciphertext":"eA=="}')
    rows = [("t", "1", "keys/tls.key", pem("RSA PRIVATE KEY", PRIVATE)), ("t", "2", "web/cert.pem", pem("CERTIFICATE", cert("Root", "host", "300101000000Z"))), ("t", "3", "sign/cosign.key", cosign), ("t", "4", "sign/cosign.pub", pem("PUBLIC KEY", SPKI)), ("u", "5", "web/cert.pem", pem("PUBLIC KEY", SPKI)), ("t", "6", None, pem("PUBLIC KEY", SPKI)), ("t", "7", "e", "")]
    objects = spark.createDataFrame([(t, k, "file", p, len(c), c.encode()) for t, k, p, c in rows] + [("t", "8", "file", "n", 0, None)], "target string, object_key string, object_type string, path string, size long, content binary")
    out = scan.run(objects)
    kinds = {r["fingerprint"]: r["kind"] for r in out.findings.collect()}
    got = sorted((kinds[r["fingerprint"]], r["target"], r["path"]) for r in out.unlocks.collect())
    assert got == sorted((k, "t", p) for k in ("tls-private-key", "cosign-private-key") for p in ("web/cert.pem", "sign/cosign.pub"))
    seen = sightings.observed(objects, keep=("target", "path"))
    published = spark.createDataFrame([("bob", r["identifier"], i) for i, r in enumerate(seen.filter("target = 'u'").collect())] + [("eve", seen.first()["identifier"], 9)], "login string, identifier string, ord int")
    said = {(kinds[r["fingerprint"]], r["matches"]) for r in sightings.committers(out.tokens, seen, published).collect()}
    assert said == {("tls-private-key", "matches bob's GitHub SSH key"), ("cosign-private-key", "matches bob's GitHub SSH key")}


def test_values_of_secrets_are_looked_at(spark):
    inner = base64.b64encode(f"ssh-ed25519 {ssh('ssh-ed25519', b'a')} deploy".encode()).decode()
    text = f"apiVersion: v1\nkind: Secret\nmetadata:\n  name: k\ndata:\n  pub: {inner}\n"
    got = sightings.observed(spark.createDataFrame([(1, text.encode()), (2, b"Secret"), (3, b"kind: Secret\ndata: [")], "object_key int, content binary")).collect()
    assert [(r["object_key"], r["detail"]) for r in got] == [(1, "ssh public key, comment deploy")]
