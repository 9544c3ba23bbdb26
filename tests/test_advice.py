"""Steps after a finding."""

from __future__ import annotations

from sluicebed.plans import advice


def test_unlocks_name_the_first_files_and_count_the_rest(spark):
    rows = [("b", "f", f"p{i}", "") for i in range(5)] + [("a", "f", "x", "certificate for y"), ("a", "g", "z", None)] + [(f"t{i}", "h", "q", "") for i in range(4)]
    unlocks = spark.createDataFrame(rows, "target string, fingerprint string, path string, detail string")
    got = {r["fingerprint"]: r["text"] for r in advice.unlocks_text(unlocks, targets=3).collect()}
    assert got == {"f": "a: 1 file (x: certificate for y) · b: 5 files (p0, p1, p2, +2 more)", "g": "a: 1 file (z)", "h": "t0: 1 file (q) · t1: 1 file (q) · t2: 1 file (q) · +1 more"}
    assert advice.unlocks_text(unlocks.limit(0)).count() == 0


def test_steps_follow_the_state(spark):
    kinds = spark.createDataFrame([("k", "Maker", "https://m/keys", True, "ask", "see log", "opens", "nothing found"), ("n", None, "", False, "cannot", None, None, None)], "kind string, provider_name string, revoke_page string, revocable boolean, revoke_note string, audit_note string, unlocks_label string, unlocks_none string")
    found = spark.createDataFrame(
        [("live", "k", "active", "App", False, None, ["env"]), ("dead", "k", "revoked", None, False, None, ["env"]), ("asked", "k", "active", None, False, "pending", None), ("gone", "k", "revoked", None, False, "done", None), ("dark", "k", None, None, True, None, []), ("new", "k", None, None, False, None, None), ("note", "n", None, None, None, None, None), ("odd", "unknown", None, None, None, None, None)],
        "fingerprint string, kind string, status string, app string, opaque boolean, revocation string, local array<string>",
    )
    unlocks = spark.createDataFrame([("t", "live", "p", "")], "target string, fingerprint string, path string, detail string")
    got: dict[str, list] = {}
    for r in advice.steps(found, kinds, unlocks).orderBy("fingerprint", "ord").collect():
        got.setdefault(r["fingerprint"], []).append((r["label"], r["text"]))
    none, audit = ("opens", "nothing found"), ("audit", "see log")
    assert got == {
        "live": [("opens", "t: 1 file (p)"), ("revoke", "at https://m/keys under App; or run again with --revoke"), ("local", "still configured in env; replace it there after revoking"), audit],
        "dead": [none, audit],
        "asked": [none, ("revoke", "Maker" + advice.PENDING), audit],
        "gone": [none, ("revoke", "done, Maker rejects it now"), audit],
        "dark": [none, ("revoke", "if it is still valid, at https://m/keys; ask"), audit],
        "new": [none, ("revoke", "if it is still valid, at https://m/keys; or with --verify --revoke"), audit],
        "note": [("revoke", "cannot")],
    }


def test_status_line_says_what_was_read(spark):
    ddl = "target string, files boolean, skipped boolean, error string, scanned long, bytes long, duration string, refs long, orphaned long, rewrites long, skipped_large long, findings long"
    rows = [("a", False, False, None, 1, 5, "2ms", 3, 0, 0, 2, 1), ("b", True, False, None, 2, 5, None, None, None, None, 1, 0), ("c", False, True, "empty", 0, 0, None, 0, 0, 0, 0, 0), ("d", None, None, "gone", None, None, None, None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, ddl).select(advice.status_line()).collect()]
    assert got[0].split() == "! a 1 object · 5 B · 2ms · 3 refs · 2 large objects skipped · 1 credential".split()
    assert got[1].split() == "✔ b 2 files · 5 B · 1 large file skipped".split()
    assert got[2] == f"– {'c':32} skipped: empty" and got[3] == f"✘ {'d':32} failed: gone"
