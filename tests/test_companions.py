from pyspark.sql import functions as F

from sluicebed.operators import detectors, findings, local, nearest

from .test_engine import body, classic


def test_registry_users(spark):
    token = "dckr_pat_" + body(27)
    contents = [f"username: me\npassword: {token}", f"docker login -u you -p {token}", f"user=far{' ' * 600}{token}", f"superuser: x {token}", f"user: one {token} username: two"]
    objects = spark.createDataFrame([(i, c.encode()) for i, c in enumerate(contents)], "object_key long, content binary")
    got = {r["object_key"]: r["secret"] for r in nearest.registry_users(detectors.hits(objects, companions=nearest.COMPANIONS)).collect()}
    assert got == {0: "me", 1: "you", 2: None, 3: None, 4: "two"}


def test_settings_are_matched_by_span(spark):
    rows = [(0, "env", "A", "é"), (1, "env", "TOKEN", classic("l")), (2, "env", "OTHER", None), (3, "~/.rc", "AGAIN", classic("l"))]
    own = local.configured(spark.createDataFrame(rows, "ord int, label string, name string, value string"))
    assert sorted(r["source"] for r in own.collect()) == ["env TOKEN", "~/.rc AGAIN"]
    found = own.select("fingerprint").distinct().withColumn("kind", F.lit("github-pat"))
    assert findings.with_local(found, own).first()["local"] == ["env TOKEN", "~/.rc AGAIN"]
