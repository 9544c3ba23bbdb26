"""Passwords that are another provider's credential.

The passwords of logins are a column of values, not contents: the distinct ones go through the detectors once more, a value being
one small object, and a peer is a match of the whole value. Providers come in the order of detectors.PROVIDERS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detectors, names

#: What a login's attribution says of a peer, before and after its kind's name.
SAID = (", password is a ", ", reported separately")


def peers(values: DataFrame, column: str, shapes: tuple[detectors.Shape, ...] = detectors.SHAPES) -> DataFrame:
    """The values that are credentials as a whole: value, provider, kind, checksum_verified, attribution; the first kind of the first provider."""
    own = values.filter(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("object_key")).distinct()
    found = detectors.hits(own.withColumn("content", F.encode("object_key", "utf-8")), shapes)
    whole = found.filter((F.col("cls") == "token") & (F.col("offset") == 0) & (F.col("value") == F.col("object_key")))
    order = F.array_position(F.array(*map(F.lit, detectors.PROVIDERS)), F.col("provider"))
    first = whole.groupBy("object_key").agg(F.min_by(F.struct("provider", "kind", "checksum_verified", "attribution"), F.struct(order, "shape", "kind")).alias("p"))
    return first.select(F.col("object_key").alias("value"), "p.*")


def with_peers(tokens: DataFrame) -> DataFrame:
    """Tokens whose logins say what their password is; where it came out of base64, so that no detector has read it, the peer is a token too, at the login's place.

    tokens: the columns of detectors.hits.
    """
    from ..sources.tables import cut

    is_login = F.coalesce((F.col("provider") == "oci") & F.col("kind").endswith("-login"), F.lit(False))
    others = tuple(s for s in detectors.SHAPES if s.provider != "oci")
    known = cut(peers(tokens.filter(is_login), "secret", others))
    known = known.select(F.col("value").alias("_password"), F.struct("provider", "kind", "checksum_verified", "attribution").alias("_peer"))
    both = tokens.join(known, is_login & (F.col("secret") == F.col("_password")), "left")
    called = F.create_map(*(F.lit(x) for s in {(s.provider, s.kind): s for s in others}.values() for x in (s.kind, names.called(s.provider, s.kind))))
    name = called[F.col("_peer.kind")]
    said = F.concat("attribution", F.lit(SAID[0]), name, F.lit(SAID[1]))
    logins = both.withColumn("attribution", F.when(F.col("_peer").isNotNull(), said).otherwise(F.col("attribution")))
    extra = both.filter(F.col("_peer").isNotNull() & F.coalesce("encoded", F.lit(False)))
    extra = extra.withColumns({"value": F.col("_password"), "secret": F.lit(None).cast("string"), "provider": F.col("_peer.provider"), "kind": F.col("_peer.kind"), "checksum_verified": F.col("_peer.checksum_verified"), "attribution": F.col("_peer.attribution")})
    return logins.select(*tokens.columns).unionByName(extra.select(*tokens.columns))
