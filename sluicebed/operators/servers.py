"""Which servers may be asked: the policy for private networks, and public endings of host names.

Addresses become 16 bytes (IPv4 mapped into IPv6), and networks rows of (prefix, bits). A longest-prefix lookup joins on equal
prefixes, once for each length that the table has; a longest-suffix lookup of a host's ending joins on equal suffixes, one for
each label. Both tables are inputs; what is joined are keys, never ranges or pairs. Nothing is asked here: what names resolve
to are recorded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

#: Networks that aren't public: private, loopback, link-local (and its multicast) and unspecified.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "127.0.0.0/8", "::1/128", "169.254.0.0/16", "fe80::/10", "224.0.0.0/24", "ff02::/16", "0.0.0.0/32", "::/128")
#: Why a server isn't asked, before and after its name.
SAID = {"parse": ("server URL ", " does not parse"), "scheme": ("server ", " is not https, not checked"), "private": ("server ", " is on a private network, not checked; pass --verify-private-servers to check it"), "lookup": ("", " not reachable from here: ")}


def ip_hex(text: Column) -> Column:
    """An address as 32 hex digits, IPv4 as ::ffff:a.b.c.d; null if it is none."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"^{octet}(?:\.{octet}){{3}}\z"
    quad = lambda a: F.concat(*(F.lpad(F.lower(F.hex(F.split_part(a, F.lit("."), F.lit(i)).cast("int"))), 2, "0") for i in range(1, 5)))
    # a dotted tail is two groups
    tail = F.regexp_extract(text, r"([0-9.]+)\z", 1)
    dotted = text.contains(":") & tail.rlike(v4) & tail.contains(".")
    plain = F.when(dotted, F.concat(F.left(text, F.length(text) - F.length(tail)), F.left(quad(tail), F.lit(4)), F.lit(":"), F.right(quad(tail), F.lit(4)))).otherwise(text)
    halves = F.split(plain, "::", -1)
    groups = lambda h: F.filter(F.split(h, ":", -1), lambda g: g != "")
    head, rest = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(head) - F.size(rest)
    every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), rest)
    shaped = plain.rlike(r"(?i)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?\z") & plain.contains(":")
    good = shaped & F.when(F.size(halves) == 1, gap == 0).otherwise((F.size(halves) == 2) & (gap >= 1))
    v6 = F.lower(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(text.rlike(v4), F.concat(F.lit("0" * 20 + "ffff"), quad(text))).when(F.coalesce(good, F.lit(False)), v6)


def _bits(hexes: Column) -> Column:
    """Hex digits as binary ones."""
    return F.array_join(F.transform(F.split(hexes, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def networks(spark: SparkSession, cidrs: tuple[str, ...] = PRIVATE) -> DataFrame:
    """cidr, bits and prefix (of binary digits) of networks."""
    rows = spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    address, size = F.split_part("cidr", F.lit("/"), F.lit(1)), F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    bits = size + F.when(address.contains(":"), 0).otherwise(96)
    return rows.select("cidr", bits.alias("bits"), F.substring(_bits(ip_hex(address)), F.lit(1), bits).alias("prefix"))


def longest_prefix(addresses: DataFrame, column: str, nets: DataFrame) -> DataFrame:
    """addresses with the cidr of the longest network that holds them, null if none does or it is no address. nets: cidr, bits, prefix."""
    lengths = [r["bits"] for r in nets.select("bits").distinct().collect()]  # at most 129
    own = addresses.select(F.col(column).alias("_a")).distinct().withColumn("_b", _bits(ip_hex(F.col("_a")))).filter(F.col("_b").isNotNull())
    keys = own.select("_a", "_b", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("bits")).select("_a", "bits", F.substring(F.col("_b"), F.lit(1), F.col("bits")).alias("prefix"))
    best = keys.join(nets, ["bits", "prefix"]).groupBy("_a").agg(F.max_by("cidr", "bits").alias("cidr"))
    return addresses.join(best, F.col(column) == F.col("_a"), "left").drop("_a")


def admitted(servers: DataFrame, lookups: DataFrame, nets: DataFrame, allow_private: bool = False) -> DataFrame:
    """server, admitted and detail of each distinct server: https only, and every address that its host has must be public.

    servers: server (an address with its scheme); lookups: host, ip (null if it has none), error. A host that is an address is
    its own answer; one without a recorded answer isn't reachable.
    """
    s = servers.select("server").distinct()
    scheme = F.lower(F.regexp_extract("server", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_extract("server", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?(?:[/?#].*)?\z", 1)
    s = s.withColumns({"_host": F.regexp_replace(place, r"^\[|\]\z", ""), "_scheme": scheme})
    said = lambda k, c: F.concat(F.lit(SAID[k][0]), c, F.lit(SAID[k][1]))
    none = F.lit(None).cast("string")
    if not allow_private:
        literal = s.filter(ip_hex(F.col("_host")).isNotNull()).select("_host", F.col("_host").alias("ip"), none.alias("error")).distinct()
        named = s.filter(ip_hex(F.col("_host")).isNull()).select("_host").distinct().join(lookups.select(F.col("host").alias("_host"), "ip", "error"), "_host")
        held = longest_prefix(literal.unionByName(named), "ip", nets)
        answers = held.groupBy("_host").agg(F.bool_or(F.col("cidr").isNotNull()).alias("_private"), F.count("ip").alias("_n"), F.min("error").alias("_error"))
        s = s.join(answers, "_host", "left")
    else:
        s = s.withColumns({"_private": F.lit(False), "_n": F.lit(1), "_error": none})
    why = F.when(F.col("_host") == "", said("parse", F.col("server"))).when(F.col("_scheme") != "https", said("scheme", F.col("server"))).when(F.col("_private"), said("private", F.col("_host"))).when(F.coalesce("_n", F.lit(0)) == 0, F.concat(said("lookup", F.col("_host")), F.coalesce("_error", F.lit("no such host"))))
    return s.select("server", why.isNull().alias("admitted"), why.alias("detail"))


def ending_rules(spark: SparkSession, lines: list[str]) -> DataFrame:
    """rule and how (plain, wildcard, exception) from the lines of a list of public endings; comments and empty lines say nothing."""
    rows = [(x.split()[0].lower().lstrip("!").removeprefix("*."), "exception" if x.startswith("!") else "wildcard" if x.startswith("*.") else "plain") for x in map(str.strip, lines) if x and not x.startswith("//")]
    return spark.createDataFrame(rows, "rule string, how string")


def public_endings(hosts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Hosts with their public ending and their registrable name (one label more; null if there is none).

    The rule with the most labels holds; a wildcard stands for one label more, an exception for one less and before all others;
    without a rule the last label is the ending. A host of n labels is looked up n times, by equal suffixes.
    """
    own = hosts.select(F.col(column).alias("_host")).distinct()
    labels = F.split(F.lower(F.regexp_replace("_host", r"\.\z", "")), r"\.")
    own = own.withColumns({"_l": labels, "_n": F.size(labels)})
    keys = own.select("_host", "_n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.array_join(F.slice("_l", i, F.col("_n")), "."))).alias("_i", "rule"))
    size = F.col("_n") - F.col("_i")  # labels of the suffix
    met = keys.join(rules, "rule").withColumn("_size", F.when(F.col("how") == "exception", size - 1).when(F.col("how") == "wildcard", size + 1).otherwise(size)).filter(F.col("_size") <= F.col("_n"))
    best = met.groupBy("_host").agg(F.coalesce(F.max(F.when(F.col("how") == "exception", F.col("_size"))), F.max("_size")).alias("_size"))
    done = own.join(best, "_host", "left").withColumn("_size", F.coalesce("_size", F.lit(1)))
    tail = lambda n: F.array_join(F.slice("_l", F.greatest(F.col("_n") - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), ".")
    done = done.select("_host", tail(F.col("_size")).alias("ending"), F.when(F.col("_n") > F.col("_size"), tail(F.col("_size") + 1)).alias("registrable"))
    return hosts.join(done, F.col(column) == F.col("_host"), "left").drop("_host")


def https_origins(text: Column) -> Column:
    """Scheme and host of an address."""
    return F.concat(F.regexp_extract(text, r"^([a-z]+://)", 1), V.host_of(text))
