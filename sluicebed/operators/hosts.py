"""Server addresses that content names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public top-level domains that are looked for unless others are given; the two-letter ones are matched by shape.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "cat", "tel", "asia", "post", "dev", "app", "cloud", "io", "ai", "tech", "site", "online", "store", "xyz", "blog", "page", "wiki", "systems", "network", "digital", "agency", "company", "software", "solutions", "services", "host", "hosting", "email", "link", "live", "news", "space", "team", "tools", "world", "zone")
#: Two-letter endings of files that are no domains in practice.
FILES = ("go", "js", "ts", "rb", "py")


def origins(text: Column, needle: str, vendors: tuple[str, ...] = (), endings: tuple[str, ...] = ()) -> Column:
    """Distinct scheme://host[:port] whose host has the needle at the start of a label, lower-cased, in order; hosts of the vendors are left out.

    The scheme is https unless http is written. A host has two labels or more, none empty or edged by a dash, and a public ending: one of those given, else of TOP_LEVEL or of two letters.
    """
    found = F.regexp_extract_all(text, F.lit(r"((?:[a-z][a-z0-9+.-]*://)?(?<![A-Za-z0-9.-])[A-Za-z0-9.-]*" + needle.replace(".", r"\.") + r"[A-Za-z0-9.-]*(?::\d{1,6}(?![A-Za-z0-9]))?)"), F.lit(1))
    host = lambda x: F.lower(F.regexp_extract(x, r"^(?:[a-z][a-z0-9+.-]*://)?([A-Za-z0-9.-]+)", 1))
    label = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    public = "|".join(endings) or rf"{'|'.join(TOP_LEVEL)}|(?!(?:{'|'.join(FILES)})\z)[a-z]{{2}}"
    good = lambda h: h.rlike(rf"^(?:{label}\.)+(?:{public})\z") & h.rlike(r"(?:^|\.)" + needle.replace(".", r"\."))
    own = lambda h: h.rlike(r"(?:^|\.)(?:" + "|".join(v.replace(".", r"\.") for v in vendors) + r")\z") if vendors else F.lit(False)
    made = F.transform(found, lambda x: F.struct(host(x).alias("h"), F.when(x.startswith("http://"), "http").otherwise("https").alias("s"), F.regexp_extract(x, r"(:\d+)\z", 1).alias("p")))
    return F.array_distinct(F.transform(F.filter(made, lambda x: good(x["h"]) & ~own(x["h"])), lambda x: F.concat(x["s"], F.lit("://"), x["h"], x["p"])))


#: Where the makers of self-hosted servers have their own sites.
VENDORS = {"gitlab": ("gitlab.com", "gitlab.io", "gitlab.net", "github.io"), "grafana": ("grafana.com", "grafana.net", "grafana.org", "github.io")}


def instances(text: Column, provider: str) -> Column:
    """Self-hosted servers of a provider that content names."""
    return origins(text, f"{provider}.", VENDORS[provider])
