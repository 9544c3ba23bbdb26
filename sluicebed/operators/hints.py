"""Which key of an administrator's list a leaked value is, from the shortened values (hints) that the list shows.

A hint is a head, an ellipsis and a tail. Hints become keys by the lengths of both; a value is looked up once for each pair of
lengths that hints have, so what is joined are equal keys and no pairs of all values and all hints. Ends longer than AFFIX are
looked up by their outer AFFIX characters and compared whole after the join; so there are few pairs of lengths at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

AFFIX = 16
#: What a lookup says.
NONE, SEVERAL = "not in this organization: no key hint matches it", "matches the hints of {} keys in this organization"


def _ends(hint: Column) -> Column:
    """Head and tail of a hint; null if it has no ellipsis, or nothing after it."""
    whole = F.regexp_replace(hint, r"\.\.\.", "…")
    head, tail = F.substring_index(whole, "…", 1), F.substring_index(whole, "…", -1)
    return F.when(whole.contains("…") & (tail != ""), F.struct(head.alias("head"), tail.alias("tail")))


def candidates(values: DataFrame, inventory: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Values with each key whose hint can be of them. values: fingerprint, value and scope; inventory: key_id, hint and scope (columns that must be equal, such as the provider)."""
    shown = inventory.withColumn("_e", _ends(F.col("hint"))).filter(F.col("_e").isNotNull())
    shown = shown.select(*scope, "key_id", "hint", F.least(F.length("_e.head"), F.lit(AFFIX)).alias("_h"), F.least(F.length("_e.tail"), F.lit(AFFIX)).alias("_t"), F.left("_e.head", F.lit(AFFIX)).alias("_head"), F.right("_e.tail", F.lit(AFFIX)).alias("_tail"))
    lengths = [(r["_h"], r["_t"]) for r in shown.select("_h", "_t").distinct().collect()]  # at most (AFFIX + 1) * AFFIX
    if not lengths:
        return values.select(*scope, "fingerprint", F.lit(None).cast(inventory.schema["key_id"].dataType).alias("key_id")).filter("false")
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("_h"), F.lit(t).alias("_t")) for h, t in lengths)))
    asked = values.select(*scope, "fingerprint", "value").distinct().select("*", each.alias("_l")).select(*scope, "fingerprint", "value", "_l.*")
    asked = asked.withColumns({"_head": F.substring(F.col("value"), F.lit(1), F.col("_h")), "_tail": F.expr("right(value, _t)")})
    met = asked.join(shown, [*scope, "_h", "_t", "_head", "_tail"])
    return met.filter(V.hint_matches(F.col("hint"), F.col("value"))).select(*scope, "fingerprint", "key_id").distinct()


def matched(values: DataFrame, inventory: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, fingerprint, matches, key_id and said of each value: the key if exactly one hint fits; else none, and why."""
    found = candidates(values, inventory, scope).groupBy(*scope, "fingerprint").agg(F.count("*").alias("matches"), F.min("key_id").alias("_key"))
    out = values.select(*scope, "fingerprint").distinct().join(found, [*scope, "fingerprint"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    before, after = SEVERAL.split("{}")
    said = F.when(F.col("matches") == 0, NONE).when(F.col("matches") > 1, F.concat(F.lit(before), F.col("matches").cast("string"), F.lit(after)))
    return out.select(*scope, "fingerprint", "matches", F.when(F.col("matches") == 1, F.col("_key")).alias("key_id"), said.alias("said"))


def account_tokens(values: DataFrame, listed: DataFrame, now: Column, recent: str = "5 minutes") -> DataFrame:
    """fingerprint, key_id and how (listed, active, recent, none) of each value, from the tokens that its account lists without their values.

    The first listed token whose shortened value fits, or that the value's own claim (token_id) names; else the only active one;
    else the only active one used within `recent` before now; else none. values: fingerprint, value, account, token_id; listed:
    account, ord, key_id, token, active, last_used. An account's list is short.
    """
    met = values.select("fingerprint", "value", "account", "token_id").distinct().join(listed, "account", "left")
    shown = F.coalesce("token", F.lit(""))
    fits = (shown != "") & ((shown == F.col("value")) | V.hint_matches(shown, F.col("value"))) | (F.col("key_id") == F.col("token_id"))
    live, late = F.coalesce("active", F.lit(False)), F.coalesce(now - F.col("last_used") < F.expr(f"INTERVAL {recent}"), F.lit(False))
    sums = met.groupBy("fingerprint").agg(
        F.min_by("key_id", F.when(fits, F.col("ord"))).alias("own"),
        F.count_if(live).alias("n_live"),
        F.min(F.when(live, F.col("key_id"))).alias("live"),
        F.count_if(live & late).alias("n_late"),
        F.min(F.when(live & late, F.col("key_id"))).alias("late"),
    )
    how = F.when(F.col("own").isNotNull(), "listed").when(F.col("n_live") == 1, "active").when(F.col("n_late") == 1, "recent").otherwise("none")
    return sums.select("fingerprint", F.when(how == "listed", F.col("own")).when(how == "active", F.col("live")).when(how == "recent", F.col("late")).alias("key_id"), how.alias("how"))
