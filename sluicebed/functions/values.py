"""Scalar functions over credential values. Text arguments are byte views: one character a byte (see bytes_view)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and beginnings that stand where a secret goes later.
PLACEHOLDER_WORDS = ("replaceme", "changeme", "changeit", "placeholder", "todo", "tbd", "fixme", "dummy")
PLACEHOLDER_STARTS = ("REPLACE_", "CHANGE_", "YOUR_", "TODO_", "FIXME_")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def as_bytes(text: Column) -> Column:
    """A text column as binary content."""
    return text.cast("binary")


def bytes_view(content: Column) -> Column:
    """Content as text of one character a byte, so that positions in it are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def fingerprint(value: Column) -> Column:
    """16 hex digits of the value's SHA-256: how a credential is named without showing it."""
    return F.substring(F.sha2(F.encode(value, "ISO-8859-1"), 256), 1, 16)


def redact(value: Column, public: Column | bool = False) -> Column:
    """Both ends of a value. Of an address, all to its last slash and both ends of the rest. What is too short to cut is hidden, unless it is public."""
    ends = lambda v, head, tail: F.when(F.length(v) > head + tail + 1, F.concat(F.substring(v, 1, head), F.lit("…"), F.right(v, F.lit(tail)))).otherwise(F.lit("…"))
    rest = F.substring_index(value, "/", -1)
    shown = F.when(value.startswith("http"), F.concat(F.left(value, F.length(value) - F.length(rest)), ends(rest, 2, 4))).otherwise(ends(value, 8, 4))
    return F.when(F.lit(public) if isinstance(public, bool) else public, value).otherwise(shown)


def base62_crc(body: Column) -> Column:
    """The CRC32 of a body as six base-62 digits."""
    crc = F.crc32(F.encode(body, "ISO-8859-1"))
    digit = lambda i: F.substr(F.lit(DIGITS), (F.floor(crc / F.lit(62**i)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(i) for i in range(5, -1, -1)))


def base36_crc(body: Column) -> Column:
    """The CRC32 of a body as seven lower-case base-36 digits."""
    return F.lpad(F.lower(F.conv(F.crc32(F.encode(body, "ISO-8859-1")).cast("string"), 10, 36)), 7, "0")


def little_endian_crc(body: Column) -> Column:
    """The CRC32 of a body in hex, lowest byte first."""
    h = F.lpad(F.lower(F.hex(F.crc32(F.encode(body, "ISO-8859-1")))), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def account_of(key_id: Column) -> Column:
    """The 12-digit account that the base-32 body of an access key id holds in its first bits."""
    body = F.substring(key_id, 5, 10)
    bits = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("bigint"), lambda a, i: a * 32 + (F.call_function("locate", F.substr(body, i, F.lit(1)), F.lit(BASE32)) - 1))
    return F.lpad(F.shiftright(F.shiftright(bits, 2).bitwiseAND(F.lit(0x7FFFFFFFFF80)), 7).cast("string"), 12, "0")


def templated(value: Column) -> Column:
    """Filled in when deployed: a template, shell or values reference."""
    return value.contains("{{") | value.contains("${") | value.contains(".Values")


def placeholder(value: Column) -> Column:
    """A short value that stands in for a secret."""
    plain = F.translate(F.lower(value), "-_ ", "")
    upper = (F.upper(value) == value) & value.rlike("^(" + "|".join(PLACEHOLDER_STARTS) + ")")
    return (value != "") & (F.length(value) <= 64) & (value.rlike(r"^(<[\s\S]*>|[xX]+|\*+)\z") & (value != "<") | plain.isin(*PLACEHOLDER_WORDS) | upper)


def hint_matches(hint: Column, value: Column) -> Column:
    """Whether a shortened value, head…tail or head...tail, can be of the value; without a tail it never is."""
    cut = F.regexp_replace(hint, r"\.\.\.", "…")
    head, tail = F.substring_index(cut, "…", 1), F.substring_index(cut, "…", -1)
    return cut.contains("…") & (tail != "") & (F.length(value) >= F.length(head) + F.length(tail)) & F.startswith(value, head) & F.endswith(value, tail)


def host_of(url: Column) -> Column:
    """Host and port of an address, or the text itself."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(host != "", host).otherwise(url)


def parse_size(size: Column) -> Column:
    """Bytes of texts such as 20G, 512MiB, 10 kb or 1.5g; null where it isn't a size."""
    n = F.regexp_extract(size, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KkMmGgTt]?)(?:i?[Bb])?\s*\z", 1)
    unit = F.upper(F.regexp_extract(size, r"^\s*[0-9.]+\s*([KkMmGgTt]?)", 1))
    power = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(n != "", (n.cast("double") * power).cast("bigint"))


def format_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB, GiB or TiB with one decimal place."""
    out = F.when(n < 1 << 10, F.format_string("%d B", n))
    for name, unit in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = out.when(n < unit << 10, F.format_string(f"%.1f {name}", n / unit))
    return out.otherwise(F.format_string("%.1f TiB", n / (1 << 40)))


def unbase64url(text: Column) -> Column:
    """The bytes of base64 in either alphabet, padded or not, as text; null where it isn't base64."""
    plain = F.translate(F.regexp_replace(text, r"=+\z", ""), "-_", "+/")
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plain.rlike(r"^[A-Za-z0-9+/]+\z") & (F.length(plain) % 4 != 1), F.decode(F.try_to_binary(whole, F.lit("base64")), "ISO-8859-1"))
