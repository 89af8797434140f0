"""Scalar expressions over text, URLs and markup. Each takes and gives Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# White space as page scripts count it, spelt out because regex dialects differ about \s.
WS = r"[\t\n\x0B\f\r    -     　﻿]"
#: The same characters one by one.
WS_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Second-level domains under which names are registered.
TWO_PART_DOMAINS = ["co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "co.jp"]
CDN_HOSTS = "cdn|cloudfront|akamai|akamaized|azureedge|fastly|shopifycdn|bigcommerce|mzstatic|cdn.shopify"


def bound(value: Column, then) -> Column:
    """then(value), the value computed once. What a lambda takes from outside is computed anew for each element; its own variables aren't."""
    return F.element_at(F.transform(F.array(value), then), 1)


def first_of_each(items: Column, key: Callable[[Column], Column], last: bool = False) -> Column:
    """The first (or last) of the items with equal keys, in the order of the array; null stays null.

    Items are sorted by (key, place) and compared with their neighbour, so the work is
    n log n in the length of the array.
    """
    placed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), ((-i) if last else i).alias("i"), x.alias("x")))
    heads = bound(F.array_sort(placed), lambda rows: F.filter(rows, lambda r, i: (i == 0) | ~r["k"].eqNullSafe(F.get(rows, i - 1)["k"])))
    back = F.array_sort(F.transform(heads, lambda r: F.struct((F.abs(r["i"])).alias("i"), r["x"].alias("x"))))
    return F.transform(back, lambda r: r["x"])


def squeeze(x: Column) -> Column:
    """Runs of white space are one blank, none at the ends; null gives ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", " "), "^ | $", "")


def strip(x: Column) -> Column:
    """White space of any kind off both ends; only these are looked at."""
    return F.btrim(x, F.lit(WS_CHARACTERS))


def non_blank(x: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*(non_blank(x) for x in xs), F.lit(""))


def decode_entities(x: Column) -> Column:
    """Five entities; ``&amp;`` goes first, so doubly escaped text opens twice."""
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def decode_once(x: Column) -> Column:
    """URL-decoded unless that fails, leaves nothing or leaves an escape."""
    plain = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(plain.isNull() | (plain == "") | plain.rlike("%[0-9A-Fa-f]{2}"), x).otherwise(plain)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def is_ip(h: Column) -> Column:
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return h.rlike(rf"^{part}(?:\.{part}){{3}}$") | (h.contains(":") & h.rlike("^[0-9a-fA-F:.]+$"))


def is_private_ip(h: Column) -> Column:
    low = F.lower(h)
    v4 = h.rlike(r"^(?:10|127)\.") | h.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\.") | h.rlike(r"^192\.168\.") | h.rlike(r"^169\.254\.")
    v6 = h.contains(":") & (low.rlike("^f[cd]") | (low == "::1") | low.startswith("fe80"))
    return is_ip(h) & (v4 | v6)


def is_dangerous_host(h: Column) -> Column:
    """Hosts that a fetch must not reach: none, local names, private addresses."""
    low = F.lower(F.coalesce(h, F.lit("")))
    return (low == "") | (low == "localhost") | low.endswith(".local") | low.endswith(".localhost") | is_private_ip(low)


def registrable_domain(h: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.coalesce(h, F.lit(""))), r"\."), lambda p: p != "")
    n = F.size(parts)
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(n - (k - 1), F.lit(1)), k), ".")
    return F.when(n <= 2, F.array_join(parts, ".")).when(tail(2).isin(*TWO_PART_DOMAINS), tail(3)).otherwise(tail(2))


def same_site(a: Column, b: Column) -> Column:
    """Same host, same registrable domain, or a content network."""
    return (host(a) == host(b)) | (registrable_domain(host(a)) == registrable_domain(host(b))) | host(b).rlike(f"(?i){CDN_HOSTS}")


def absolute(base: Column, link: Column) -> Column:
    """A link against its page: as it is, by scheme, by site or by folder. ``..`` isn't resolved."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(link.isNull() | (link == "") | link.rlike("^(?i)https?://") | (origin == ""), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, folder, link))
    )


def title_case(x: Column) -> Column:
    """Small letters, but the first of each run of ASCII letters, digits and ``_`` is a capital."""
    runs = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.substr(r, F.lit(2)))), "")


def sentences(x: Column) -> Column:
    """Parts between sentence ends before a capital or digit, line breaks, and bullets."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9])|\n+|(?:^|\s)[•\-]\s+"), strip), lambda s: s != "")


def plain_value(x: Column) -> Column:
    """One blank between words, no closing ``; : ,``."""
    x = F.regexp_replace(F.regexp_replace(x, "[\r\n\t]+", " "), f"{WS}{{2,}}", " ")
    return strip(F.regexp_replace(x, "[;:,]+$", ""))


def value_list(x: Column) -> Column:
    """Values divided by ``or``, stroke, comma, colon or semicolon; null and blank give none."""
    parts = F.split(F.regexp_replace(F.coalesce(x, F.lit("")), f"(?i){WS}+or{WS}+", ","), "[/,:;]+")
    return F.filter(F.transform(parts, plain_value), lambda v: v != "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_fences(x: Column) -> Column:
    """Text out of code fences."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def json_candidate(x: Column) -> Column:
    """From the first ``{`` to the last ``}``, if that reads as JSON, else the whole text."""
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner).otherwise(x)


def short_dashes(x: Column) -> Column:
    return F.regexp_replace(x, "—|---", "–")


def short_name(heading: Column, most: int = 60) -> Column:
    """What stands before an en dash, cut to ``most`` characters without a broken last word."""
    name = strip(F.element_at(F.split(heading, "–"), 1))
    return F.when(F.length(name) <= most, name).otherwise(strip(F.regexp_replace(F.substr(name, F.lit(1), F.lit(most)), r"\s+\S*$", "")))


def list_items(html: Column) -> Column:
    return F.regexp_count(F.lower(html), F.lit("<li[ >]"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{{ KEY }}`` replaced by each value; null values are ''."""
    for key, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + key + r"\s*\}\}"), F.regexp_replace(F.coalesce(value, F.lit("")), F.lit(r"([\\$])"), F.lit(r"\\$1")))
    return template


def column_letters(n: Column) -> Column:
    """1 is A, 27 is AA: spreadsheet columns up to three letters."""
    letter = lambda k: F.chr(F.lit(65) + k.cast("int"))
    last = F.pmod(n - 1, F.lit(26))
    second = F.floor((n - 1) / 26)
    first = F.floor((second - 1) / 26)
    return F.concat(F.when(second > 26, letter(first - 1)).otherwise(""), F.when(second > 0, letter(F.pmod(second - 1, F.lit(26)))).otherwise(""), letter(last))


def random_id() -> Column:
    return F.substr(F.sha2(F.expr("uuid()"), 256), F.lit(1), F.lit(12))
