"""Checks of written product texts: lengths, placeholders, lists, forbidden content. All limits are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions import text as T

# Bounds of each text in characters.
BOUNDS = {"name": (90, 110), "short_name": (1, 60), "description": (1200, 32000), "meta_title": (60, 68), "meta_description": (150, 160)}
SIZES = ["XS", "S", "M", "L", "XL", "2XL", "3XL"]
SIZE_NAMES = {"extra small": "XS", "x-small": "XS", "small": "S", "medium": "M", "large": "L", "extra large": "XL", "x-large": "XL", "xxl": "2XL", "2x-large": "2XL", "xx-large": "2XL", "3x-large": "3XL", "xxxl": "3XL"}
PLACEHOLDER = r"(?i)\{\{|\}\}|lorem ipsum|\btbd\b|\bxxx+\b|\[insert|placeholder"


def out_of_bounds(fields: dict[str, Column], bounds: dict[str, tuple[int, int]] | None = None) -> Column:
    """``field: n`` of every text whose length without tags is outside its bounds; a null text has length 0."""
    rows = []
    for name, (low, high) in (BOUNDS | (bounds or {})).items():
        if name in fields:
            n = F.length(T.squeeze(F.regexp_replace(F.coalesce(fields[name], F.lit("")), "<[^>]+>", " ")))
            rows.append(F.when(~n.between(low, high), F.concat(F.lit(f"{name}: "), n.cast("string"))))
    return F.array_compact(F.array(*rows))


def has_placeholder(x: Column) -> Column:
    return F.coalesce(x.rlike(PLACEHOLDER), F.lit(False))


def keyword_faults(keywords: Column, low: int = 5, high: int = 10) -> Column:
    """Faults of a keyword list: its number, capitals, repeats."""
    words = F.coalesce(keywords, F.array().cast("array<string>"))
    return F.array_compact(F.array(F.when(~F.size(words).between(low, high), F.lit("number")), F.when(F.exists(words, lambda w: w != F.lower(w)), F.lit("capitals")), F.when(F.size(F.array_distinct(F.transform(words, F.lower))) < F.size(words), F.lit("repeats"))))


def name_faults(name: Column, sku: Column) -> Column:
    """A code, a trade number or a mark in a name, or an end that hangs."""
    low_sku = F.lower(F.coalesce(sku, F.lit("")))
    return F.array_compact(
        F.array(
            F.when((low_sku != "") & F.contains(F.lower(name), low_sku), F.lit("sku")),
            F.when(name.rlike("(?<![0-9])(?:[0-9]{8}|[0-9]{12,14})(?![0-9])"), F.lit("gtin")),
            F.when(name.rlike("[™®℠©]"), F.lit("mark")),
            F.when(T.strip(name).rlike(r"(?i)(?:[-–,:;&]|\s(?:and|or|with|for|of|the))$"), F.lit("hanging end")),
        )
    )


def size_label(x: Column) -> Column:
    """XS to 3XL of a size as written, else the text as it is."""
    low = F.lower(T.squeeze(x))
    named = F.try_element_at(F.create_map(*[v for k, s in SIZE_NAMES.items() for v in (F.lit(k), F.lit(s))]), low)
    return F.coalesce(named, F.when(F.upper(low).isin(*SIZES), F.upper(low)), T.squeeze(x))


def sizes_in_order(sizes: Column) -> Column:
    """Size labels from small to large, others after them by name."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in SIZES)), s), F.lit(0)), F.lit(99))
    return F.transform(F.array_sort(F.transform(F.array_distinct(F.transform(sizes, size_label)), lambda s: F.struct(rank(s).alias("r"), s.alias("s")))), lambda x: x["s"])


def list_lengths(html: Column) -> Column:
    """struct(items, headings, links) counted in markup."""
    n = lambda p: F.regexp_count(F.lower(F.coalesce(html, F.lit(""))), F.lit(p)).cast("bigint")
    return F.struct(n("<li[ >]").alias("items"), n("<h3[ >]").alias("headings"), n("<a[ >]").alias("links"))
