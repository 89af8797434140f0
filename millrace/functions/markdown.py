"""Texts and maps as markdown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions.lines import lines_of
from millrace.functions.text import strip, title_case


def paragraphs(text: Column, bullets: str = "[-*•]") -> Column:
    """Runs of lines are paragraphs joined by blanks, lines with a bullet stand alone as ``- x``; blank lines between."""
    item = lambda x: x.rlike(f"^{bullets} ")
    last = lambda acc: F.element_at(acc, -1)
    grown = F.aggregate(
        lines_of(text),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(item(x), F.concat(acc, F.array(F.regexp_replace(x, "^• *", "- "))))
        .when((F.size(acc) > 0) & ~last(acc).rlike("^[-*] "), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.lit(" "), x))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(grown, "\n\n")


def spec_table(specs: Column) -> Column:
    """A map as a table of two columns, its keys in title case; '' for an empty map."""
    row = lambda e: F.concat(F.lit("| "), title_case(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(" | "), strip(F.regexp_replace(e["value"], "\n+", " ")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.map_entries(specs)), row)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(F.array_join(F.concat(F.array(F.lit("| Spec | Value |"), F.lit("|---|---|")), rows), "\n"))
