"""Expressions over lists of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from millrace.functions.text import WS, bound, first_of_each, strip

# Fixed values of the line rules.
STOP_WORDS = [" the ", " and ", " with ", " for ", " from ", " of ", " to ", " an ", " a ", " in "]
MARKED_LETTERS = "áéíóúñàèùâêîôûäëïöüçœ’"
INCLUDED_WORDS = ["includes", "comes with", "in the box", "kit includes", "package includes", "included"]
BENEFIT_WORDS = ["ideal for", "helps", "benefit", "provides", "for use", "designed to", "allows you", "great for", "beneficial"]
NAVIGATION_PHRASES = [
    "inventory management", "vaccine management", "biomedical equipment solutions", "instrument management services", "technology consultants", "distribution", "medical waste management", "drug disposal",
    "patient home delivery", "medical freight management", "lab management", "lab consulting", "lab information systems", "lab results", "clinical and equipment setup", "training and compliance",
    "patient care and engagement", "remote patient monitoring", "financial services", "revenue cycle management", "invoice management", "capital medical equipment", "real estate solutions",
    "analytics & reporting", "analytics and reporting", "ecommerce services", "covid-19 vaccines", "flu season is coming", "order now", "pre-book", "view all accessories", "view less accessories", "share this:",
]
SECTION_LABELS = [
    "products", "bath safety", "beds", "commodes", "inspired", "mobility", "patient room", "personal care", "respiratory", "sleep therapy", "therapeutic support surfaces", "new arrivals",
    "support & resources", "who we are", "who we serve", "account", "get in touch", "press releases", "articles & blogs", "leadership", "work with us", "faqs", "knowledge base",
]
KEPT_LINES = r"use\s*&\s*operation|use\s+and\s+operation|close\s+product\s+options"
SPEC_LIKE_STARTS = "^(?:bed height|sleep surface|weight capacity|max patient weight|assembled bed|assembled bed weight|limited warranty)"
JOINING_WORDS = "and|as|to|for|with|in|on"
INSTRUCTION_WORDS = r"do\s+not|warning|caution|manual|future\s+reference|pendant|control|allow\s+a\s+slight"


def lines_of(text: Column) -> Column:
    """The stripped lines of a text, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def printable_share(x: Column) -> Column:
    """(printable ASCII characters, all characters)"""
    return F.length(F.regexp_replace(x, r"[^\x20-\x7e]", "")), F.length(x)


def english_by_ascii(line: Column) -> Column:
    """At least 0.7 of the stripped line is printable ASCII; blank lines aren't English."""

    def told(x: Column) -> Column:
        ascii_, all_ = printable_share(x)
        return (all_ > 0) & (~x.rlike(r"[^\x20-\x7e]") | (ascii_ * 10 >= all_ * 7))

    return bound(strip(line), told)


def english_unmarked(line: Column) -> Column:
    """No letter with marks, and at least 0.7 printable ASCII."""
    ascii_, all_ = printable_share(line)
    return (all_ > 0) & ~F.lower(line).rlike(f"[{MARKED_LETTERS}]") & (ascii_ * 10 >= all_ * 7)


def english_by_words(line: Column) -> Column:
    """At least 0.6 of the non-blank characters are ASCII letters, and a common English word stands inside."""
    x = F.coalesce(line, F.lit(""))
    letters, all_ = F.length(F.regexp_replace(x, "[^A-Za-z]", "")), F.length(F.regexp_replace(x, f"{WS}+", ""))
    return (all_ > 0) & (letters * 10 >= all_ * 6) & _has(F.lower(x), STOP_WORDS)


def distinct_in_order(lines: Column) -> Column:
    """The first of each group of lines equal but for case."""
    return first_of_each(lines, F.lower)


def merged(a: Column, b: Column) -> Column:
    """Lines of a, then of b, each once."""
    return F.array_join(distinct_in_order(F.concat(lines_of(a), lines_of(b))), "\n")


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), f"[^a-z0-9\\t\\n\\x0B\\f\\r \\u00a0]", " "), f"{WS}+"), lambda w: w != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct tokens; 0 if there are none."""
    return _jaccard(tokens(a), tokens(b))


def _jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def without_similar(lines: Column, threshold: float = 0.8) -> Column:
    """Greedy: a line stays unless it is at least threshold similar to one that stayed before it."""
    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), tokens(x).alias("words")))
    start = F.array().cast("array<struct<line:string,words:array<string>>>")
    kept = F.aggregate(rows, start, lambda kept, x: F.when(F.exists(kept, lambda k: _jaccard(x["words"], k["words"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return F.transform(kept, lambda k: k["line"])


def _has(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(re.escape(w) if not w.startswith(" ") else w for w in words))


def sentence_class(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(_has(low, INCLUDED_WORDS), "included").when(_has(low, BENEFIT_WORDS), "benefit").otherwise("feature")


def navigation_line(x: Column) -> Column:
    """Two phrases of site navigation, or one as the whole line; lines on use and operation never are."""


    def test(low: Column) -> Column:
        hits = sum((F.contains(low, F.lit(p)).cast("int") for p in NAVIGATION_PHRASES), F.lit(0))
        return ~low.rlike(KEPT_LINES) & ((hits >= 2) | low.isin(*NAVIGATION_PHRASES))

    low = F.lower(strip(x))
    return _has(low, NAVIGATION_PHRASES) & bound(low, test)  # one pass tells most lines


def without_navigation(text: Column) -> Column:
    rows = F.filter(F.split(text, "\r?\n"), lambda x: (strip(x) != "") & ~navigation_line(x))
    return strip(F.array_join(rows, "\n"))


def feature_kept(line: Column) -> Column:
    """English, no strokes, no language names, not a section label of a shop."""
    x = strip(line)
    low = F.lower(x)
    return english_unmarked(x) & ~x.rlike(r"[\\/]") & ~low.rlike("español|français") & ~low.isin(*SECTION_LABELS)


def joined_fragments(lines: Column) -> Column:
    """Lines that carry on the one before are joined to it.

    A line carries on if it begins with a joining word, or begins small while the line before
    ends without a full stop. What has been joined ends as its last line ends, so looking at
    the text so far is looking at the line before.
    """
    filled = F.filter(F.transform(lines, strip), lambda x: x != "")
    last = lambda acc: F.element_at(acc, -1)
    goes_on = lambda acc, x: x.rlike(f"^(?:{JOINING_WORDS})(?![A-Za-z0-9_])") | (x.rlike("^[a-z]") & ~last(acc).rlike("[.!?]$"))
    return F.aggregate(
        filled,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(goes_on(acc, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x))),
    )


def clean_features(lines: Column) -> Column:
    """Distinct feature lines without instructions and long ones, fragments joined, spec-like lines left out."""
    usable = F.filter(lines, lambda x: x.isNotNull() & (strip(x) != "") & ~F.lower(strip(x)).rlike(INSTRUCTION_WORDS) & (F.length(x) <= 150) & ~F.contains(x, F.lit("\n")))
    joined = joined_fragments(first_of_each(usable, lambda x: F.lower(strip(x))))
    return F.filter(joined, lambda x: ~F.lower(strip(x)).rlike(SPEC_LIKE_STARTS) & ~F.contains(x, F.lit(":")))


def compiled_features(lines: Column) -> Column:
    """Features whose line begins with a dash, or follows one that ends open, are joined to the one before."""
    filled = F.filter(F.transform(lines, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    bare = lambda x: strip(F.regexp_replace(x, r"^[-–—]+\s*", ""))
    last = lambda acc: F.element_at(acc, -1)
    open_end = lambda t: strip(t).rlike(r"(?:[,;:]|(?:^|\s)(?i:and|or))$")
    out = F.aggregate(
        filled,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (last(acc) == ""), F.concat(F.filter(acc, lambda a: a != ""), F.array(bare(x))))
        .when(x.rlike("^[-–—]") | open_end(last(acc)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last(acc), F.lit(" "), bare(x)))))
        .otherwise(F.concat(acc, F.array(bare(x)))),
    )
    return F.filter(F.transform(out, strip), lambda x: x != "")


def section(lines: Column, start: str, stop: str) -> Column:
    """Lines after the first one equal to start, up to the first later one equal to stop; bullets taken off."""
    low = F.transform(lines, lambda x: F.lower(strip(x)))
    begin = F.array_position(low, F.lit(start).cast("string"))
    after = F.slice(lines, begin.cast("int") + 1, F.size(lines))
    low_after = F.transform(after, lambda x: F.lower(strip(x)))
    end = F.array_position(low_after, F.lit(stop).cast("string"))
    body = F.when(end > 0, F.slice(after, 1, end.cast("int") - 1)).otherwise(after)
    bare = F.transform(body, lambda x: strip(F.regexp_replace(strip(x), "^[-•\\s]+", "")))
    return F.when(begin > 0, F.filter(bare, lambda x: (x != "") & (F.lower(x) != start))).otherwise(F.array().cast("array<string>"))
