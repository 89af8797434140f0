"""Catalogue listings of different sellers grouped by the product they describe.

Listings become sets of normalised tokens: the words of the name that neither sell, nor name
a brand, a kind of product or a measure, plus the number of a maker's code. What words name
a brand or a kind is counted over all listings. Listings with equal sets are one node; nodes
meet in a prefix-filtered containment join with rarity weights; stars around the most
frequent nodes are model families. Within a family the measure that tells its members apart
(size, capacity, volume, colour or count) is found by counting, and gives the product.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.functions.units import LENGTH, MASS, VOLUME, parse_number, resolve
from millrace.llm.setjoin import containment_join, star_clusters
from millrace.session import cut

# Words that sell, and words that only join. Fixed values.
MARKETING = frozenset(
    "new best seller sale free shipping fast ship easy returns return top rated premium professional grade hospital quality heavy duty deluxe comfort latest model warranty with w original genuine official sold by for and the of in a an on to usa tm oem cap capacity max wide width finish color colour item sku mpn ref no".split()
)
# Words that set a line of models apart from the plain one; they may be written onto the model's name. Fixed values.
LINES = ("air", "xt", "neo", "duo", "go", "mini", "ii", "iii", "flex", "hd", "max", "pro", "plus", "lite")
# Colour words and their short forms. Fixed values.
COLOURS = {
    "black": "BK", "blk": "BK", "bk": "BK", "white": "WH", "wht": "WH", "wh": "WH", "red": "RD", "rd": "RD", "green": "GN", "grn": "GN", "gn": "GN", "blue": "BL", "blu": "BL", "bl": "BL",
    "silver": "SV", "slvr": "SV", "sv": "SV", "grey": "GY", "gray": "GY", "gy": "GY", "yellow": "YE", "yel": "YE", "ye": "YE", "pink": "PK", "purple": "PU", "orange": "OR", "brown": "BR", "brn": "BR", "beige": "BE",
}
_MEASURE = re.compile(r"(?<![\w.])(?P<n>\d+(?:[.,]\d+)?)\s*-?\s*(?P<u>fl\.?\s?oz|millimet\w+|centimet\w+|mm|cm|inch(?:es)?|in|\"|″|”|pounds?|lbs?|#|kilograms?|kgs?|grams?|g|millilit\w+|ml|cc|lit(?:er|re)s?|ltr|l|gallons?|gal|oz)(?![a-z0-9])\.?", re.I)
_W_INCH = re.compile(r"(?<![\w])W(\d{1,3})\s?in\b", re.I)
_COUNT = re.compile(r"(?:(?:box|pack|case|bag|set) of|qty\.?|quantity|(?:pk|bx|cs|pack|box)\s?/)\s*(\d{1,5})\b|(?<![\w.])(\d{1,5})\s*(?:-\s?)?(?:count|ct|pcs|pieces|pack|pk|per box|/\s?(?:box|bx|pk|pack))\b", re.I)
# A maker's code: letters, a long number and a suffix that tells the member of the family, with any separators.
_SUFFIXED = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{3})[-_. ]?(\d{7})[-_. ]?(\d{2,3}[HM]|P\d{1,3}|[A-Z]{2}|\d{2})?(?![A-Za-z0-9])", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_GLUED = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _round2(x: float) -> int:
    """Two leading digits: a rounded conversion of a measure gives the same number."""
    digits = len(str(int(x)))
    step = 10 ** max(0, digits - 2)
    return int(x / step + 0.5) * step


def code_of(text: str) -> tuple[str, str] | None:
    """(number, suffix) of the first maker's code in a text."""
    m = _SUFFIXED.search(text)
    return (m[1].upper() + m[2], (m[3] or "").upper()) if m else None


def suffix_measure(suffix: str) -> tuple[str, str] | None:
    """The measure that a code's suffix states: 40H (tens of pounds), 80M (tens of mL), P50 (count), GN (colour), 26 (inches)."""
    if suffix in COLOURS.values():
        return "colour", suffix
    if m := re.fullmatch(r"(\d+)H", suffix):
        return "capacity", str(int(m[1]) * 10)
    if m := re.fullmatch(r"(\d+)M", suffix):
        return "volume", str(int(m[1]) * 10)
    if m := re.fullmatch(r"P(\d+)", suffix):
        return "count", str(int(m[1]))
    return ("length", suffix) if suffix.isdigit() else None


def measures(text: str) -> tuple[dict[str, str], str]:
    """kind to value of the measures in a text, and the text without them. The first of a kind counts."""
    found: dict[str, str] = {}

    def count(m: re.Match) -> str:
        found.setdefault("count", str(int(m[1] or m[2])))
        return " "

    def inches(m: re.Match) -> str:
        found.setdefault("length", m[1])
        return " "

    def quantity(m: re.Match) -> str:
        unit, value = " ".join(m["u"].lower().replace(".", " ").split()), parse_number(m["n"])
        for kind, dims, scale in (("volume", VOLUME, 1e-6), ("length", LENGTH, 0.0254), ("capacity", MASS, 0.45359237)):
            if value and (u := resolve("fl oz" if unit in ("floz", "fl oz") else unit, dims)) and not (unit == "oz" and kind == "volume"):
                found.setdefault(kind, str(_round2(value * u.scale / scale)))
                return " "
        return " "

    text = _MEASURE.sub(quantity, _W_INCH.sub(inches, _COUNT.sub(count, text)))
    for w in _WORD.findall(text.lower()):
        if w in COLOURS:
            found.setdefault("colour", COLOURS[w])
    return found, text


def identity(name: str | None, sku: str | None, brand: str | None, specs: str | None, categories) -> dict:
    """words, number, measures and the brand and category words of one listing."""
    name = name or ""
    codes = [c for c in (code_of(sku or ""), code_of(name)) if c]
    number = codes[0][0] if codes else None
    by_kind: dict[str, str] = {}
    coded = ""
    for _, suffix in codes:
        if suffix and (m := suffix_measure(suffix)):
            by_kind.setdefault(*m)
            coded = coded or m[0]
    rest = _SUFFIXED.sub(" ", name)
    listed, rest = measures(rest)
    pieces = [html.unescape(p) for p in re.split(r"<[^>]+>", specs or "") if p.strip()]
    stated: dict[str, str] = {}
    for p in pieces:
        for kind, value in measures(p)[0].items():
            stated.setdefault(kind, value)
    for source in (listed, stated):
        for kind, value in source.items():
            by_kind.setdefault(kind, value)
    brand_words = {w.lower() for w in _WORD.findall(brand or "")}
    kind_words = {w.lower() for text in (*(categories if categories is not None else ()), *pieces[:1]) for w in _WORD.findall(text or "")}
    words = {w.lower() for chunk in _WORD.findall(rest) for w in _GLUED.split(chunk)}
    words = sorted(w for w in words if len(w) > 1 and w not in MARKETING and w not in COLOURS)
    return {"words": words, "number": number, "coded": coded or None, "measures": [{"kind": k, "value": v} for k, v in sorted(by_kind.items())], "brand_words": sorted(brand_words), "kind_words": sorted(kind_words)}


_IDENTITY = "struct<words:array<string>,number:string,coded:string,measures:array<struct<kind:string,value:string>>,brand_words:array<string>,kind_words:array<string>>"


def _identities(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        yield pd.DataFrame([identity(*row) for row in zip(*columns)], columns=["words", "number", "coded", "measures", "brand_words", "kind_words"])


def _once(listings: DataFrame) -> DataFrame:
    """One row for each listing_id, the first delivered."""
    columns = ["name", "sku", "brand", "specs_html", "categories"]
    first = F.min_by(F.struct(*columns), F.struct("ingested_at", "name", "sku")).alias("_x")
    return listings.where(F.col("listing_id").isNotNull()).groupBy("listing_id").agg(first).select("listing_id", "_x.*")


def respelled(words: DataFrame) -> DataFrame:
    """(word, to) of the words that are a slip of a more frequent one; ``words`` has word, n, number and kind.

    Two words meet in what remains when one letter is left out, or a line word is taken off
    the end; each such remainder points to its most frequent word, and to the most frequent of
    the word's own code number and of none, so no pairs of a group are made. A word goes over only to one a slip away without another code number, which is at
    least twice as frequent or has the same number.
    """
    long = words.where(F.length("word") >= 6)
    left_out = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    stems = F.array_compact(F.array(*(F.when(F.endswith("word", F.lit(x)) & (F.length("word") >= len(x) + 5), F.expr(f"left(word, length(word) - {len(x)})")) for x in LINES)))
    met = long.select("*", F.explode(F.array_distinct(F.concat(F.array("word"), left_out, stems))).alias("key"))
    top = F.max(F.struct("n", "word", "number")).alias("best")
    by_number = cut(met.groupBy("key", "kind", "number").agg(top))
    overall = by_number.groupBy("key", "kind").agg(F.max("best").alias("best"))
    # A word with a number fits the best word of that number or of none; one without fits the best overall.
    bare = by_number.where("number is null").select("key", "kind", F.col("best").alias("bare"))
    own = by_number.where("number is not null").select("key", "kind", "number", F.col("best").alias("own"))
    frequent = (F.col("best.n") >= 2 * F.col("n")) | ((F.col("number") == F.col("best.number")) & (F.struct("n", "word") < F.struct("best.n", "best.word")))
    offered = met.join(overall, ["key", "kind"]).join(bare, ["key", "kind"], "left").join(own, ["key", "kind", "number"], "left")
    offered = offered.withColumn("best", F.explode(F.array_distinct(F.array_compact(F.array("best", "bare", "own"))))).drop("bare", "own")
    pairs = offered.where(frequent & (F.col("best.word") != F.col("word")))
    near = F.levenshtein("word", "best.word") <= F.when(F.col("key") == F.col("best.word"), 4).otherwise(2)
    fits = F.col("number").isNull() | F.col("best.number").isNull() | (F.col("number") == F.col("best.number"))
    return pairs.where(near & fits).groupBy("word").agg(F.max(F.struct(F.col("best.n"), F.col("best.word").alias("to"))).alias("_b")).select("word", "_b.to")


def product_groups(listings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(listing_id, product): listings of the same product have the same product id.

    A listing that shows neither a model name nor a code, or not which member of its family
    it is while the family has several, is its own product. Null names and skus count as
    missing. Re-delivered listings count once.
    """
    once = _once(listings)
    seen = cut(once.select("listing_id", F.pandas_udf(_identities, _IDENTITY)("name", "sku", "brand", "specs_html", "categories").alias("i")).select("listing_id", "i.*"))
    total = seen.count()

    # Of every word: in how many names it stands, and how often as a brand's or a kind's word.
    said = seen.select("listing_id", F.explode("words").alias("word"), F.lit(1).alias("n"), F.lit(0).alias("b"), F.lit(0).alias("k"))
    branded = seen.select("listing_id", F.explode("brand_words").alias("word"), F.lit(0).alias("n"), F.lit(1).alias("b"), F.lit(0).alias("k"))
    kinds = seen.select("listing_id", F.explode("kind_words").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(1).alias("k"))
    stats = said.union(branded).union(kinds).groupBy("word").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("k").alias("k")).where("n > 0")
    telling = cut(stats.where((F.col("b") < 0.3 * F.col("n")) & (F.col("k") < 0.3 * F.col("n"))).select("word", "n"))

    # The words that tell, of each listing, with slips put right.
    main_kind = F.array_min("kind_words")
    each = seen.select("listing_id", "number", main_kind.alias("kind"), F.explode("words").alias("word")).join(telling, "word")
    numbered = each.groupBy("word", "number").agg(F.max("n").alias("n"), F.count("*").alias("c"))
    by_word = numbered.groupBy("word").agg(F.max("n").alias("n"), F.max_by("number", F.when(F.col("number").isNotNull(), F.struct("c", "number"))).alias("number"))
    slips = cut(respelled(by_word.withColumn("kind", F.lit(""))))
    put_right = each.select("listing_id", "word").join(slips, "word", "left").select("listing_id", F.coalesce("to", "word").alias("word"))
    words = put_right.groupBy("listing_id").agg(F.sort_array(F.collect_set("word")).alias("words"))

    # Equal sets are one node.
    named = seen.select("listing_id", "number", "coded", "measures").join(words, "listing_id", "left")
    tokens = F.concat(F.coalesce(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.array().cast("array<string>")), F.when(F.col("number").isNotNull(), F.array(F.concat(F.lit("n:"), "number"))).otherwise(F.array().cast("array<string>")))
    named = cut(named.withColumn("set", tokens).withColumn("node", F.xxhash64("set")))
    # Words of a line of models don't name a model by themselves.
    names_one = F.exists("set", lambda t: ~t.isin(*(f"w:{x}" for x in LINES)))
    nodes = named.where(names_one).groupBy("node").agg(F.first("set").alias("set"), F.count("*").alias("n"))
    counts = nodes.select(F.explode("set").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("df"))
    weight = F.pow(F.log(F.lit(1.0 + total) / F.col("df")), 3)
    weighted = nodes.select("node", "n", F.explode("set").alias("token")).join(counts, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", weight.alias("weight"), "df")).alias("tokens"))
    # Beside a code that others share, a word that nobody else writes tells little.
    coded = F.exists("tokens", lambda t: t["token"].startswith("n:") & (t["df"] > 1))
    lone = F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), F.when(coded & (t["df"] == 1), t["weight"] / 10).otherwise(t["weight"]).alias("weight")))
    weighted = cut(weighted.withColumn("tokens", lone))
    links = cut(containment_join(weighted.select(F.col("node").alias("id"), "tokens"), threshold))
    families = star_clusters(weighted.select(F.col("node").alias("id"), F.struct("n", F.size("tokens")).alias("rank")), links)
    placed = cut(named.join(families.select(F.col("id").alias("node"), F.col("center").alias("family")), "node", "left"))

    # The measure that tells the members of a family apart: stated by its codes, else the one with most values.
    shown = placed.where(F.col("family").isNotNull()).select("listing_id", "family", "coded", F.inline("measures"))
    per_value = shown.groupBy("family", "kind", "value").agg(F.count("*").alias("n"), F.sum(F.when(F.col("coded") == F.col("kind"), 1).otherwise(0)).alias("c"))
    per_kind = per_value.groupBy("family", "kind").agg(F.sum("c").alias("c"), F.count("*").alias("values"), F.sum("n").alias("n"), F.max_by("value", "n").alias("only"))
    telling_kind = per_kind.groupBy("family").agg(F.max(F.struct("c", "values", "n", "kind", "only")).alias("t")).select("family", "t.kind", "t.values", "t.only")
    value = shown.join(telling_kind, ["family", "kind"]).select("listing_id", "value")
    members = placed.select("listing_id", "family").join(telling_kind, "family", "left").join(value, "listing_id", "left")
    member = F.coalesce("value", F.when(F.col("values") == 1, F.col("only")))
    product = F.when(F.col("family").isNotNull() & (F.col("kind").isNull() | member.isNotNull()), F.xxhash64("family", F.coalesce(member, F.lit("")))).otherwise(F.xxhash64(F.lit("alone"), "listing_id"))
    return members.select("listing_id", product.alias("product"))


def product_pairs(listings: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b) of every two listings of the same product, the smaller id first."""
    groups = cut(product_groups(listings))
    a, b = groups.select(F.col("listing_id").alias("listing_id_a"), "product"), groups.select(F.col("listing_id").alias("listing_id_b"), "product")
    return a.join(b, "product").where(F.col("listing_id_a") < F.col("listing_id_b")).select("listing_id_a", "listing_id_b")
