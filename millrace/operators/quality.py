"""Completeness, quality scores and rule checks of product records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import strip

# Fixed values of the content rules; parameters of content_errors.
RULES = {
    "required_disclaimer": "This product is not intended to diagnose, treat, cure, or prevent any disease.",
    "banned_phrases": ["cures cancer", "guaranteed results", "FDA-approved"],
    "title_max": 70,
    "description_max": 160,
    "images_min": 1,
}


def missing(fields: dict[str, tuple[Column, str]]) -> Column:
    """Names of the fields that are null, blank texts or empty lists; ``fields`` is name to (column, kind: text, list or any)."""
    empty = {"text": lambda c: strip(c) == "", "list": lambda c: F.size(c) == 0, "any": lambda c: F.lit(False)}
    return F.array_compact(F.array(*(F.when(c.isNull() | empty[kind](c), F.lit(name)) for name, (c, kind) in fields.items())))


def completeness(missing_: Column, of: int) -> Column:
    """Present fields in percent, halves rounded up."""
    return F.floor((of - F.size(missing_)) * 100 / of + 0.5).cast("bigint")


def publishable(missing_: Column, score: Column, threshold: int = 95) -> Column:
    return (F.size(missing_) == 0) & (score >= threshold)


def _grade(n: Column) -> Column:
    return F.when(n >= 3, 4).when(n >= 1, 2).otherwise(0)


def quality_tenths(features: Column, specs: Column, documents: Column, document_features: Column | None = None) -> Column:
    """Tenths of the quality score: features and specs up to 4 each, documents and features out of them 1 each."""
    has = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1).otherwise(0)
    total = _grade(F.greatest(F.size(features), F.lit(0))) + _grade(F.greatest(F.size(F.map_keys(specs)), F.lit(0))) + has(documents)
    return F.least(total + (has(document_features) if document_features is not None else F.lit(0)), F.lit(10))


def content_errors(categories: Column, disclaimer: Column, description: Column, title: Column, meta: Column, images: Column, rules: dict | None = None) -> Column:
    """Messages of the content rules a record breaks, in a fixed order."""
    r = RULES | (rules or {})
    regulated = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(c).rlike("supplement|medical"))
    checks = [F.when(regulated & ~F.contains(F.coalesce(disclaimer, F.lit("")), F.lit(r["required_disclaimer"])), F.lit("Content: missing required regulatory disclaimer"))]
    checks += [F.when(F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit(p.lower())), F.lit(f"Content: banned phrase detected → {p}")) for p in r["banned_phrases"]]
    checks += [
        F.when(F.length(title) > r["title_max"], F.lit(f"SEO: meta_title exceeds {r['title_max']} chars")),
        F.when(F.length(meta) > r["description_max"], F.lit(f"SEO: meta_description exceeds {r['description_max']} chars")),
        F.when(F.greatest(F.coalesce(F.size(images), F.lit(0)), F.lit(0)) < r["images_min"], F.lit("Images: at least one product image is required")),
    ]
    return F.array_compact(F.array(*checks))


def catalogue_errors(sku: Column, variants: Column) -> Column:
    """Messages on a missing root sku, repeated variant skus and variants without options."""
    rows = F.coalesce(variants, F.array().cast("array<struct<sku:string,option_values:array<struct<option_name:string,value:string>>>>"))
    skus = F.transform(rows, lambda v: v["sku"])
    per = F.flatten(
        F.transform(
            rows,
            lambda v, i: F.array_compact(
                F.array(
                    F.when(F.array_position(F.slice(skus, 1, i), v["sku"]) > 0, F.concat(F.lit("BC: duplicate variant SKU "), v["sku"])),
                    F.when(F.coalesce(F.size(v["option_values"]), F.lit(0)) <= 0, F.concat(F.lit("BC: variant "), F.coalesce(v["sku"], F.lit("")), F.lit(" missing option_values"))),
                )
            ),
        )
    )
    return F.concat(F.array_compact(F.array(F.when(F.coalesce(sku, F.lit("")) == "", F.lit("BC: root SKU missing")))), per)


# Fixed values: (field, least length, most length) of a product's texts.
TEXT_BOUNDS = [("name", 3, 255), ("sku", 1, 60), ("description", 30, None), ("meta_title", None, 70), ("meta_description", None, 160)]


def schema_errors(fields: dict[str, Column], required: list[str]) -> Column:
    """Messages on required texts that are missing and on texts outside their bounds."""
    checks = [F.when(fields[f].isNull(), F.lit(f"Schema: {f} is required")) for f in required]
    for f, low, high in TEXT_BOUNDS:
        if f in fields:
            if low:
                checks.append(F.when(F.length(fields[f]) < low, F.lit(f"Schema: {f} is too short")))
            if high:
                checks.append(F.when(F.length(fields[f]) > high, F.lit(f"Schema: {f} is too long")))
    return F.array_compact(F.array(*checks))


def product_errors(fields: dict[str, Column]) -> Column:
    """Every breach of the product schema: required fields, lengths, a price of nothing or more, addresses, lists and their elements.

    ``fields`` has any of name, sku, brand, price, description, short_description, images,
    categories, faq, variants, meta_title and meta_description; those it lacks count as missing.
    """
    get = lambda f: fields.get(f, F.lit(None))
    required = [F.when(get(f).isNull(), F.lit(f"Schema: '{f}' is required")) for f in ("name", "sku", "brand", "price", "description", "categories")]
    texts = [c for f, low, high in TEXT_BOUNDS if f in fields for c in (F.when(F.length(fields[f]) < low, F.lit(f"Schema: {f} is too short")) if low else None, F.when(F.length(fields[f]) > high, F.lit(f"Schema: {f} is too long")) if high else None) if c is not None]
    checks = [*required, *texts]
    if "brand" in fields:
        checks.append(F.when(F.length(fields["brand"]) < 1, F.lit("Schema: brand is too short")))
    if "price" in fields:
        checks.append(F.when(fields["price"] < 0, F.lit("Schema: price is below 0")))
    if "images" in fields:
        checks += [F.when(F.size(fields["images"]) == 0, F.lit("Schema: images is empty")), F.when(F.exists(fields["images"], lambda u: ~address(u)), F.lit("Schema: images holds no address"))]
    if "categories" in fields:
        checks += [F.when(F.size(fields["categories"]) == 0, F.lit("Schema: categories is empty")), F.when(F.exists(fields["categories"], lambda c: F.length(c) < 2), F.lit("Schema: a category is too short"))]
    if "faq" in fields:
        checks.append(F.when(F.exists(fields["faq"], lambda x: x["q"].isNull() | x["a"].isNull()), F.lit("Schema: faq lacks a question or an answer")))
    if "variants" in fields:
        v = fields["variants"]
        options = lambda x: F.coalesce(x["option_values"], F.array().cast("array<struct<option_name:string,value:string>>"))
        checks += [
            F.when(F.exists(v, lambda x: x["sku"].isNull() | x["price"].isNull() | x["option_values"].isNull()), F.lit("Schema: a variant lacks sku, price or option_values")),
            F.when(F.exists(v, lambda x: x["price"] < 0), F.lit("Schema: a variant's price is below 0")),
            F.when(F.exists(v, lambda x: F.exists(options(x), lambda o: o["option_name"].isNull() | o["value"].isNull())), F.lit("Schema: an option lacks its name or value")),
        ]
    return F.array_compact(F.array(*checks))


def address(url: Column) -> Column:
    """Is it an address with a scheme and something behind it, without blanks?"""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+\S*$"), F.lit(False))


# Texts that a written description and a set of search texts must have, with least and most length.
DESCRIPTION_TEXTS = {**dict.fromkeys(("hook_html", "main_description_html", "features_html", "specs_html", "why_choose_html", "faq_html"), (1, None)), "name_best": (0, None), "short_name_60": (0, None)}
SEARCH_TEXTS = {"h1": (1, 200), "title": (1, 100), "meta_description": (0, 320)}


def text_errors(fields: dict[str, Column], bounds: dict[str, tuple[int, int | None]]) -> Column:
    """``/field must ...`` of every required text that is missing or outside its bounds."""
    out = []
    for f, (low, high) in bounds.items():
        c = fields.get(f, F.lit(None).cast("string"))
        out.append(F.when(c.isNull(), F.lit(f"/ must have required property '{f}'")).when(F.length(c) < low, F.lit(f"/{f} must NOT have fewer than {low} characters")).when(F.length(c) > (high or 2**31 - 1), F.lit(f"/{f} must NOT have more than {high} characters")))
    return F.array_compact(F.array(*out))


def variant_errors(variants: DataFrame, key: str) -> DataFrame:
    """(key, error, times): skus that more than one variant of a product has, and variants without options, counted.

    ``variants`` has key, sku and option_values. The counts are added up before anything moves,
    so a product with very many variants is no task of its own.
    """
    rows = variants.groupBy(key, "sku").agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.size("option_values"), F.lit(0)) <= 0, 1).otherwise(0)).alias("bare"))
    name = F.coalesce("sku", F.lit(""))
    kinds = F.array(F.struct(F.concat(F.lit("BC: duplicate variant SKU "), F.col("sku")).alias("error"), (F.col("n") - 1).alias("times")), F.struct(F.concat(F.lit("BC: variant "), name, F.lit(" missing option_values")).alias("error"), F.col("bare").alias("times")))
    return rows.select(key, F.inline(kinds)).where("error is not null and times > 0").select(key, "error", F.col("times").cast("bigint").alias("times"))
