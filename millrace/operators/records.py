"""Parts of a product record: codes, brand, name, provenance of features, fields for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import lines as L, specs as S, text as T

# How much a code is trusted by where it was found, and first words of names that are no brand.
CODE_SOURCES = {"structured": 5, "open_graph": 4, "itemprop": 4, "item_number": 4, "data_attribute": 3, "labelled": 3, "url": 1}
NO_BRAND = [
    "the", "a", "an", "with", "and", "for", "of", "by", "pro", "basic", "mechanical", "digital", "portable", "heavy", "duty", "heavy-duty", "antimicrobial", "large", "small", "medium", "xl", "xxl", "xs", "x-large",
    "extra-large", "xlarge", "sm", "md", "lg", "eye", "level", "waist", "high", "chair", "floor", "platform", "scale",
]
CODE_LABELS = r"(?i)(?<![A-Za-z0-9_])(?:sku|product\s*id|item\s*(?:number|no|#)?|model\s*(?:number|no|#)?|part\s*(?:number|no|#)?|product\s*code|code)\s*[:#]\s*([A-Za-z0-9][A-Za-z0-9._/\-]{1,39})"


def is_gtin(x: Column) -> Column:
    return x.rlike("^[0-9]+$") & F.length(x).isin(8, 12, 13, 14)


def ranked_codes(candidates: DataFrame, key: str) -> DataFrame:
    """(key, rank, code, score) of (key, ord, source, code): each code once, the best first.

    Of codes equal but for case the first counts, with its own source. Numbers of the length of
    a trade number are left out. Ties go by ord.
    """
    clean = candidates.select(key, "ord", "source", T.squeeze(F.col("code")).alias("code")).where((F.col("code") != "") & ~is_gtin(F.col("code")))
    first = clean.groupBy(key, F.lower("code").alias("_low")).agg(F.min_by(F.struct("code", "source", "ord"), F.struct("ord", "source", "code")).alias("x")).select(key, "x.*")
    base = F.coalesce(F.try_element_at(F.create_map(*[v for k, n in CODE_SOURCES.items() for v in (F.lit(k), F.lit(n))]), F.col("source")), F.lit(0))
    score = base + F.when(F.col("code").rlike("[A-Za-z]") & F.col("code").rlike("[0-9]"), 2).otherwise(0) + F.when(F.length("code").between(3, 40), 1).otherwise(0)
    scored = first.withColumn("score", score.cast("bigint"))
    return scored.select(key, F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "ord", "code")).cast("bigint").alias("rank"), "code", "score")


def labelled_codes(text: Column) -> Column:
    """Codes that follow a label such as ``SKU:`` or ``Item #``."""
    return F.regexp_extract_all(text, F.lit(CODE_LABELS), F.lit(1))


def brand_of_name(name: Column) -> Column:
    """The first word of a name if it is written like a brand, else ''."""
    first = F.coalesce(F.element_at(F.split(T.squeeze(name), " "), 1), F.lit(""))
    return F.when(first.rlike(r"^[A-Z][A-Za-z0-9\-]+$") & ~F.lower(first).isin(*NO_BRAND), first).otherwise("")


def codes_of_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    found = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in ("/item/([^/?#]+)", "/p/([a-z0-9._-]+)", "/product/([a-z0-9._-]+)")]
    return F.array_compact(F.array(*found))


def family_of_url(url: Column) -> Column:
    """struct(slug_full, family_id) of a ``product-page.x`` URL; '' where it is none."""
    full = F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)product-page[.]([a-z0-9-]+)", 1)
    return F.struct(full.alias("slug_full"), F.regexp_replace(full, "[0-9-]+$", "").alias("family_id"))


def repaired_name(name: Column, brand: Column, og_title: Column, url: Column) -> Column:
    """A name that is only the brand gives way to the page's title, then to the last part of its URL."""
    last = F.regexp_replace(F.try_element_at(F.filter(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""), "/"), lambda p: p != ""), F.lit(-1)), "[-_]+", " ")
    bare = F.lower(T.squeeze(name)) == F.lower(T.squeeze(brand))
    return F.when(bare, F.coalesce(T.non_blank(og_title), T.non_blank(last), name)).otherwise(name)


def looks_like_url(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike(r"https?://|www\.|product for ")


def specs_from_features(specs: Column, features: Column) -> Column:
    """struct(specs, features): a record without specs takes the feature lines that read as such."""
    read = lambda x: S.spec_line(x)
    pairs = F.filter(F.transform(features, read), lambda p: p.isNotNull())
    taken = (F.coalesce(F.size(F.map_keys(specs)), F.lit(0)) <= 0) & (F.size(pairs) > 0)
    return F.struct(F.when(taken, S.last_wins(pairs)).otherwise(specs).alias("specs"), F.when(taken, F.filter(features, lambda x: read(x).isNull())).otherwise(features).alias("features"))


def by_source(structured: Column, documents: Column, browsed: Column, raw: Column) -> Column:
    """struct(structured, documents, browsed, html, combined): feature lists by where they come from, each without near-repeats, and together in that order."""
    none = F.array().cast("array<string>")
    s, d, b = (F.coalesce(x, none) for x in (structured, documents, browsed))
    html = T.bound(F.transform(F.concat(s, d, b), F.lower), lambda known: F.filter(F.coalesce(raw, none), lambda x: ~F.array_contains(known, F.lower(x))))
    lists = [L.without_similar(x) for x in (s, d, b, html)]
    return F.struct(*(x.alias(n) for x, n in zip(lists, ("structured", "documents", "browsed", "html"))), L.distinct_in_order(F.concat(*lists)).alias("combined"))


def by_class(lines: Column) -> Column:
    """feature, benefit and included to the lines of each."""
    return F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("key"), F.filter(lines, lambda x: L.sentence_class(x) == c).alias("value")) for c in ("feature", "benefit", "included"))))  # noqa: B023


def full_name(brand: Column, application: Column, size: Column, ply: Column, sterility: Column, count: Column, code: Column) -> Column:
    """The filled parts joined by commas, and the code in brackets."""
    filled = F.array_compact(F.array(T.non_blank(F.replace(brand, F.lit("®"), F.lit(""))), *(T.non_blank(x) for x in (application, size, ply, sterility)), F.when(count.isNotNull(), F.concat(count.cast("string"), F.lit("/Pack")))))
    parts = F.array_join(filled, ", ")
    return T.squeeze(F.concat(parts, F.coalesce(F.concat(F.lit(" ("), T.non_blank(code), F.lit(")")), F.lit(""))))


def search_fields(name: Column, description: Column, specs: Column, features: Column) -> Column:
    """struct(title, meta, keywords, slug) as they come without editing."""
    flat = T.strip(F.regexp_replace(F.coalesce(description, F.lit("")), "\n+", " "))
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce(F.array_sort(F.map_keys(specs)), none), F.coalesce(features, none))
    return F.struct(F.coalesce(name, F.lit("")).alias("title"), F.substr(flat, F.lit(1), F.lit(155)).alias("meta"), F.lower(F.array_join(words, ", ")).alias("keywords"), T.slug(F.coalesce(name, F.lit(""))).alias("slug"))


def signed(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex of a text, of built-in hashes only: h(key xor o-pad, h(key xor i-pad, text))."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signature_holds(payload: Column, given: Column, secret: str) -> Column:
    """Is the given signature the payload's? A missing one isn't."""
    return F.coalesce(F.lower(given) == signed(payload, secret), F.lit(False))


def with_manual_texts(records: DataFrame, key: str, manuals: str, texts: DataFrame, most: int = 5) -> DataFrame:
    """records + (manual_text, manuals_failed): texts (url, text) of each record's first ``most`` distinct manuals, in order, and the URLs without one.

    ``most`` is the operator's own limit of manuals read for a record.
    """
    listed = records.select(key, F.posexplode(F.slice(F.array_distinct(F.filter(manuals, lambda u: u.isNotNull())), 1, most)).alias("_pos", "url"))
    once = texts.groupBy("url").agg(F.max("text").alias("text"))
    met = listed.join(once, "url", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pos", "url", "text"))).alias("_m"))  # at most `most` entries
    joined = met.select(key, F.array_join(F.transform(F.filter("_m", lambda m: m["text"].isNotNull()), lambda m: m["text"]), "\n\n").alias("manual_text"), F.transform(F.filter("_m", lambda m: m["text"].isNull()), lambda m: m["url"]).alias("manuals_failed"))
    return records.join(joined, key, "left")


def merged_structured(json_ld: Column, microdata: Column, rdfa: Column) -> Column:
    """One struct(name, brand, description, specs, images, features) of three such: filled texts and specs by priority, images and features as ordered unions."""
    sides = (json_ld, microdata, rdfa)
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    text = lambda f: F.coalesce(*(T.non_blank(s[f]) for s in sides), F.lit("")).alias(f)
    specs = S.overlaid(S.overlaid(F.coalesce(rdfa["specs"], empty), F.coalesce(microdata["specs"], empty)), F.coalesce(json_ld["specs"], empty))
    together = lambda f: F.concat(*(F.coalesce(s[f], none) for s in sides))
    return F.struct(text("name"), text("brand"), text("description"), specs.alias("specs"), F.array_distinct(together("images")).alias("images"), L.distinct_in_order(together("features")).alias("features"))


def open_graph_specs(properties: Column) -> Column:
    """``product:x`` entries of a page's properties as specs, prices left out."""
    kept = F.map_filter(properties, lambda k, v: k.startswith("product:") & ~F.contains(k, F.lit("price")) & (T.strip(v) != ""))
    return F.transform_keys(kept, lambda k, v: F.replace(F.substr(k, F.lit(9)), F.lit(":"), F.lit("_")))
