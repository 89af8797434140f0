"""From a page of markup to a product record, each page parsed once and all else in its own row.

page_parts() gives what a page consists of as nested columns: its blocks with their text and
where they stand, key/value pairs, option groups and tab panels. What these say about the
product is told by column expressions over them, so a record needs no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import lines as L, specs as S, text as T
from millrace.operators import media, records as R
from millrace.operators.pages import _Builder

# Classes, ids and roles of page furniture, of lists of other products, of main parts, of feature lists and of
# descriptions, in this order.
CHROME_MARKS = frozenset("footer site-footer page-footer global-footer nav navbar breadcrumbs legal legalese bottom-bar cookie consent newsletter subscribe sitemap".split())
OTHER_MARKS = frozenset(
    "related related-products upsell cross-sell crosssell you-may-also-like recommended recommendations product-recommendations product-recs frequently-bought frequently-bought-together fbt also-viewed people-also-viewed also-bought customers-also-bought similar-products more-like-this "
    "recommended-for-you recommendation recommended-items recommended-products related-items related-content you-may-also-be-interested you-may-be-interested customers-viewed customers-also-viewed product-suggestions suggested-products co-viewed".split()
)
MAIN_MARKS = frozenset("main content product product-detail product-details product__info".split())
FEATURE_MARKS = frozenset("features feature-list product-features product-highlights key-features highlights".split())
ABOUT_MARKS = frozenset("product-description long-description product-details product-detail description details copy product__description overview product-overview intro summary tab-content tabs-content accordion-content product-tabs product-info".split())
OPTION_MARKS = frozenset("product-options product-option option-group swatch".split())
OPTION_COLUMNS = ["color", "size", "dimensions", "dimension", "gauge", "width", "length", "height", "volume", "capacity"]
LEGAL = r"(?i)\b(?:privacy|terms|cookies?|trademark|copyright|©|™|®|newsletter|subscribe|sitemap|back\s*to\s*top|about|careers|press|blog|faq|support|returns?|shipping|track\s*order|store\s*locator|contact|account|login|sign\s*in)\b"
PART_TABLE = re.compile(r"(?i)\b(?:no\.?|part(?:\s*no\.?)?|item(?:\s*description)?|qty(?:\s*req\.)?|quantity|price)\b")
_LEGAL = re.compile(LEGAL)
_BLOCKS = frozenset("title h1 h2 h3 h4 h5 h6 p li dt dd th td a label option strong b".split())
_KEPT = _BLOCKS | {"img", "meta", "link", "script"}
_SCHEMA = (
    "struct<blocks:array<struct<ord:int,tag:string,text:string,attrs:map<string,string>,chrome:boolean,other:boolean,main:boolean,features:boolean,about:int>>,"
    "pairs:array<struct<channel:string,key:string,value:string>>,options:array<struct<name:string,values:array<string>>>,tabs:array<struct<title:string,text:string,source:string>>>"
)


class _Page(_Builder):
    """A tree of elements that knows what part of the page each stands in."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        node = self.nodes[-1]
        up = self.nodes[node["parent"]] if node["parent"] is not None else {}
        known = node["attrs"]
        marks = {*node["classes"], known.get("id", "")}
        label = known.get("aria-label", "").lower()
        node["chrome"] = up.get("chrome", False) or tag in ("footer", "nav") or bool(marks & CHROME_MARKS) or known.get("role") in ("navigation", "contentinfo") or "footer" in label or "breadcrumb" in label
        node["other"] = up.get("other", False) or bool(marks & OTHER_MARKS) or "data-recommendations" in known or "data-related-products" in known or "data-upsell" in known
        node["main"] = up.get("main", False) or tag == "main" or bool(marks & MAIN_MARKS)
        node["features"] = up.get("features", False) or bool(marks & FEATURE_MARKS) or "data-features" in known
        about = up.get("about", -1)
        node["about"] = node["ord"] if about < 0 and (bool(marks & ABOUT_MARKS) or known.get("itemprop") == "description" or known.get("role") == "tabpanel") else about


def _pairs(page: _Page) -> Iterator[tuple[str, str, str]]:
    """Rows of two cells or more, terms with their descriptions, and items ``K: V``, outside furniture, other products and part tables."""
    for node in page.nodes:
        if node["chrome"] or node["other"]:
            continue
        if node["tag"] == "table":
            rows = [[page.text(c) for c in page.below(r, "th", "td")] for r in page.below(node, "tr")]
            filled = [r for r in rows if len(r) >= 2]
            links = sum(any(re.search("/(?:item|product)/", a["attrs"].get("href", "")) for a in page.below(r, "a")) for r in page.below(node, "tr"))
            if rows and PART_TABLE.search(" | ".join(rows[0])) or len(filled) >= 3 and sum(r[0].isdigit() for r in filled) >= 2 and links >= 2:
                continue
            yield from (("table", r[0], r[1]) for r in filled)
        elif node["tag"] == "dl":
            names, values = page.below(node, "dt"), page.below(node, "dd")
            if len(names) == len(values):
                yield from (("terms", page.text(a), page.text(b)) for a, b in zip(names, values))
        elif node["tag"] in ("li", "p"):
            if m := re.fullmatch(r"([^:]{2,60}):\s+(.{2,300})", page.text(node)):
                yield ("line", m[1], m[2])


def _options(page: _Page) -> Iterator[tuple[str, list[str]]]:
    """Option names with their values: select lists, labelled groups of buttons, table columns headed like options."""
    selects = 0
    for node in page.nodes:
        if node["tag"] == "select":
            selects += 1
            name = node["attrs"].get("data-option-name") or node["attrs"].get("name") or node["attrs"].get("id")
            values = [t for o in page.below(node, "option") if (t := page.text(o)) and not t.lower().startswith("select")]
            yield re.sub("[_-]+", " ", name) if name else f"Option {selects}", values
        elif set(node["classes"]) & OPTION_MARKS:
            labels = page.below(node, "label")
            inner = page.nodes[node["ord"] + 1 : node["last"] + 1]
            values = [t for n in inner if (n["tag"] in ("button", "li") or {"swatch-option", "option-value"} & set(n["classes"])) and (t := page.text(n))]
            if labels and (label := page.text(labels[0])):
                yield label, values
        elif node["tag"] == "table":
            heads = [page.text(th) for head in page.below(node, "thead") for th in page.below(head, "th")]
            rows = [[page.text(c) for c in page.below(r, "td")] for body in page.below(node, "tbody") for r in page.below(body, "tr")]
            if len(heads) >= 2:
                for i, head in enumerate(heads):
                    if any(w in head.lower() for w in OPTION_COLUMNS):
                        yield head, [r[i] for r in rows if i < len(r) and r[i]]


# Classes of the parts of tab sets by shop platform: (source, classes of the list of titles, classes of a panel).
TAB_SETS = [
    ("woocommerce", {"wc-tabs"}, {"woocommerce-Tabs-panel"}), ("bootstrap", {"nav-tabs"}, {"tab-pane"}), ("shopify", {"tabs"}, {"accordion__panel"}), ("magento", {"items"}, {"content"}),
    ("squarespace", {"sqs-tabs", "tabs-nav", "tab-nav"}, {"tab"}), ("aem", {"cmp-tabs__tablist"}, {"cmp-tabs__tabpanel"}),
]
_HEADS = ("h2", "h3", "h4")
_WANTED = re.compile(r"(?i)products?\s+include|what'?s?\s+in\s+the\s+box|\b(?:inclusions?|package\s+contents?)\b|\b(?:specs?|specifications?)\b|\bfeatures?\b")


def _tabs(page: _Page) -> Iterator[tuple[str, str, str]]:
    """(title, text, source) of tab panels, of headed parts in tab sets and accordions, and of sections with a telling heading; each once."""
    seen = set()

    def once(title: str, text: str, source: str) -> Iterator[tuple[str, str, str]]:
        if text and (title, text[:256]) not in seen:
            seen.add((title, text[:256]))
            yield title, text, source

    titles: dict[str, str] = {}
    for node in page.nodes:
        if node["attrs"].get("role") == "tab" or node["tag"] in ("a", "button"):
            target = node["attrs"].get("aria-controls") or node["attrs"].get("href", "").lstrip("#") or node["attrs"].get("data-target", "").lstrip("#")
            if target and node["attrs"].get("href", "#").startswith("#") and (t := page.text(node)):
                titles.setdefault(target, t)
    for node in page.nodes:
        marks, key = set(node["classes"]), node["attrs"].get("id", "")
        source = next((s for s, _, panel in TAB_SETS if marks & panel and (s != "magento" or "item" in marks)), "aria" if node["attrs"].get("role") == "tabpanel" else "shopify" if key in titles else "")
        if source:
            heads = page.below(node, *_HEADS)
            yield from once(titles.get(key) or node["attrs"].get("aria-label") or (page.text(heads[0]) if heads else ""), page.text(node), source)
    for node in page.nodes:
        if set(node["classes"]) & {"tabs", "tabset", "tabbed", "et_pb_tabs", "accordion", "et_pb_accordion", "accordion-item", "sqs-block-accordion-item"}:
            for head in page.below(node, *_HEADS):
                parts, at = [], head["last"] + 1
                while at <= node["last"] and page.nodes[at]["parent"] == head["parent"] and page.nodes[at]["tag"] not in _HEADS:
                    parts.append(page.text(page.nodes[at]))
                    at = page.nodes[at]["last"] + 1
                if title := page.text(head):
                    yield from once(title, " ".join(p for p in parts if p), "generic")
    for node in page.nodes:
        if node["tag"] in ("section", "div", "article") and (heads := page.below(node, *_HEADS)) and _WANTED.search(title := page.text(heads[0])):
            yield from once(title, page.text(node), "heuristic")


def read_page(html: str) -> dict:
    """The parts of one page."""
    page = _Page()
    page.feed(html)
    page.close()
    page._close_to(0)
    blocks = []
    for n in page.nodes:
        if n["tag"] in _KEPT or "itemprop" in n["attrs"] or any(k.startswith("data-") for k in n["attrs"]):
            blocks.append({k: n[k] for k in ("ord", "tag", "attrs", "chrome", "other", "main", "features", "about")} | {"text": page.text(n) if n["tag"] in _BLOCKS or n["tag"] == "script" or "itemprop" in n["attrs"] else ""})
    pairs = [{"channel": c, "key": k, "value": v} for c, k, v in _pairs(page) if k and v and len(k) < 80 and len(v) < 400 and not _LEGAL.search(k) and not _LEGAL.search(v)]
    options = [{"name": n, "values": list(dict.fromkeys(v))} for n, v in _options(page) if len(set(v)) > 1]
    return {"blocks": blocks, "pairs": pairs, "options": options, "tabs": [{"title": t, "text": x, "source": s} for t, x, s in _tabs(page)]}


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = [read_page(h) if isinstance(h, str) else {"blocks": [], "pairs": [], "options": [], "tabs": []} for h in pages]
        yield pd.DataFrame(rows, columns=["blocks", "pairs", "options", "tabs"])


def page_parts(pages: DataFrame, html: str = "html", most_bytes: int = 3_000_000) -> DataFrame:
    """pages + (blocks, pairs, options, tabs); null pages and those beyond most_bytes, the feature's own limit, have none.

    Plan: one Arrow UDF for each page, nothing moves. It is said to be nondeterministic, so that it runs once however many
    expressions read its parts.
    """
    bounded = F.when(F.octet_length(html) <= most_bytes, F.col(html))
    parsed = pages.withColumn("_parts", F.pandas_udf(_read, _SCHEMA).asNondeterministic()(bounded))
    return parsed.select(*pages.columns, "_parts.*")


def _attr(x: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(x["attrs"], F.lit(name)), F.lit(""))


def first_text(blocks: Column, *tags: str) -> Column:
    return F.coalesce(F.get(F.filter(blocks, lambda x: x["tag"].isin(*tags)), 0)["text"], F.lit(""))


def meta(blocks: Column, name: str) -> Column:
    """The content of the first meta of a property or name, else ''."""
    return F.coalesce(_attr(F.get(F.filter(blocks, lambda x: (x["tag"] == "meta") & ((_attr(x, "property") == name) | (_attr(x, "name") == name))), 0), "content"), F.lit(""))


def structured_product(blocks: Column) -> Column:
    """The first JSON-LD node that is a product, as VARIANT, lists and graphs opened; null if there is none."""
    scripts = F.filter(blocks, lambda x: (x["tag"] == "script") & (F.lower(_attr(x, "type")) == "application/ld+json"))
    docs = F.filter(F.transform(scripts, lambda x: F.try_parse_json(x["text"])), lambda d: d.isNotNull())
    nodes = F.flatten(F.transform(docs, lambda d: F.coalesce(F.try_variant_get(d, "$", "array<variant>"), F.try_variant_get(d, "$.@graph", "array<variant>"), F.array(d))))
    get = lambda n, path: F.try_variant_get(n, path, "string")
    is_one = lambda n: (get(n, "$.@type") == "Product") | (get(n, "$.name").isNotNull() & (get(n, "$.sku").isNotNull() | get(n, "$.mpn").isNotNull()))
    return F.get(F.filter(nodes, lambda n: F.coalesce(is_one(n), F.lit(False))), 0)


def property_specs(product: Column) -> Column:
    """The additionalProperty list of a structured product as specs, the last of a name counting."""
    rows = F.coalesce(F.try_variant_get(product, "$.additionalProperty", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    pairs = F.transform(rows, lambda p: F.struct(F.regexp_replace(F.lower(T.strip(F.coalesce(p["name"], F.lit("")))), r"\s+", "_").alias("key"), T.strip(F.coalesce(p["value"], F.lit(""))).alias("value")))
    return S.last_wins(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))


def microdata(blocks: Column, name: str) -> Column:
    """Content or text of the first element of an itemprop, else ''."""
    hit = F.get(F.filter(blocks, lambda x: _attr(x, "itemprop") == name), 0)
    return F.coalesce(F.coalesce(F.nullif(_attr(hit, "content"), F.lit("")), hit["text"]), F.lit(""))


def page_description(blocks: Column) -> Column:
    """The longest text of a description container, headings and stressed words before paragraphs; else the longest paragraph of the main part.

    Furniture and legal texts don't count.
    """
    usable = F.filter(blocks, lambda x: ~x["chrome"] & x["tag"].isin("h1", "h2", "h3", "h4", "h5", "strong", "b", "p") & (x["text"] != ""))

    def longest(xs: Column) -> Column:
        areas = F.array_distinct(F.transform(F.filter(xs, lambda x: x["about"] >= 0), lambda x: x["about"]))
        joined = lambda a, p: F.array_join(F.transform(F.filter(xs, lambda x: (x["about"] == a) & ((x["tag"] == "p") == p)), lambda x: x["text"]), " ")
        texts = F.filter(F.transform(areas, lambda a: T.squeeze(F.concat(joined(a, F.lit(False)), F.lit(" "), joined(a, F.lit(True))))), lambda t: (t != "") & ~t.rlike(LEGAL))
        paragraphs = F.transform(F.filter(xs, lambda x: x["main"] & (x["tag"] == "p") & ~x["text"].rlike(LEGAL)), lambda x: x["text"])
        top = lambda ts: F.array_max(F.transform(ts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
        return F.coalesce(top(texts), top(paragraphs), F.lit(""))

    return T.bound(usable, longest)


def feature_text(x: Column, most: int = 500) -> Column:
    """May a text be a feature: its length, no arrows, legal words, addresses or phrases of site navigation?"""
    return F.length(x).between(7, most) & ~x.rlike(">|›|»") & ~x.rlike(r"(?i)\b(?:privacy|terms|trademark|copyright|newsletter|subscribe)\b|https?://|www\.") & ~F.lower(x).rlike("|".join(re.escape(p) for p in L.NAVIGATION_PHRASES))


def page_features(blocks: Column, tabs: Column, most: int = 20) -> Column:
    """Items and headings of feature lists, in order, each once; without any the sentences of the main part's paragraphs and its items.

    ``most`` is the feature's own limit, 30 for sentences.
    """
    listed = F.filter(blocks, lambda x: x["features"] & ~x["chrome"] & ~x["other"] & x["tag"].isin("li", "h3", "h4", "h5"))
    found = F.filter(F.transform(listed, lambda x: T.squeeze(x["text"])), lambda x: feature_text(x))
    main = F.filter(blocks, lambda x: x["main"] & ~x["chrome"] & ~x["other"])
    sentences = F.flatten(F.transform(F.filter(main, lambda x: x["tag"] == "p"), lambda x: T.sentences(T.squeeze(x["text"]))))
    items = F.transform(F.filter(main, lambda x: x["tag"] == "li"), lambda x: T.squeeze(x["text"]))
    prose = F.filter(F.concat(sentences, items), lambda x: feature_text(x, 400))
    return T.bound(F.slice(L.distinct_in_order(found), 1, most), lambda f: F.when(F.size(f) > 0, f).otherwise(F.slice(L.distinct_in_order(prose), 1, 30)))


def page_specs(pairs: Column, structured: Column) -> Column:
    """Canonical names to values with short units: tables and terms before lines, the page before structured data."""
    rank = lambda p: F.when(p["channel"] == "line", 1).otherwise(0)
    ordered = F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(rank(p).alias("r"), i.alias("i"), S.canonical_key(p["key"]).alias("key"), S.units_typed(p["value"]).alias("value")))), lambda p: F.struct(p["key"], p["value"]))
    own = S.first_wins(F.filter(ordered, lambda p: (p["key"] != "") & (p["value"] != "")))
    return S.enriched(T.bound(structured, lambda s: T.bound(own, lambda o: S.overlaid(s, o))))


def page_codes(blocks: Column, structured: Column) -> Column:
    """Codes of a page, the best first: structured data, open graph, itemprop, item numbers, data attributes, labelled texts.

    Numbers of the length of a trade number are left out; of codes equal but for case the first counts.
    """
    row = lambda v, source: F.struct(T.squeeze(v).alias("code"), F.lit(R.CODE_SOURCES[source]).alias("base"))
    several = lambda xs, source: F.transform(xs, lambda v: row(v, source))
    data = ("data-sku", "data-product-sku", "data-productid", "data-item", "data-item-number", "data-model-number")
    from_data = F.transform(blocks, lambda x: F.coalesce(*(F.nullif(_attr(x, d), F.lit("")) for d in data), F.lit("")))
    labelled = F.flatten(F.transform(F.filter(blocks, lambda x: x["tag"].isin("li", "p", "dt", "dd", "td")), lambda x: R.labelled_codes(x["text"])))
    every = F.concat(
        several(F.array(F.coalesce(F.try_variant_get(structured, "$.sku", "string"), F.lit("")), F.coalesce(F.try_variant_get(structured, "$.mpn", "string"), F.lit(""))), "structured"),
        several(F.array(meta(blocks, "product:retailer_item_id")), "open_graph"),
        several(F.array(microdata(blocks, "sku")), "itemprop"),
        several(F.transform(F.filter(blocks, lambda x: F.array_contains(F.split(_attr(x, "class"), " "), "item-number")), lambda x: F.regexp_extract(x["text"], r"(?i)^item\s+([A-Za-z0-9][A-Za-z0-9._\-/]{1,40})$", 1)), "item_number"),
        several(from_data, "data_attribute"),
        several(labelled, "labelled"),
    )
    good = F.filter(every, lambda c: (c["code"] != "") & ~R.is_gtin(c["code"]))
    once = T.first_of_each(good, lambda c: F.lower(c["code"]))
    score = lambda c: c["base"] + F.when(c["code"].rlike("[A-Za-z]") & c["code"].rlike("[0-9]"), 2).otherwise(0) + F.when(F.length(c["code"]).between(3, 40), 1).otherwise(0)
    return F.transform(F.array_sort(F.transform(once, lambda c, i: F.struct((-score(c)).alias("s"), i.alias("i"), c["code"].alias("code")))), lambda c: c["code"])


# Words of classes, alternative texts and addresses of images that show no product.
NO_PRODUCT_IMAGE = r"swatch|logo|favicon|brandmark|badge|trust|payment|visa|mastercard|paypal|icons?(?:[/_.-]|$)|sprite|placeholder|banner|hero|noimage|no[-_]image|coming[-_]?soon"


def page_images(blocks: Column, structured: Column, url: Column, least_side: int = 0, most: int = 12) -> Column:
    """URLs of product images, each photo once: stated ones, then those of the main part, then others; small declared sides are left out.

    An image counts by the larger of its declared sides (attribute, style or URL); one whose
    class, alternative text or URL has words of logos, swatches and the like is none.
    """
    row = lambda u, main, i, side: F.struct(main.alias("m"), i.alias("i"), u.alias("u"), side.alias("side"))
    zero = F.lit(0)
    stated = F.transform(
        F.filter(F.concat(F.coalesce(F.try_variant_get(structured, "$.image", "array<string>"), F.array(F.coalesce(F.try_variant_get(structured, "$.image.url", "string"), F.try_variant_get(structured, "$.image", "string"), F.lit("")))), F.array(meta(blocks, "og:image"))), lambda u: F.coalesce(u, F.lit("")) != ""),
        lambda u, i: row(u, zero, i, zero),
    )
    shown = F.filter(blocks, lambda x: (x["tag"] == "img") & ~x["chrome"] & ~x["other"] & ~F.lower(F.concat_ws(" ", _attr(x, "class"), _attr(x, "alt"))).rlike(NO_PRODUCT_IMAGE))
    source = lambda x: F.coalesce(media.largest_source(F.nullif(_attr(x, "srcset"), F.lit(""))), F.nullif(_attr(x, "data-src"), F.lit("")), _attr(x, "src"))
    side = lambda x: F.greatest(css_pixels(_attr(x, "width")), css_pixels(_attr(x, "height")), css_pixels(F.regexp_extract(_attr(x, "style"), r"(?i)(?:^|[;\s])(?:max-)?width\s*:\s*([^;]+)", 1)))
    from_page = F.transform(shown, lambda x: row(source(x), F.when(x["main"], 1).otherwise(2), x["ord"], side(x)))
    usable = F.filter(F.concat(stated, from_page), lambda r: (r["u"] != "") & ~r["u"].rlike(f"(?i){NO_PRODUCT_IMAGE}") & ((r["side"] == 0) | (r["side"] >= least_side)))
    sized = F.transform(F.array_sort(usable), lambda r: F.struct(T.absolute(url, r["u"]).alias("u")))
    once = T.first_of_each(sized, lambda r: media.image_key(r["u"]))
    return F.slice(F.transform(once, lambda r: r["u"]), 1, most)


def css_pixels(x: Column) -> Column:
    """The number of a length in pixels or without a unit, else 0."""
    return F.coalesce(F.regexp_extract(T.strip(F.coalesce(x, F.lit(""))), r"^([0-9]+(?:\.[0-9]+)?)(?:px)?$", 1).try_cast("double"), F.lit(0.0)).cast("int")


def page_manuals(blocks: Column, url: Column, code: Column, name: Column) -> Column:
    """URLs of documents with words of manuals, those with the code or the name's first word first."""
    links = F.filter(F.transform(F.filter(blocks, lambda x: x["tag"] == "a"), lambda x: F.replace(T.strip(F.regexp_replace(T.absolute(url, _attr(x, "href")), "#.*$", "")), F.lit(" "), F.lit("%20"))), lambda u: F.lower(u).rlike(r"\.pdf(?:$|[?])"))
    good = F.filter(F.array_distinct(links), lambda u: F.lower(u).rlike(media.MANUAL_WORDS) & ~F.lower(u).rlike(f"(?:^|[^a-z])(?:{media.OTHER_WORDS})(?:[^a-z]|$)"))
    word = F.coalesce(F.get(F.split(T.squeeze(name), " "), 0), F.lit(""))
    return F.transform(F.array_sort(F.transform(good, lambda u, i: F.struct((-media.manual_score(u, code, word)).alias("s"), i.alias("i"), u.alias("u")))), lambda r: r["u"])


def page_records(pages: DataFrame, url: str = "url", html: str = "html", least_side: int = 0) -> DataFrame:
    """pages without html + (source, name_raw, description_raw, specs, features_raw, images, manuals, brand, sku, option_groups, tabs).

    Structured data come first for name, brand, description and code, then open graph and the
    page's own parts. Null and empty pages give empty fields. Plan: one parse of each page and
    expressions over its parts; no shuffle.
    """
    parts = page_parts(pages, html).withColumn("_p", structured_product(F.col("blocks")))
    b, p = F.col("blocks"), F.col("_p")
    get = lambda path: F.try_variant_get(p, path, "string")
    name = T.squeeze(T.first_filled(get("$.name"), microdata(b, "name"), meta(b, "og:title"), first_text(b, "h1")))
    named = parts.withColumns({"name_raw": name, "_brand": T.squeeze(T.first_filled(get("$.brand.name"), get("$.brand"), microdata(b, "brand")))})
    described = T.squeeze(T.first_filled(get("$.description"), microdata(b, "description"), page_description(b), meta(b, "og:description"), meta(b, "description")))
    codes = page_codes(b, p)
    coded = named.withColumns({"brand": F.when(F.col("_brand") != "", F.col("_brand")).otherwise(R.brand_of_name(F.col("name_raw"))), "sku": F.coalesce(F.get(codes, 0), F.lit(""))})
    full = coded.withColumns(
        {
            "source": F.col(url), "description_raw": described, "specs": page_specs(F.col("pairs"), property_specs(p)), "features_raw": page_features(b, F.col("tabs")), "images": page_images(b, p, F.col(url), least_side),
            "manuals": page_manuals(b, F.col(url), F.col("sku"), F.col("name_raw")), "option_groups": F.col("options"),
        }
    )
    fields = ["source", "name_raw", "description_raw", "specs", "features_raw", "images", "manuals", "brand", "sku", "option_groups", "tabs"]
    return full.select(*(c for c in pages.columns if c not in (html, *fields)), *fields)
