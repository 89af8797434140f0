"""Written product texts brought to their form, vendor keys to canonical ones, payloads and reports read from JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions import lines as L, specs as S, text as T

# Keys of one vendor's sheets and their fields; phrases and classes of its page furniture.
SHEET_FIELDS = {
    "mckesson": "mckesson_item", "mckesson #": "mckesson_item", "manufacturer #": "mpn", "manufacturer": "manufacturer", "brand": "brand", "country of origin": "country_of_origin", "application": "application", "color": "color", "dimensions": "dimensions", "length": "length", "material": "material",
    "number per pack": "count_per_pack", "ply": "ply", "shape": "shape", "shape range": "shape_range", "sterility": "sterility", "unspsc code": "unspsc", "width": "width", "latex free indicator": "latex_free_indicator", "hcpcs": "hcpcs", "fsa eligible - buy uom": "fsa_eligible",
    "unspsc_code": "unspsc", "mckesson_#": "mckesson_item", "manufacturer_#": "mpn",
}
FURNITURE_PHRASES = [
    "vaccine management", "biomedical equipment solutions", "instrument management services", "technology consultants", "medical waste management", "drug disposal and returns", "patient home delivery", "medical freight management", "lab consulting", "lab information systems", "lab results",
    "covid-19 vaccines are available", "flu season is coming", "order now", "pre-book",
]
FURNITURE_CLASSES = ["public-sub-menu", "highlight-image", "highlight-content"]


def sheet_fields(specs: Column) -> Column:
    """Canonical fields of a vendor's specs, the last of a field counting; other keys are left out.

    Marks go from brands, packs become a number, plies ``n‑ply``; latex_free tells whether the
    indicator says so. A missing brand is the manufacturer.
    """
    known = F.create_map(*[F.lit(x) for pair in SHEET_FIELDS.items() for x in pair])

    def value(f: Column, v: Column) -> Column:
        ply = F.coalesce(F.nullif(F.regexp_extract(v, r"(?i)(\d+)\s*-\s*ply|\b(\d+)\s*ply\b", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?i)(\d+)\s*-\s*ply|\b(\d+)\s*ply\b", 2), F.lit("")))
        return (
            F.when(f == "brand", T.strip(F.replace(v, F.lit("®"), F.lit(""))))
            .when(f == "count_per_pack", F.coalesce(F.nullif(F.regexp_extract(v, r"(\d+)", 1), F.lit("")), v))
            .when(f == "ply", F.coalesce(F.concat(ply, F.lit("‑ply")), T.squeeze(F.regexp_replace(v, "(?i)ply", "ply"))))
            .otherwise(v)
        )

    rows = F.transform(F.map_entries(specs), lambda e: F.struct(F.try_element_at(known, F.lower(T.strip(e["key"]))).alias("key"), T.strip(F.coalesce(e["value"], F.lit(""))).alias("value")))
    kept = F.transform(F.filter(rows, lambda r: r["key"].isNotNull() & (r["value"] != "")), lambda r: F.struct(r["key"], value(r["key"], r["value"]).alias("value")))

    def filled(out: Column) -> Column:
        get = lambda k: F.try_element_at(out, F.lit(k))
        latex = F.when(get("latex_free_indicator").isNotNull(), F.lower(get("latex_free_indicator")).contains("not made with natural rubber latex").cast("string"))
        more = F.array(F.struct(F.lit("latex_free").alias("key"), latex.alias("value")), F.struct(F.lit("brand").alias("key"), F.when(get("brand").isNull(), get("manufacturer")).alias("value")))
        return F.map_concat(out, F.map_from_entries(F.filter(more, lambda m: m["value"].isNotNull())))

    return T.bound(S.last_wins(kept), filled)


def furniture_tab(html: Column, text: Column) -> Column:
    """Is a tab no part of the product: empty, with marks or phrases of page furniture, or neither features nor a table of specifications?"""
    h, t = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))
    wanted = F.contains(h, F.lit("product-features")) | (F.contains(h, F.lit("product specifications")) & F.contains(h, F.lit("<table")))
    return ((h == "") & (t == "")) | any_of(h, FURNITURE_CLASSES) | any_of(t, FURNITURE_PHRASES) | ~wanted


def short_description(text: Column) -> Column:
    """The first two different lines or bullets before a heading of features or specifications, without furniture phrases."""
    rows = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"\r?\n|•\s+"), T.strip), lambda x: x != "")
    kept = F.filter(rows, lambda x: ~F.exists(F.array(*map(F.lit, FURNITURE_PHRASES)), lambda p: F.contains(F.lower(x), p)))

    def cut_at(xs: Column) -> Column:
        stop = F.get(F.filter(F.transform(xs, lambda x, i: F.when(F.lower(x).isin("features", "product specifications"), i)), lambda i: i.isNotNull()), 0)
        return F.array_join(F.slice(F.array_distinct(F.when(stop.isNotNull(), F.slice(xs, 1, stop)).otherwise(xs)), 1, 2), " ")

    return T.bound(kept, cut_at)


def safety_sheet(pdfs: Column, tab_htmls: Column) -> Column:
    """The first linked document, else the first document URL in the tabs' markup, else null."""
    inner = F.flatten(F.transform(F.coalesce(tab_htmls, F.array().cast("array<string>")), lambda h: F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(r"(?i)https?://[^\s\"'<>]+\.pdf"), F.lit(0))))
    return F.coalesce(F.nullif(F.get(pdfs, 0), F.lit("")), F.get(inner, 0))


def _each_item(html: Column, form) -> Column:
    """html with the inside of each list item formed anew."""
    pieces = F.split(html, "(?i)</li>")
    done = lambda p: F.concat(F.regexp_extract(p, r"(?is)^(.*?)<li>", 1), F.lit("<li>"), form(T.strip(F.regexp_extract(p, r"(?is)^.*?<li>(.*)$", 1))), F.lit("</li>"))
    body = lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p: F.when(p.rlike("(?i)<li>"), done(p)).otherwise(F.concat(p, F.lit("</li>"))))
    return T.bound(pieces, lambda ps: F.concat(F.array_join(body(ps), ""), F.element_at(ps, -1)))


def spec_items(html: Column) -> Column:
    """List items as ``<strong>Label</strong>: value``; an item without a colon keeps its stressed text or is all label."""

    def form(s: Column) -> Column:
        s = T.squeeze(s)
        at = F.instr(s, ":")
        label = T.strip(F.regexp_replace(F.substring(s, F.lit(1), at - 1), "(?i)</?strong>", ""))
        value = T.strip(F.regexp_replace(T.strip(F.substr(s, at + 1)), r"^[\s–-]+", ""))
        return F.when(at > 0, F.concat(F.lit("<strong>"), label, F.lit("</strong>: "), value)).when(s.rlike("(?i)<strong>.*</strong>"), s).otherwise(F.concat(F.lit("<strong>"), s, F.lit("</strong>:")))

    return _each_item(html, form)


def feature_items(html: Column) -> Column:
    """List items as ``<strong>Label</strong> – Text.``: parted at a dash, else at the first full stop or comma."""

    def form(s: Column) -> Column:
        s = T.short_dashes(s)
        parts = F.when(F.contains(s, F.lit(" – ")), F.split(s, " – ")).when(F.contains(s, F.lit(" - ")), F.split(s, " - "))
        first = F.regexp_extract(s, r"(?s)^(.*?)(?:[.,]\s+|$)", 1)
        head = F.coalesce(F.get(parts, 0), first)
        tail = F.when(parts.isNotNull(), F.coalesce(F.get(parts, 1), F.lit(""))).otherwise(F.regexp_replace(F.substr(s, F.length(first) + 1), r"^[.,\s]+", ""))
        label = T.strip(F.regexp_replace(head, "(?i)</?strong>", ""))

        def ended(rest: Column) -> Column:
            big = F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
            return F.when(rest == "", "").when(rest.rlike("[.!?]$"), big).otherwise(F.concat(big, F.lit(".")))

        plain = F.concat(F.lit("<strong>"), label, F.lit("</strong> – "), T.bound(T.strip(tail), ended))
        return F.when(s.rlike("<strong>.*?</strong>") & F.contains(s, F.lit("–")), F.regexp_replace(s, r"\s*–\s*", " – ")).otherwise(plain)

    return _each_item(html, form)


# Parts of a written description in their order: (title or the field that holds it, text field).
DESCRIPTION_PARTS = [(None, "hook_html"), ("main_description_title", "main_description_html"), ("Features and Benefits", "features_html"), ("Product Specifications", "specs_html"), ("Internal Links", "internal_links_html"), ("why_choose_title", "why_choose_html"), ("Manuals and Troubleshooting Guides", "manuals_html"), ("Frequently Asked Questions", "faq_html")]


def assembled_description(fields: dict[str, Column]) -> Column:
    """The filled parts of a description under their headings, a blank line between them; specs are formed as spec_items."""
    out = []
    for title, field in DESCRIPTION_PARTS:
        if field not in fields:
            continue
        body = spec_items(fields[field]) if field == "specs_html" else fields[field]
        filled = F.coalesce(fields[field], F.lit("")) != ""
        if title == "main_description_title":  # its heading stands by itself
            head = fields.get(title, F.lit(None))
            out.append(F.when(F.coalesce(head, F.lit("")) != "", F.concat(F.lit("<h2>"), head, F.lit("</h2>"))))
        elif title:
            head = F.coalesce(F.nullif(fields.get("why_choose_title", F.lit(None).cast("string")), F.lit("")), F.lit("Why Choose")) if title == "why_choose_title" else F.lit(title)
            out.append(F.when(filled, F.concat(F.lit("<h2>"), head, F.lit("</h2>"))))
        out.append(F.when(filled, body))
    return F.array_join(F.array_compact(F.array(*out)), "\n\n")


def coerced_specs(json: Column) -> Column:
    """A map of the filled entries of a JSON object, or of an array of ``{key, value}`` or one-entry objects; empty for anything else."""
    empty = F.create_map().cast("map<string,string>")
    plain = F.map_entries(F.coalesce(F.from_json(json, "map<string,string>"), empty))
    listed = F.coalesce(F.from_json(json, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    pair = lambda m: F.when(T.non_blank(F.try_element_at(m, F.lit("key"))).isNotNull() & T.non_blank(F.try_element_at(m, F.lit("value"))).isNotNull(), F.struct(F.try_element_at(m, F.lit("key")).alias("key"), F.try_element_at(m, F.lit("value")).alias("value"))).when(F.size(m) == 1, F.get(F.map_entries(m), 0))
    rows = F.when(F.ltrim(json).startswith("["), F.filter(F.transform(listed, pair), lambda p: p.isNotNull())).otherwise(plain)
    clean = F.transform(rows, lambda p: F.struct(T.strip(p["key"]).alias("key"), T.strip(F.coalesce(p["value"], F.lit(""))).alias("value")))
    return S.last_wins(F.filter(clean, lambda p: (p["key"] != "") & (p["value"] != "")))


def listing_patch(h1: Column, title: Column, meta: Column, keywords: Column, slug: Column, html: Column) -> Column:
    """struct of the fields a catalogue listing takes over from written texts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(text(h1).alias("name"), text(meta).alias("meta_description"), text(title).alias("page_title"), F.coalesce(F.array_join(keywords, ", "), F.lit("")).alias("search_keywords"), F.concat(F.lit("/"), slug).alias("custom_url"), text(html).alias("description"))


# Audits of a speed report that call for something to be done.
SPEED_ACTIONS = {
    "modern-image-formats": "Serve images in WebP/AVIF.", "unused-javascript": "Reduce/defers unused JS (apps, trackers).", "render-blocking-resources": "Inline critical CSS; defer non-critical CSS/JS.",
    "offscreen-images": "Add loading=lazy to below-the-fold images.", "uses-responsive-images": "Provide responsive srcset/sizes.", "uses-rel-preconnect": "Preconnect CDN/origin and critical third parties.",
}


def speed_report(json: Column) -> Column:
    """struct(performance, lcp, tbt, cls, actions) of a page-speed report in JSON; null parts where it has none."""
    doc = F.try_parse_json(json)

    def read(d: Column) -> Column:
        audit = lambda name, what, kind="string": F.try_variant_get(d, f"$.lighthouseResult.audits['{name}'].{what}", kind)
        actions = F.array_compact(F.array(*(F.when(audit(a, "score", "double") < 1, F.lit(t)) for a, t in SPEED_ACTIONS.items())))
        return F.struct(
            F.try_variant_get(d, "$.lighthouseResult.categories.performance.score", "double").alias("performance"), audit("largest-contentful-paint", "displayValue").alias("lcp"), audit("total-blocking-time", "displayValue").alias("tbt"),
            audit("cumulative-layout-shift", "displayValue").alias("cls"), actions.alias("actions"),
        )

    return T.bound(doc, read)


def resolved_product(product: Column, tab_html: Column, dom: Column) -> Column:
    """struct(name, description, images): of a structured product, its description else the first 200 words of the tabs' or the page's markup."""
    get = lambda path: F.coalesce(F.try_variant_get(product, path, "string"), F.lit(""))
    markup = T.squeeze(F.regexp_replace(F.coalesce(F.nullif(tab_html, F.lit("")), dom, F.lit("")), "<[^>]+>", " "))
    words = F.array_join(F.slice(F.split(markup, " "), 1, 200), " ")
    images = F.coalesce(F.try_variant_get(product, "$.image", "array<string>"), F.filter(F.array(get("$.image")), lambda u: u != ""))
    return F.struct(get("$.name").alias("name"), F.coalesce(F.nullif(get("$.description"), F.lit("")), words).alias("description"), images.alias("images"))


def addresses_in_json(json: Column, extensions: str) -> Column:
    """Distinct texts anywhere in a JSON document that end like files of the given extensions, in order."""
    found = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(rf'(?i)"((?:[^"\\]|\\.)*?\.(?:{extensions})(?:[?#](?:[^"\\]|\\.)*)?)"(?!\s*:)'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("\\/"), F.lit("/"))))


def images_in_json(json: Column) -> Column:
    return addresses_in_json(json, "jpe?g|png|webp")


def documents_in_json(json: Column) -> Column:
    return addresses_in_json(json, "pdf")


def css_backgrounds(style: Column) -> Column:
    """The addresses of url() values in a style, data addresses left out."""
    return F.filter(F.regexp_extract_all(F.coalesce(style, F.lit("")), F.lit(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)"""), F.lit(1)), lambda u: ~u.startswith("data:"))


def escaped_pattern(x: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def merged_tabs(tabs: Column, order: list[str]) -> Column:
    """Texts of tabs (title, text) under their titles, those of ``order`` first, repeats left out."""
    low = [o.lower() for o in order]
    rank = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, low)), F.lower(t["title"])), F.lit(0)), F.lit(len(low) + 1))
    ordered = F.array_sort(F.transform(tabs, lambda t, i: F.struct(rank(t).alias("r"), i.alias("i"), T.strip(t["text"]).alias("t"))))
    return F.array_join(L.distinct_in_order(F.filter(F.transform(ordered, lambda o: o["t"]), lambda t: t != "")), "\n\n")
