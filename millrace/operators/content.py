"""Texts, features and included items of a record put together from its sources, and the last cleaning of a record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions import lines as L, specs as S, text as T

def _none() -> Column:
    return F.array().cast("array<string>")


# What a feature line says if it belongs into a description. A parameter of compiled_description.
TELLING_FEATURES = [
    r"hospital[-\s]?strength", r"efficiency,\s*power,\s*and\s*performance", r"benefit\s+from", r"maximum\s+suction", "270mmhg", r"up\s+to\s+270", r"vacuum\s+suction", r"suction\s+is\s+adjustable", r"adjustable\s+suction",
    r"quiet\s+pump.*timer.*night\s+light", r"natural\s+nursing", r"closed\s+system", r"built[-\s]?in\s+battery", r"features\s+of\s+the\s+s2\s+plus", r"premier\s+rechargeable\s+double\s+electric\s+breast\s+pump",
]
# Fixed values of the last cleaning: texts of legal and account lines, of addresses, of documents and of image paths.
LEGAL_LINE = r"\b(?:privacy|terms|cookies?|trademark|copyright|©|™|®|newsletter|subscribe|sitemap|back\s*to\s*top|about|careers|press|blog|faq|support|returns?|shipping|track\s*order|store\s*locator|contact|account|login|facebook|instagram|twitter|linkedin)\b"
ADDRESS_LIKE = r"https?://|www\.|@[a-z0-9_.-]+"
DOCUMENT_KEPT = "manual|ifu|instruction|user[- ]?guide|assembly|install|setup|quick[- ]?start|datasheet|spec(?:sheet)?|guide|brochure"
DOCUMENT_DROPPED = r"iso|mdsap|ce(?:[-\s])?cert|certificate|quality\s+management|annex|audit|policy|regulatory|warranty"
IMAGE_WORDS = ["logo", "brandmark", "favicon", "sprite", "placeholder", "no[-_]?image", "missingimage", "coming[-_]?soon", "awaiting", "spacer", "blank", "default", "dummy", "sample", "temp", "swatch", "icons?", "thumb(?:nail)?s?"]
IMAGE_PATHS = ["/common/images/", "/icons/", "/wp-content/themes/", "/rbslider/", "/theme_options/", "/wysiwyg/[^?#]*(?:banner|payment|footer)"]


def compiled_description(texts: list[Column], features: Column, telling: list[str] | None = None) -> Column:
    """The distinct lines of several descriptions, a blank line between them, and the telling feature lines of four words or more that they lack.

    '' if no description has text.
    """
    lines = L.distinct_in_order(L.lines_of(F.concat_ws("\n", *texts)))
    pattern = "(?i)" + "|".join(telling or TELLING_FEATURES)

    def whole(text: Column) -> Column:
        low = F.lower(text)
        fit = lambda x: (F.size(F.split(x, f"{T.WS}+")) >= 4) & x.rlike(pattern) & ~F.contains(low, F.lower(x))
        extra = L.distinct_in_order(F.filter(F.transform(F.coalesce(features, _none()), T.strip), lambda x: x.isNotNull() & fit(x)))
        return T.bound(extra, lambda e: F.when(text == "", "").when(F.size(e) == 0, text).otherwise(F.concat(text, F.lit("\n\n"), F.array_join(e, " "))))

    return T.bound(F.array_join(lines, "\n\n"), whole)


def benefit_sentences(text: Column) -> Column:
    """Parts of 8 to 180 characters between full stops, line ends, bullets, dashes and semicolons."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[.\n•·–;-]+"), T.strip)
    return F.filter(parts, lambda s: F.length(s).between(8, 180))


def specs_from_text(text: Column) -> Column:
    """A map of the lines ``K: V``; the first of a key counts."""
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), T.strip)
    pattern = r"^([^:]{2,60}):\s*(.{2,300})$"
    pairs = F.transform(F.filter(rows, lambda r: r.rlike(pattern)), lambda r: F.struct(F.regexp_replace(F.lower(F.regexp_extract(r, pattern, 1)), f"{T.WS}+", "_").alias("key"), T.strip(F.regexp_extract(r, pattern, 2)).alias("value")))
    return S.first_wins(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))


def first_paragraph(text: Column) -> Column:
    """The first line of more than 50 characters, else ''."""
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), T.strip), lambda s: F.length(s) > 50)
    return F.coalesce(F.get(rows, 0), F.lit(""))


def sound_features(features: Column, specs: Column) -> Column:
    """Distinct feature lines of 7 to 500 characters without legal words and addresses; if fewer than three are left, specs as ``Key: value`` follow."""
    good = lambda t: F.length(t).between(7, 500) & ~t.rlike(f"(?i){LEGAL_LINE}") & ~t.rlike(f"(?i){ADDRESS_LIKE}") & ~t.rlike("[›»>]")
    kept = L.distinct_in_order(F.filter(F.coalesce(features, _none()), lambda t: t.isNotNull() & good(t)))
    told = F.transform(F.map_entries(F.coalesce(specs, F.create_map().cast("map<string,string>"))), lambda e: F.concat(T.title_case(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), T.strip(F.coalesce(e["value"], F.lit("")))))
    short = F.filter(told, lambda s: F.length(s).between(7, 180))
    return T.bound(kept, lambda k: F.when(F.size(k) < 3, L.distinct_in_order(F.concat(k, short))).otherwise(k))


def sound_manuals(urls: Column) -> Column:
    """URLs with words of manuals and none of certificates and the like."""
    return F.filter(F.coalesce(urls, _none()), lambda u: u.rlike(f"(?i){DOCUMENT_KEPT}") & ~u.rlike(f"(?i){DOCUMENT_DROPPED}"))


def sound_images(urls: Column) -> Column:
    """URLs without path parts of placeholders, icons, thumbnails and page themes."""
    bad = rf"(?i)(?:^|[/_.-])(?:{'|'.join(IMAGE_WORDS)})(?:[/_.-]|$)|{'|'.join(IMAGE_PATHS)}"
    return F.filter(F.coalesce(urls, _none()), lambda u: (u != "") & ~u.rlike(bad))


def sound_specs(specs: Column, description: Column) -> Column:
    """Entries with a value and without legal keys; if none is left, those that the description's lines state."""
    kept = F.map_filter(F.transform_values(specs, lambda k, v: T.strip(F.coalesce(v, F.lit("")))), lambda k, v: (k != "") & ~k.rlike(r"(?i)\b(?:privacy|terms|copyright|©|™|®)\b") & (v != ""))
    return F.when(specs.isNull(), specs).when(F.size(kept) > 0, kept).otherwise(specs_from_text(description))


def sanitized(features: Column, specs: Column, manuals: Column, images: Column, description: Column) -> Column:
    """struct(features, specs, manuals, images, description): a record after the last cleaning."""
    better = T.bound(first_paragraph(description), lambda p: F.when(F.coalesce(F.length(description), F.lit(0)) >= 30, description).otherwise(F.coalesce(F.nullif(p, F.lit("")), description)))
    return F.struct(
        sound_features(features, specs).alias("features"), sound_specs(specs, description).alias("specs"), sound_manuals(manuals).alias("manuals"), sound_images(images).alias("images"), better.alias("description")
    )


def looks_like_menu(text: Column, name: Column) -> Column:
    """Is a page's text a list of links: over ten lines with little punctuation that seldom mention the product, or over thirty without its name?

    Words of more than three letters of the name count.
    """
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), f"{T.WS}+"), lambda w: F.length(w) > 3)

    def told(rows: Column) -> Column:
        n = F.size(rows)
        marked = F.size(F.filter(rows, lambda r: r.rlike("[.,;:!?]")))
        named = F.size(F.filter(rows, lambda r: F.exists(words, lambda w: F.contains(F.lower(r), w))))
        anywhere = F.exists(words, lambda w: F.contains(F.lower(text), w))
        return ((n > 30) & ~anywhere) | ((n > 10) & (marked < 0.15 * n) & (named < 0.2 * n))

    return F.coalesce(T.bound(F.split(T.strip(text), "\n+"), told), F.lit(False))


def readable_text(text: Column, name: Column, *descriptions: Column) -> Column:
    """The text, or the first filled description where it looks like a menu."""
    return F.when(looks_like_menu(text, name), F.coalesce(*(T.non_blank(d) for d in descriptions), text)).otherwise(text)


def tab_texts_read(texts: Column) -> Column:
    """struct(features, specs) of the texts of tabs: ``Key (unit) number`` and spec lines, and other parts of three words or more.

    Long parts with product codes or words of microscopes' accessories are left out. The first of a key counts.
    """
    clean = F.transform(F.filter(F.coalesce(texts, _none()), lambda t: T.non_blank(t).isNotNull()), lambda t: F.regexp_replace(T.squeeze(t), r"\)(?=\d)", ") "))
    united = r"([A-Za-z][^()]+?)\s*\(([^)]+)\)\s*(\d+(?:\.\d+)?)"

    def pairs(t: Column) -> Column:
        name = lambda x: F.regexp_replace(F.lower(T.strip(F.concat(F.regexp_extract(x, united, 1), F.lit(" "), F.regexp_extract(x, united, 2)))), f"{T.WS}+", "_")
        return F.transform(F.regexp_extract_all(t, F.lit(united), F.lit(0)), lambda x: F.struct(name(x).alias("key"), F.regexp_extract(x, united, 3).alias("value")))

    parts = lambda t: F.filter(F.transform(F.split(t, r"(?<!\d)[.\n•]+|\bTo\b"), T.strip), lambda p: p != "")
    listing = lambda p: (F.size(F.split(p, " ")) > 20) & (p.rlike(r"\b[A-Z]{1,2}\d{2,4}-") | p.rlike("(?i)eyepiece|auxiliary|lens|stand|boom"))
    rows = F.flatten(F.transform(clean, lambda t: F.filter(parts(t), lambda p: ~listing(p))))

    def read(rs: Column) -> Column:
        lines = F.transform(rs, lambda p: F.struct(S.spec_line(p).alias("pair"), p.alias("part")))

        def split(ls: Column) -> Column:
            told = F.transform(F.filter(ls, lambda x: x["pair"].isNotNull()), lambda x: x["pair"])
            rest = F.filter(F.transform(F.filter(ls, lambda x: x["pair"].isNull()), lambda x: x["part"]), lambda p: F.size(F.split(p, f"{T.WS}+")) >= 3)
            return F.struct(L.distinct_in_order(rest).alias("features"), S.first_wins(F.concat(F.flatten(F.transform(clean, pairs)), told)).alias("specs"))

        return T.bound(lines, split)

    return T.bound(rows, read)


def browse_lift(features: Column, specs: Column, sections: Column) -> Column:
    """struct(features, specs, features_browse, specs_browse): a record with what its browsed sections add.

    ``sections`` has the texts features, included and specifications and the map tabs. Lines
    of features and included and those of the tabs, each unless alike to one before, are the
    browsed features; those the record lacks go behind its own. Spec lines (the last of a key)
    and the tabs' specs are the browsed specs; the record's own keys stay.
    """
    empty = F.create_map().cast("map<string,string>")
    tabs = tab_texts_read(F.map_values(F.coalesce(sections["tabs"], empty)))

    def lift(t: Column) -> Column:
        browsed = L.without_similar(F.concat(L.lines_of(sections["features"]), L.lines_of(sections["included"]), F.filter(F.transform(t["features"], T.strip), lambda x: x != "")))
        pairs = F.filter(F.transform(F.split(F.coalesce(sections["specifications"], F.lit("")), "\n+"), S.spec_line), lambda p: p.isNotNull())
        stated = S.overlaid(t["specs"], S.last_wins(pairs))
        own = F.coalesce(features, _none())
        more = T.bound(F.transform(own, F.lower), lambda low: F.filter(L.distinct_in_order(browsed), lambda x: ~F.array_contains(low, F.lower(x))))
        return F.struct(F.concat(own, more).alias("features"), S.overlaid(stated, F.coalesce(specs, empty)).alias("specs"), browsed.alias("features_browse"), stated.alias("specs_browse"))

    return T.bound(tabs, lift)


# Words that end a list of contents, words of contents, and words of lines that are none.
CONTENTS_CUE = "includes everything|includes.*needed"
CONTENTS_END = r"recommended|review|customer|based on|\bi am\b|\bgynecologic\b|\bgynecologist\b|\boncologist\b|\bsurgeon\b|hospital|parts & accessories|use & operation|assembling|sanitizing|how to use|stand|case|kit|sold out|add to cart|\$|switch|trolley|power supply|hard case|cable|set"
CONTENTS_ITEM = r"\b(?:breast|shield|bottle|tube|adapter|manual|pump|diaphragm|cap|diaphragms|flange|flanges|air tube|stand|case|kit|tubing|body|bodies|bottles|cable|cables)\b|[0-9]"
PART_LINES = [("commode bucket", "bucket"), ("commode seat", "seat"), (r"replacement\s*leg\s*set|replacement-leg-set", "leg set"), ("leg tip", "leg tip"), (r"\b(?:ac\s*power\s*adapter|power\s*adapter|adapter/charger|charger)\b", "adapter|charger")]
COUNTED_ITEM = r"\b(?:breast|shield|bottle|tube|tubing|adapter|charger|power|manual|pump|diaphragm|valve|flange|backflow|protector|bag|connector|body|bodies|duckbill|kit|flanges|caps|membrane)\b"
NO_ITEM = r"recommended|review|customer|based on|gynecologic|gynecologist|oncologist|surgeon|hospital|kit|stand|case|trolley|switch|power supply|hard case|cable|set|price|\$|add to cart|sold out|parts & accessories"


def guessed_contents(visible: Column, features: Column) -> Column:
    """What a product comes with: lines behind a cue in the page's text, its lines of parts, and feature lines that list or count items."""
    rows = L.lines_of(visible)

    def from_page(rs: Column) -> Column:
        low = F.transform(rs, F.lower)
        begin = F.get(F.filter(F.transform(low, lambda x, i: F.when(x.rlike(CONTENTS_CUE), i)), lambda i: i.isNotNull()), 0)
        after = F.when(begin.isNotNull(), F.slice(rs, begin + 2, F.size(rs))).otherwise(_none())

        def body(a: Column) -> Column:
            # a further cue is passed over, not an end
            stop = F.get(F.filter(F.transform(a, lambda x, i: F.when(F.lower(x).rlike(CONTENTS_END) & ~F.lower(x).rlike(CONTENTS_CUE), i)), lambda i: i.isNotNull()), 0)
            listed = F.filter(F.when(stop.isNotNull(), F.slice(a, 1, stop)).otherwise(a), lambda x: F.lower(x).rlike(CONTENTS_ITEM) & ~F.lower(x).rlike(CONTENTS_CUE))
            return F.filter(F.transform(listed, lambda x: T.strip(F.regexp_replace(x, r"^[-•\s]+", ""))), lambda x: x != "")

        # each kind of part once, in the order of the lines, unless named already
        def parts(found: Column) -> Column:
            firsts = F.array(*(F.struct(F.get(F.filter(F.transform(low, lambda x, i: F.when(x.rlike(line), i)), lambda i: i.isNotNull()), 0).alias("i"), F.lit(k).alias("k"), F.lit(known).alias("known")) for k, (line, known) in enumerate(PART_LINES)))  # noqa: B023
            told = F.array_sort(F.filter(firsts, lambda p: p["i"].isNotNull()))
            return F.aggregate(told, found, lambda acc, p: F.when(F.exists(acc, lambda v: F.regexp_like(F.lower(v), p["known"])), acc).otherwise(F.concat(acc, F.array(F.get(rs, p["i"])))))

        return T.bound(T.bound(after, body), parts)

    lines = F.transform(F.coalesce(features, _none()), lambda x: T.strip(F.coalesce(x, F.lit(""))))
    cue = "^(?i)(?:includes|comes with|comes complete)"
    items = lambda x: F.transform(F.split(F.regexp_replace(T.strip(F.regexp_replace(x, cue, "")), r"(?i)\band\b", ","), "[,;]"), lambda y: T.strip(F.regexp_replace(y, r"^[\s:\-]+", "")))
    listed = F.filter(F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(cue)), items)), lambda y: y != "")
    counted = F.filter(lines, lambda x: x.rlike(r"^(?i)(?:(?:one|two|three|four|five|six|seven|eight|nine|ten)\b|\(?\d+\)?\s+)") & F.lower(x).rlike(COUNTED_ITEM) & ~F.lower(x).rlike(r"\b(?:mmhg|kg|g|lb|lbs|oz|ml)\b"))
    every = F.concat(T.bound(rows, from_page), listed, counted)
    return F.filter(every, lambda x: ~F.lower(x).rlike(NO_ITEM) & ~(F.lower(x).rlike(r"^(?:with|and)\b") & (F.size(F.split(x, f"{T.WS}+")) <= 4) & ~x.rlike("[0-9]")))
