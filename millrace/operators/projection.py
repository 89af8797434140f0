"""What a page says about its product, read from the relation of its elements.

All functions take the rows of pages.page_nodes and give rows keyed by page; order in the page
is carried by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import specs as S, text as T
from millrace.operators import media

# Words of part tables and of legal cells.
PART_HEADS = r"(?i)^(?:no\.?|part(?: (?:no\.?|number|#))?|item(?: (?:no\.?|#))?|qty|quantity|price)$"
LEGAL = r"(?i)privacy|terms|cookie|shipping|returns|login|support|about us|copyright"
IMAGE_REJECT = r"(?i)swatch|logo|favicon|brandmark|badge|trust|payment|visa|mastercard|paypal|icon|sprite|placeholder|banner|hero"


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def page_facts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, title, heading, og_title, description, canonical, paragraph): the page's own statements and its longest paragraph outside the chrome."""
    meta = F.coalesce(attr("property"), attr("name"))
    paragraph = (F.col("tag") == "p") & ~F.col("in_chrome") & (F.col("text") != "")
    first = lambda test, value, name: F.min_by(F.when(test, value), F.when(test, F.col("ord"))).alias(name)
    facts = nodes.groupBy(key).agg(
        first(F.col("tag") == "title", F.col("text"), "title"),
        first(meta == "og:title", attr("content"), "og_title"),
        first(meta.isin("description", "og:description"), attr("content"), "description"),
        first((F.col("tag") == "link") & (attr("rel") == "canonical"), attr("href"), "canonical"),
        first((F.col("tag") == "h1") & ~F.col("in_chrome") & (F.col("text") != ""), F.col("text"), "heading"),
        F.max_by(F.when(paragraph, F.col("text")), F.when(paragraph, F.struct(F.length("text"), -F.col("ord")))).alias("paragraph"),
    )
    return facts


def links(nodes: DataFrame, key: str, base: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(key, ord, href, text) of the links, against the page's URL if ``base`` (key, url) is given."""
    found = nodes.where((F.col("tag") == "a") & (F.coalesce(attr("href"), F.lit("")) != "")).select(key, "ord", attr("href").alias("href"), F.nullif("text", F.lit("")).alias("text"))
    return found if base is None else found.join(base.select(key, F.col(url).alias("_b")), key).withColumn("href", T.absolute(F.col("_b"), F.col("href"))).drop("_b")


def spec_pairs(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ord, channel, name, value): rows of two cells, terms with their descriptions, and items and paragraphs ``K: V``.

    Cells longer than 80 and 400 characters and those of legal text are no pairs, by the
    operator's definition.
    """
    texts = nodes.where(F.col("tag").isin("td", "th", "dt", "dd", "li", "p") & (F.col("text") != "")).select(key, "ord", "text", "tag", "parent")
    of_row = W.partitionBy(key, "parent").orderBy("ord")
    cells = texts.where(F.col("tag").isin("td", "th")).withColumns({"n": F.row_number().over(of_row), "value": F.lead("text").over(of_row), "all": F.count("*").over(W.partitionBy(key, "parent"))})
    table = cells.where("n = 1 and all = 2").select(key, "ord", F.lit("table").alias("channel"), F.col("text").alias("name"), "value")
    terms = texts.where(F.col("tag").isin("dt", "dd")).withColumns({"value": F.lead("text").over(of_row), "next": F.lead("tag").over(of_row)})
    listed = terms.where("tag = 'dt' and next = 'dd'").select(key, "ord", F.lit("terms").alias("channel"), F.col("text").alias("name"), "value")
    typed = texts.where(F.col("tag").isin("li", "p")).select(key, "ord", F.lit("line").alias("channel"), T.strip(F.regexp_extract("text", "^([^:]{2,60}):\\s*(.{2,300})$", 1)).alias("name"), T.strip(F.regexp_extract("text", "^([^:]{2,60}):\\s*(.{2,300})$", 2)).alias("value"))
    rows = table.union(listed).union(typed)
    return rows.where((F.length("name").between(1, 80)) & (F.length("value").between(1, 400)) & ~F.col("name").rlike(LEGAL) & ~F.col("value").rlike(LEGAL))


def spec_map(pairs: DataFrame, key: str, first: bool = True) -> DataFrame:
    """(key, specs): canonical names to values with short units, the first or the last of a name counting."""
    named = pairs.select(key, "ord", S.canonical_key(F.col("name")).alias("k"), S.units_typed(F.col("value")).alias("v")).where("k <> ''")
    pick = F.min_by if first else F.max_by
    one = named.groupBy(key, "k").agg(pick("v", F.struct("ord", "v")).alias("v"))
    return one.groupBy(key).agg(S.enriched(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("specs"))  # one entry for each name of a page


def part_tables(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ord) of tables of parts: heads such as No., Part, Qty, or at least three rows with two that begin with a number and two links."""
    tables = nodes.where("tag = 'table'").select(key, F.col("ord").alias("_t"), F.col("last").alias("_to"))
    inner = nodes.where(F.col("tag").isin("th", "td", "tr", "a") & (F.col("text") != "")).select(key, "ord", "text", "tag", "parent")
    first_cell = F.row_number().over(W.partitionBy(key, "parent").orderBy("ord")) == 1
    rows = inner.withColumn("_first", first_cell).join(tables, key).where(F.col("ord").between(F.col("_t"), F.col("_to")))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    counted = rows.groupBy(key, "_t").agg(n((F.col("tag") == "th") & F.col("text").rlike(PART_HEADS)).alias("heads"), n(F.col("tag") == "tr").alias("rows"), n((F.col("tag") == "td") & F.col("_first") & F.col("text").rlike("^[0-9]+$")).alias("numbers"), n(F.col("tag") == "a").alias("links"))
    return counted.where("heads >= 2 or (rows >= 3 and numbers >= 2 and links >= 2)").select(key, F.col("_t").alias("ord"))


def json_ld(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ord, node) of the JSON-LD nodes of each page as VARIANT, lists and graphs opened; unreadable scripts have none."""
    scripts = nodes.where((F.col("tag") == "script") & (F.lower(attr("type")) == "application/ld+json") & F.contains("text", F.lit("{")))
    doc = scripts.select(key, "ord", F.try_parse_json("text").alias("d")).where("d is not null")
    many = F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.try_variant_get("d", "$.@graph", "array<variant>"), F.array("d"))
    return doc.select(key, "ord", F.posexplode(many).alias("pos", "node"))


def json_ld_product(nodes: DataFrame, key: str) -> DataFrame:
    """(key, name, brand, description, sku, price, images) of each page's first product node."""
    get = lambda path, kind="string": F.try_variant_get("node", path, kind)
    product = get("$.@type") == "Product"
    like_one = get("$.name").isNotNull() & (get("$.sku").isNotNull() | get("$.mpn").isNotNull() | get("$.offers", "variant").isNotNull())
    rows = json_ld(nodes, key).where(product | like_one)
    facts = F.struct(
        get("$.name").alias("name"), F.coalesce(get("$.brand.name"), get("$.brand")).alias("brand"), get("$.description").alias("description"), F.coalesce(get("$.sku"), get("$.mpn")).alias("sku"),
        F.coalesce(get("$.offers.price", "double"), get("$.offers[0].price", "double"), get("$.offers.priceSpecification.price", "double")).alias("price"),
        F.coalesce(F.try_variant_get("node", "$.image", "array<string>"), F.array_compact(F.array(get("$.image.url"), get("$.image")))).alias("images"),
    )
    return rows.groupBy(key).agg(F.min_by(facts, F.struct("ord", "pos")).alias("f")).select(key, "f.*")


def item_properties(nodes: DataFrame, key: str, scope: str = "itemscope", name: str = "itemprop") -> DataFrame:
    """(key, property, values): microdata, or RDFa with scope ``typeof`` and name ``property``; content before text."""
    rows = nodes.where(attr(name).isNotNull()).select(key, "ord", attr(name).alias("property"), F.coalesce(attr("content"), attr("href"), attr("src")).alias("v"), F.nullif("text", F.lit("")).alias("text"))
    held = nodes.where(F.map_contains_key("attrs", scope)).groupBy(key).agg(F.min("ord").alias("_s"))
    return rows.join(held, key).where("ord > _s").groupBy(key, "property").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("v", "text").alias("t")))), lambda x: x["t"]).alias("values"))


def tabs(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ord, title, text): panels that a link or button names by href, aria-controls or data-target, with their text."""
    target = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(attr("href"), F.lit("")), "^#(.+)$", 1), F.lit("")), F.nullif(attr("aria-controls"), F.lit("")), F.nullif(F.regexp_extract(F.coalesce(attr("data-target"), F.lit("")), "^#(.+)$", 1), F.lit("")))
    heads = nodes.where(F.col("tag").isin("a", "button", "li") & target.isNotNull() & (F.col("text") != ""))
    named = heads.groupBy(key, target.alias("element_id")).agg(F.min_by("text", "ord").alias("title"))
    panels = nodes.where("element_id is not null").select(key, "ord", "element_id", "text")
    return panels.join(named, [key, "element_id"]).select(key, "ord", "title", "text")


def images(nodes: DataFrame, key: str, base: DataFrame, url: str = "url", least_side: int = 0) -> DataFrame:
    """(key, rank, url): product images of a page, those of the main part first, each photo once.

    Candidates come from the page's own statement, img elements with the largest source of
    their set, and links to image files, with weights 8, 3 and 2; one inside the chrome or a
    list of other products, or with words of swatches, logos and the like, is none.
    """
    stated = nodes.where(F.coalesce(attr("property"), F.lit("")) == "og:image").select(key, "ord", attr("content").alias("u"), F.lit(8).alias("w"), F.lit(True).alias("main"))
    shown = nodes.where((F.col("tag") == "img") & ~F.col("in_chrome") & ~F.col("in_other")).select(key, "ord", F.coalesce(media.largest_source(attr("srcset")), attr("data-src"), attr("src")).alias("u"), F.lit(3).alias("w"), F.col("in_main").alias("main"))
    linked = nodes.where((F.col("tag") == "a") & attr("href").rlike(r"(?i)\.(?:jpe?g|png|webp)(?:$|[?#])") & ~F.col("in_chrome") & ~F.col("in_other")).select(key, "ord", attr("href").alias("u"), F.lit(2).alias("w"), F.col("in_main").alias("main"))
    rows = stated.union(shown).union(linked).where(F.coalesce(F.col("u"), F.lit("")) != "").join(base.select(key, F.col(url).alias("_b")), key).withColumn("u", T.absolute(F.col("_b"), F.col("u")))
    size = media.declared_size(F.col("u"))
    good = rows.where(~F.col("u").rlike(IMAGE_REJECT) & ((size == 0) | (size >= least_side)))
    best = good.groupBy(key, "u").agg(F.max("w").alias("w"), F.max("main").alias("main"), F.min("ord").alias("ord"))
    placed = best.select(key, F.col("u").alias("url"), F.row_number().over(W.partitionBy(key).orderBy(F.desc("main"), F.desc("w"), "ord")).alias("pos"))
    return media.distinct_images(placed, key)


def manuals(nodes: DataFrame, key: str, products: DataFrame, url: str = "url") -> DataFrame:
    """(key, rank, url): documents linked from a page, manuals by their words, best match of the product's code and name first.

    ``products`` has key, url, code and name.
    """
    found = links(nodes, key).join(products.select(key, F.col(url).alias("_b"), "code", "name"), key).withColumn("u", T.absolute(F.col("_b"), F.col("href")))
    pdf = F.lower("u").rlike(r"\.pdf(?:$|[?#])") & F.lower("u").rlike(media.MANUAL_WORDS) & ~F.lower("u").rlike(f"(?:^|[^a-z])(?:{media.OTHER_WORDS})(?:[^a-z]|$)")
    clean = found.where(pdf).withColumn("u", F.replace(T.strip(F.regexp_replace("u", "#.*$", "")), F.lit(" "), F.lit("%20")))
    score = media.manual_score(F.col("u"), F.col("code"), F.element_at(F.split(T.squeeze(F.col("name")), " "), 1))
    one = clean.groupBy(key, "u").agg(F.max(score).alias("s"), F.min("ord").alias("ord"))
    return one.select(key, F.row_number().over(W.partitionBy(key).orderBy(F.desc("s"), "ord")).cast("bigint").alias("rank"), F.col("u").alias("url"))


def payloads(records: DataFrame, name: str = "name_raw", specs: str = "specs") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): records with a name that isn't made of a URL, and with specs."""
    from millrace.operators.records import looks_like_url

    reason = F.when(T.non_blank(F.col(name)).isNull() | looks_like_url(F.col(name)), "no name").when(F.coalesce(F.size(F.map_keys(specs)), F.lit(0)) <= 0, "no specs")
    marked = records.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
