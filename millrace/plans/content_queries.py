"""Queries of the record-content and page-record operators, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import specs as S
from millrace.operators import browse, content as C, page_record, quality, variants
from millrace.plans.latest import LATEST, latest_records
from millrace.plans.reference_queries import _WS, _strip, query
from millrace.sources.tables import table

_SQUEEZE = lambda x: _strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


@query(
    f"""WITH one AS ({LATEST}), p AS (SELECT record_id, pos, {_strip('part')} AS part FROM (SELECT record_id, unnest(regexp_split_to_array(coalesce(r.d, ''), '[.\\n•·–;-]+')) AS part, generate_subscripts(regexp_split_to_array(coalesce(r.d, ''), '[.\\n•·–;-]+'), 1) AS pos FROM one))
    SELECT record_id, count(*)::BIGINT AS sentences, md5(string_agg(part, '|' ORDER BY pos)) AS digest FROM p WHERE length(part) BETWEEN 8 AND 180 GROUP BY 1"""
)
def benefit_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_records(spark, folder).select("record_id", C.benefit_sentences(F.col("d")).alias("s")).where(F.size("s") > 0)
    return rows.select("record_id", F.size("s").cast("bigint").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_TEXT_LINES = f"SELECT pdf_id, pos, {_strip('raw')} AS line FROM (SELECT pdf_id, unnest(string_split(raw_text, chr(10))) AS raw, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM (SELECT DISTINCT pdf_id, raw_text FROM pdf_texts))"


@query(
    f"""WITH l AS ({_TEXT_LINES}), kv AS (SELECT pdf_id, pos, regexp_replace(lower(regexp_extract(line, '^([^:]{{2,60}}):\\s*(.{{2,300}})$', 1)), '{_WS}+', '_', 'g') AS key, {_strip("regexp_extract(line, '^([^:]{2,60}):\\s*(.{2,300})$', 2)")} AS value FROM l WHERE regexp_matches(line, '^[^:]{{2,60}}:\\s*.{{2,300}}$'))
    SELECT pdf_id, key, arg_min(value, pos) AS value FROM kv WHERE key <> '' AND value <> '' GROUP BY 1, 2"""
)
def specs_from_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Key/value lines of manuals, the first of a key counting."""
    return table(spark, folder, "pdf_texts").select("pdf_id", "raw_text").distinct().select("pdf_id", F.explode(C.specs_from_text(F.col("raw_text"))))


@query(f"WITH l AS ({_TEXT_LINES}), f AS (SELECT pdf_id, arg_min(line, pos) AS paragraph FROM l WHERE length(line) > 50 GROUP BY 1) SELECT DISTINCT t.pdf_id, coalesce(f.paragraph, '') AS paragraph FROM pdf_texts t LEFT JOIN f USING (pdf_id)")
def first_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pdf_texts").select("pdf_id", C.first_paragraph(F.col("raw_text")).alias("paragraph")).distinct()


_GOOD_FEATURE = f"length(x) BETWEEN 7 AND 500 AND NOT regexp_matches(x, '(?i){C.LEGAL_LINE}') AND NOT regexp_matches(x, '(?i){C.ADDRESS_LIKE}') AND NOT regexp_matches(x, '[›»>]')"
_TITLED = "array_to_string(list_transform(regexp_extract_all(lower(replace(k, '_', ' ')), '[a-z0-9_]+|[^a-z0-9_]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query(
    f"""WITH one AS ({LATEST}), e AS (SELECT record_id, pos, x FROM (SELECT record_id, unnest(r.f) AS x, generate_subscripts(r.f, 1) AS pos FROM one) WHERE {_GOOD_FEATURE}),
    k AS (SELECT record_id, lower(x) AS low, min(pos) AS pos, arg_min(x, pos) AS x FROM e GROUP BY 1, 2), n AS (SELECT record_id, count(*) AS n FROM k GROUP BY 1),
    s AS (SELECT record_id, 1000 + row_number() OVER (PARTITION BY record_id ORDER BY pos) AS pos, x FROM (SELECT record_id, pos, {_TITLED} || ': ' || {_strip("coalesce(v, '')")} AS x FROM (SELECT record_id, unnest(map_keys(r.specs)) AS k, unnest(map_values(r.specs)) AS v, generate_subscripts(map_keys(r.specs), 1) AS pos FROM one)) WHERE length(x) BETWEEN 7 AND 180),
    a AS (SELECT * EXCLUDE (low) FROM k UNION ALL SELECT s.record_id, s.pos, s.x FROM s LEFT JOIN n USING (record_id) WHERE coalesce(n, 0) < 3), d AS (SELECT record_id, lower(x) AS low, min(pos) AS pos, arg_min(x, pos) AS x FROM a GROUP BY 1, 2)
    SELECT record_id, count(*)::BIGINT AS features, md5(string_agg(x, '|' ORDER BY pos)) AS digest FROM d GROUP BY 1"""
)
def sound_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_records(spark, folder).select("record_id", C.sound_features(F.col("f"), F.col("specs")).alias("s")).where(F.size("s") > 0)
    return rows.select("record_id", F.size("s").cast("bigint").alias("features"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(
    f"""WITH one AS ({LATEST}) SELECT record_id, coalesce(len(list_filter(r.m, lambda u: regexp_matches(u, '(?i){C.DOCUMENT_KEPT}') AND NOT regexp_matches(u, '(?i){C.DOCUMENT_DROPPED}'))), 0)::BIGINT AS manuals,
    coalesce(len(list_filter(r.i, lambda u: u <> '' AND NOT regexp_matches(u, '(?i)(?:^|[/_.-])(?:{'|'.join(C.IMAGE_WORDS)})(?:[/_.-]|$)|{'|'.join(C.IMAGE_PATHS)}'))), 0)::BIGINT AS images FROM one"""
)
def sound_links(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of documents and images that the last cleaning keeps."""
    n = lambda c: F.size(c).cast("bigint")
    return latest_records(spark, folder).select("record_id", n(C.sound_manuals(F.col("m"))).alias("manuals"), n(C.sound_images(F.col("i"))).alias("images"))


_PAGES = "SELECT page_id, any_value(record_id) AS record_id, any_value(visible_text) AS visible_text, any_value(sections) AS sections FROM (SELECT DISTINCT page_id, record_id, visible_text, sections FROM browse_pages) GROUP BY 1"


def _browsed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, exact copies once, with the records they belong to."""
    pages = table(spark, folder, "browse_pages").groupBy("page_id").agg(*(F.any_value(c).alias(c) for c in ("record_id", "visible_text", "sections")))
    return pages.join(latest_records(spark, folder), "record_id")


@query(
    f"""WITH one AS ({LATEST}), p AS (SELECT page_id, {_strip('visible_text')} AS t, list_filter(regexp_split_to_array(lower(coalesce(r.name, '')), '{_WS}+'), lambda w: length(w) > 3) AS words FROM ({_PAGES}) JOIN one USING (record_id) WHERE visible_text IS NOT NULL),
    l AS (SELECT page_id, t, words, regexp_split_to_array(t, '\\n+') AS rows FROM p),
    c AS (SELECT page_id, len(rows) AS n, len(list_filter(rows, lambda r: regexp_matches(r, '[.,;:!?]'))) AS marked, len(list_filter(rows, lambda r: len(list_filter(words, lambda w: contains(lower(r), w))) > 0)) AS named, len(list_filter(words, lambda w: contains(lower(t), w))) > 0 AS anywhere FROM l)
    SELECT page_id, (n > 30 AND NOT anywhere) OR (n > 10 AND marked < 0.15 * n AND named < 0.2 * n) AS menu FROM c"""
)
def menu_like_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _browsed(spark, folder).where("visible_text is not null").select("page_id", C.looks_like_menu(F.col("visible_text"), F.col("name")).alias("menu"))


@query(
    f"""WITH one AS ({LATEST}), t AS (SELECT page_id, coalesce(r.d, '') || chr(10) || coalesce(sections.description, '') AS t FROM ({_PAGES}) JOIN one USING (record_id)),
    l AS (SELECT page_id, pos, {_strip('raw')} AS line FROM (SELECT page_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM t)), d AS (SELECT page_id, lower(line) AS low, min(pos) AS pos, arg_min(line, pos) AS line FROM l WHERE line <> '' GROUP BY 1, 2)
    SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS description FROM d GROUP BY 1"""
)
def compiled_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of records and of their pages as one, each line once."""
    rows = _browsed(spark, folder).select("page_id", C.compiled_description([F.col("d"), F.col("sections.description")], F.lit(None).cast("array<string>")).alias("description"))
    return rows.where("description <> ''")


_SPEC_WORDS = "(?i)(?:lb|lbs|kg|g|oz|ft|in|cm|mm|inch|inches|year|warranty|pcs|pieces)"


@query(
    f"""WITH one AS ({LATEST}), l AS (SELECT page_id, pos, {_strip('raw')} AS line FROM (SELECT page_id, unnest(string_split(sections.specifications, chr(10))) AS raw, generate_subscripts(string_split(sections.specifications, chr(10)), 1) AS pos FROM ({_PAGES}) JOIN one USING (record_id))),
    c AS (SELECT page_id, pos, line, regexp_extract(line, '^([^:–]+):\\s*(.+)$', ['k', 'v']) AS a, regexp_extract(line, '^(.+?)\\s+-\\s+(.+)$', ['k', 'v']) AS b, regexp_extract(line, '(?i)^(.*?)\\s+([0-9]+\\s*(?:lb|lbs|kg|g|oz|ft|in|cm|mm|"|inch|inches)(?:[^A-Za-z0-9_].*|$))$', ['k', 'v']) AS m FROM l),
    p AS (SELECT page_id, pos, CASE WHEN trim(a.k) <> '' AND trim(a.v) <> '' AND (regexp_matches(a.v, '[0-9]') OR regexp_matches(a.v, '{_SPEC_WORDS}')) THEN a WHEN trim(b.k) <> '' AND trim(b.v) <> '' AND (regexp_matches(b.v, '[0-9]') OR regexp_matches(b.v, '{_SPEC_WORDS}')) THEN b WHEN trim(m.k) <> '' AND trim(m.v) <> '' THEN m END AS x FROM c)
    SELECT page_id, lower(regexp_replace({_strip('x.k')}, '{_WS}+', '_', 'g')) AS key, arg_max({_strip('x.v')}, pos) AS value FROM p WHERE x IS NOT NULL GROUP BY 1, 2"""
)
def browsed_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Specs that the sections of browsed pages state."""
    sections = F.struct(F.col("sections.features").alias("features"), F.col("sections.included").alias("included"), F.col("sections.specifications").alias("specifications"), F.lit(None).cast("map<string,string>").alias("tabs"))
    return _browsed(spark, folder).select("page_id", F.explode(C.browse_lift(F.col("f"), F.col("specs"), sections)["specs_browse"]))


def _word_at(spelling: str) -> str:
    return r"\s*".join("".join(f"[{c}]" if c in ".+/&#" else c for c in w) for w in spelling.split())


_SPELLINGS = ", ".join(f"('{f}', '{x}')" for f, x in sorted({(f, " ".join(x.split()).replace("'", "''")) for f, xs in S.spellings().items() for x in xs}))


@query(
    f"""WITH one AS (SELECT DISTINCT ON (pdf_id) pdf_id, pairs FROM pdf_texts WHERE pairs IS NOT NULL ORDER BY pdf_id, pairs::VARCHAR), kv AS (SELECT pdf_id, unnest(map_keys(pairs)) AS k, unnest(map_values(pairs)) AS v, generate_subscripts(map_keys(pairs), 1) AS pos FROM one),
    s(field, spelling) AS (VALUES {_SPELLINGS}), m AS (SELECT DISTINCT pdf_id, field, v, pos FROM kv JOIN s ON contains(' ' || regexp_replace(lower(k), '[_ ]+', ' ', 'g') || ' ', ' ' || spelling || ' '))
    SELECT pdf_id, field AS key, arg_min(v, (-length(v), pos)) AS value FROM m WHERE v IS NOT NULL GROUP BY 1, 2"""
)
def picked_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that the key/value pairs of manuals state, by all their spellings."""
    rows = table(spark, folder, "pdf_texts").where("pdf_id is not null and pairs is not null")
    one = rows.groupBy("pdf_id").agg(F.min_by("pairs", F.col("pairs").cast("string")).alias("pairs"))
    return one.select("pdf_id", F.explode(S.picked(F.transform(F.map_entries("pairs"), lambda e: F.struct(e["key"], e["value"])))))


def _escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def made_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as pages of four layouts: (record_id, url, html).

    Names stand in the heading, open graph or JSON-LD; specs in tables, terms, items or JSON-LD;
    features in a marked list or plain items; menus, offers, part tables and footers around them.
    """
    rows = latest_records(spark, folder).where("name is not null and name not rlike '^\\\\s*$' and d is not null")
    kind = F.col("record_id") % 4
    e = _escaped
    specs = F.map_entries(F.coalesce("specs", F.create_map().cast("map<string,string>")))
    each = lambda before, mid, after: F.array_join(F.transform(specs, lambda x: F.concat(F.lit(before), e(x["key"]), F.lit(mid), e(F.coalesce(x["value"], F.lit(""))), F.lit(after))), "")
    items = F.array_join(F.transform(F.coalesce("f", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), e(F.coalesce(x, F.lit(""))))), "\n")
    code = F.coalesce("sku", F.lit(""))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("name"), F.struct(F.col("b").alias("name")).alias("brand"), F.col("sku"), F.col("i").alias("image"), F.col("d").alias("description")))
    top = F.lit('<!doctype html><nav><ul><li>Weight: none<li>Shop</ul></nav><header class="breadcrumbs"><p>Home</p></header>')
    end = F.lit('<div class="related-products"><table><tr><td>Other weight<td>1 kg</table><ul class="features"><li>Another product feature</ul></div><table><tr><th>No.<th>Part<th>Qty<tr><td>1<td>bolt<td>2</table><footer><p>© 2024</p><dl><dt>Phone<dd>555</dl></footer>')
    html = F.concat(
        F.when(kind == 1, F.concat(F.lit('<meta property="og:title" content="'), e(F.col("name")), F.lit('">'))).when(kind == 2, F.concat(F.lit('<script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))).otherwise(F.lit("")),
        top, F.lit("<main>"), F.when(kind.isin(0, 3), F.concat(F.lit("<h1>"), e(F.col("name")), F.lit("</h1>"))).otherwise(F.lit("<h1>Product page</h1>")),
        F.when(kind == 0, F.concat(F.lit('<div class="product-description"><p>'), e(F.col("d")), F.lit("</p></div>"))).when(kind != 2, F.concat(F.lit('<div itemprop="description">'), e(F.col("d")), F.lit("</div>"))).otherwise(F.lit("")),
        F.when(kind == 0, F.concat(F.lit("<table><tbody>"), each("<tr><th>", "<td>", "</tr>"), F.lit("</table>"))).otherwise(F.concat(F.lit("<dl>"), each("<dt>", "<dd>", ""), F.lit("</dl>"))),
        F.when(code != "", F.when(kind == 3, F.concat(F.lit('<span itemprop="sku">'), e(code), F.lit("</span>"))).when(kind != 2, F.concat(F.lit('<div data-sku="'), e(code), F.lit('"></div>'))).otherwise(F.lit(""))).otherwise(F.lit("")),
        F.lit('<ul class="key-features">'), items, F.lit("</ul></main>"), end,
    )
    return rows.select("record_id", F.concat(F.lit("https://shop.example/p/"), "record_id").alias("url"), html.alias("html"))


_PAGED = f"SELECT record_id, r FROM ({LATEST}) WHERE r.name IS NOT NULL AND NOT regexp_matches(r.name, '^\\s*$') AND r.d IS NOT NULL"
_SKU = f"CASE WHEN regexp_matches({_SQUEEZE('r.sku')}, '^(?:[0-9]{{8}}|[0-9]{{12,14}})$') THEN NULL ELSE nullif({_SQUEEZE('r.sku')}, '') END"


# A description in a container that reads like a legal text isn't taken, nor is its paragraph.
@query(f"SELECT record_id, {_SQUEEZE('r.name')} AS name_raw, CASE WHEN record_id % 4 = 0 AND regexp_matches(r.d, '{page_record.LEGAL}') THEN '' ELSE {_SQUEEZE('r.d')} END AS description_raw FROM ({_PAGED})")
def record_names_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Names and descriptions read back from pages of four layouts."""
    return page_record.page_records(made_pages(spark, folder)).select("record_id", "name_raw", "description_raw")


_FEATURE_TEXT = r"length(x) BETWEEN 7 AND 500 AND NOT regexp_matches(x, '>|›|»') AND NOT regexp_matches(x, '(?i)\b(?:privacy|terms|trademark|copyright|newsletter|subscribe)\b|https?://|www\.')"


@query(
    f"""WITH f AS (SELECT record_id, pos, {_SQUEEZE('x')} AS x FROM (SELECT record_id, unnest(r.f) AS x, generate_subscripts(r.f, 1) AS pos FROM ({_PAGED}))), g AS (SELECT * FROM f WHERE {_FEATURE_TEXT} AND NOT regexp_matches(lower(x), '{'|'.join(p.replace('.', '[.]') for p in C.L.NAVIGATION_PHRASES)}')),
    d AS (SELECT record_id, lower(x) AS low, min(pos) AS pos, arg_min(x, pos) AS x FROM g GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS rank FROM d)
    SELECT record_id, count(*)::BIGINT AS features, md5(string_agg(x, '|' ORDER BY pos)) AS digest FROM n WHERE rank <= 20 GROUP BY 1"""
)
def record_features_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Features read back from the pages' marked lists."""
    pages = made_pages(spark, folder).join(latest_records(spark, folder).select("record_id", "f"), "record_id")
    own = page_record.page_parts(pages).select("record_id", page_record.page_features(F.filter("blocks", lambda x: x["features"]), F.col("tabs")).alias("f")).where(F.size("f") > 0)
    return own.select("record_id", F.size("f").cast("bigint").alias("features"), F.md5(F.array_join("f", "|")).alias("digest"))


@query(f"SELECT record_id, {_SKU} AS sku FROM ({_PAGED}) WHERE {_SKU} IS NOT NULL AND record_id % 4 <> 1")
def record_codes_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Codes read back from JSON-LD, itemprop and data attributes, without those of labelled texts."""
    parts = page_record.page_parts(made_pages(spark, folder).where(F.col("record_id") % 4 != 1))
    marked = F.filter("blocks", lambda x: ~x["tag"].isin("li", "p", "dt", "dd", "td"))
    return parts.select("record_id", F.get(page_record.page_codes(marked, page_record.structured_product(F.col("blocks"))), 0).alias("sku")).where("sku is not null")


_PAIR = "'^([^:]{2,60}):\\s+(.{2,300})$'"
# A table whose first row reads like the head of a list of parts isn't taken.
_PART_HEAD = page_record.PART_TABLE.pattern
_LEGAL_SQL = f"regexp_matches(key, '{page_record.LEGAL}') OR regexp_matches(value, '{page_record.LEGAL}')"


@query(
    f"""WITH p AS ({_PAGED}), s AS (SELECT record_id, CASE WHEN record_id % 4 = 0 THEN 'table' ELSE 'terms' END AS channel, {_SQUEEZE('k')} AS key, {_SQUEEZE("coalesce(v, '')")} AS value FROM (SELECT record_id, unnest(map_keys(r.specs)) AS k, unnest(map_values(r.specs)) AS v FROM p WHERE record_id % 4 <> 0 OR NOT regexp_matches(map_keys(r.specs)[1] || ' | ' || coalesce(map_values(r.specs)[1], ''), '{_PART_HEAD}'))),
    t AS (SELECT record_id, {_SQUEEZE('x')} AS x FROM (SELECT record_id, unnest(r.f) AS x FROM p UNION ALL SELECT record_id, r.d FROM p WHERE record_id % 4 = 0)),
    l AS (SELECT record_id, 'line' AS channel, regexp_extract(x, {_PAIR}, 1) AS key, regexp_extract(x, {_PAIR}, 2) AS value FROM t WHERE regexp_matches(x, {_PAIR}))
    SELECT record_id, channel, key, value FROM (SELECT * FROM s UNION ALL SELECT * FROM l) WHERE key <> '' AND value <> '' AND length(key) < 80 AND length(value) < 400 AND NOT ({_LEGAL_SQL})"""
)
def record_pairs_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Key/value pairs of pages by table, terms and lines; those of menus, other products and part tables don't come."""
    return page_record.page_parts(made_pages(spark, folder)).select("record_id", F.inline("pairs"))


_OPTIONS = "SELECT record_id, o.option_name AS name, o.value AS value FROM (SELECT record_id, unnest(option_values) AS o FROM (SELECT DISTINCT record_id, variant_id, option_values FROM variants WHERE record_id IS NOT NULL)) WHERE o.option_name IS NOT NULL AND o.value IS NOT NULL"


@query(
    f"""WITH o AS (SELECT record_id, name, {_SQUEEZE('value')} AS value FROM ({_OPTIONS})) SELECT record_id, regexp_replace(name, '[_-]+', ' ', 'g') AS name, array_to_string(list_sort(list_distinct(list(value))), '|') AS "values" FROM o
    WHERE value <> '' AND NOT starts_with(lower(value), 'select') GROUP BY record_id, o.name HAVING count(DISTINCT value) > 1"""
)
def option_groups_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Option names and values read back from select lists of pages."""
    groups = page_record.page_parts(_option_pages(spark, folder)).select("record_id", F.inline("options"))
    return groups.select("record_id", "name", F.array_join(F.array_sort("values"), "|").alias("values"))


def _option_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a select list for each option name of a record's variants: (record_id, html)."""
    rows = table(spark, folder, "variants").where("record_id is not null").select("record_id", "variant_id", "option_values").distinct().select("record_id", F.inline("option_values")).where("option_name is not null and value is not null")
    each = rows.groupBy("record_id", "option_name").agg(F.array_sort(F.collect_set("value")).alias("v"))  # the values of one option of one record
    select = F.concat(F.lit('<select data-option-name="'), _escaped(F.col("option_name")), F.lit('"><option>Select one'), F.array_join(F.transform("v", lambda x: F.concat(F.lit("<option>"), _escaped(x))), ""), F.lit("</select>"))
    return each.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list(select)), "").alias("html"))


_PLAIN_OPTION = lambda x: _strip(f"regexp_replace(regexp_replace({x}, '[;:,]+$', ''), '{_WS}+', ' ', 'g')")


@query(
    f"""WITH o AS (SELECT record_id, {_PLAIN_OPTION("regexp_replace(name, '[_-]+', ' ', 'g')")} AS name, {_PLAIN_OPTION(_SQUEEZE('value'))} AS value, starts_with(lower({_SQUEEZE('value')}), 'select') AS cue, name AS own, {_SQUEEZE('value')} AS raw FROM ({_OPTIONS})),
    g AS (SELECT record_id, name, own, list(DISTINCT value) AS v FROM o WHERE raw <> '' AND NOT cue GROUP BY 1, 2, 3 HAVING count(DISTINCT raw) > 1), m AS (SELECT record_id, name, len(list_distinct(flatten(list(v)))) AS n FROM g WHERE name <> '' GROUP BY 1, 2)
    SELECT record_id, product(n)::BIGINT AS variants, (product(n) - 1)::BIGINT AS last FROM m WHERE n > 1 GROUP BY 1"""
)
def page_variant_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many combinations of options pages state, numbered without a gap."""
    made = variants.page_variants(page_record.page_records(_option_pages(spark, folder).withColumn("url", F.lit("https://shop.example/p"))), "record_id")
    return made.groupBy("record_id").agg(F.count("*").alias("variants"), F.max("idx").alias("last"))


_PLAIN = _SQUEEZE("regexp_replace(regexp_replace(regexp_replace(raw_text, '[“”]', '\"', 'g'), '[‘’]', '''', 'g'), '[–—]', '-', 'g')")
_FIRSTS = ", ".join("('{}', '{}')".format(f, S._pattern(xs[0]).replace("'", "''")) for f, xs in S.spellings().items())


@query(
    f"""WITH t AS (SELECT pdf_id, any_value({_PLAIN}) AS plain FROM (SELECT DISTINCT pdf_id, raw_text FROM pdf_texts WHERE raw_text IS NOT NULL AND pdf_id IS NOT NULL) GROUP BY 1), s(key, pattern) AS (VALUES {_FIRSTS})
    SELECT pdf_id, key, value FROM (SELECT pdf_id, key, {_strip("regexp_extract(plain, '(?i)' || pattern || '[:s-]+(.{2,80})', 1)")} AS value FROM t, s) WHERE value <> ''"""
)
def fields_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that the running text of manuals states, where no pairs are known."""
    rows = table(spark, folder, "pdf_texts").where("raw_text is not null and pdf_id is not null").select("pdf_id", "raw_text").distinct().groupBy("pdf_id").agg(F.any_value("raw_text").alias("raw_text"))
    pairs = F.array().cast("array<struct<key:string,value:string>>")
    return rows.select("pdf_id", F.explode(S.picked(pairs, F.col("raw_text"))))


@query(
    """WITH l AS (SELECT DISTINCT listing_id, name, sku, brand, price, description, images, categories, meta_title FROM product_listings)
    SELECT listing_id, e AS error, count(*)::BIGINT AS times FROM (SELECT listing_id, unnest(list_filter([
      CASE WHEN name IS NULL THEN 'Schema: ''name'' is required' END, CASE WHEN sku IS NULL THEN 'Schema: ''sku'' is required' END, CASE WHEN brand IS NULL THEN 'Schema: ''brand'' is required' END, CASE WHEN price IS NULL THEN 'Schema: ''price'' is required' END,
      CASE WHEN description IS NULL THEN 'Schema: ''description'' is required' END, CASE WHEN categories IS NULL THEN 'Schema: ''categories'' is required' END,
      CASE WHEN length(name) < 3 THEN 'Schema: name is too short' END, CASE WHEN length(name) > 255 THEN 'Schema: name is too long' END, CASE WHEN length(sku) < 1 THEN 'Schema: sku is too short' END, CASE WHEN length(sku) > 60 THEN 'Schema: sku is too long' END,
      CASE WHEN length(description) < 30 THEN 'Schema: description is too short' END, CASE WHEN length(meta_title) > 70 THEN 'Schema: meta_title is too long' END, CASE WHEN length(brand) < 1 THEN 'Schema: brand is too short' END, CASE WHEN price < 0 THEN 'Schema: price is below 0' END,
      CASE WHEN len(images) = 0 THEN 'Schema: images is empty' END, CASE WHEN len(list_filter(images, lambda u: NOT coalesce(regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s/]+[^\\s]*$'), false))) > 0 THEN 'Schema: images holds no address' END,
      CASE WHEN len(categories) = 0 THEN 'Schema: categories is empty' END, CASE WHEN len(list_filter(categories, lambda c: length(c) < 2)) > 0 THEN 'Schema: a category is too short' END], lambda x: x IS NOT NULL)) AS e FROM l) GROUP BY 1, 2"""
)
def listing_schema_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of the product schema by listing, counted over its differing deliveries."""
    names = ["name", "sku", "brand", "price", "description", "images", "categories", "meta_title"]
    rows = table(spark, folder, "product_listings").select("listing_id", *names).distinct()
    errors = rows.select("listing_id", F.explode(quality.product_errors({n: F.col(n) for n in names})).alias("error"))
    return errors.groupBy("listing_id", "error").agg(F.count("*").alias("times"))


@query(
    """WITH v AS (SELECT DISTINCT record_id, variant_id, sku, option_values FROM variants WHERE record_id IS NOT NULL), c AS (SELECT record_id, sku, count(*) AS n, count(*) FILTER (coalesce(len(option_values), 0) = 0) AS bare FROM v GROUP BY 1, 2)
    SELECT record_id, 'BC: duplicate variant SKU ' || sku AS error, (n - 1)::BIGINT AS times FROM c WHERE sku IS NOT NULL AND n > 1 UNION ALL SELECT record_id, 'BC: variant ' || coalesce(sku, '') || ' missing option_values', bare::BIGINT FROM c WHERE bare > 0"""
)
def variant_rule_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Variants that share a sku or have no options, by record."""
    rows = table(spark, folder, "variants").where("record_id is not null").select("record_id", "variant_id", "sku", "option_values").distinct()
    return quality.variant_errors(rows, "record_id")


_HEAD = "coalesce(sections.description, '')"
_SECTION_LINES = lambda x: f"array_to_string(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {_SQUEEZE('l')}), lambda l: l <> ''), chr(10))"


@query(
    f"""WITH p AS ({_PAGES}), v AS (SELECT page_id, {_SECTION_LINES('visible_text')} AS seen, sections FROM p WHERE visible_text IS NOT NULL)
    SELECT page_id, CASE WHEN length(seen) >= 10 THEN md5(seen) END AS visible_digest, {_SECTION_LINES('sections.specifications')} AS specifications, {_SECTION_LINES('sections.features')} AS features FROM v WHERE length(seen) >= 10"""
)
def browsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Text and sections read back from pages: lines as paragraphs of the main part, sections behind it, a menu around them."""
    rows = table(spark, folder, "browse_pages").groupBy("page_id").agg(*(F.any_value(c).alias(c) for c in ("visible_text", "sections"))).where("visible_text is not null")
    lines = lambda c, tag: F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.concat(F.lit(f"<{tag}>"), _escaped(x))), "")
    html = F.concat(
        F.lit("<nav><p>Shop</p></nav><script>var a = 1;</script><main>"), lines(F.col("visible_text"), "p"), F.lit('<div class="side menu"><p>Offers</p></div></main><div class="specs"><ul>'),
        lines(F.col("sections.specifications"), "li"), F.lit("</ul></div><h3>Key features</h3><ul>"), lines(F.col("sections.features"), "li"), F.lit("</ul>"),
    )
    got = browse.browsed(rows.select("page_id", html.alias("html")))
    return got.where(F.length("visible_text") >= 10).select("page_id", F.md5("visible_text").alias("visible_digest"), F.coalesce("sections.specifications", F.lit("")).alias("specifications"), F.coalesce("sections.features", F.lit("")).alias("features"))
