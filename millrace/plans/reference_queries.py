"""Queries of the product-content operators over the whole tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.functions import lines as L, markdown, specs as S, text as T
from millrace.operators import audit, media, pages, projection, quality, records as R, resolve, variants
from millrace.plans import ingest
from millrace.plans.latest import LATEST, latest_records
from millrace.sources.tables import table
from millrace.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` is its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Numbered, stripped, non-blank lines of the documents.
_LINES = f"WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), lines AS (SELECT doc_id, lang, pos, {_strip('raw')} AS line FROM l WHERE {_strip('raw')} <> '')"


def _has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_CLASS = f"CASE WHEN {_has('lower(line)', L.INCLUDED_WORDS)} THEN 'included' WHEN {_has('lower(line)', L.BENEFIT_WORDS)} THEN 'benefit' ELSE 'feature' END"
_ASCII = r"10 * length(regexp_replace(line, '[^\x20-\x7e]', '', 'g')) >= 7 * length(line)"


@query(
    f"""{_LINES}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS rn FROM lines WHERE {_ASCII}),
    per AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_CLASS} = 'feature') AS f, count(*) FILTER ({_CLASS} = 'benefit') AS b, count(*) FILTER ({_CLASS} = 'included') AS i FROM kept WHERE rn = 1 GROUP BY 1),
    docs AS (SELECT d.lang, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(b, 0) AS b, coalesce(i, 0) AS i,
      floor(100.0 * ((CASE WHEN {_strip("coalesce(text, '')")} <> '' THEN 1 ELSE 0 END) + (CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN n > 0 THEN 1 ELSE 0 END)) / 5 + 0.5)::BIGINT AS c
      FROM documents d LEFT JOIN per USING (doc_id))
    SELECT lang, count(*)::BIGINT AS documents, sum(n)::BIGINT AS lines_kept, sum(f)::BIGINT AS features, sum(b)::BIGINT AS benefits, sum(i)::BIGINT AS included, sum(c)::BIGINT AS completeness_sum, count(*) FILTER (c >= 95)::BIGINT AS publishable FROM docs GROUP BY 1"""
)
def flagship_doc_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by language: distinct English lines by class, completeness, publishable ones."""
    docs = table(spark, folder, "documents")
    kept = L.distinct_in_order(F.filter(L.lines_of(F.col("text")), L.english_by_ascii))
    of = lambda c: F.size(F.filter("_c", lambda x: x == c)).cast("bigint")
    missing = quality.missing({"text": (F.col("text"), "text"), "lang": (F.col("lang"), "any"), "source": (F.col("source"), "any"), "title": (F.col("title"), "any"), "lines": (F.col("_k"), "list")})
    scored = docs.withColumn("_k", kept).withColumn("_c", F.transform("_k", L.sentence_class)).select("lang", F.size("_k").alias("n"), of("feature").alias("f"), of("benefit").alias("b"), of("included").alias("i"), quality.completeness(missing, 5).alias("c"))
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return scored.groupBy("lang").agg(F.count("*").alias("documents"), total("n", "lines_kept"), total("f", "features"), total("b", "benefits"), total("i", "included"), total("c", "completeness_sum"), F.sum(F.when(F.col("c") >= 95, 1).otherwise(0)).cast("bigint").alias("publishable"))


@query(f"SELECT doc_id, {_strip(f'''regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')''')} AS clean FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.squeeze(F.col("text")).alias("clean"))


@query(
    f"""{_LINES} SELECT doc_id, count(*) FILTER ({_ASCII})::BIGINT AS by_ascii,
    count(*) FILTER ({_ASCII} AND NOT regexp_matches(lower(line), '[{L.MARKED_LETTERS}]'))::BIGINT AS unmarked,
    count(*) FILTER (length(regexp_replace(line, '{_WS}+', '', 'g')) > 0 AND 10 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 6 * length(regexp_replace(line, '{_WS}+', '', 'g')) AND {_has('lower(line)', L.STOP_WORDS)})::BIGINT AS by_words FROM lines GROUP BY 1"""
)
def english_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document that pass each of the three tests for English."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(L.lines_of(F.col("text"))).alias("line"))
    n = lambda test, name: F.sum(test(F.col("line")).cast("bigint")).alias(name)
    return rows.groupBy("doc_id").agg(n(L.english_by_ascii, "by_ascii"), n(L.english_unmarked, "unmarked"), n(L.english_by_words, "by_words"))


@query("SELECT listing_id, replace(replace(replace(replace(replace(specs_html, '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>') AS decoded FROM product_listings WHERE specs_html IS NOT NULL")
def decoded_markup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "product_listings").where("specs_html is not null").select("listing_id", T.decode_entities(F.col("specs_html")).alias("decoded"))


@query(
    """WITH h AS (SELECT page_id, lower(regexp_extract(source_url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_matches(source_url, '^(?i)https?://') AS http FROM browse_pages)
    SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, http, (host = '' OR host = 'localhost') AS dangerous FROM h"""
)
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("source_url")
    return table(spark, folder, "browse_pages").select("page_id", T.host(url).alias("host"), T.registrable_domain(T.host(url)).alias("domain"), T.is_http(url).alias("http"), T.is_dangerous_host(T.host(url)).alias("dangerous"))


@query(
    """WITH h AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '10.0.' || event_id % 200 || '.1' WHEN 1 THEN '172.' || event_id % 40 || '.3.4' WHEN 2 THEN '192.168.1.' || event_id % 250 WHEN 3 THEN 'shop' || event_id % 9 || '.co.uk' WHEN 4 THEN '8.8.' || event_id % 250 || '.8' ELSE 'node.local' END AS host FROM events)
    SELECT event_id, host, (host LIKE '10.%' OR host LIKE '192.168.%' OR host LIKE '%.local' OR (host LIKE '172.%' AND TRY_CAST(split_part(host, '.', 2) AS INT) BETWEEN 16 AND 31)) AS dangerous FROM h"""
)
def guarded_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts made of event numbers: which of them a fetch must not reach."""
    n = F.col("event_id")
    host = (
        F.when(n % 6 == 0, F.concat(F.lit("10.0."), n % 200, F.lit(".1"))).when(n % 6 == 1, F.concat(F.lit("172."), n % 40, F.lit(".3.4"))).when(n % 6 == 2, F.concat(F.lit("192.168.1."), n % 250))
        .when(n % 6 == 3, F.concat(F.lit("shop"), n % 9, F.lit(".co.uk"))).when(n % 6 == 4, F.concat(F.lit("8.8."), n % 250, F.lit(".8"))).otherwise("node.local")
    )
    return table(spark, folder, "events").select("event_id", host.alias("host")).select("event_id", "host", T.is_dangerous_host(F.col("host")).alias("dangerous"))


@query(f"{_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS rn FROM lines) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS merged FROM k WHERE rn = 1 GROUP BY 1")
def distinct_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.array_join(L.distinct_in_order(L.lines_of(F.col("text"))), "\n").alias("merged")).where("merged <> ''")


@query(
    f"""WITH r AS (SELECT DISTINCT p.page_id, p.sections.description AS a, t.value AS b FROM (SELECT page_id, sections, unnest(map_entries(sections.tabs)) AS t FROM browse_pages) p),
    l AS (SELECT page_id, a, b, 1 AS s, unnest(string_split(coalesce(a, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(a, ''), chr(10)), 1) AS pos FROM r
      UNION ALL SELECT page_id, a, b, 2, unnest(string_split(coalesce(b, ''), chr(10))), generate_subscripts(string_split(coalesce(b, ''), chr(10)), 1) FROM r),
    k AS (SELECT page_id, a, b, s, pos, {_strip('raw')} AS line, row_number() OVER (PARTITION BY page_id, a, b, lower({_strip('raw')}) ORDER BY s, pos) AS rn FROM l WHERE {_strip('raw')} <> '')
    SELECT page_id, string_agg(line, chr(10) ORDER BY s, pos) AS merged FROM k WHERE rn = 1 GROUP BY page_id, a, b"""
)
def merged_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's description and tab text, line by line, each line once."""
    rows = table(spark, folder, "browse_pages").select("page_id", F.col("sections.description").alias("a"), F.explode("sections.tabs").alias("_k", "b")).select("page_id", "a", "b").distinct()
    return rows.select("page_id", L.merged(F.col("a"), F.col("b")).alias("merged")).where("merged <> ''")


@query(f"{_LINES} SELECT coalesce(lang, '') AS lang, {_CLASS} AS class, count(*)::BIGINT AS n FROM lines GROUP BY 1, 2")
def line_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(L.lines_of(F.col("text"))).alias("line"))
    return rows.groupBy("lang", L.sentence_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


# Distinct lists of features with a number each, and their lines.
_FEATURES = f"WITH r AS (SELECT record_id, r.f AS f FROM ({LATEST}) WHERE len(r.f) > 0), d AS (SELECT record_id, f FROM r), l AS (SELECT record_id, unnest(f) AS raw, generate_subscripts(f, 1) AS pos FROM d)"


def _feature_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The list of features of each record's last delivery."""
    return latest_records(spark, folder).where(F.size("f") > 0).select("record_id", "f")


@query(
    f"""{_FEATURES}, s AS (SELECT record_id, pos, {_strip("coalesce(raw, '')")} AS x FROM l), p AS (SELECT *, lag(x) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM s WHERE x <> ''),
    b AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND (regexp_matches(x, '^(?:and|as|to|for|with|in|on)(?:[^A-Za-z0-9_]|$)') OR (regexp_matches(x, '^[a-z]') AND NOT regexp_matches(before, '[.!?]$'))) THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY pos) AS island FROM p)
    SELECT record_id, island::BIGINT AS line_no, string_agg(x, ' ' ORDER BY pos) AS line FROM b GROUP BY 1, 2"""
)
def fragment_merge(spark: SparkSession, folder: str) -> DataFrame:
    lists = _feature_lists(spark, folder).select("record_id", F.posexplode(L.joined_fragments(F.filter("f", lambda x: x.isNotNull()))).alias("p", "line"))
    return lists.select("record_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


_BARE = _strip("regexp_replace(x, '^[-–—]+\\s*', '')")


@query(
    f"""{_FEATURES}, s AS (SELECT record_id, pos, {_strip("coalesce(raw, '')")} AS x FROM l), b AS (SELECT record_id, pos, x, {_BARE} AS bare FROM s WHERE x <> ''), p AS (SELECT *, lag(bare) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM b),
    i AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND (regexp_matches(x, '^[-–—]') OR regexp_matches(before, '(?:[,;:]|(?:^|\\s)(?i:and|or))$')) THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY pos) AS island FROM p)
    SELECT record_id, island::BIGINT AS line_no, string_agg(bare, ' ' ORDER BY pos) AS line FROM i GROUP BY 1, 2"""
)
def compiled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature lines joined at dashes and open ends."""
    lists = _feature_lists(spark, folder).select("record_id", F.posexplode(L.compiled_features(F.col("f"))).alias("p", "line"))
    return lists.select("record_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


@query(
    f"""{_FEATURES}, s AS (SELECT record_id, pos, raw, {_strip('raw')} AS x FROM l WHERE raw IS NOT NULL),
    e AS (SELECT * FROM s WHERE length(x) > 0 AND NOT regexp_matches(lower(x), '[{L.MARKED_LETTERS}]') AND 10 * length(regexp_replace(x, '[^\\x20-\\x7e]', '', 'g')) >= 7 * length(x) AND NOT regexp_matches(x, '[\\\\/]') AND NOT regexp_matches(lower(x), 'español|français')
      AND lower(x) NOT IN ({', '.join(f"'{w}'" for w in L.SECTION_LABELS)}) AND NOT regexp_matches(lower(x), '{L.INSTRUCTION_WORDS}') AND length(raw) <= 150 AND NOT contains(raw, chr(10))),
    u AS (SELECT record_id, lower(x) AS low, min(pos) AS pos, arg_min(x, pos) AS x FROM e GROUP BY 1, 2), p AS (SELECT *, lag(x) OVER (PARTITION BY record_id ORDER BY pos) AS before FROM u),
    b AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND (regexp_matches(x, '^(?:{L.JOINING_WORDS})(?:[^A-Za-z0-9_]|$)') OR (regexp_matches(x, '^[a-z]') AND NOT regexp_matches(before, '[.!?]$'))) THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY pos) AS island FROM p),
    j AS (SELECT record_id, island, string_agg(x, ' ' ORDER BY pos) AS line FROM b GROUP BY 1, 2)
    SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY island)::BIGINT AS line_no, line FROM j WHERE NOT regexp_matches(lower(line), '{L.SPEC_LIKE_STARTS}') AND NOT contains(line, ':')"""
)
def cleaned_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features after the line rules: English, no shop labels, no instructions, each once, fragments joined, no spec lines."""
    lists = _feature_lists(spark, folder).select("record_id", F.posexplode(L.clean_features(F.filter("f", lambda x: x.isNotNull() & L.feature_kept(x)))).alias("p", "line"))
    return lists.select("record_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


@query()
def distinct_features(spark: SparkSession, folder: str) -> DataFrame:
    """Those without near-repeats; the greedy choice is tested against a loop."""
    kept = F.filter("f", lambda x: x.isNotNull() & L.feature_kept(x))
    return _feature_lists(spark, folder).select("record_id", L.without_similar(L.clean_features(kept)).alias("features"))


@query(f"{_LINES} SELECT doc_id, pos::BIGINT AS pos FROM lines WHERE NOT regexp_matches(lower(line), 'use\\s*&\\s*operation|use\\s+and\\s+operation|close\\s+product\\s+options') AND (({' + '.join(f'''contains(lower(line), '{p}')::INT''' for p in L.NAVIGATION_PHRASES)}) >= 2 OR lower(line) IN ({', '.join(f'''{chr(39)}{p}{chr(39)}''' for p in L.NAVIGATION_PHRASES)}))")
def navigation_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    return rows.where((T.strip(F.col("raw")) != "") & L.navigation_line(F.col("raw"))).select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"))


@query(
    f"""WITH l AS (SELECT DISTINCT page_id, unnest(string_split(visible_text, chr(10))) AS raw, generate_subscripts(string_split(visible_text, chr(10)), 1) AS pos FROM (SELECT DISTINCT page_id, visible_text FROM browse_pages)),
    s AS (SELECT page_id, pos, {_strip('raw')} AS x FROM l), b AS (SELECT page_id, min(pos) AS begin FROM s WHERE lower(x) = 'specifications' GROUP BY 1), e AS (SELECT s.page_id, min(pos) AS stop FROM s JOIN b USING (page_id) WHERE pos > begin AND lower(x) = 'follow us' GROUP BY 1),
    k AS (SELECT s.page_id, s.pos, {_strip("regexp_replace(x, '^[-•' || chr(92) || 's]+', '')")} AS line FROM s JOIN b USING (page_id) LEFT JOIN e USING (page_id) WHERE pos > begin AND (stop IS NULL OR pos < stop))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::BIGINT AS line_no, line FROM k WHERE line <> '' AND lower(line) <> 'specifications'"""
)
def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages between the first Specifications and the next Follow us, in order."""
    texts = table(spark, folder, "browse_pages").select("page_id", "visible_text").distinct().where("visible_text is not null")
    rows = texts.select("page_id", F.posexplode(L.section(F.split("visible_text", "\n"), "specifications", "follow us")).alias("p", "line"))
    return rows.select("page_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


@query(
    f"""WITH p AS (SELECT a.doc_id AS a, b.doc_id AS b, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS x, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    n AS (SELECT a, b, len(list_intersect(list_distinct(x), list_distinct(y))) AS i, len(list_distinct(list_concat(x, y))) AS u FROM p)
    SELECT a, b, CASE WHEN u = 0 THEN 0.0 ELSE round(i::DOUBLE / u, 6) END AS similarity FROM n"""
)
def token_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Token Jaccard of every document and the next."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("text").alias("other"))
    ascii_ = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    met = docs.where("text is not null").join(after.where("other is not null"), "doc_id")
    none = docs.join(after, "doc_id").where("text is null or other is null").select(F.col("doc_id").alias("a"), "b", F.lit(None).cast("double").alias("similarity"))
    return met.select(F.col("doc_id").alias("a"), "b", F.round(L.token_jaccard(ascii_("text"), ascii_("other")), 6).alias("similarity")).union(none)


# Spec lines made of the parts, so that every branch of the reading occurs.
_SPEC_LINE = "CASE p_partkey % 4 WHEN 0 THEN 'Seat Width: ' || p_size || ' in' WHEN 1 THEN 'Frame Finish: ' || p_brand WHEN 2 THEN 'Net  Weight - ' || p_size || ' lbs' ELSE 'Total weight capacity ' || p_size || ' lbs' END"


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'seat_width' WHEN 1 THEN CASE WHEN regexp_matches(p_brand, '[0-9]') THEN 'frame_finish' END WHEN 2 THEN 'net_weight' ELSE 'total_weight_capacity' END AS key,
    CASE p_partkey % 4 WHEN 0 THEN p_size || ' in' WHEN 1 THEN CASE WHEN regexp_matches(p_brand, '[0-9]') THEN p_brand END ELSE p_size || ' lbs' END AS value FROM part"""
)
def spec_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", F.expr(_SPEC_LINE).alias("line"))
    return rows.select("p_partkey", S.spec_line(F.col("line")).alias("p")).select("p_partkey", "p.key", "p.value")


@query(
    """WITH t AS (SELECT p_partkey, 'seat width' AS k, p_size || ' in.' AS v, 1 AS o FROM part UNION ALL SELECT p_partkey, 'weight capacity', p_size * 10 || ' lb.', 2 FROM part UNION ALL SELECT p_partkey, 'shipping weight', p_size * 100 || ' lb plus pallet', 3 FROM part)
    SELECT p_partkey, max(v) FILTER (o = 1) AS seat_width, max(v) FILTER (o = 2) AS weight_capacity, max(v) FILTER (o = 3) AS weight FROM t GROUP BY 1"""
)
def picked_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical fields out of the sentences of made-up manuals: of several keys the longest value."""
    text = F.concat(F.lit("Seat Width: "), "p_size", F.lit(" in. Weight Capacity: "), F.col("p_size") * 10, F.lit(" lb. Shipping Weight: "), F.col("p_size") * 100, F.lit(" lb plus pallet"))
    pick = S.picked(S.key_values(text))
    get = lambda k: F.try_element_at(pick, F.lit(k)).alias(k)
    return table(spark, folder, "part").select("p_partkey", get("seat_width"), get("weight_capacity"), get("weight"))


_LOW_KEY = f"lower(regexp_replace({_strip('key')}, '{_WS}+', ' ', 'g'))"
_CANON = (
    "coalesce(map {" + ", ".join(f"'{a}': '{b}'" for a, b in S.KEY_SYNONYMS.items()) + "}[k], "
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '[^\p{L}\p{N} /.\-]+', '', 'g'), '/', '_', 'g'), ' +', '_', 'g'), '-+', '_', 'g'), '^_+|_+$', '', 'g'))"
)


@query(f"WITH e AS (SELECT unnest(map_keys(specs)) AS key FROM product_records), l AS (SELECT key, {_LOW_KEY} AS k FROM e) SELECT key, {_CANON} AS canonical, count(*)::BIGINT AS n FROM l GROUP BY 1, 2")
def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_records").select(F.explode(F.map_keys("specs")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n")).select("key", S.canonical_key(F.col("key")).alias("canonical"), "n")


@query(
    r"""WITH e AS (SELECT record_id, unnest(map_entries(specs)) AS e FROM product_records), v AS (SELECT DISTINCT record_id, e.key AS key, e.value AS value FROM e)
    SELECT record_id, key, """
    + _strip(
        r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '([0-9])\s*["”]', '\1 in', 'g'), '([0-9])\s*[''’]', '\1 ft', 'g'), '(?i)\b(?:pounds?|lbs?)\b', 'lb', 'g'), '(?i)\bounces?\b', 'oz', 'g'), '(?i)\bmillimet(?:er|re)s?\b', 'mm', 'g'), '(?i)\bcentimet(?:er|re)s?\b', 'cm', 'g'), '(?i)\bkilograms?\b', 'kg', 'g'), '(?i)\bgrams?\b', 'g', 'g'), '"""
        + _WS
        + "{2,}', ' ', 'g')"
    )
    + " AS value FROM v"
)
def typed_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_records").select("record_id", F.explode("specs")).distinct()
    return rows.select("record_id", "key", S.units_typed(F.col("value")).alias("value"))


@query("SELECT p_partkey, p_size::DOUBLE AS width, (p_size + 2)::DOUBLE AS depth, (p_size + 5)::DOUBLE AS height, CASE p_partkey % 3 WHEN 0 THEN 'cm' WHEN 1 THEN 'in' ELSE 'in' END AS unit FROM part")
def parsed_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_size")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(" x "), n + 2, F.lit(" x "), n + 5, F.lit(" centimeters"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("\" × "), n + 2, F.lit(' × '), n + 5)).otherwise(F.concat(n, F.lit("x"), n + 2, F.lit("x"), n + 5))
    return table(spark, folder, "part").select("p_partkey", S.dimensions(text).alias("d")).select("p_partkey", "d.*")


@query("SELECT record_id, list_sort(map_keys(specs)) AS keys FROM (SELECT DISTINCT record_id, map_from_entries(list_filter(map_entries(specs), lambda e: NOT (trim(e.key) = '' OR regexp_matches(e.key, '^[0-9]+$') OR e.key LIKE '#%' OR regexp_matches(e.key, '[0-9].*_.*[0-9]|_[0-9]+$') OR regexp_matches(lower(e.key), 'item#|case_quantity|hcpcs|productid|simple_store|covid')))) AS specs FROM product_records WHERE specs IS NOT NULL)")
def pruned_specs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_records").where("specs is not null").select("record_id", F.sort_array(F.map_keys(S.pruned(F.col("specs")))).alias("keys"))
    return rows.distinct()


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE s_name END AS brand, s_name AS maker, p_type AS kind FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) + 1"
)
def overlaid_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Specs of a part over those of a supplier; the part's win where it has the key."""
    supplier = table(spark, folder, "supplier")
    n = supplier.count()
    part = table(spark, folder, "part").withColumn("s_suppkey", F.col("p_partkey") % n + 1)
    rows = part.join(supplier, "s_suppkey", "left")
    over = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("brand"), "p_brand", F.lit("kind"), "p_type")).otherwise(F.create_map(F.lit("kind"), "p_type"))
    both = S.overlaid(F.create_map(F.lit("brand"), "s_name", F.lit("maker"), "s_name"), over)
    return rows.select("p_partkey", *(F.try_element_at(both, F.lit(k)).alias(k) for k in ("brand", "maker", "kind")))


_SIDES = {
    "A": ("product_records", "record_id", {"brand": "brand", "sku": "sku"}),
    "B": ("documents", "record_id", {"brand": "brand"}),
    "C": ("variants", "record_id", {"sku": "sku"}),
}


@query(
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT {k} AS record_id, '{f}' AS field, {c} AS value, {i} AS r, '{n}' AS s FROM {t}" for i, (n, (t, k, cs)) in enumerate(_SIDES.items()) for f, c in cs.items())
    + """), p AS (SELECT record_id, field, r, s, min(value) AS value FROM t WHERE value IS NOT NULL AND record_id IS NOT NULL GROUP BY 1, 2, 3, 4),
    c AS (SELECT record_id, field, arg_min(value, r) AS value, arg_min(s, r) AS choice FROM p GROUP BY 1, 2),
    o AS (SELECT p.record_id, p.field, p.value AS other, min(p.r) AS r, p.value || ' (from ' || string_agg(p.s, '+' ORDER BY p.r) || ')' AS said FROM p JOIN c USING (record_id, field) WHERE p.value <> c.value GROUP BY 1, 2, 3),
    d AS (SELECT record_id, field, string_agg(said, '; ' ORDER BY r) AS discarded FROM o GROUP BY 1, 2)
    SELECT record_id, field, value, choice, discarded, discarded IS NOT NULL AS conflict FROM c LEFT JOIN d USING (record_id, field)"""
)
def resolved_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Brand and sku of each record by three sources, with conflicts."""
    sides = []
    for name, (t, key, columns) in _SIDES.items():
        rows = table(spark, folder, t).where(F.col(key).isNotNull())
        sides.append((name, resolve.as_fields(rows.select(F.col(key).alias("record_id"), *(F.col(c).alias(f) for f, c in columns.items())), "record_id", list(columns))))
    return resolve.resolved(sides, "record_id")


_MISSING = {"name": "name_raw IS NULL OR trim(name_raw) = ''", "brand": "brand IS NULL OR trim(brand) = ''", "description": "description_raw IS NULL OR trim(description_raw) = ''", "features": "features_raw IS NULL OR len(features_raw) = 0", "specs": "specs IS NULL"}


@query(
    f"""WITH m AS (SELECT record_id, ingested_at, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _MISSING.items())}], lambda x: x IS NOT NULL) AS missing FROM product_records)
    SELECT DISTINCT record_id, array_to_string(missing, ',') AS missing, ((5 - len(missing)) * 20)::BIGINT AS score, (len(missing) = 0) AS publishable FROM m"""
)
def publish_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_records")
    gone = quality.missing({"name": (F.col("name_raw"), "text"), "brand": (F.col("brand"), "text"), "description": (F.col("description_raw"), "text"), "features": (F.col("features_raw"), "list"), "specs": (F.col("specs"), "any")})
    scored = rows.select("record_id", gone.alias("_m")).withColumn("score", quality.completeness(F.col("_m"), 5))
    return scored.select("record_id", F.array_join("_m", ",").alias("missing"), "score", quality.publishable(F.col("_m"), F.col("score")).alias("publishable")).distinct()


def _grade_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN 4 WHEN {n} >= 1 THEN 2 ELSE 0 END"


@query(
    f"""WITH s AS (SELECT DISTINCT record_id, ({_grade_sql('len(features_raw)')} + {_grade_sql('cardinality(specs)')} + CASE WHEN len(manuals) > 0 THEN 1 ELSE 0 END) AS tenths FROM product_records)
    SELECT record_id, tenths::BIGINT AS tenths, tenths < 7 AS needs_review FROM s"""
)
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_records").select("record_id", quality.quality_tenths(F.col("features_raw"), F.col("specs"), F.col("manuals")).cast("bigint").alias("tenths"))
    return rows.withColumn("needs_review", F.col("tenths") < 7).distinct()


@query(
    """WITH l AS (SELECT listing_id, sku, categories, description, meta_title, images, list_filter([
      CASE WHEN len(list_filter(categories, lambda c: regexp_matches(lower(c), 'supplement|medical'))) > 0 THEN 'Content: missing required regulatory disclaimer' END,
      CASE WHEN contains(lower(description), 'cures cancer') THEN 'Content: banned phrase detected → cures cancer' END, CASE WHEN contains(lower(description), 'guaranteed results') THEN 'Content: banned phrase detected → guaranteed results' END,
      CASE WHEN contains(lower(description), 'fda-approved') THEN 'Content: banned phrase detected → FDA-approved' END,
      CASE WHEN length(meta_title) > 70 THEN 'SEO: meta_title exceeds 70 chars' END, CASE WHEN coalesce(len(images), 0) < 1 THEN 'Images: at least one product image is required' END,
      CASE WHEN coalesce(sku, '') = '' THEN 'BC: root SKU missing' END], lambda x: x IS NOT NULL) AS errors FROM product_listings) SELECT DISTINCT listing_id, array_to_string(errors, '|') AS errors FROM l"""
)
def rule_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_listings")
    null = F.lit(None).cast("string")
    errors = F.concat(quality.content_errors(F.col("categories"), null, F.col("description"), F.col("meta_title"), null, F.col("images")), quality.catalogue_errors(F.col("sku"), F.lit(None)))
    return rows.select("listing_id", F.array_join(errors, "|").alias("errors")).distinct()


@query(
    """SELECT p_partkey, (c.i * 2 + s.i)::BIGINT AS idx, p_brand || '-' || c.v || '-' || upper(s.v || p_size) AS sku FROM part, (VALUES (0, 'RED'), (1, 'BLUE')) c(i, v), (VALUES (0, 'S'), (1, 'L')) s(i, v)"""
)
def expanded_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Two colours by two sizes of every part, with their skus."""
    groups = F.array(F.struct(F.lit("Color").alias("name"), F.array(F.lit("Red"), F.lit("Blue")).alias("values")), F.struct(F.lit("Size").alias("name"), F.array(F.concat(F.lit("S "), "p_size"), F.concat(F.lit("L "), "p_size")).alias("values")))
    return variants.expanded(table(spark, folder, "part").withColumn("g", groups), "p_partkey", "g", "p_brand").select("p_partkey", "idx", "sku")


_PLAIN_VALUE = lambda x: _strip(f"regexp_replace(regexp_replace(regexp_replace({x}, '[;:,]+$', ''), '[\\r\\n\\t]+', ' ', 'g'), '{_WS}{{2,}}', ' ', 'g')")


@query(
    f"""WITH e AS (SELECT record_id, unnest(map_keys(r.specs)) AS k, unnest(map_values(r.specs)) AS v FROM ({LATEST})),
    p AS (SELECT record_id, {_PLAIN_VALUE('k')} AS name, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(v, ''), '{_WS}+[oO][rR]{_WS}+', ',', 'g'), '[/,:;]+'), lambda x: {_PLAIN_VALUE('x')}), lambda x: x <> ''))) AS value, k FROM e)
    SELECT record_id, name, array_to_string(list_sort(list(value)), '|') AS "values" FROM p WHERE name <> '' GROUP BY record_id, name, k HAVING count(*) > 1"""
)
def spec_option_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Option groups that the specs of each record suggest."""
    rows = latest_records(spark, folder).select("record_id", F.explode(variants.spec_groups(F.col("specs"))).alias("g"))
    return rows.select("record_id", "g.name", F.array_join(F.array_sort("g.values"), "|").alias("values"))


@query(
    f"""WITH l AS (SELECT DISTINCT page_id, unnest(string_split(visible_text, chr(10))) AS raw FROM (SELECT DISTINCT page_id, visible_text FROM browse_pages)), s AS (SELECT page_id, {_strip('raw')} AS x FROM l)
    SELECT page_id, {_strip("regexp_extract(x, '^([0-9]+) × (.+)$', 2)")} AS item, sum(regexp_extract(x, '^([0-9]+) × (.+)$', 1)::BIGINT)::BIGINT AS quantity FROM s WHERE regexp_matches(x, '^[0-9]+ × .+$') GROUP BY 1, 2"""
)
def included_quantities(spark: SparkSession, folder: str) -> DataFrame:
    """What a page says is in the box, ``n × item``, equal lines counted once, summed by item."""
    rows = table(spark, folder, "browse_pages").select("page_id", "visible_text").distinct().select("page_id", F.explode(F.split("visible_text", "\n")).alias("raw")).distinct()
    return included_items(rows.where(T.strip(F.col("raw")).rlike("^[0-9]+ × .+$")), "page_id", "raw")


# Numbers in words.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def included_items(rows: DataFrame, key: str, line: str) -> DataFrame:
    """(key, item, quantity) of lines such as ``2 x tube``, ``two tubes``, ``tube x 2`` or ``tube (2)``."""
    x = F.replace(T.squeeze(F.col(line)), F.lit("×"), F.lit("x"))
    number = F.create_map(*[v for i, w in enumerate(NUMBER_WORDS, 1) for v in (F.lit(w), F.lit(i))])
    word = lambda p: F.try_element_at(number, F.lower(F.regexp_extract(x, p, 1)))
    forms = [(r"(?i)^([0-9]+)\s*x\s*(.+)$", 1, 2, False), (r"(?i)^([a-z]+)\s*x\s*(.+)$", 1, 2, True), (r"^([0-9]+)\s+(.+)$", 1, 2, False), (r"(?i)^([a-z]+)\s+(.+)$", 1, 2, True), (r"(?i)^(.+)\s+x\s*([0-9]+)$", 2, 1, False), (r"^(.+)\s+\(([0-9]+)\)$", 2, 1, False)]
    item, quantity = x, F.lit(1).cast("bigint")
    for pattern, n, rest, in_words in reversed(forms):
        hit = word(pattern).isNotNull() if in_words else x.rlike(pattern)
        count = word(pattern).cast("bigint") if in_words else F.regexp_extract(x, pattern, n).try_cast("bigint")
        item, quantity = F.when(hit, F.regexp_extract(x, pattern, rest)).otherwise(item), F.when(hit, count).otherwise(quantity)
    bare = T.squeeze(F.regexp_replace(item, r"^[\s•\-–—]+", ""))
    return rows.select(key, bare.alias("item"), F.coalesce(quantity, F.lit(1)).alias("quantity")).where("item <> ''").groupBy(key, "item").agg(F.sum("quantity").cast("bigint").alias("quantity"))


@query(
    """WITH i AS (SELECT DISTINCT p_partkey, u FROM part, (VALUES (1, 'https://a.example/p/' ), (2, 'https://b.example/q/')) v(n, b), LATERAL (SELECT b || 'Photo' || p_partkey % 7 || '.jpg' AS u) x)
    SELECT p_partkey, 1::BIGINT AS rank, 'https://b.example/q/photo' || p_partkey % 7 || '.jpg?w=900' AS url FROM part"""
)
def distinct_images(spark: SparkSession, folder: str) -> DataFrame:
    """Two URLs of one photo for each part; the larger stays, in the first one's place."""
    name = F.concat(F.lit("photo"), F.col("p_partkey") % 7, F.lit(".jpg"))
    urls = F.array(F.concat(F.lit("https://a.example/p/Photo"), F.col("p_partkey") % 7, F.lit(".jpg?w=300")), F.concat(F.lit("https://b.example/q/"), name, F.lit("?w=900")))
    return media.distinct_images(table(spark, folder, "part").select("p_partkey", F.posexplode(urls).alias("pos", "url")), "p_partkey")


@query("SELECT p_partkey, 'https://a.example/' || greatest(p_size, 25) || '.jpg' AS url FROM part")
def largest_sources(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_size")
    srcset = F.concat(F.lit("https://a.example/25.jpg 25w, https://a.example/"), n, F.lit(".jpg "), n, F.lit("w"))
    return table(spark, folder, "part").select("p_partkey", media.largest_source(srcset).alias("url"))


@query("WITH m AS (SELECT DISTINCT record_id, unnest(manuals) AS u FROM product_records) SELECT DISTINCT record_id, replace(trim(regexp_replace(u, '#.*$', '')), ' ', '%20') AS url FROM m WHERE u IS NOT NULL")
def manual_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "product_records").select("record_id", F.explode(media.manual_urls(F.col("manuals"))).alias("url")).distinct()


@query("SELECT DISTINCT listing_id, i::BIGINT AS item_no, regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g') AS text FROM (SELECT listing_id, unnest(regexp_extract_all(specs_html, '<li>([^<]*)</li>', 1)) AS x, generate_subscripts(regexp_extract_all(specs_html, '<li>([^<]*)</li>', 1), 1) AS i FROM product_listings) WHERE trim(x) <> ''")
def markup_items(spark: SparkSession, folder: str) -> DataFrame:
    """List items of the listings' markup, by way of the element relation."""
    nodes = pages.page_nodes(table(spark, folder, "product_listings").select("listing_id", "specs_html").distinct(), "listing_id", "specs_html")
    items = pages.subtree_texts(nodes, "listing_id", F.col("tag") == "li")
    return items.select("listing_id", F.row_number().over(W.partitionBy("listing_id").orderBy("ord")).cast("bigint").alias("item_no"), "text")


_BUCKET = "CASE " + " ".join(f"WHEN {_has('lower(title)', words)} THEN '{bucket}'" for bucket, words in pages.TAB_WORDS.items()) + " ELSE '' END"


@query(
    f"""WITH t AS (SELECT DISTINCT page_id, unnest(map_keys(sections.tabs)) AS title, unnest(map_values(sections.tabs)) AS "text" FROM browse_pages)
    SELECT page_id, {_BUCKET} AS bucket, arg_max("text", (length("text"), "text")) AS "text", count(*)::BIGINT AS tabs FROM t GROUP BY 1, 2"""
)
def tab_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Tabs of the pages by bucket, with the longest text of each page's bucket."""
    tabs = table(spark, folder, "browse_pages").select("page_id", F.explode("sections.tabs").alias("title", "text")).distinct()
    return tabs.groupBy("page_id", pages.tab_bucket(F.col("title")).alias("bucket")).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"), F.count("*").alias("tabs"))


@query("SELECT p_partkey, p_brand AS brand, p_name AS name, p_retailprice AS price, 'sku-' || p_partkey AS sku FROM part")
def structured_products(spark: SparkSession, folder: str) -> DataFrame:
    """Product facts read back from JSON-LD made of the parts."""
    json = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.concat(F.lit("sku-"), "p_partkey").alias("sku"), F.array(F.struct(F.col("p_retailprice").alias("price"))).alias("offers")))
    doc = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    return table(spark, folder, "part").select("p_partkey", get("$.brand.name", "string").alias("brand"), get("$.name", "string").alias("name"), get("$.offers[0].price", "double").alias("price"), get("$.sku", "string").alias("sku"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(p_name || ' by ' || p_brand, 1, 155) AS meta, lower(p_type) || ', ' || lower(p_brand) AS keywords FROM part")
def search_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), F.substring(F.concat("p_name", F.lit(" by "), "p_brand"), 1, 155).alias("meta"), F.lower(F.concat_ws(", ", "p_type", "p_brand")).alias("keywords"))


@query(
    """WITH q AS (SELECT event_id, event_type, user_id::VARCHAR AS user_text, CASE event_id % 3 WHEN 0 THEN 'Pending_Scrape ' ELSE 'done' END AS status FROM events), p AS (SELECT * FROM q WHERE lower(trim(status)) = 'pending_scrape')
    SELECT event_id, 'event_type' AS "column", event_type AS value FROM p WHERE event_type IS NOT NULL UNION ALL SELECT event_id, 'user_text', user_text FROM p WHERE user_text IS NOT NULL"""
)
def queue_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Pending rows of a queue made of the events, as the cells to write."""
    rows = table(spark, folder, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_text"), F.when(F.col("event_id") % 3 == 0, "Pending_Scrape ").otherwise("done").alias("ingest_status"))
    return queue.cells(queue.pending(rows), "event_id", ["event_type", "user_text"])


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last FROM l WHERE last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY last DESC, user_id LIMIT 100")
def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred users seen last, within a day of the last event: what a cache of that size would hold."""
    events = table(spark, folder, "events")
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return queue.live_entries(events, "user_id", "ts", now, ttl_seconds=86_400, most=100)


@query("SELECT event_id, CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) END AS letters FROM (SELECT event_id, (event_id % 700 + 1)::INT AS n FROM events)")
def column_letters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", T.column_letters(F.col("event_id") % 700 + 1).alias("letters"))


@query()
def ingested_records(spark: SparkSession, folder: str) -> DataFrame:
    """Product records after all stages; each stage is tested by itself."""
    everything = table(spark, folder, "product_records")
    rows = everything.where("record_id is not null").groupBy("record_id").agg(F.max_by(F.struct(*everything.columns), F.struct("ingested_at", "fetched_at")).alias("r")).select("r.*")
    out = ingest.ingested(rows)
    return out.select("record_id", "name_raw", "brand", "description_raw", "features_raw", F.size("specs").alias("specs"), "quality_score", "needs_review")


@query(
    """WITH c AS (SELECT record_id, lower(sku) AS low, sku AS code, 1 AS ord, 5 AS base FROM product_records WHERE sku IS NOT NULL UNION ALL SELECT record_id, lower(sku), sku, 2, 3 FROM variants WHERE sku IS NOT NULL),
    k AS (SELECT record_id, low, trim(regexp_replace(code, '\\s+', ' ', 'g')) AS code, ord, base FROM c WHERE record_id IS NOT NULL AND trim(code) <> '' AND NOT regexp_matches(trim(code), '^([0-9]{8}|[0-9]{12,14})$')),
    f AS (SELECT record_id, low, min(ord) AS ord, arg_min(code, (ord, -base, code)) AS code, arg_min(base, (ord, -base, code)) AS base FROM k GROUP BY 1, 2),
    s AS (SELECT *, base + CASE WHEN regexp_matches(code, '[A-Za-z]') AND regexp_matches(code, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN length(code) BETWEEN 3 AND 40 THEN 1 ELSE 0 END AS score FROM f)
    SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, ord, code) AS rank, code, score::BIGINT AS score FROM s"""
)
def ranked_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of each record by its own sku and its variants'."""
    own = table(spark, folder, "product_records").where("record_id is not null and sku is not null").select("record_id", F.lit(1).alias("ord"), F.lit("structured").alias("source"), F.col("sku").alias("code"))
    other = table(spark, folder, "variants").where("record_id is not null and sku is not null").select("record_id", F.lit(2).alias("ord"), F.lit("labelled").alias("source"), F.col("sku").alias("code"))
    return R.ranked_codes(own.union(other), "record_id")


@query("SELECT DISTINCT record_id, CASE WHEN regexp_matches(w, '^[A-Z][A-Za-z0-9-]+$') AND NOT list_contains(['" + "','".join(R.NO_BRAND) + "'], lower(w)) THEN w ELSE '' END AS brand FROM (SELECT record_id, string_split(" + _strip(f"regexp_replace(coalesce(name_raw, ''), '{_WS}+', ' ', 'g')") + ", ' ')[1] AS w FROM product_records)")
def named_brands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "product_records").select("record_id", R.brand_of_name(F.col("name_raw")).alias("brand")).distinct()


@query("SELECT DISTINCT page_id, regexp_extract(lower(source_url), '/p/([a-z0-9._-]+)', 1) AS code FROM browse_pages WHERE regexp_matches(lower(source_url), '/p/[a-z0-9._-]')")
def url_codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "browse_pages").select("page_id", F.explode(R.codes_of_url(F.col("source_url"))).alias("code")).distinct()


@query(
    f"WITH r AS (SELECT record_id, r.name AS name, r.d AS d, r.specs AS specs, r.f AS f FROM ({LATEST}))"
    "  SELECT record_id, coalesce(name, '') AS title, substr("
    + _strip("regexp_replace(coalesce(d, ''), chr(10) || '+', ' ', 'g')")
    + ", 1, 155) AS meta, lower(array_to_string(list_filter(list_concat(coalesce(list_sort(map_keys(specs)), []), coalesce(f, [])), lambda x: x IS NOT NULL), ', ')) AS keywords, regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM r"
)
def record_search_fields(spark: SparkSession, folder: str) -> DataFrame:
    one = latest_records(spark, folder)
    return one.select("record_id", R.search_fields(F.col("name"), F.col("d"), F.col("specs"), F.col("f")).alias("s")).select("record_id", "s.*")


@query("SELECT p_partkey, '| Spec | Value |' || chr(10) || '|---|---|' || chr(10) || '| P Brand | ' || p_brand || ' |' || chr(10) || '| P Size | ' || p_size || ' |' AS markdown FROM part")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", markdown.spec_table(F.create_map(F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_brand"), "p_brand")).alias("markdown"))


@query(
    "SELECT DISTINCT listing_id, array_to_string(list_filter([CASE WHEN coalesce(sku, '') <> '' AND contains(lower(name), lower(sku)) THEN 'sku' END, CASE WHEN regexp_matches(name, '(?:^|[^0-9])(?:[0-9]{8}|[0-9]{12,14})(?:[^0-9]|$)') THEN 'gtin' END, CASE WHEN regexp_matches(name, '[™®℠©]') THEN 'mark' END, CASE WHEN regexp_matches("
    + _strip("name")
    + r", '(?i)(?:[-–,:;&]|\s(?:and|or|with|for|of|the))$') THEN 'hanging end' END], lambda x: x IS NOT NULL), ',') AS faults FROM product_listings"
)
def name_faults(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "product_listings").select("listing_id", F.array_join(audit.name_faults(F.col("name"), F.col("sku")), ",").alias("faults")).distinct()


@query("WITH s AS (SELECT listing_id, arg_max(struct_pack(i := images), (ingested_at, price)).i AS i FROM product_listings GROUP BY 1) SELECT listing_id, count(DISTINCT lower(split_part(regexp_extract(u, '([^/]*)$', 1), '?', 1)))::BIGINT AS images FROM (SELECT listing_id, unnest(i) AS u FROM s) WHERE u IS NOT NULL GROUP BY 1")
def image_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many different images each listing shows."""
    one = table(spark, folder, "product_listings").groupBy("listing_id").agg(F.max_by("images", F.struct("ingested_at", "price")).alias("i"))
    return one.select("listing_id", F.explode("i").alias("u")).where("u is not null").groupBy("listing_id").agg(F.count_distinct(media.image_key(F.col("u"))).alias("images"))


_PADS = [bytes(b ^ n for b in b"secret".ljust(64, b"\0")).hex() for n in (0x36, 0x5C)]


@query(
    f"""WITH s AS (SELECT event_id, event_id % 2 = 0 AS kept, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(event_type)))) AS signature FROM events)
    SELECT event_id, signature, kept AS holds FROM s"""
)
def signed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures of event payloads, and whether they hold for payloads of which every second one was changed on its way."""
    rows = table(spark, folder, "events").select("event_id", "event_type", R.signed(F.col("event_type"), "secret").alias("signature"))
    got = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("!")))
    return rows.select("event_id", "signature", R.signature_holds(got, F.col("signature"), "secret").alias("holds"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages made of the parts: (p_partkey, url, html)."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<title>Shop</title><nav><a href=/home>Home</a></nav><main><h1>"), "p_name", F.lit("</h1><p>Made by <b>"), "p_brand", F.lit("</b> for daily use.</p><table><tr><th>Seat Width<td>"), size,
        F.lit(" inches</tr></table><dl><dt>Max weight<dd>"), size, F.lit("0 pounds</dl><ul><li>Color: "), "p_type", F.lit("</ul><img src=/i/"), n, F.lit(".jpg?w=100><img src=/i/"), n,
        F.lit(".jpg?w=900><a href=#t1>Features</a><div id=t1><p>Folds "), size, F.lit(" ways</p></div></main><div class=related><img src=/i/other.jpg></div><script type=application/ld+json>"),
        F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.concat(F.lit("sku-"), n).alias("sku"), F.struct(F.col("p_retailprice").alias("price")).alias("offers"))), F.lit("</script>"),
    )
    return table(spark, folder, "part").select("p_partkey", F.concat(F.lit("https://a.example/p/"), n).alias("url"), html.alias("html"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_nodes(_pages(spark, folder), "p_partkey", "html")


@query("SELECT p_partkey, 'Shop' AS title, p_name AS heading, 'Made by ' || p_brand || ' for daily use.' AS paragraph FROM part")
def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    return projection.page_facts(_nodes(spark, folder), "p_partkey").select("p_partkey", "title", "heading", "paragraph")


@query("SELECT p_partkey, p_size || ' inches' AS seat_width, p_size || '0 lb' AS weight_capacity, p_type AS color FROM part")
def page_specs(spark: SparkSession, folder: str) -> DataFrame:
    specs = projection.spec_map(projection.spec_pairs(_nodes(spark, folder), "p_partkey"), "p_partkey")
    return specs.select("p_partkey", *(F.try_element_at("specs", F.lit(k)).alias(k) for k in ("seat_width", "weight_capacity", "color")))


@query("SELECT p_partkey, p_name AS name, 'sku-' || p_partkey AS sku, p_retailprice AS price FROM part")
def page_products(spark: SparkSession, folder: str) -> DataFrame:
    return projection.json_ld_product(_nodes(spark, folder), "p_partkey").select("p_partkey", "name", "sku", "price")


@query("SELECT p_partkey, 'Features' AS title, 'Folds ' || p_size || ' ways' AS text FROM part")
def page_tabs(spark: SparkSession, folder: str) -> DataFrame:
    return projection.tabs(_nodes(spark, folder), "p_partkey").select("p_partkey", "title", "text")


@query("SELECT p_partkey, 1::BIGINT AS rank, 'https://a.example/i/' || p_partkey || '.jpg?w=900' AS url FROM part")
def page_images(spark: SparkSession, folder: str) -> DataFrame:
    return projection.images(_nodes(spark, folder), "p_partkey", _pages(spark, folder))
