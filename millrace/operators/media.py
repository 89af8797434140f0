"""Images and documents of product pages: identity, size, choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions.text import decode_once, strip

_IMAGE = r"(?i)\.(?:jpe?g|png|webp|gif)(?:$|[?#])"


def image_key(url: Column) -> Column:
    """The file an image URL shows: an image name inside a query value, else the last part of the path; decoded, in small letters."""
    values = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), p))
    inner = F.try_element_at(F.filter(values, lambda v: v.rlike(_IMAGE)), F.lit(1))
    name = lambda u: F.element_at(F.split(F.element_at(F.split(u, "/"), -1), "[?#]"), 1)
    return F.lower(decode_once(F.coalesce(name(inner), F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1))))


def declared_size(url: Column) -> Column:
    """The larger side that a URL states in its query, else as ``WxH``, else 0."""
    asked = lambda names: F.try_to_number(F.nullif(F.regexp_extract(url, rf"(?i)[?&](?:{names})=([0-9]{{1,6}})", 1), F.lit("")), F.lit("999999")).cast("int")
    wide, high = F.coalesce(asked("width|w|wid|size"), F.lit(0)), F.coalesce(asked("height|h|hei|size"), F.lit(0))
    pair = [F.coalesce(F.regexp_extract(url, r"(?i)([0-9]{2,5})\s*x\s*([0-9]{2,5})", g).try_cast("int"), F.lit(0)) for g in (1, 2)]
    query = F.greatest(wide, high)
    return F.when(query > 0, query).otherwise(F.greatest(*pair))


def distinct_images(images: DataFrame, key: str, url: str = "url", pos: str = "pos", limit: int = 12) -> DataFrame:
    """(key, rank, url): one row for each image shown, at the place of its first URL, with its largest URL.

    A URL that states no size counts as the original and so as the largest. At most ``limit``
    images of a page, and only URLs that come before the last of them count.
    """
    sized = images.where(F.col(url).isNotNull()).select(key, F.col(url).alias("_url"), F.col(pos).alias("_pos"), image_key(F.col(url)).alias("_key"), declared_size(F.col(url)).alias("_size"))
    effective = F.when(F.col("_size") > 0, F.col("_size")).otherwise(F.lit(2**31 - 1))
    one = sized.withColumn("_first", F.min("_pos").over(W.partitionBy(key, "_key")))
    ranked = one.withColumn("_rank", F.dense_rank().over(W.partitionBy(key).orderBy("_first")))
    last = F.max(F.when(F.col("_rank") == limit, F.col("_first"))).over(W.partitionBy(key))
    usable = ranked.withColumn("_last", last).where((F.col("_rank") <= limit) & (F.col("_last").isNull() | (F.col("_pos") <= F.col("_last"))))
    best = usable.groupBy(key, "_rank").agg(F.max_by("_url", F.struct(effective.alias("e"), (-F.col("_pos")).alias("p"))).alias("url"))
    return best.select(key, F.col("_rank").cast("bigint").alias("rank"), "url")


def largest_source(srcset: Column) -> Column:
    """The URL with the largest descriptor of a srcset; of equal ones the first."""
    parts = F.filter(F.transform(F.split(srcset, ","), strip), lambda p: p != "")
    rows = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\s([0-9]+(?:\.[0-9]+)?)[wx]$", 1).try_cast("double"), F.lit(0.0)).alias("n"), (-i).alias("i"), F.element_at(F.split(p, r"\s+"), 1).alias("u")))
    return F.array_max(rows)["u"]


def manual_urls(urls: Column) -> Column:
    """URLs without fragment, blanks escaped, each once in order."""
    return F.array_distinct(F.transform(F.filter(urls, lambda u: u.isNotNull()), lambda u: F.replace(strip(F.regexp_replace(u, "#.*$", "")), F.lit(" "), F.lit("%20"))))


# Words of document URLs that tell manuals, and those that tell something else.
MANUAL_WORDS = "manual|ifu|instruction|guide|user|owner|assembly|install|setup|quick|brochure|datasheet|data-sheet|spec"
OTHER_WORDS = "iso|warranty|certificate|catalog|msds|sds|policy|terms"


def manual_score(url: Column, code: Column, title_token: Column) -> Column:
    """2 for the product's code in the URL and 1 for its title's first word."""
    low = F.lower(url)
    hit = lambda x, n: F.when((F.coalesce(x, F.lit("")) != "") & F.contains(low, F.lower(F.coalesce(x, F.lit("")))), n).otherwise(0)
    return hit(code, 2) + hit(title_token, 1)
