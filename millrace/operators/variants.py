"""Option groups of a product and their combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import bound, plain_value, value_list

_GROUPS = "array<struct<name:string,values:array<string>>>"
_COMBOS = "array<array<struct<option_name:string,value:string>>>"


def spec_groups(specs: Column) -> Column:
    """Groups of the spec entries that hold more than one distinct value, by key."""
    rows = F.transform(F.map_entries(specs), lambda e: F.struct(plain_value(e["key"]).alias("name"), F.array_distinct(value_list(e["value"])).alias("values")))
    return F.array_sort(F.filter(F.coalesce(rows, F.array().cast(_GROUPS)), lambda g: (g["name"] != "") & (F.size(g["values"]) > 1)))


def text_values(lines: Column) -> Column:
    """Values out of ``available / comes / offered in a, b``."""
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:available|comes|offered)\s+in\s+([A-Za-z0-9_\s\-×.]+(?:,\s*[A-Za-z0-9_\s\-×.]+)+)"
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda x: F.transform(F.split(x, r",\s*"), plain_value))), lambda v: v != ""))


def offer_groups(offers: Column) -> Column:
    """Color and Size groups of offer structs with color and size."""
    group = lambda name, field: F.struct(F.lit(name).alias("name"), F.array_distinct(F.array_compact(F.transform(offers, lambda o: F.nullif(plain_value(o[field]), F.lit(""))))).alias("values"))
    return F.filter(F.array(group("Color", "color"), group("Size", "size")), lambda g: F.size(g["values"]) > 0)


def merged_groups(groups: Column) -> Column:
    """Groups of equal names as one, in the order of their first, each value once."""

    def one(gs: Column) -> Column:
        names = F.array_distinct(F.transform(gs, lambda g: g["name"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.array_distinct(F.flatten(F.transform(F.filter(gs, lambda g: g["name"] == n), lambda g: g["values"]))).alias("values")))

    return bound(groups, one)


def option_groups(specs: Column, texts: Column, marked: Column, offers: Column | None = None) -> Column:
    """All option groups of a product: of its specs, of its texts (as Variant), of offers and of its page's markup; those of one value are left out."""
    none = F.array().cast(_GROUPS)
    told = bound(text_values(texts), lambda v: F.when(F.size(v) > 0, F.array(F.struct(F.lit("Variant").alias("name"), v.alias("values")))).otherwise(none))
    plain = F.transform(F.coalesce(marked, none), lambda g: F.struct(plain_value(g["name"]).alias("name"), F.transform(g["values"], plain_value).alias("values")))
    every = F.concat(spec_groups(specs), told, none if offers is None else F.coalesce(offer_groups(offers), none), plain)
    return F.filter(merged_groups(every), lambda g: (g["name"] != "") & (F.size(g["values"]) > 1))


def page_variants(records: DataFrame, key: str) -> DataFrame:
    """(key, idx, sku, option_values) of every combination of the options that page records state.

    ``records`` has key and the specs, features_raw, description_raw, option_groups and sku of page_record.page_records.
    """
    texts = F.concat(F.coalesce("features_raw", F.array().cast("array<string>")), F.array(F.coalesce("description_raw", F.lit(""))))
    grouped = records.select(key, F.col("sku").alias("_sku"), option_groups(F.col("specs"), texts, F.col("option_groups")).alias("_groups")).where(F.size("_groups") > 0)
    return expanded(grouped, key, "_groups", "_sku")


def combinations(groups: Column, most: int = 10_000) -> Column:
    """All combinations of one value a group, the last group running fastest.

    A product whose group sizes multiply beyond ``most`` would flood the rows; it gets null,
    which a caller can tell from the empty list of a product without groups.
    """
    sizes = F.aggregate(groups, F.lit(1.0), lambda a, g: a * F.size(g["values"]))
    start = F.array(F.array().cast("array<struct<option_name:string,value:string>>"))
    grown = F.aggregate(
        groups,
        start,
        lambda acc, g: F.flatten(F.transform(acc, lambda c: F.transform(g["values"], lambda v: F.concat(c, F.array(F.struct(g["name"].alias("option_name"), v.alias("value")))))))
    )
    return F.when(F.coalesce(F.size(groups), F.lit(0)) <= 0, F.array().cast(_COMBOS)).when(sizes <= most, grown)


def variant_sku(base: Column, options: Column, index: Column) -> Column:
    """The base sku and up to eight letters and digits of each option value; without both ``VARn``."""
    short = F.transform(options, lambda o: F.upper(F.substr(F.regexp_replace(o["value"], "[^a-zA-Z0-9]", ""), F.lit(1), F.lit(8))))
    suffix = F.array_join(F.filter(short, lambda s: s != ""), "-")
    filled = F.nullif(base, F.lit(""))
    return F.when(filled.isNotNull(), F.when(suffix != "", F.concat(filled, F.lit("-"), suffix)).otherwise(filled)).when(suffix != "", suffix).otherwise(F.concat(F.lit("VAR"), (index + 1).cast("string")))


def option_key(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(plain_value(o["option_name"]), F.lit(":"), plain_value(o["value"]))), "|")


def expanded(products: DataFrame, key: str, groups: str, base_sku: str, most: int = 10_000) -> DataFrame:
    """(key, idx, sku, option_values) of every combination of a product's groups.

    A product of up to ``most`` combinations makes them in one array. The numbers of a larger one's combinations are dealt
    out in ranges of ``most``, and each number is read as a mixed-radix number whose digits pick the values.
    """
    rows = products.select(key, F.col(base_sku).alias("_base"), F.filter(groups, lambda g: F.size(g["values"]) > 1).alias("_g"))
    few = rows.select(key, "_base", F.posexplode(combinations(F.col("_g"), most)).alias("idx", "option_values")).where(F.size("option_values") > 0)
    size = lambda gs, start: F.aggregate(gs, start, lambda a, g: a * F.size(g["values"]))
    # step: how many combinations run through before a group goes on to its next value
    many = rows.where(size(F.col("_g"), F.lit(1.0)) > most).withColumns(
        {"_n": size(F.col("_g"), F.lit(1).cast("bigint")), "_step": F.transform("_g", lambda g, i: size(F.slice("_g", i + 2, F.size("_g")), F.lit(1).cast("bigint")))}
    )
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(most).cast("bigint")))).repartition(parts, key, "_from")
    numbered = ranges.withColumn("idx", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + most, F.col("_n")) - 1)))
    digit = lambda g, step: ((F.col("idx") % (step * F.size(g["values"])) - F.col("idx") % step) / step).cast("int")
    picked = F.zip_with("_g", "_step", lambda g, step: F.struct(g["name"].alias("option_name"), F.get(g["values"], digit(g, step)).alias("value")))
    rows = few.withColumn("idx", F.col("idx").cast("bigint")).union(numbered.select(key, "_base", "idx", picked.alias("option_values")))
    return rows.select(key, "idx", variant_sku(F.col("_base"), F.col("option_values"), F.col("idx")).alias("sku"), "option_values")


def added_variants(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Variants held, and those of new whose sku and options none of them has."""
    mark = F.lower(F.concat(F.coalesce("sku", F.lit("")), F.lit("|"), option_key(F.col("option_values"))))
    return held.unionByName(new.withColumn("_m", mark).join(held.select(key, mark.alias("_m")), [key, "_m"], "left_anti").drop("_m"))


def priced(combos: DataFrame, offers: DataFrame, key: str, base_price: str) -> DataFrame:
    """combos (key, option_values, ...) + price: an offer's where one has just these options (color, then size), else the product's own."""
    label = lambda name, c: F.when(_filled(c), F.concat(F.lit(f"{name}:"), plain_value(c)))
    keyed = offers.select(key, F.concat_ws("|", label("Color", F.col("color")), label("Size", F.col("size"))).alias("_k"), "price").where("_k <> ''").groupBy(key, "_k").agg(F.max("price").alias("_p"))
    return combos.withColumn("_k", option_key(F.col("option_values"))).join(keyed, [key, "_k"], "left").withColumn("price", F.coalesce("_p", base_price)).drop("_k", "_p")


def _filled(c: Column) -> Column:
    return F.coalesce(plain_value(c), F.lit("")) != ""
