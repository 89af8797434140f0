"""Several values packed in one field, brought to one value per row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.delimiters import DELIMITERS, TOKEN, resolve_rule
from millrace.session import cut

PACKED_FIELDS = ("included_accessories", "compatible_models", "colors_available", "certifications")


def _class(token: Column) -> Column:
    trimmed = F.trim(token)
    return (
        F.when(token.rlike(r"^ *\(?[0-9]{1,3}[.)] +$"), "N")
        .when(trimmed.rlike("^(?i)(?:and|und|et|&)$") & token.rlike(" $"), "&")
        .when(token.rlike(r"^[\p{L}\p{N}\p{M}]"), "x")
        .when(trimmed.rlike("^<br"), "B")
        .when(token.isin("-", "–"), "m")
        .when(token == "+", "p")
        .when(token.rlike(rf"^ *[{DELIMITERS}]"), F.regexp_replace(token, " ", ""))
        .when(trimmed == "", " ")
        .otherwise(trimmed)
    )


def _rules(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for skeletons in batches:
        yield pd.Series([[{"first": a + 1, "size": b - a, "escape": e} for a, b, e in resolve_rule(s)] for s in skeletons])


def field_name(key: Column) -> Column:
    """A written key in lower case, its words joined by ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(key), r"^[\s_\-]+|[\s_\-]+$", ""), r"[\s_\-]+", "_")


def split_packed(entries: DataFrame, keep: list[str], value: str, broadcast_bytes: int = 8 << 20, salts: int = 16) -> DataFrame:
    """keep + (pos, item) of every value that packs at least two items.

    Values are cut into tokens and reduced to delimiter skeletons on the JVM; splitting rules
    are resolved once for each distinct skeleton, and items are taken by position. The rules
    are broadcast while their text is within broadcast_bytes; beyond that they are joined by
    shuffle, over ``salts`` copies, as one skeleton may hold a large part of the rows.

    Nulls, blanks and values of one item give no row; ``pos`` counts from 1 within a value;
    equal rows come out once. Columns other than keep and value are ignored.
    """
    tokens = (
        entries.where(F.col(value).isNotNull() & F.col(value).rlike(rf"[{DELIMITERS}/+&<–-]|\d[.)] | (?i:and|und|et) "))
        .select(*keep, F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0)).alias("_tokens"))
        .withColumn("_skeleton", F.coalesce(F.array_join(F.transform("_tokens", _class), ""), F.lit("")))  # never null, or the join would test that by computing it twice
    )
    rules = tokens.select("_skeleton").distinct().withColumn("_rule", F.pandas_udf(_rules, "array<struct<first:int,size:int,escape:string>>")("_skeleton")).where(F.size("_rule") >= 2)
    rules = cut(rules)
    bytes_ = rules.agg(F.sum(F.length("_skeleton") + 24 * F.size("_rule")).alias("n")).first()["n"] or 0
    if bytes_ <= broadcast_bytes:
        ruled = tokens.join(F.broadcast(rules), "_skeleton")
    else:
        salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        ruled = tokens.withColumn("_salt", F.pmod(F.xxhash64("_tokens"), F.lit(salts)).cast("int")).join(salted, ["_skeleton", "_salt"])

    def item(rule: Column) -> Column:
        text = F.array_join(F.slice(F.col("_tokens"), rule["first"], rule["size"]), "")
        plain = (
            F.when(rule["escape"] == '"', F.replace(text, F.lit('""'), F.lit('"')))
            .when(rule["escape"] == "'", F.replace(text, F.lit("''"), F.lit("'")))
            .when(rule["escape"] == "json", F.coalesce(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")[0], text))
            .otherwise(text)
        )
        return F.trim(plain)

    items = ruled.select(*keep, F.posexplode(F.transform("_rule", item)).alias("_pos", "item"))
    return items.select(*keep, (F.col("_pos") + 1).cast("bigint").alias("pos"), "item").distinct()


def product_items(records: DataFrame) -> DataFrame:
    """(record_id, spec_field, pos, item) of the packed fields of product_records.specs."""
    entries = (
        records.where(F.col("record_id").isNotNull())
        .select("record_id", F.explode("specs").alias("_key", "_value"))
        .select("record_id", field_name(F.col("_key")).alias("spec_field"), "_value")
        .where(F.col("spec_field").isin(*PACKED_FIELDS))
    )
    return split_packed(entries, ["record_id", "spec_field"], "_value")
