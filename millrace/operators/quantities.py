"""Quantities written in many units, brought to the common unit of their field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.functions.units import DEFAULTS_PATTERN, PRODUCT_FIELDS, SENTENCE_END, FieldSet, quantities, split_key

_RESULT = "array<struct<spec_field:string,idx:bigint,base_value:bigint>>"


def _key_test(fields: FieldSet) -> str:
    """A cheap test on the JVM side: only entries of a quantity field go to Python."""
    return "^[\\s_\\-]*(?:" + "|".join(re.escape(f).replace("_", "[\\s_\\-]+") for f in fields.units) + ")(?![a-z])"


def _parser(fields: FieldSet):
    units, multi = dict(fields.units), fields.multi

    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = FieldSet(units, multi)
        for columns in batches:
            out, seen = [], {}
            for entry in zip(*columns):
                if entry not in seen:
                    key, text, defaults = entry
                    field, unit = split_key(key, own)
                    seen[entry] = [{"spec_field": field, "idx": i, "base_value": v} for i, v in quantities(field, unit, text, defaults, own)] if field in units else []
                out.append(seen[entry])
            yield pd.Series(out)

    return parse


def common_units(entries: DataFrame, keep: list[str], key: str = "key", value: str = "value", defaults: str = "defaults", fields: FieldSet = PRODUCT_FIELDS) -> DataFrame:
    """keep + (spec_field, idx, base_value): every quantity of key/value entries in its field's common unit.

    ``defaults`` names a text column with the record's statement of its units, or null;
    ``fields`` has the fields and their common units. A null key or value, a placeholder and a
    number without a unit in value, key or defaults give no row, nor does one whose unit
    expression has another dimension; repeated rows give one row. Long texts are read whole;
    columns other than keep, key and value are ignored, whatever their names.

    Plan: a narrow map with one Arrow UDF behind a JVM-side filter on the key, then one
    distinct with a map-side combine.
    """
    picked = entries.select(*keep, F.col(key).alias("_key"), F.col(value).alias("_text"), F.col(defaults).alias("_defaults")).where(
        F.col("_key").isNotNull() & F.col("_text").isNotNull() & F.lower("_key").rlike(_key_test(fields)) & F.col("_text").rlike("\\S")
    )
    parsed = picked.select(*keep, F.inline(F.pandas_udf(_parser(fields), _RESULT)("_key", "_text", "_defaults")))
    return parsed.distinct()


def spec_entries(records: DataFrame) -> DataFrame:
    """(src, row_id, defaults, key, value) of product_records.specs; defaults holds the sentences of the description that state units, in order."""
    sentences = F.transform(F.split("description_raw", SENTENCE_END), lambda s: F.regexp_extract(s, DEFAULTS_PATTERN, 1))
    stated = F.nullif(F.array_join(F.filter(sentences, lambda s: s != ""), "; "), F.lit(""))
    once = records.where(F.col("record_id").isNotNull() & F.col("specs").isNotNull()).select(F.lit("specs").alias("src"), F.col("record_id").alias("row_id"), stated.alias("defaults"), "specs")
    return once.select("src", "row_id", "defaults", F.explode("specs"))


def option_entries(variants: DataFrame) -> DataFrame:
    """(src, row_id, defaults, key, value) of variants.option_values; a variant states no units of its own."""
    return variants.where(F.col("variant_id").isNotNull()).select(F.lit("option").alias("src"), F.col("variant_id").alias("row_id"), F.lit(None).cast("string").alias("defaults"), F.inline("option_values")).withColumnsRenamed({"option_name": "key"})


def product_quantities(records: DataFrame, variants: DataFrame) -> DataFrame:
    """(src, row_id, spec_field, idx, base_value) over specs and option values."""
    return common_units(spec_entries(records).unionByName(option_entries(variants)), ["src", "row_id"])
