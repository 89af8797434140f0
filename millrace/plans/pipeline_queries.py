"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.packed import product_items
from millrace.operators.quantities import product_quantities
from millrace.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_items(table(spark, folder, "product_records"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_quantities(table(spark, folder, "product_records"), table(spark, folder, "variants"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found}
