"""Queries of the operators on text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.boilerplate import all_furniture
from millrace.llm.canonical import product_values
from millrace.llm.encoding import restored_digest
from millrace.llm.listings import product_pairs
from millrace.llm.mixing import mixed
from millrace.llm.packing import document_containers
from millrace.llm.scans import found_flaws
from millrace.sources.tables import table

#: The vocabulary that sizes texts in the queries; the operators take it as a parameter.
VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_pairs(table(spark, folder, "product_listings"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_values(table(spark, folder, "product_records"), table(spark, folder, "canonical_values"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_furniture(table(spark, folder, "browse_pages"), table(spark, folder, "product_records"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_flaws(table(spark, folder, "pdf_texts"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return document_containers(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"), VOCABULARY)


def p8_chosen(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), VOCABULARY)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), VOCABULARY)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return restored_digest(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p7_containers": p7_containers, "p8_chosen": p8_chosen, "p8_shares": p8_shares, "p9_found": p9_found}
ORACLE: dict[str, str] = {}
