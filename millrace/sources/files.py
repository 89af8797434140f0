"""Other sources: queues kept as sheets, binary documents, prompt texts; and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header as text columns, names in snake case. Cells are read as written."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*("_".join(c.strip().lower().split()) for c in rows.columns))


def binaries(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int = 3_000_000) -> DataFrame:
    """(path, length, content) of files up to most_bytes, the source's own limit; the size is tested before the content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where(F.col("length") <= most_bytes).select("path", "length", "content")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, template): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(?:[.][^./]*)?$", 1).alias("name"), F.col("value").alias("template"))


def write_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, by folders of one column if named."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def upserted(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of held, replaced by those of new with the same key, and the rest of new."""
    return held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
