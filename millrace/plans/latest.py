"""Records as they were last delivered, for queries and for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.tables import table

FIELDS = {"name": "name_raw", "d": "description_raw", "specs": "specs", "f": "features_raw", "i": "images.url", "m": "manuals", "b": "brand", "sku": "sku", "src": "source"}
LATEST = "SELECT record_id, arg_max(struct_pack(name := name_raw, d := description_raw, specs := specs, f := features_raw, i := list_transform(images, lambda x: x.url), m := manuals, b := brand, sku := sku, src := source), (ingested_at, fetched_at)) AS r FROM product_records WHERE record_id IS NOT NULL GROUP BY 1"


def latest_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, short names of FIELDS) of each record's last delivery."""
    row = F.struct(*(F.col(c).alias(n) for n, c in FIELDS.items()))
    rows = table(spark, folder, "product_records").where("record_id is not null")
    return rows.groupBy("record_id").agg(F.max_by(row, F.struct("ingested_at", "fetched_at")).alias("r")).select("record_id", "r.*")
