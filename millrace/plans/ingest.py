"""The stages of a product record's way, as DataFrame to DataFrame functions in their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from millrace.functions import lines as L, specs as S, text as T
from millrace.operators import media, quality, records as R

Stage = Callable[[DataFrame], DataFrame]


def named(df: DataFrame) -> DataFrame:
    """A brand where none is known, and a name that isn't only the brand."""
    brand = F.coalesce(T.non_blank(F.col("brand")), F.nullif(R.brand_of_name(F.col("name_raw")), F.lit("")))
    return df.withColumn("brand", brand).withColumn("name_raw", R.repaired_name(F.col("name_raw"), F.col("brand"), F.lit(None).cast("string"), F.col("source")))


def derived(df: DataFrame) -> DataFrame:
    """Dimensions out of blocks, short units."""
    return df.withColumn("specs", S.enriched(F.col("specs")))


def english(df: DataFrame) -> DataFrame:
    """English description lines, feature lines and spec values only."""
    return df.withColumns(
        {
            "description_raw": F.array_join(F.filter(L.lines_of(F.col("description_raw")), L.english_unmarked), "\n"),
            "features_raw": F.filter("features_raw", lambda x: x.isNotNull() & L.feature_kept(x)),
            "specs": F.map_filter("specs", lambda k, v: v.isNotNull() & L.english_unmarked(T.strip(v))),
        }
    )


def quieted(df: DataFrame) -> DataFrame:
    """Navigation out of descriptions, noise out of features, ordering data out of specs."""
    return df.withColumns({"description_raw": L.without_navigation(F.col("description_raw")), "features_raw": L.clean_features(F.col("features_raw")), "specs": S.pruned(F.col("specs"))})


def lifted(df: DataFrame) -> DataFrame:
    """Specs out of feature lines where a record has none."""
    return df.withColumn("_s", R.specs_from_features(F.col("specs"), F.col("features_raw"))).withColumns({"specs": F.col("_s.specs"), "features_raw": F.col("_s.features")}).drop("_s")


def documented(df: DataFrame) -> DataFrame:
    return df.withColumn("pdf_docs", media.manual_urls(F.col("manuals")))


def classified(df: DataFrame) -> DataFrame:
    """Near-repeats out, features by class."""
    return df.withColumn("features_raw", L.without_similar(F.col("features_raw"))).withColumn("features_by_class", R.by_class(F.col("features_raw")))


def scored(df: DataFrame) -> DataFrame:
    tenths = quality.quality_tenths(F.col("features_raw"), F.col("specs"), F.col("pdf_docs"))
    return df.withColumn("quality_score", tenths / 10).withColumn("needs_review", F.col("quality_score") < 0.7)


STAGES: list[Stage] = [named, derived, english, quieted, lifted, documented, classified, scored]


def ingested(records: DataFrame, stages: list[Stage] | None = None) -> DataFrame:
    """records after all stages: all narrow, one pass over the rows, no shuffle."""
    for stage in stages or STAGES:
        records = records.transform(stage)
    return records
