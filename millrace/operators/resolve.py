"""Values of several sources brought to one, with what disagreed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def as_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value): one row for each non-null column, as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(key, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def resolved(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, field, value, choice, discarded, conflict): per field the value of the first source that has one.

    ``sources`` are (name, rows of key, field, value), the most trusted first. Values are
    compared as text. ``discarded`` lists the other values with the sources that gave them,
    in the order of the sources; it is null where all agree. Of repeated rows of one source
    the smallest value counts.

    Plan: one union and one grouping with a map-side combine, whatever the number of sources.
    """
    tagged = reduce(DataFrame.unionByName, (df.select(key, "field", "value", F.lit(i).alias("_rank"), F.lit(n).alias("_source")) for i, (n, df) in enumerate(sources)))
    per_source = tagged.where("value is not null").groupBy(key, "field", "_rank", "_source").agg(F.min("value").alias("value"))
    all_ = per_source.groupBy(key, "field").agg(F.sort_array(F.collect_list(F.struct("_rank", "_source", "value"))).alias("_v"))  # at most one entry a source
    first = F.col("_v")[0]
    others = F.array_distinct(F.filter(F.transform("_v", lambda v: v["value"]), lambda v: v != first["value"]))
    named = F.transform(others, lambda o: F.concat(o, F.lit(" (from "), F.array_join(F.transform(F.filter("_v", lambda v: v["value"] == o), lambda v: v["_source"]), "+"), F.lit(")")))
    conflict = F.size(others) > 0
    return all_.select(key, "field", first["value"].alias("value"), first["_source"].alias("choice"), F.when(conflict, F.array_join(named, "; ")).alias("discarded"), conflict.alias("conflict"))
