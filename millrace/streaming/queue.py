"""A polling queue as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

PENDING = "pending_scrape"


def pending(rows: DataFrame, status: str = "ingest_status") -> DataFrame:
    """Rows whose status, in any case, is pending."""
    return rows.where(F.lower(F.trim(F.col(status))) == PENDING)


def cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value): one row for each cell to write; nulls are not written."""
    return rows.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([key], columns, "column", "value").where("value is not null")


def run_queue(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Takes what arrives in the folder source, does work on the pending rows, and writes them to sink.

    A batch that is repeated after a failure overwrites its own part of the sink, so each row
    comes out once. With once the stream ends when the folder is worked off; else it polls.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(pending(rows)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    arriving = spark.readStream.schema(schema).parquet(source)
    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def live_entries(accesses: DataFrame, key: str, time: str, now, ttl_seconds: int = 180, most: int = 100) -> DataFrame:
    """(key, last) of a cache after the given accesses: entries not older than the time to live, the most recently used first, at most ``most``.

    The limit is the cache's capacity. Ranking goes by a partial top within each partition of
    keys, then over those survivors.
    """
    last = accesses.groupBy(key).agg(F.max(time).alias("last")).where(F.col("last") > F.lit(now) - F.expr(f"interval {ttl_seconds} seconds"))
    return last.orderBy(F.desc("last"), key).limit(most)


def state_counts(jobs: DataFrame, state: str = "state") -> DataFrame:
    return jobs.groupBy(state).agg(F.count("*").alias("n"))


def first_of_states(jobs: DataFrame, order: str, limits: dict[str, int], state: str = "state") -> DataFrame:
    """The first rows of each state, as many as its limit."""
    allowed = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col(state))
    return jobs.where(F.col(state).isin(*limits)).withColumn("_n", F.row_number().over(W.partitionBy(state).orderBy(order))).where(F.col("_n") <= allowed).drop("_n")
