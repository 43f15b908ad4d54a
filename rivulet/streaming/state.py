"""Streaming forms of the stateful operators (keyed state: ``streaming.keyed``).

``run_circuit`` (O30): a query over ``keyed.breaker_stream``. Within a micro-batch attempts
apply in (ts, attempt_id) order, whatever order they arrived in; attempts of a later batch
apply after it.

``error_lists_stream`` (O20): session windows with the list TTL as gap over a watermarked
event time; append mode emits a list once the watermark passes its expiry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.circuit import TIMELINE
from rivulet.operators.errors import ERROR_LIST_MAX, ERROR_TTL
from rivulet.streaming.keyed import breaker_stream, event_time


def run_circuit(attempts: DataFrame, out: str, checkpoint_dir: str, trigger: dict | None = None,
                **params):
    """O30 as a streaming query over ``attempts`` (a streaming DataFrame). Breaker states are
    keyed state (``keyed.breaker_stream``); the timeline rows go to Parquet files under
    ``out/run``, each batch published once by the file sink's log."""
    return (breaker_stream(attempts, **params).writeStream.format("parquet")
            .option("path", f"{out}/run").option("checkpointLocation", checkpoint_dir)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def read_timeline(spark: SparkSession, out: str) -> DataFrame:
    """The timeline rows written so far."""
    return spark.read.parquet(f"{out}/run").select(*TIMELINE)


def error_lists_stream(errors: DataFrame, delay: str, ttl: str = ERROR_TTL,
                       cap: int = ERROR_LIST_MAX, key: str = "stream_id",
                       ts: str = "ts") -> DataFrame:
    """O20 on a streaming DataFrame; a list is emitted when the watermark passes its expiry.
    ``delay`` is how late an error may arrive and still count: Spark drops later ones, so the
    caller has to choose it (``late_errors`` finds them). Watermarks need a zoned timestamp, so
    the naive UTC time is read as UTC (no session zone involved)."""
    ev = errors.withColumn("_ets", event_time(ts))
    g = (ev.withWatermark("_ets", delay)
         .groupBy(key, F.session_window("_ets", ttl).alias("w"))
         .agg(F.min(ts).alias("list_start"), F.max(ts).alias("last_push"),
              F.count(F.lit(1)).alias("n_pushed")))
    return g.select(key, "list_start", "last_push",
                    (F.col("last_push") + F.expr(f"INTERVAL {ttl}")).alias("expires_at"),
                    "n_pushed",
                    F.least(F.col("n_pushed"), F.lit(cap).cast("long")).alias("n_kept"))


def late_errors(errors: DataFrame, newest_before: DataFrame, delay: str,
                ts: str = "ts") -> DataFrame:
    """The side output of a micro-batch: errors older than the newest time of the batches
    before (``newest_before``: one row, one column ``newest``) less ``delay``, which the session
    windows no longer take. For ``foreachBatch`` next to the list query."""
    return (errors.join(F.broadcast(newest_before.limit(1)), on=F.expr(
        f"{ts} < newest - INTERVAL {delay}"), how="inner").drop("newest"))
