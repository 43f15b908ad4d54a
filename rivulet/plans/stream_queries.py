"""Registered queries that run the streaming jobs end to end (availableNow, two runs over
two time-ordered chunks of input, sharing one query checkpoint) and read back what they
wrote. The input chunks are derived by Spark from the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.plans import fixtures as fx
from rivulet.schemas import COMMENT
from rivulet.session import new_work_dir, stream_session
from rivulet.streaming.ingest import run_ingest

SESSION_START = "2024-01-01 05:00:00"
FLUSH_CUT = "2024-01-16 00:00:00"
FLUSH_NOW = dt.datetime(2024, 2, 1)
EVERY = 10  # checkpoint interval of the ingest queries
LIST_DELAY = "1 hour"


def _two_chunks(df: DataFrame, ts: str, cut) -> list[DataFrame]:
    return [df.where(F.col(ts) < cut), df.where(F.col(ts) >= cut)]


def _ingest(spark: SparkSession, d: str) -> str:
    spark = stream_session(spark)
    work = new_work_dir(spark, "ingest")
    comments = fx.comments(spark, d).select(*COMMENT.fieldNames())
    lo, hi = comments.agg(F.min("arrival_ts"), F.max("arrival_ts")).first()
    cut = (F.lit((lo + (hi - lo) / 2).isoformat(sep=" ")).cast("timestamp_ntz")
           if lo is not None else F.lit(None))
    streams = fx.comment_streams(spark, d)
    checkpoints = fx.comment_checkpoints(spark, d)
    for i, chunk in enumerate(_two_chunks(comments, "arrival_ts", cut)):
        chunk.write.parquet(f"{work}/in/chunk={i}")
        q = run_ingest(spark, f"{work}/in/*", f"{work}/out", f"{work}/query", streams,
                       checkpoints, fx.ntz(SESSION_START), every=EVERY)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return work


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages the streaming ingest published."""
    work = _ingest(spark, d)
    return spark.read.parquet(f"{work}/out/messages").drop("batch_id")


def ingest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """O27 + O24: checkpoints the streaming ingest stored (every 10th success per stream,
    counted across micro-batches), as rows of the checkpoint log."""
    work = _ingest(spark, d)
    return spark.read.parquet(f"{work}/out/checkpoints").drop("batch_id")


def ingest_flush(spark: SparkSession, d: str) -> DataFrame:
    """O27, O24, O25 and O28 as one chain: the flush reads the log that the ingest wrote."""
    from rivulet.streaming.flush import durable_table, run_flush
    work = _ingest(spark, d)
    q = run_flush(stream_session(spark), f"{work}/out/checkpoints/*", f"{work}/table",
                  f"{work}/flush", lambda _: F.lit(FLUSH_NOW.isoformat(sep=" ")).cast("timestamp_ntz"))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return durable_table(spark, f"{work}/table")


def flush_stream(spark: SparkSession, d: str) -> DataFrame:
    """Durable checkpoint table after two periodic flushes of the checkpoint log."""
    from rivulet.schemas import CHECKPOINT_LOG
    from rivulet.streaming.flush import durable_table, make_flush_writer, seed_table
    caller, spark = spark, stream_session(spark)
    work = new_work_dir(spark, "flush")
    seed_table(fx.checkpoint_table(spark, d), f"{work}/table")
    log = fx.checkpoint_log(spark, d)
    writer = make_flush_writer(
        f"{work}/table",
        lambda bid: F.lit((FLUSH_NOW + dt.timedelta(hours=bid)).isoformat(sep=" "))
        .cast("timestamp_ntz"))
    for i, chunk in enumerate(_two_chunks(log, "updated_at", fx.ntz(FLUSH_CUT))):
        chunk.write.parquet(f"{work}/in/chunk={i}")
        q = (spark.readStream.schema(CHECKPOINT_LOG).parquet(f"{work}/in/*")
             .writeStream.foreachBatch(writer).option("checkpointLocation", f"{work}/query")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return durable_table(caller, f"{work}/table")


def circuit_stream(spark: SparkSession, d: str) -> DataFrame:
    """O30 streaming form: breaker states carried across micro-batches."""
    from rivulet.plans.catalog import BREAKER
    from rivulet.schemas import ATTEMPTS
    from rivulet.streaming.state import read_timeline, run_circuit
    caller, spark = spark, stream_session(spark)
    work = new_work_dir(spark, "breaker")
    att = fx.attempts(spark, d).select(*ATTEMPTS.fieldNames())
    for i, chunk in enumerate(_two_chunks(att, "ts", fx.ntz("2024-01-16 00:00:00"))):
        chunk.write.parquet(f"{work}/in/chunk={i}")
        src = spark.readStream.schema(ATTEMPTS).parquet(f"{work}/in/*")
        q = run_circuit(src, f"{work}/out", f"{work}/query", **BREAKER)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return read_timeline(caller, f"{work}/out")


def error_lists_stream(spark: SparkSession, d: str) -> DataFrame:
    """O20 streaming form: lists emitted by session windows once the watermark (the latest
    error time seen) has passed their expiry."""
    from rivulet.streaming.state import error_lists_stream as _stream
    caller, spark = spark, stream_session(spark)
    work = new_work_dir(spark, "lists")
    errs = fx.errors(spark, d)
    for i, chunk in enumerate(_two_chunks(errs, "ts", fx.ntz(FLUSH_CUT))):
        chunk.write.parquet(f"{work}/in/chunk={i}")
        src = spark.readStream.schema(errs.schema).parquet(f"{work}/in/*")
        q = (_stream(src, LIST_DELAY).writeStream.format("parquet").option("path", f"{work}/out")
             .option("checkpointLocation", f"{work}/query").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return caller.read.parquet(f"{work}/out")


def _two_runs(spark: SparkSession, df: DataFrame, cut, name: str, make) -> DataFrame:
    """``make(source)`` as a query into Parquet files, run over two time-ordered chunks of
    ``df`` with one checkpoint; what it wrote."""
    caller, spark = spark, stream_session(spark)
    work = new_work_dir(spark, name)
    for i, chunk in enumerate(_two_chunks(df, "ts", cut)):
        chunk.write.parquet(f"{work}/in/chunk={i}")
        src = spark.readStream.schema(df.schema).parquet(f"{work}/in/*")
        q = (make(src).writeStream.format("parquet").option("path", f"{work}/out")
             .option("checkpointLocation", f"{work}/query").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return caller.read.parquet(f"{work}/out")


def live_lists_stream(spark: SparkSession, d: str) -> DataFrame:
    """O21 and O22 on a stream: each stream's live list at the last watermark (the newest error
    less an hour), from keyed state with timers."""
    from rivulet.streaming.keyed import latest_lists
    from rivulet.streaming.keyed import live_lists_stream as _stream
    told = _two_runs(spark, fx.errors(spark, d), fx.ntz(FLUSH_CUT), "live-lists",
                     lambda src: _stream(src, LIST_DELAY))
    return latest_lists(told).where("error_count > 0")


def lease_stream(spark: SparkSession, d: str) -> DataFrame:
    """O31 on a stream: every lease in its latest form, ended by a call or by the watermark."""
    from rivulet.plans.catalog import LEASE_TTL
    from rivulet.streaming.keyed import latest_leases, leases_stream
    return latest_leases(_two_runs(spark, fx.lease_log(spark, d), fx.ntz(FLUSH_CUT), "leases",
                                   lambda src: leases_stream(src, LIST_DELAY, LEASE_TTL)))


def _published(spark: SparkSession, d: str) -> str:
    """The comments as a channel log of two segments, ingested after each was appended."""
    from rivulet.streaming.published import run_published
    work = new_work_dir(spark, "published")
    comments = fx.comments(spark, d).select(*COMMENT.fieldNames())
    lo, hi = comments.agg(F.min("arrival_ts"), F.max("arrival_ts")).first()
    cut = (F.lit((lo + (hi - lo) / 2).isoformat(sep=" ")).cast("timestamp_ntz")
           if lo is not None else F.lit(None))
    streams, checkpoints = fx.comment_streams(spark, d), fx.comment_checkpoints(spark, d)
    for i, chunk in enumerate(_two_chunks(comments, "arrival_ts", cut)):
        chunk.write.partitionBy("subreddit").parquet(f"{work}/in/segment={i}")
        q = run_published(spark, f"{work}/in", f"{work}/out", f"{work}/query", streams,
                          checkpoints, SESSION_START)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return work


def ingest_published(spark: SparkSession, d: str) -> DataFrame:
    """O27 through the data source and the publishing sink: the messages."""
    from rivulet.streaming.published import published_messages
    return published_messages(spark, f"{_published(spark, d)}/out").drop("arrival_ts")


def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    """O4 on the ingest's path: the error rows that were published with the messages."""
    from rivulet.streaming.published import published_errors
    return published_errors(spark, f"{_published(spark, d)}/out")


def checkpoint_stream(spark: SparkSession, d: str) -> DataFrame:
    """O24 on a stream: every 10th event of an event type, counted in keyed state."""
    from rivulet.streaming.keyed import checkpoints_stream
    messages = fx.table(spark, d, "events").select(
        F.col("event_type").alias("stream_id"), F.col("event_id").cast("string").alias("comment_id"),
        "ts", F.col("ts").alias("arrival_ts"))
    return _two_runs(spark, messages, fx.ntz(FLUSH_CUT), "checkpoints",
                     lambda src: checkpoints_stream(src, EVERY))
