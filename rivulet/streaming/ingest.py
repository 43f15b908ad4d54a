"""The ingest pipeline as one Structured Streaming query.

comments (O1) -> registry lookup (O15; unregistered channels are not ingested)
-> start position (O2) -> skip processed (O16) -> normalize (O7) -> validate (O8)
-> split (O9): messages encoded (O5) and written (O3); invalid rows to the error sink (O4)
-> every-N checkpoints (O24) with the per-stream counter carried across micro-batches
-> one 'active' status event per stream and batch; 'starting' when the query starts and
   'stopped' / 'error' when it ends (``finish_ingest``): the status log O26 reads.

``foreachBatch`` writes every output under ``batch_id=N`` folders with overwrite, so a
batch replayed after a failure rewrites the same files instead of adding duplicates. The
per-stream success counter after batch N is a snapshot keyed by stream; batch N reads the
snapshot of batch N-1, never its own, so a replay starts from the same counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.expr import iso_z, normalize, utc_now, validate
from rivulet.functions.scan import keyed_scan
from rivulet.operators.checkpoints import CHECKPOINT_EVERY, skip_processed, start_position
from rivulet.operators.errors import split, with_error_defaults
from rivulet.operators.registry import lookup
from rivulet.session import delete_path
from rivulet.sources import io
from rivulet.sources.tables import with_bucket

COUNTER_SCHEMA = "stream_id string, n_processed long"
UNPARSED = "unparsed"  # stream of the error rows of records without a channel
# Order of lifecycle events among a run's status rows (ties on time are broken by seq).
FIRST_SEQ, LAST_SEQ = -1, 1 << 62


def status_events(streams: DataFrame, status: str, instance_id: str, seq: int) -> DataFrame:
    """Status-log rows (stream_id, seq, ts, status, instance_id) for every registered
    stream, stamped with the processing time in naive UTC."""
    return streams.select(F.col("id").alias("stream_id"), F.lit(seq).cast("long").alias("seq"),
                          utc_now().alias("ts"), F.lit(status).alias("status"),
                          F.lit(instance_id).alias("instance_id"))


def prepare(comments: DataFrame, streams: DataFrame, checkpoints: DataFrame,
            session_start: Column, ts_col: str | None = "arrival_ts") -> DataFrame:
    """Per-batch shaping shared by the streaming job and its batch equivalent. A comment
    without an arrival time gets the processing time (the per-stream order needs one). A
    comment without a channel (a record that did not parse) goes on to fail validation."""
    comments = comments.withColumn("arrival_ts",
                                   F.coalesce(F.col("arrival_ts"), utc_now()))
    known = lookup(comments, streams).withColumn("stream_id", F.coalesce(
        "stream_id", F.when(F.col("subreddit").isNull(), F.lit(UNPARSED))))
    registered = known.where(F.col("stream_id").isNotNull())
    started = start_position(registered, checkpoints, session_start, channel="stream_id")
    fresh = skip_processed(started, checkpoints, channel="stream_id")
    shaped = normalize(fresh, ts_col=F.col(ts_col) if ts_col else None)
    return validate(shaped)


def make_batch_writer(out: str, streams: DataFrame, checkpoints: DataFrame,
                      session_start: Column, every: int = CHECKPOINT_EVERY,
                      ts_col: str | None = "arrival_ts", sink: str = "files",
                      sink_options: dict | None = None, value_format: str | None = None,
                      instance_id: str = "spark",
                      streams_fn: Callable[[SparkSession], DataFrame] | None = None
                      ) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of the ingest query. ``sink`` is ``files`` (under
    ``out/messages/batch_id=N``: message rows, or with ``value_format`` json or avro their
    encoded ``value``) or ``kafka`` (value-only records, json unless ``value_format`` says
    otherwise, ``sink_options`` from ``sources.io.kafka_options``). ``streams_fn`` reads the
    registry anew for every batch, so that streams registered during a run are ingested.

    Error rows have the columns of the error table (O4). Checkpoints are rows of the
    checkpoint log that the flush (O28) reads: ``seq`` is the stream's count of messages."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = streams_fn(spark) if streams_fn else streams
        validated = prepare(batch, known, checkpoints, session_start, ts_col)
        # Only ids, times and the error rows are kept; messages, with their texts, are
        # written straight from the plan.
        narrow = validated.select(
            "stream_id", "comment_id", "arrival_ts", "is_valid", "reasons").persist()
        try:
            good, _ = split(validated, stream_col="stream_id")
            if sink == "kafka":
                io.write_messages(good, "", "kafka", sink_options, value_format)
            else:
                cols = ["stream_id", "comment_id"] + ([] if value_format else io.MESSAGE_FIELDS)
                io.write_messages(good if value_format else good.select(*cols),
                                  f"{out}/messages/batch_id={batch_id}", "parquet",
                                  value_format=value_format, keep=cols)
            msgs, bad = split(narrow, stream_col="stream_id")
            with_bucket(with_error_defaults(bad), "stream_id").write.mode("overwrite").parquet(
                f"{out}/errors/batch_id={batch_id}")

            prior = (spark.read.schema(COUNTER_SCHEMA).parquet(
                f"{out}/counters/batch_id={batch_id - 1}") if batch_id > 0
                else spark.createDataFrame([], COUNTER_SCHEMA))
            pos = keyed_scan(msgs.select("stream_id", "comment_id", "arrival_ts"),
                             ["stream_id"], "arrival_ts", ["comment_id"], rn="_pos")
            pos = (pos.join(prior.withColumnRenamed("n_processed", "_prior"), "stream_id", "left")
                   .withColumn("n_processed", F.col("_pos") + F.coalesce(F.col("_prior"),
                                                                         F.lit(0))))
            (pos.where(F.col("n_processed") % every == 0)
             .select("stream_id", F.col("n_processed").alias("seq"),
                     F.col("arrival_ts").alias("updated_at"),
                     F.col("comment_id").alias("last_comment_id"),
                     iso_z(F.col("arrival_ts")).alias("last_processed_at"))
             .write.mode("overwrite").parquet(f"{out}/checkpoints/batch_id={batch_id}"))
            (narrow.select("stream_id").distinct()
             .select("stream_id", F.lit(batch_id).cast("long").alias("seq"),
                     utc_now().alias("ts"), F.lit("active").alias("status"),
                     F.lit(instance_id).alias("instance_id"))
             .write.mode("overwrite").parquet(f"{out}/status/batch_id={batch_id}"))
            counts = msgs.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_new"))
            (prior.join(counts, "stream_id", "full_outer")
             .select("stream_id", (F.coalesce(F.col("n_processed"), F.lit(0))
                                   + F.coalesce(F.col("_new"), F.lit(0))).alias("n_processed"))
             .write.mode("overwrite").parquet(f"{out}/counters/batch_id={batch_id}"))
            if batch_id >= 2:  # a replay of this batch reads only batch_id - 1
                delete_path(spark, f"{out}/counters/batch_id={batch_id - 2}")
        finally:
            narrow.unpersist()
    return write


def run_ingest(spark: SparkSession, source: str, out: str, checkpoint_dir: str,
               streams: DataFrame, checkpoints: DataFrame, session_start: Column,
               trigger: dict | None = None, fmt: str = "parquet",
               every: int = CHECKPOINT_EVERY, ts_col: str | None = "arrival_ts",
               max_files_per_trigger: int | None = None, sink: str = "files",
               sink_options: dict | None = None, instance_id: str = "spark",
               source_options: dict | None = None, value_format: str | None = None,
               streams_fn: Callable[[SparkSession], DataFrame] | None = None):
    """Start the ingest query. ``trigger`` defaults to ``availableNow`` (process what is
    there, then stop); pass ``{"processingTime": "10 seconds"}`` for a continuous run.
    Registered streams get a 'starting' status event under ``out/status/batch_id=start``."""
    (status_events(streams, "starting", instance_id, FIRST_SEQ)
     .write.mode("append").parquet(f"{out}/status/batch_id=start"))
    comments = io.read_comments(spark, source, fmt=fmt, streaming=True,
                                options=source_options,
                                max_files_per_trigger=max_files_per_trigger)
    writer = make_batch_writer(out, streams, checkpoints, session_start, every, ts_col,
                               sink=sink, sink_options=sink_options, value_format=value_format,
                               instance_id=instance_id, streams_fn=streams_fn)
    return (comments.writeStream.foreachBatch(writer)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(**(trigger or {"availableNow": True})).start())


def finish_ingest(query, out: str, streams: DataFrame, instance_id: str = "spark") -> str:
    """After the query ended: 'error' for every registered stream if it failed, else
    'stopped'. Returns the status written."""
    status = "error" if query.exception() is not None else "stopped"
    (status_events(streams, status, instance_id, LAST_SEQ)
     .write.mode("append").parquet(f"{out}/status/batch_id=end"))
    return status
