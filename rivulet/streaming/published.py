"""O27 from the channel log to the published folder: one streaming query without
``foreachBatch``. Messages (O3) and error rows (O4) of a micro-batch appear together and once;
the sink's commit is the only place where a batch becomes visible. Checkpoints (O24) are a
query of their own over the published messages, with the counts as keyed state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.expr import COMMENT_ERROR_TYPE, bucket_of
from rivulet.operators.errors import error_id
from rivulet.schemas import COMMENT, ERRORS, MESSAGE, TABLE_BUCKETS
from rivulet.sources.datasource import read_published, register
from rivulet.streaming.ingest import prepare

MESSAGES, ERROR_ROWS = "messages", "errors"
_MESSAGE = [f.name for f in MESSAGE.fields]
_ROW = T.StructType([
    T.StructField("stream_id", T.StringType()), T.StructField("comment_id", T.StringType()),
    *[T.StructField(f, T.StringType()) for f in _MESSAGE],
    T.StructField("arrival_ts", T.TimestampNTZType())])


def outcome(validated: DataFrame) -> DataFrame:
    """O9 as a projection: ``kind`` tells messages from error rows, so the stream is read and
    shaped once. Message columns are null in error rows and the other way round."""
    good = F.col("is_valid")

    def bad(c: Column) -> Column:
        return F.when(~good, c)

    return validated.select(
        F.when(good, MESSAGES).otherwise(ERROR_ROWS).alias("kind"), "stream_id", "comment_id",
        *(F.when(good, F.col(c)).alias(c) for c in _MESSAGE), "arrival_ts",
        bad(error_id("stream_id", "comment_id")).alias("id"),
        bad(F.lit(COMMENT_ERROR_TYPE)).alias("error_type"),
        bad(F.col("reasons")).alias("error_message"), bad(F.lit(0)).alias("retry_count"),
        bad(F.lit(1)).alias("is_recoverable"),
        bad(bucket_of("stream_id", TABLE_BUCKETS)).alias("bucket"))


def read_channels(spark: SparkSession, path: str, checkpoints: DataFrame | None = None,
                  session_start: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """O1 and O2: the channel log as a stream of comments. With ``session_start``, channels
    without a checkpoint begin at the segments of the session; ``start_position`` does the rest
    row by row. Only ``columns`` are read from the files."""
    register(spark)
    schema = COMMENT if columns is None else T.StructType([COMMENT[c] for c in columns])
    reader = spark.readStream.format("channel_log").option("path", path).schema(schema)
    if session_start:
        resume = [] if checkpoints is None else [r[0] for r in checkpoints.where(
            "last_comment_id IS NOT NULL").select("stream_id").distinct().collect()]  # channels
        reader = reader.option("session_start", session_start).option("resume", json.dumps(resume))
    return reader.load().where("comment_id IS NOT NULL")


def run_published(spark: SparkSession, source: str, out: str, checkpoint_dir: str,
                  streams: DataFrame, checkpoints: DataFrame, session_start: str,
                  ts_col: str | None = "arrival_ts", trigger: dict | None = None):
    """Start the query. ``session_start`` is an ISO time in naive UTC."""
    comments = read_channels(spark, source, checkpoints, session_start)
    start = F.lit(session_start).cast("timestamp_ntz")
    rows = outcome(prepare(comments, streams, checkpoints, start, ts_col))
    return (rows.writeStream.format("published").option("path", out).option("bucket", "bucket")
            .option("checkpointLocation", checkpoint_dir).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def published_messages(spark: SparkSession, out: str) -> DataFrame:
    """O3: the messages published so far."""
    return read_published(spark, out, MESSAGES, _ROW)


def published_errors(spark: SparkSession, out: str) -> DataFrame:
    """The error rows published so far, in the columns of the error table. Files lie in a
    folder per bucket of the stream."""
    fields = [f for f in ERRORS.fields if f.name != "timestamp"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields]
                          + [T.StructField("arrival_ts", T.TimestampNTZType())])
    return read_published(spark, out, ERROR_ROWS, schema).withColumnRenamed("arrival_ts", "timestamp")
