"""Declared schemas (never inferred) and the idempotent table definitions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

S, TS, NTZ, I, L, B = (T.StringType(), T.TimestampType(), T.TimestampNTZType(),
                       T.IntegerType(), T.LongType(), T.BooleanType())


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Raw comment as it arrives from a channel (author null = deleted account).
COMMENT = _st(("comment_id", S, True), ("subreddit", S, True), ("author", S, True),
              ("body", S, True), ("arrival_ts", NTZ, True))

# The published message; all four fields are required strings.
MESSAGE = _st(("subreddit", S, False), ("author_id", S, False), ("text", S, False),
              ("timestamp", S, False))

# Avro form of D2 (fixed values: record name, namespace and field order of the topic schema).
MESSAGE_AVRO_SCHEMA = """{
  "type": "record",
  "name": "RedditComment",
  "namespace": "com.reddit.stream",
  "fields": [
    {"name": "subreddit", "type": "string"},
    {"name": "author_id", "type": "string"},
    {"name": "text", "type": "string"},
    {"name": "timestamp", "type": "string"}
  ]
}"""

# Stream registry.
STREAMS = _st(("id", S, False), ("subreddit", S, False), ("status", S, False),
              ("instance_id", S, True), ("config", S, True), ("last_heartbeat", NTZ, True),
              ("created_at", NTZ, False), ("updated_at", NTZ, False))

# Durable checkpoints, one row per stream.
CHECKPOINTS = _st(("id", S, False), ("stream_id", S, False), ("last_comment_id", S, True),
                  ("last_processed_at", NTZ, True), ("updated_at", NTZ, False))

# Append-only error rows.
ERRORS = _st(("id", S, False), ("stream_id", S, False), ("error_type", S, True),
             ("error_message", S, True), ("retry_count", I, True), ("is_recoverable", I, True),
             ("timestamp", NTZ, False))

# Log-shaped inputs (ours): status log, checkpoint log, call attempts, lease log.
STATUS_LOG = _st(("stream_id", S, False), ("seq", L, False), ("ts", NTZ, False),
                 ("status", S, True), ("instance_id", S, True))
CHECKPOINT_LOG = _st(("stream_id", S, False), ("seq", L, False), ("updated_at", NTZ, False),
                     ("last_comment_id", S, True), ("last_processed_at", S, True))
ATTEMPTS = _st(("stream_id", S, False), ("attempt_id", L, False), ("ts", NTZ, False),
               ("error_type", S, True))
LEASE_LOG = _st(("subreddit", S, False), ("instance_id", S, False), ("seq", L, False),
                ("ts", NTZ, False), ("action", S, False))

# Number of hash buckets used as the partition column of the keyed tables; it plays the
# role of the reference's secondary indexes (partition pruning on the key).
TABLE_BUCKETS = 16

# The three durable tables (fixed values: their names and columns). Defaults and
# uniqueness are enforced by the writers.
DDL = {
    "streams": """id STRING, subreddit STRING, status STRING, instance_id STRING,
        config STRING, last_heartbeat TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ""",
    "stream_checkpoints": """id STRING, stream_id STRING, last_comment_id STRING,
        last_processed_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "stream_errors": """id STRING, stream_id STRING, error_type STRING, error_message STRING,
        retry_count INT, is_recoverable INT, timestamp TIMESTAMP_NTZ""",
}
# The column whose hash tells a row's bucket: what the table is looked up by.
BUCKETED = {"streams": "subreddit", "stream_checkpoints": "stream_id", "stream_errors": "stream_id"}


def create_tables(spark: SparkSession, db: str = "default", buckets: int = TABLE_BUCKETS,
                  location: str | None = None) -> list[str]:
    """Create the three tables if absent (running it twice is a no-op), in ``buckets`` buckets;
    ``location`` is a folder for their files."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    for name, columns in DDL.items():
        key = BUCKETED[name]
        at = f"LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} ({columns}) USING parquet "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS {at}")
    return [f"{db}.{name}" for name in DDL]
