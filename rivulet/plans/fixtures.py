"""Operator inputs derived from the driver tables (documents, events).

Deterministic DataFrame derivations; the oracle SQL in ``plans.oracle`` states the same
rules as text, so Spark and DuckDB share them. All timestamps are TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _u(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("u"), c.cast("string"))


def comments(spark, sf_dir) -> DataFrame:
    """one comment per document; every 7th author deleted, every 50th body empty."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("comment_id"),
        F.col("source").alias("subreddit"),
        F.when(d % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), (d % 97).cast("string"))).alias("author"),
        F.when(d % 50 == 3, F.lit("")).otherwise(F.col("text")).alias("body"),
        F.timestamp_add("SECOND", d * 37, ntz("2024-01-01 00:00:00")).alias("arrival_ts"))


def messages(spark, sf_dir) -> DataFrame:
    """F1 messages with a synthetic stamp column so that validation is deterministic."""
    c = comments(spark, sf_dir)
    k = F.col("comment_id").cast("bigint") % 40
    return c.select(
        "comment_id", "subreddit", "arrival_ts",
        F.coalesce(F.col("author"), F.lit("[deleted]")).alias("author_id"),
        F.col("body").alias("text"),
        F.when(k == 5, F.lit("2024-01-01T00:00:00"))
         .when(k == 6, F.lit("not-a-dateZ"))
         .otherwise(F.lit("2024-01-01T00:00:00.000001Z")).alias("timestamp"))


def comment_checkpoints(spark, sf_dir) -> DataFrame:
    """Snapshot of checkpoints per channel (two channels have none)."""
    d = F.col("doc_id")
    return (table(spark, sf_dir, "documents")
            .where(~F.col("source").isin("src1", "src2"))
            .groupBy(F.col("source").alias("stream_id"))
            .agg(F.max(F.when(d % 3 == 0, d)).cast("string").alias("last_comment_id")))


def comment_streams(spark, sf_dir) -> DataFrame:
    """Registry for the F1 channels: every channel but src19 is registered, id = channel."""
    return (table(spark, sf_dir, "documents").where(F.col("source") != "src19")
            .select(F.col("source").alias("id"), F.col("source").alias("subreddit"))
            .distinct().withColumn("status", F.lit("active")))


ERROR_TYPES_BY_MOD11 = ["ConnectionError", "TimeoutError", "TooManyRequests", "RequestException",
                        "SuspiciousActivity", "ResponseException", "RateLimitError", "NotFound",
                        "Forbidden", "ValueError", "KeyError"]


def errors(spark, sf_dir) -> DataFrame:
    """one error per event, stream = user, type cycles over 11 classes."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 11
    t = F.lit(ERROR_TYPES_BY_MOD11[-1])
    for i, name in reversed(list(enumerate(ERROR_TYPES_BY_MOD11[:-1]))):
        t = F.when(m == i, F.lit(name)).otherwise(t)
    return e.select(_u("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "ts",
                    t.alias("error_type"), F.col("props").alias("error_message"))


def errors_dense(spark, sf_dir) -> DataFrame:
    """Every event is an error of stream = event type (five hot streams)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream_id"), F.col("event_id").alias("seq"), "ts",
        F.lit("TimeoutError").alias("error_type"), F.col("props").alias("error_message"))


def clears(spark, sf_dir) -> DataFrame:
    """Error-list clears, latest per stream."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("clear_ts"))
            .select(_u("user_id").alias("stream_id"), "clear_ts"))


def checkpoint_log(spark, sf_dir) -> DataFrame:
    """partial checkpoint updates (null = field not set) with bad and offset stamps."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        _u("user_id").alias("stream_id"), i.alias("seq"), F.col("ts").alias("updated_at"),
        F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(i.cast("string"))
         .alias("last_comment_id"),
        F.when(i % 5 == 0, F.lit(None).cast("string"))
         .when(i % 11 == 0, F.lit("bad"))
         .when(i % 13 == 0, F.lit("2024-01-05T10:00:00+02:00"))
         .otherwise(F.lit("2024-01-05T10:00:00Z")).alias("last_processed_at"))


def checkpoint_table(spark, sf_dir) -> DataFrame:
    """F3 table: existing durable checkpoints, partly overlapping the log's streams."""
    users = table(spark, sf_dir, "events").select((F.col("user_id") + 75).alias("k")).distinct()
    sid = F.concat(F.lit("u"), F.col("k").cast("string"))
    return users.select(sid.alias("id"), sid.alias("stream_id"),
                        F.lit("old").alias("last_comment_id"),
                        ntz("2023-12-31 00:00:00").alias("last_processed_at"),
                        ntz("2023-12-31 00:00:00").alias("updated_at"))


def requests(spark, sf_dir) -> DataFrame:
    """F4 requests: create-stream calls, many per channel; those of even events ask for
    channels that are not registered, every 37th names no channel, every 5th has no config."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("st"), i.cast("string")).alias("id"),
        F.when(i % 37 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string"), F.when(
            i % 2 == 0, F.lit("x")).otherwise(F.lit("")))).alias("subreddit"),
        F.col("ts").alias("requested_at"),
        F.concat(F.lit("i"), (i % 3).cast("string")).alias("instance_id"),
        F.when(i % 5 != 0, F.col("props")).alias("config"))


STATUS_BY_MOD6 = ["inactive", "starting", "active", "paused", "stopped", "error"]


def streams(spark, sf_dir) -> DataFrame:
    """F4 registry: a channel of every user, with every status; configs are good, bad JSON,
    empty or null."""
    k = F.col("k")
    st = F.lit(STATUS_BY_MOD6[-1])
    for i, name in reversed(list(enumerate(STATUS_BY_MOD6[:-1]))):
        st = F.when(k % 6 == i, F.lit(name)).otherwise(st)
    ks = table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct()
    return ks.select(F.concat(F.lit("s"), k.cast("string")).alias("id"),
                     F.concat(F.lit("c"), k.cast("string")).alias("subreddit"),
                     st.alias("status"),
                     F.when(k % 4 == 0, F.lit("{bad")).when(k % 7 == 0, F.lit(""))
                      .when(k % 9 != 0, F.lit('{"limit": 100}')).alias("config"))


def registry_checkpoints(spark, sf_dir) -> DataFrame:
    """F4 checkpoints of the registry's streams, and of as many that are not registered."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct()
    ids = users.select(F.explode(F.array(
        F.concat(F.lit("s"), F.col("k").cast("string")),
        F.concat(F.lit("ghost"), F.col("k").cast("string")))).alias("id"))
    return ids.select("id", F.col("id").alias("stream_id"), F.lit("x").alias("last_comment_id"),
                      ntz("2023-12-31 00:00:00").alias("last_processed_at"),
                      ntz("2023-12-31 00:00:00").alias("updated_at"))


def registry_leases(spark, sf_dir) -> DataFrame:
    """F4 leases: one per registered channel."""
    return streams(spark, sf_dir).select("subreddit", F.concat(
        F.lit("i"), F.length("id").cast("string")).alias("instance_id"))


def status_log(spark, sf_dir) -> DataFrame:
    """F4 status log: one status write per event; instance only on even events; every 997th
    write is a tombstone."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    i = F.col("event_id")
    status = (F.when(i % 997 == 0, "deleted").when(t == "signup", "starting")
              .when(t == "purchase", "stopped").when(t == "error", "error").otherwise("active"))
    return e.select(_u("user_id").alias("stream_id"), i.alias("seq"), "ts",
                    status.alias("status"),
                    F.when(i % 2 == 0, F.concat(F.lit("i"), (i % 3).cast("string")))
                     .alias("instance_id"))


def delete_ids(spark, sf_dir) -> DataFrame:
    """Ids to delete: of every user k, s of 3k (beyond the last user it is unknown, a no-op)
    and ghost k (a checkpoint without a stream, a no-op too)."""
    k = F.col("user_id")
    return (table(spark, sf_dir, "events").select(k).distinct().select(F.explode(F.array(
        F.concat(F.lit("s"), (k * 3).cast("string")),
        F.concat(F.lit("ghost"), k.cast("string")))).alias("id")))


def attempts(spark, sf_dir) -> DataFrame:
    """call attempts of five streams; value > 30 is a failed call, of four classes."""
    i = F.col("event_id") % 4
    kind = (F.when(i == 0, "ConnectionError").when(i == 1, "TooManyRequests")
            .when(i == 2, "RateLimitError").otherwise("TimeoutError"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("stream_id"),
        F.col("event_id").alias("attempt_id"), "ts",
        F.when(F.col("value") > 30, kind).alias("error_type"))


def lease_log(spark, sf_dir) -> DataFrame:
    """lock calls per channel: acquire, refresh and release by three instances."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("subreddit"),
        F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("instance_id"),
        F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_id") % 50 == 0, "release").when(F.col("event_id") % 3 == 0, "acquire")
         .otherwise("refresh").alias("action"))


def instants(spark, sf_dir) -> DataFrame:
    """every event's time, asked of the error list of the next user."""
    return table(spark, sf_dir, "events").select(
        _u(F.col("user_id") + 1).alias("stream_id"), F.col("ts").alias("at"),
        F.col("event_id").alias("id"))


def lease_instants(spark, sf_dir) -> DataFrame:
    """Every event's time plus half an hour, asked of the event's channel."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("subreddit"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"), F.col("event_id").alias("id"))


def damaged(values: DataFrame) -> DataFrame:
    """F8: encoded values, by their comment's number mod 5: last byte gone, a byte more, a byte
    in front, last byte replaced, whole."""
    v = F.col("value")
    k = F.col("comment_id").cast("bigint") % 5
    most = F.substring(v, F.lit(1), F.octet_length(v) - 1)
    return values.withColumn("value", F.when(k == 0, most)
                             .when(k == 1, F.concat(v, F.unhex(F.lit("00"))))
                             .when(k == 2, F.concat(F.unhex(F.lit("01")), v))
                             .when(k == 3, F.concat(most, F.unhex(F.lit("FF")))).otherwise(v))
