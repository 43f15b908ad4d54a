"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator family.

Each reads the driver tables through ``plans.fixtures`` and runs the library operators on
the whole tables. Output columns are aliased to match ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import expr
from rivulet.operators import checkpoints as ck
from rivulet.operators import asof, circuit, errors, lease, registry
from rivulet.plans import fixtures as fx
from rivulet.sources import io

# Fixed instants used by the as-of queries (inside the 30 days the events cover).
NOW = "2024-02-01 00:00:00"
ERRORS_AS_OF = "2024-01-31 00:00:00"
SESSION_START = "2024-01-01 05:00:00"
LEASE_AS_OF = "2024-01-15 12:00:00"
LEASE_TTL = 3600  # seconds
# A first recovery time short enough for an error's suggested backoff to act as the floor.
BREAKER = {"recovery": 10}

MESSAGE_COLS = ["comment_id", "subreddit", "author_id", "text", "timestamp"]


def _validated(spark, d):
    return expr.validate(fx.messages(spark, d))


def messages_valid(spark, d):
    good, _ = errors.split(_validated(spark, d))
    return good.select(*MESSAGE_COLS)


def messages_quarantine(spark, d):
    _, bad = errors.split(_validated(spark, d))
    return bad


def encode_roundtrip(spark, d):
    """O5 through storage: messages are encoded, written, read back and decoded."""
    from rivulet.session import new_work_dir
    good, _ = errors.split(_validated(spark, d))
    path = f"{new_work_dir(spark, 'encode')}/values"
    io.write_messages(good, path, "parquet", value_format="json", keep=["comment_id"])
    return io.decode_message(spark.read.parquet(path), keep=["comment_id"])


def avro_roundtrip(spark, d):
    """O5 in Avro through storage: the binary records are written, read back and decoded."""
    from rivulet.session import new_work_dir
    good, _ = errors.split(_validated(spark, d))
    path = f"{new_work_dir(spark, 'avro')}/values"
    io.write_messages(good, path, "parquet", value_format="avro", keep=["comment_id"])
    return io.decode_message(spark.read.parquet(path), fmt="avro", keep=["comment_id"])


def avro_quarantine(spark, d):
    """What the strict decoder says of values of which four in five are damaged."""
    good, _ = errors.split(_validated(spark, d))
    values = fx.damaged(io.encode_message(good, fmt="avro", keep=["comment_id"]))
    return io.decode_message(values, fmt="avro", keep=["comment_id"], reasons=True).select(
        "comment_id", "reason", F.col("text").isNull().alias("dropped"))


def error_classified(spark, d):
    return expr.classify(fx.errors(spark, d)).drop("ts", "error_message")


def errors_append(spark, d):
    c = expr.classify(fx.errors(spark, d))
    rows = c.select(errors.error_id("stream_id", "seq").alias("id"), "stream_id", "error_type",
                    "error_message", "is_recoverable", F.col("ts").alias("timestamp"))
    return errors.with_error_defaults(rows)


def errors_keep_last(spark, d):
    return errors.keep_last(fx.errors(spark, d)).drop("error_message")


def errors_keep_last_dense(spark, d):
    return errors.keep_last(fx.errors_dense(spark, d)).drop("error_message")


def error_lists(spark, d):
    return errors.error_lists(fx.errors(spark, d))


def error_lists_dense(spark, d):
    return errors.error_lists(fx.errors_dense(spark, d))


def error_count_live(spark, d):
    return errors.error_count(fx.errors(spark, d), fx.ntz(ERRORS_AS_OF))


def errors_recent(spark, d):
    return errors.recent_errors(fx.errors(spark, d), fx.ntz(ERRORS_AS_OF))


def error_count_dense(spark, d):
    return errors.error_count(fx.errors_dense(spark, d), fx.ntz(ERRORS_AS_OF))


def errors_recent_dense(spark, d):
    return errors.recent_errors(fx.errors_dense(spark, d), fx.ntz(ERRORS_AS_OF))


def errors_recent_cleared(spark, d):
    """O23 then O22: what a reader sees after the lists were cleared."""
    left = errors.clear_errors(fx.errors(spark, d), fx.clears(spark, d))
    return errors.recent_errors(left, fx.ntz(ERRORS_AS_OF))


def errors_after_clear(spark, d):
    return errors.clear_errors(fx.errors(spark, d), fx.clears(spark, d))


def checkpoint_every(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("event_type").alias("stream_id"),
                                             F.col("event_id").alias("seq"), "ts")
    return ck.checkpoint_every(ev)


def checkpoint_merge(spark, d):
    return ck.merge_checkpoints(fx.checkpoint_log(spark, d))


def checkpoint_flush(spark, d):
    return ck.flush_rows(ck.merge_checkpoints(fx.checkpoint_log(spark, d)), fx.ntz(NOW))


def checkpoint_upsert(spark, d):
    return ck.flush_checkpoints(fx.checkpoint_log(spark, d), fx.checkpoint_table(spark, d),
                                fx.ntz(NOW))


def start_position(spark, d):
    return ck.start_position(fx.comments(spark, d), fx.comment_checkpoints(spark, d),
                             fx.ntz(SESSION_START)).select("comment_id", "subreddit",
                                                           "arrival_ts", "replay")


def skip_processed(spark, d):
    return ck.skip_processed(fx.comments(spark, d), fx.comment_checkpoints(spark, d)).select(
        "comment_id", "subreddit", "arrival_ts")


def streams_create(spark, d):
    created, _ = registry.create_streams(fx.streams(spark, d), fx.requests(spark, d))
    return created


def streams_conflicts(spark, d):
    _, conflicts = registry.create_streams(fx.streams(spark, d), fx.requests(spark, d))
    return conflicts


def streams_lookup(spark, d):
    return registry.lookup(fx.requests(spark, d).select("id", "subreddit"), fx.streams(spark, d))


def streams_list(spark, d):
    return registry.list_streams(fx.streams(spark, d))


def streams_current(spark, d):
    return registry.current_streams(fx.status_log(spark, d))


def _deleted(spark, d):
    return registry.delete_streams(fx.streams(spark, d), fx.registry_checkpoints(spark, d),
                                   fx.delete_ids(spark, d), fx.registry_leases(spark, d))


def _swept(spark, d):
    return registry.sweep_dead(fx.streams(spark, d), fx.registry_checkpoints(spark, d),
                               fx.registry_leases(spark, d))


def streams_delete(spark, d):
    return _deleted(spark, d)[0]


def streams_delete_checkpoints(spark, d):
    return _deleted(spark, d)[1]


def streams_delete_leases(spark, d):
    return _deleted(spark, d)[2]


def streams_sweep(spark, d):
    return _swept(spark, d)[0]


def streams_sweep_remaining(spark, d):
    """The cascade side: remaining streams, checkpoints and leases as (kind, id)."""
    _, s, c, held = _swept(spark, d)
    return (s.select(F.lit("stream").alias("kind"), "id")
            .unionByName(c.select(F.lit("checkpoint").alias("kind"), F.col("stream_id").alias("id")))
            .unionByName(held.select(F.lit("lease").alias("kind"), F.col("subreddit").alias("id"))))


def failure_streaks(spark, d):
    return circuit.failure_streaks(fx.attempts(spark, d))


def circuit_timeline(spark, d):
    return circuit.circuit_timeline(fx.attempts(spark, d), **BREAKER)


def lease_intervals(spark, d):
    return lease.lease_intervals(lease.lease_calls(fx.lease_log(spark, d), LEASE_TTL), LEASE_TTL)


def lease_calls(spark, d):
    return lease.lease_calls(fx.lease_log(spark, d), LEASE_TTL).select(
        "subreddit", "seq", "granted", "lease_no")


def lease_conflicts(spark, d):
    return lease.lease_conflicts(lease.lease_calls(fx.lease_log(spark, d), LEASE_TTL))


def lease_holders(spark, d):
    return lease.holders(fx.lease_log(spark, d), fx.ntz(LEASE_AS_OF), LEASE_TTL)


def error_count_at(spark, d):
    """O21 at every event's time, asked of the stream of the next user."""
    return asof.error_count_at(fx.errors(spark, d), fx.instants(spark, d))


def lease_holders_at(spark, d):
    """O32 at every event's time plus half a lease's life, asked of the event's channel."""
    return asof.holders_at(fx.lease_log(spark, d), fx.lease_instants(spark, d), LEASE_TTL)


def _tables(spark, d, streams=False):
    """O6's tables, empty or with the registry of the fixtures."""
    import uuid

    from rivulet.session import new_work_dir
    from rivulet.sources.bucketed import Tables
    tables = Tables(spark, f"rivulet_{uuid.uuid4().hex[:8]}", 8, new_work_dir(spark, "tables"))
    if streams:
        tables.append("streams", fx.streams(spark, d))
    return tables


def table_lookup(spark, d):
    """O15 on the bucketed registry."""
    return _tables(spark, d, streams=True).lookup(fx.requests(spark, d).select("id", "subreddit"))


def table_skip(spark, d):
    """O16 on the bucketed checkpoint table."""
    tables = _tables(spark, d)
    tables.append("stream_checkpoints", fx.comment_checkpoints(spark, d))
    return tables.skip(fx.comments(spark, d), "subreddit").select(
        "comment_id", "subreddit", "arrival_ts")


def table_upsert(spark, d):
    """O17 and O28 on the bucketed checkpoint table: what it holds after the flush."""
    tables = _tables(spark, d)
    tables.append("stream_checkpoints", fx.checkpoint_table(spark, d))
    merged = ck.merge_checkpoints(fx.checkpoint_log(spark, d))
    tables.upsert(ck.flush_rows(merged, fx.ntz(NOW)), fx.ntz(NOW))
    return tables.read("stream_checkpoints")


def table_create(spark, d):
    """O14 as a durable step: the registry after the claims."""
    tables = _tables(spark, d, streams=True)
    tables.create(fx.requests(spark, d))
    return tables.read("streams").select("id", "subreddit", "status", "config")


def table_sweep(spark, d):
    """O33 and O18 as one call: what the tables hold afterwards, as (kind, id)."""
    tables = _tables(spark, d, streams=True)
    tables.append("stream_checkpoints", fx.registry_checkpoints(spark, d))
    tables.sweep()
    return (tables.read("streams").select(F.lit("stream").alias("kind"), "id")
            .unionByName(tables.read("stream_checkpoints").select(
                F.lit("checkpoint").alias("kind"), F.col("stream_id").alias("id"))))


def table_errors(spark, d):
    """Classified errors appended to the bucketed error table."""
    tables = _tables(spark, d)
    tables.append_errors(errors_append(spark, d))
    return tables.read("stream_errors")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "messages_valid": messages_valid,
    "messages_quarantine": messages_quarantine,
    "encode_roundtrip": encode_roundtrip,
    "avro_roundtrip": avro_roundtrip,
    "avro_quarantine": avro_quarantine,
    "error_classified": error_classified,
    "errors_append": errors_append,
    "errors_keep_last": errors_keep_last,
    "errors_keep_last_dense": errors_keep_last_dense,
    "error_lists": error_lists,
    "error_lists_dense": error_lists_dense,
    "error_count_live": error_count_live,
    "errors_recent": errors_recent,
    "error_count_dense": error_count_dense,
    "errors_recent_dense": errors_recent_dense,
    "errors_recent_cleared": errors_recent_cleared,
    "errors_after_clear": errors_after_clear,
    "checkpoint_every": checkpoint_every,
    "checkpoint_merge": checkpoint_merge,
    "checkpoint_flush": checkpoint_flush,
    "checkpoint_upsert": checkpoint_upsert,
    "start_position": start_position,
    "skip_processed": skip_processed,
    "streams_create": streams_create,
    "streams_conflicts": streams_conflicts,
    "streams_lookup": streams_lookup,
    "streams_list": streams_list,
    "streams_current": streams_current,
    "streams_delete": streams_delete,
    "streams_delete_checkpoints": streams_delete_checkpoints,
    "streams_delete_leases": streams_delete_leases,
    "streams_sweep": streams_sweep,
    "streams_sweep_remaining": streams_sweep_remaining,
    "failure_streaks": failure_streaks,
    "circuit_timeline": circuit_timeline,
    "lease_calls": lease_calls,
    "lease_intervals": lease_intervals,
    "lease_conflicts": lease_conflicts,
    "lease_holders": lease_holders,
    "table_lookup": table_lookup,
    "table_skip": table_skip,
    "table_upsert": table_upsert,
    "table_create": table_create,
    "table_sweep": table_sweep,
    "table_errors": table_errors,
    "error_count_at": error_count_at,
    "lease_holders_at": lease_holders_at,
}

from rivulet.plans import stream_queries as _sq  # noqa: E402

QUERIES.update({
    "ingest_stream": _sq.ingest_stream,
    "ingest_checkpoints": _sq.ingest_checkpoints,
    "ingest_flush": _sq.ingest_flush,
    "flush_stream": _sq.flush_stream,
    "circuit_stream": _sq.circuit_stream,
    "error_lists_stream": _sq.error_lists_stream,
    "live_lists_stream": _sq.live_lists_stream,
    "lease_stream": _sq.lease_stream,
    "ingest_published": _sq.ingest_published,
    "ingest_errors": _sq.ingest_errors,
    "checkpoint_stream": _sq.checkpoint_stream,
})
