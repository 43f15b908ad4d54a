"""Stream registry: read/list (O13), create-if-absent (O14), lookup by channel (O15),
delete cascade (O18), current status from the status log (O26), dead-stream sweep (O33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status given to a new stream, statuses the sweep removes.
CREATED_STATUS = "starting"
DEAD_STATUSES = ["stopped", "error", "inactive"]
TOMBSTONE = "deleted"


def parsed_config(config: str = "config") -> Column:
    """Config text as read back: valid JSON kept, bad JSON -> '{}', empty/null as is."""
    c = F.col(config)
    return (F.when(c.isNull() | (c == ""), c)
            .when(F.try_parse_json(c).isNotNull(), c)
            .otherwise(F.lit("{}")))


def list_streams(streams: DataFrame) -> DataFrame:
    """O13 (list): every stream with its config parsed; ``config_limit`` is the parsed
    ``limit`` field."""
    cfg = parsed_config()
    return streams.select(
        *[c for c in streams.columns if c != "config"], cfg.alias("config"),
        F.get_json_object(cfg, "$.limit").cast("bigint").alias("config_limit"))


def get_stream(streams: DataFrame, stream_id: str) -> DataFrame:
    """O13 (get): the stream with this id, or no row. The filter reaches the scan."""
    return list_streams(streams.where(F.col("id") == F.lit(stream_id)))


def create_streams(streams: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claim each channel once, for the instance that asks. Within the batch the earliest
    request wins (requested_at, then id); a channel already in the registry is not claimed
    again, and a request without a channel claims nothing. Returns (created rows, conflicting
    requests with the id holding the claim).

    The per-channel winner is a min over a struct, a partial aggregate, so a channel with a
    third of all requests is pre-reduced before the shuffle."""
    requests = requests.where(F.col("subreddit").isNotNull())
    win = (requests.groupBy("subreddit")
           .agg(F.min(F.struct("requested_at", "id", "instance_id", "config")).alias("w"))
           .select("subreddit", F.col("w.id").alias("id"),
                   F.col("w.requested_at").alias("requested_at"),
                   F.col("w.instance_id").alias("instance_id"),
                   F.col("w.config").alias("config")))
    existing = streams.select("subreddit", F.col("id").alias("holder_id"))
    created = (win.join(existing, "subreddit", "left_anti")
               .select("id", "subreddit", F.lit(CREATED_STATUS).alias("status"),
                       "instance_id",
                       F.coalesce(F.col("config"), F.lit("{}")).alias("config"),
                       F.col("requested_at").alias("created_at"),
                       F.col("requested_at").alias("updated_at")))
    holders = existing.unionByName(created.select("subreddit",
                                                  F.col("id").alias("holder_id")))
    conflicts = (requests.join(holders, "subreddit", "inner")
                 .where(F.col("id") != F.col("holder_id"))
                 .select("id", "subreddit", "holder_id"))
    return created, conflicts


def lookup(df: DataFrame, streams: DataFrame, channel: str = "subreddit") -> DataFrame:
    """Attach the registry id and status by channel (no match -> nulls)."""
    reg = streams.select(F.col("subreddit").alias("_r_sub"), F.col("id").alias("stream_id"),
                         F.col("status").alias("stream_status"))
    return (df.join(reg, df[channel] == F.col("_r_sub"), "left").drop("_r_sub"))


def delete_streams(streams: DataFrame, checkpoints: DataFrame, ids: DataFrame,
                   leases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Remove the registered streams among ``ids`` with their checkpoints, their leases
    (rows by ``subreddit``) and so their channel claims. An id that is not registered is a
    no-op: a checkpoint under it stays. Returns what remains of each table."""
    gone = (ids.join(streams.select(F.col("id"), F.col("subreddit").alias("_del_channel")), "id")
            .select(F.col("id").alias("_del_id"), "_del_channel").distinct())
    s = streams.join(gone, streams["id"] == F.col("_del_id"), "left_anti")
    c = checkpoints.join(gone, checkpoints["stream_id"] == F.col("_del_id"), "left_anti")
    held = None if leases is None else leases.join(
        gone, leases["subreddit"] == F.col("_del_channel"), "left_anti")
    return s, c, held


def current_streams(status_log: DataFrame, key: str = "stream_id", ts: str = "ts",
                    seq: str = "seq") -> DataFrame:
    """Last status wins; ``instance_id`` changes only when a write supplied one;
    ``updated_at`` is the last write. A tombstone is terminal (the stream is gone).
    Aggregation only, combined map-side."""
    order = F.struct(F.col(ts), F.col(seq))
    inst = F.col("instance_id")
    return (status_log.groupBy(key)
            .agg(F.max_by("status", order).alias("status"),
                 F.max_by(inst, F.when(inst.isNotNull(), order)).alias("instance_id"),
                 F.max(ts).alias("updated_at"),
                 F.max((F.col("status") == TOMBSTONE).cast("int")).alias("_dead"))
            .where(F.col("_dead") == 0).drop("_dead"))


def sweep_dead(streams: DataFrame, checkpoints: DataFrame, leases: DataFrame | None = None
               ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Streams in a dead status are deleted with their checkpoints, leases and claims.
    Returns (swept rows, remaining streams, remaining checkpoints, remaining leases)."""
    swept = streams.where(F.col("status").isin(DEAD_STATUSES))
    return swept, *delete_streams(streams, checkpoints, swept.select("id"), leases)
