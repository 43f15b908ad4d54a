"""Checkpoint operators: start position (O2), skip processed (O16), upsert (O17),
every-N checkpoint (O24), partial-update merge (O25) and flush (O28, batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.expr import parse_naive_utc
from rivulet.functions.scan import keyed_scan

# Fixed value: a checkpoint is stored after every N successful messages of a stream.
CHECKPOINT_EVERY = 100


def start_position(comments: DataFrame, checkpoints: DataFrame, session_start: Column,
                   channel: str = "subreddit", ts: str = "arrival_ts") -> DataFrame:
    """O2: a stream with a checkpoint replays everything; one without skips what existed
    before the session started."""
    ck = checkpoints.where(F.col("last_comment_id").isNotNull()).select(
        F.col("stream_id").alias("_ck_stream"), F.lit(True).alias("_has_ck"))
    j = comments.join(ck, comments[channel] == F.col("_ck_stream"), "left")
    replay = F.coalesce(F.col("_has_ck"), F.lit(False))
    return (j.where(replay | (F.col(ts) >= session_start))
            .select(*[comments[c] for c in comments.columns], replay.alias("replay")))


def skip_processed(comments: DataFrame, checkpoints: DataFrame, channel: str = "subreddit",
                   id_col: str = "comment_id") -> DataFrame:
    """Drop the one comment equal to its stream's last checkpointed id (equality,
    not order); a null checkpoint skips nothing."""
    ck = checkpoints.where(F.col("last_comment_id").isNotNull()).select(
        F.col("stream_id").alias("_ck_stream"), F.col("last_comment_id").alias("_ck_id"))
    cond = (comments[channel] == F.col("_ck_stream")) & (comments[id_col] == F.col("_ck_id"))
    return comments.join(ck, cond, "left_anti")


def checkpoint_every(rows: DataFrame, n: int = CHECKPOINT_EVERY, key: str = "stream_id",
                     ts: str = "ts", tiebreak: str = "seq", id_col: str = "seq",
                     unit: str = "HOUR") -> DataFrame:
    """Per stream, the n-th, 2n-th, ... successful row becomes a checkpoint; the
    tail after the last multiple is not checkpointed. The counter is the row's position in
    the stream's (ts, tiebreak) order, computed without a per-stream single task."""
    pos = keyed_scan(rows, [key], ts, [tiebreak], unit=unit, rn="n_processed")
    return pos.where(F.col("n_processed") % n == 0).select(
        F.col(key).alias("stream_id"), F.col(id_col).cast("string").alias("last_comment_id"),
        F.col(ts).alias("last_processed_at"), "n_processed")


def merge_checkpoints(log: DataFrame, key: str = "stream_id", ts: str = "updated_at",
                      seq: str = "seq",
                      fields: tuple[str, ...] = ("last_comment_id", "last_processed_at")
                      ) -> DataFrame:
    """Each update sets only its non-null fields, last write wins per field;
    ``updated_at`` moves only when an update set something. Streams whose updates never
    set anything have no checkpoint. Pure aggregation (partial, map-side)."""
    order = F.struct(F.col(ts), F.col(seq))
    any_set = None
    for f in fields:
        any_set = F.col(f).isNotNull() if any_set is None else any_set | F.col(f).isNotNull()
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    aggs.append(F.max(F.when(any_set, F.col(ts))).alias("updated_at"))
    return log.groupBy(key).agg(*aggs).where(F.col("updated_at").isNotNull())


def flush_rows(merged: DataFrame, now: Column, key: str = "stream_id") -> DataFrame:
    """O28 (one flush): parse each merged checkpoint's stamp to naive UTC; rows whose
    stamp does not parse are skipped, the others written with id = stream id."""
    raw = F.col("last_processed_at")
    parsed = parse_naive_utc(raw)
    empty = raw.isNull() | (raw == "")
    return (merged.where(empty | parsed.isNotNull())
            .select(F.col(key).alias("id"), F.col(key).alias("stream_id"), "last_comment_id",
                    F.when(empty, F.lit(None).cast("timestamp_ntz")).otherwise(parsed)
                    .alias("last_processed_at"), now.alias("updated_at")))


def upsert_checkpoints(table: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Insert or overwrite per stream_id (null values overwrite too) and stamp
    ``updated_at``; the existing row keeps its id. Adds ``change`` =
    inserted / updated / unchanged."""
    t = table.select(*[F.col(c).alias(f"_t_{c}") for c in
                       ("id", "stream_id", "last_comment_id", "last_processed_at",
                        "updated_at")])
    u = updates.select(*[F.col(c).alias(f"_u_{c}") for c in
                         ("id", "stream_id", "last_comment_id", "last_processed_at")])
    j = t.join(u, F.col("_t_stream_id") == F.col("_u_stream_id"), "full_outer")
    has_u = F.col("_u_stream_id").isNotNull()
    has_t = F.col("_t_stream_id").isNotNull()
    return j.select(
        F.when(has_t, F.col("_t_id")).otherwise(F.coalesce(F.col("_u_id"),
                                                           F.col("_u_stream_id"))).alias("id"),
        F.coalesce(F.col("_t_stream_id"), F.col("_u_stream_id")).alias("stream_id"),
        F.when(has_u, F.col("_u_last_comment_id")).otherwise(F.col("_t_last_comment_id"))
        .alias("last_comment_id"),
        F.when(has_u, F.col("_u_last_processed_at")).otherwise(F.col("_t_last_processed_at"))
        .alias("last_processed_at"),
        F.when(has_u, now).otherwise(F.col("_t_updated_at")).alias("updated_at"),
        F.when(has_u & has_t, "updated").when(has_u, "inserted").otherwise("unchanged")
        .alias("change"))


def flush_checkpoints(log: DataFrame, table: DataFrame, now: Column) -> DataFrame:
    """O28 end to end (batch): merge the log, parse, skip bad rows, upsert."""
    return upsert_checkpoints(table, flush_rows(merge_checkpoints(log), now), now)


def flush_checkpoint(log: DataFrame, table: DataFrame, now: Column, stream_id: str) -> DataFrame:
    """O28 single-stream variant (flush on stop): the same merge, parse and upsert for one
    stream; the filter reaches the scan, other streams' rows are left as they are."""
    one = log.where(F.col("stream_id") == F.lit(stream_id))
    return upsert_checkpoints(table, flush_rows(merge_checkpoints(one), now), now)
