"""Quarantine split (O9), error rows (O4 shape) and the per-stream error list:
keep-last-N (O19), sliding-expiry lists (O20), live count (O21), recent errors (O22) and
clears (O23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.expr import COMMENT_ERROR_TYPE
from rivulet.functions.scan import keyed_scan

# List bound and sliding expiry of the per-stream error list.
ERROR_LIST_MAX = 100
ERROR_TTL = "24 hours"
RECENT_LIMIT = 10


def error_id(*cols) -> Column:
    """Deterministic uuid-shaped id, so a replayed batch writes the same rows again."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def split(validated: DataFrame, stream_col: str = "subreddit", ts_col: str = "arrival_ts",
          id_col: str = "comment_id") -> tuple[DataFrame, DataFrame]:
    """Valid rows go on as messages; invalid rows become recoverable error rows and the
    stream goes on. Both come from one validated input (cache it inside a micro-batch)."""
    good = validated.where(F.col("is_valid"))
    bad = validated.where(~F.col("is_valid"))
    errors = bad.select(
        error_id(stream_col, id_col).alias("id"),
        F.col(stream_col).alias("stream_id"),
        F.col(id_col).alias("comment_id"),
        F.lit(COMMENT_ERROR_TYPE).alias("error_type"),
        F.col("reasons").alias("error_message"),
        F.lit(0).alias("retry_count"),
        F.lit(1).alias("is_recoverable"),
        F.col(ts_col).alias("timestamp"))
    return good, errors


def with_error_defaults(df: DataFrame) -> DataFrame:
    """O4 row shape with the table defaults: retry_count 0, is_recoverable 1."""
    cols = df.columns
    return df.select(
        F.col("id"), F.col("stream_id"), F.col("error_type"), F.col("error_message"),
        (F.coalesce(F.col("retry_count"), F.lit(0)) if "retry_count" in cols else F.lit(0))
        .cast("int").alias("retry_count"),
        (F.coalesce(F.col("is_recoverable"), F.lit(1)) if "is_recoverable" in cols else F.lit(1))
        .cast("int").alias("is_recoverable"),
        F.col("timestamp"))


def keep_last(errors: DataFrame, n: int = ERROR_LIST_MAX, key: str = "stream_id",
              ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest ``n`` per stream (position 1 = newest). Spark plans a partial top-n
    before the shuffle, so a hot stream ships at most ``n`` rows per input partition."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return (errors.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= n)
            .withColumn("position", F.col("position").cast("long")))


def with_lists(errors: DataFrame, ttl: str = ERROR_TTL, key: str = "stream_id",
               ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Tag each error with its list number: a push more than ``ttl`` after the previous
    push of the stream starts a new list (a gap of exactly ``ttl`` keeps the list)."""
    return keyed_scan(errors, [key], ts, [seq], gap=ttl).withColumnRenamed("island", "list_no")


def error_lists(errors: DataFrame, ttl: str = ERROR_TTL, cap: int = ERROR_LIST_MAX,
                key: str = "stream_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """One row per list: first and last push, expiry (last push + ttl), pushes and the
    number of entries kept (capped at ``cap``)."""
    tagged = with_lists(errors, ttl, key, ts, seq)
    return (tagged.groupBy(key, "list_no")
            .agg(F.min(ts).alias("list_start"), F.max(ts).alias("last_push"),
                 F.count(F.lit(1)).alias("n_pushed"))
            .select(key, "list_no", "list_start", "last_push",
                    (F.col("last_push") + F.expr(f"INTERVAL {ttl}")).alias("expires_at"),
                    "n_pushed", F.least(F.col("n_pushed"), F.lit(cap).cast("long"))
                    .alias("n_kept")))


def live_entries(errors: DataFrame, as_of: Column, ttl: str = ERROR_TTL,
                 cap: int = ERROR_LIST_MAX, key: str = "stream_id", ts: str = "ts",
                 seq: str = "seq") -> DataFrame:
    """Entries of each stream's live list as of ``as_of``, ``position`` 1 = newest.

    Only the newest list can be live, and it holds at most ``cap`` entries. So the newest
    ``cap`` pushes are taken first (a partial top-n before the shuffle, whatever the history),
    and over those few rows the list is what comes before the first gap over ``ttl``."""
    top = keep_last(errors.where(F.col(ts) <= as_of), cap, key, ts, seq)
    w = Window.partitionBy(key).orderBy("position")
    later = F.coalesce(F.lag(ts).over(w), as_of)
    gap = (later > F.col(ts) + F.expr(f"INTERVAL {ttl}")).cast("int")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (top.withColumn("_gap", gap).withColumn("_gaps", F.sum("_gap").over(run))
            .where(F.col("_gaps") == 0).drop("_gap", "_gaps"))


def error_count(errors: DataFrame, as_of: Column, ttl: str = ERROR_TTL,
                cap: int = ERROR_LIST_MAX, streams: DataFrame | None = None,
                key: str = "stream_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Live list length per stream as of ``as_of`` (0 when expired or never pushed)."""
    live = (live_entries(errors, as_of, ttl, cap, key, ts, seq).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n")))
    base = streams if streams is not None else errors.select(key).distinct()
    return (base.join(live, key, "left")
            .select(key, F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("error_count")))


def recent_errors(errors: DataFrame, as_of: Column, limit: int = RECENT_LIMIT,
                  ttl: str = ERROR_TTL, cap: int = ERROR_LIST_MAX, key: str = "stream_id",
                  ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest ``limit`` entries of each stream's live list as of ``as_of``; never more
    than the list holds."""
    return live_entries(errors, as_of, ttl, cap, key, ts, seq).where(F.col("position") <= limit)


def clear_errors(errors: DataFrame, clears: DataFrame, key: str = "stream_id",
                 ts: str = "ts", clear_ts: str = "clear_ts") -> DataFrame:
    """Drop each stream's errors at or before its latest clear."""
    last = clears.groupBy(key).agg(F.max(clear_ts).alias("_clear"))
    return (errors.join(last, key, "left")
            .where(F.col("_clear").isNull() | (F.col(ts) > F.col("_clear")))
            .drop("_clear"))
