"""Questions about many instants at once: the live error count (O21) and the lease holder
at every row of a table of instants. An as-of join without a range join: the log and the
instants are one sequence per key, gone through in time order; a key with most of the rows is
cut into segments that run beside each other (``functions.segments``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.functions.segments import array_of, segmented_pass
from rivulet.operators.errors import ERROR_LIST_MAX, ERROR_TTL
from rivulet.operators.lease import LEASE_TTL_SECONDS, lease_calls

# The newest push of a key's list (epoch microseconds) and how many the list has had.
_STORED = "stored_last long, stored_n long"
_TABLE = "piece long, first long, islands long, " + _STORED
LOOK = "look"  # a lease call that asks and changes nothing


class Pushes:
    """Pushes of one or more runs of rows, with the length of each one's list so far. A state
    row counts as all the pushes it stands for."""

    def __init__(self, table: pa.Table, starts: np.ndarray, ttl: int):
        n = len(table)
        stored = table.column("stored_last").combine_chunks().is_valid().to_numpy(
            zero_copy_only=False)
        self.is_state = table.column("at").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.t = np.where(stored, array_of(table, "stored_last", 0), array_of(table, "at", 0))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.at = np.flatnonzero(stored | (array_of(table, "kind", 1) == 0))
        t, g = self.t[self.at], group[self.at]
        self.new = np.ones(len(t), dtype=bool)
        self.new[1:] = (g[1:] != g[:-1]) | (t[1:] - t[:-1] > ttl)
        size = np.where(stored, array_of(table, "stored_n", 0), 1)[self.at]
        before = np.cumsum(size) - size
        base = np.maximum.accumulate(np.where(self.new, before, 0)) if len(t) else before
        self.n = before + size - base
        # The last push at or before each row of its run, -1 if there is none.
        last = np.searchsorted(self.at, np.arange(n), side="right") - 1
        own = (last >= 0) & (group[self.at[np.maximum(last, 0)]] == group) if len(t) \
            else np.zeros(n, dtype=bool)
        self.last = np.where(own, last, -1)


def _advance(ttl: int, cap: int):
    def advance(table: pa.Table, starts: np.ndarray):
        pushes = Pushes(table, starts, ttl)
        if len(pushes.at):
            k = np.maximum(pushes.last, 0)
            alive = (pushes.last >= 0) & (pushes.t - pushes.t[pushes.at[k]] <= ttl)
            count = np.where(alive, np.minimum(pushes.n[k], cap), 0)
        else:
            count = np.zeros(len(table), dtype=np.int64)
        asked = (array_of(table, "kind", 0) == 1) & ~pushes.is_state
        rows = pa.table({"stream_id": table.column("stream_id"), "id": table.column("id"),
                         "at": table.column("at"), "error_count": pa.array(count)})
        z = pushes.last[np.append(starts[1:], len(table)) - 1]
        own = table.select(["stream_id", "_seg", "_segs"]).take(pa.array(starts))
        columns = {c: own.column(c) for c in own.column_names}
        if len(pushes.at):
            k = np.maximum(z, 0)
            columns["stored_last"] = pa.array(pushes.t[pushes.at[k]], pa.int64(), mask=z < 0)
            columns["stored_n"] = pa.array(pushes.n[k], pa.int64(), mask=z < 0)
        states = pa.table([columns.get(f.name, pa.nulls(len(starts), f.type))
                           for f in table.schema], schema=table.schema)
        return rows.filter(pa.array(asked)), states

    return advance


def _table(ttl: int, kinds: pa.Schema):
    def table(rows: pa.Table, name: tuple) -> pa.Table:
        for c in ("stored_last", "stored_n"):
            rows = rows.append_column(c, pa.nulls(len(rows), pa.int64()))
        pushes = Pushes(rows, np.array([0]), ttl)
        some = len(pushes.at) > 0
        row = {"stream_id": name[0], "_seg": name[1], "piece": 0,
               "first": int(pushes.t[pushes.at[0]]) if some else None,
               "islands": int(pushes.new.sum()),
               "stored_last": int(pushes.t[pushes.at[-1]]) if some else None,
               "stored_n": int(pushes.n[-1]) if some else None}
        schema = pa.schema([kinds.field("stream_id"), ("_seg", pa.int32()), *[
            (c, pa.int64()) for c in list(row)[2:]]])
        return pa.Table.from_pylist([row], schema)

    return table


def _lookup(ttl: int):
    def lookup(state: dict | None, table: pd.DataFrame) -> dict:
        s = state or {"stored_last": None, "stored_n": None}
        row = table.iloc[0]
        if row["islands"] == 0:
            return s
        n = int(row["stored_n"])
        if row["islands"] == 1 and not pd.isna(s["stored_last"]) \
                and row["first"] - s["stored_last"] <= ttl:
            n += int(s["stored_n"])
        return {"stored_last": int(row["stored_last"]), "stored_n": n}

    return lookup


def error_count_at(errors: DataFrame, instants: DataFrame, ttl_hours: float = 24,
                   cap: int = ERROR_LIST_MAX, key: str = "stream_id", ts: str = "ts",
                   seq: str = "seq", at: str = "at", id_col: str = "id",
                   parts: int | None = None) -> DataFrame:
    """O21 for a table of instants (``key``, ``at``, ``id_col``): one row per instant with the
    length of its stream's live list then (``key``, ``id_col``, ``at``, ``error_count``), as
    ``errors.error_count`` gives it for one. Errors at the instant itself count. Rows without
    a stream or time take no part: such an instant gets no row."""
    ttl = round(ttl_hours * 3_600_000_000)
    kind = instants.schema[id_col].dataType.simpleString()
    pushes = errors.select(F.col(key).alias("stream_id"), F.col(ts).alias("at"),
                           F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"))
    asked = instants.select(F.col(key).alias("stream_id"), F.col(at).alias("at"),
                            F.lit(1).alias("kind"), F.col(id_col).alias("id"))
    src = pushes.unionByName(asked).where("stream_id IS NOT NULL AND at IS NOT NULL")
    name = src.schema["stream_id"].dataType.simpleString()
    # Pushes of one instant are alike, so nothing beyond (at, kind) orders them.
    out = segmented_pass(
        src, "stream_id", ["at", "kind"],
        schema=f"stream_id {name}, id {kind}, at timestamp_ntz, error_count long",
        advance=_advance(ttl, cap), state_schema=_STORED, table_schema=_TABLE,
        table=_table(ttl, to_arrow_schema(src.schema)), lookup=_lookup(ttl), parts=parts)
    return out.select(F.col("stream_id").alias(key), F.col("id").alias(id_col),
                      F.col("at").alias(at), "error_count")


def holders_at(log: DataFrame, instants: DataFrame, ttl: int = LEASE_TTL_SECONDS,
               at: str = "at", id_col: str = "id", parts: int | None = None) -> DataFrame:
    """O32 for a table of instants (``subreddit``, ``at``, ``id_col``): one row per instant with
    the lease that was live then (``instance_id``, ``held_since``, ``held_until``; null if the
    channel was free), as ``lease.holders`` gives it for one. An instant goes through the
    channel's calls as one that asks and changes nothing, after the calls of its time. Instants
    without a channel or time get no row; ``id_col`` is a long."""
    looks = instants.select("subreddit", F.lit("").alias("instance_id"),
                            F.col(id_col).cast("long").alias("seq"), F.col(at).alias("ts"),
                            F.lit(LOOK).alias("action"))
    calls = log.select("subreddit", "instance_id", F.col("seq").cast("long").alias("seq"), "ts",
                       "action")
    return (lease_calls(calls.unionByName(looks), ttl, parts, after=LOOK)
            .where(F.col("action") == LOOK)
            .select("subreddit", F.col("seq").alias(id_col), F.col("ts").alias(at),
                    F.col("holder_instance").alias("instance_id"), "held_since", "held_until"))
