"""Keyed state on streams: breaker (O30), live error lists (O20 to O22), leases (O31, O32) and
the checkpoint counter (O24).

Each is a ``transformWithState`` operator: a micro-batch reads and writes the state of the keys
that it touches, and of those whose timer the watermark has passed, however many keys there
are. State lives in the RocksDB store under the query's checkpoint, so a restart goes on from
the last committed batch. Rows of one key apply in time order within a micro-batch; rows of a
later batch apply after them.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rivulet.functions.expr import iso_z, suggested_backoff
from rivulet.operators import circuit, lease
from rivulet.operators.errors import ERROR_LIST_MAX, ERROR_TTL, RECENT_LIMIT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store; the setting is the session's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_time(ts: str):
    """A naive UTC time as the zoned timestamp that watermarks need (no session zone involved)."""
    return F.expr("timestamp_micros(timestampdiff(MICROSECOND, "
                  f"TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}))")


def _gather(rows, order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable",
                                                                ignore_index=True)


def _with_state(pdf: pd.DataFrame, key: str, value, types: dict, names: list[str], state):
    """An Arrow table of one run of rows for a segment's ``advance``, the state row first."""
    body = pa.table({c: pa.array(pdf[c], t) for c, t in types.items()})
    n = len(pdf)
    body = body.add_column(0, key, pa.array([value] * n, pa.string()))
    for c in ("_seg", "_segs"):
        body = body.append_column(c, pa.array(np.zeros(n, np.int32)))
    for c in names:
        body = body.append_column(c, pa.nulls(n, pa.string() if c in _TEXTS else pa.int64()))
    if state is None:
        return body
    row = {key: value, "_seg": 0, "_segs": 0, **dict(zip(names, state))}
    return pa.concat_tables([pa.Table.from_pylist([row], schema=body.schema), body])


def _timer(at: int) -> int:
    """The timer that fires once the watermark has reached ``at`` (microseconds): timers fire
    when the watermark, in milliseconds, is past them."""
    return -(-at // 1000) - 1


_TEXTS = ("stored_state", "stored_holder")


# ---- O30

class _Breaker(StatefulProcessor):
    def __init__(self, rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.breaker = handle.getValueState("breaker", circuit.STATE_FIELDS)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, ["ts", "attempt_id"])
        ids = pa.array(pdf["attempt_id"])
        table = _with_state(pdf, "stream_id", key[0], {
            "attempt_id": ids.type, "ts": pa.timestamp("us"), "failed": pa.bool_(),
            "suggested": pa.int64()}, circuit._NAMES, self.breaker.get())
        out, states = circuit._advance(self.rule)(table, np.array([0]))
        self.breaker.update(tuple(states.column(c)[0].as_py() for c in circuit._NAMES))
        yield out.select(circuit.TIMELINE).to_pandas()

    def close(self) -> None:
        pass


def breaker_stream(attempts: DataFrame, threshold: int = circuit.FAILURE_THRESHOLD,
                   recovery: int = circuit.RECOVERY_TIMEOUT,
                   successes: int = circuit.SUCCESS_THRESHOLD,
                   mult: float = circuit.BACKOFF_MULTIPLIER,
                   cap: int = circuit.MAX_BACKOFF) -> DataFrame:
    """O30 on a streaming DataFrame: the timeline rows of every attempt, as
    ``circuit.circuit_timeline`` gives them, with one breaker state per stream kept between
    micro-batches. Attempts without a stream, id or time take no part; stream ids are strings."""
    use_keyed_state(attempts.sparkSession)
    rule = circuit.Rule(threshold, recovery, successes, mult, cap)
    kind = attempts.schema["attempt_id"].dataType.simpleString()
    src = (attempts.where("stream_id IS NOT NULL AND attempt_id IS NOT NULL AND ts IS NOT NULL")
           .select("stream_id", "attempt_id", "ts", F.col("error_type").isNotNull().alias("failed"),
                   suggested_backoff("error_type").cast("long").alias("suggested")))
    return src.groupBy("stream_id").transformWithStateInPandas(
        _Breaker(rule), f"stream_id string, attempt_id {kind}, state string, admitted boolean, "
        "failure_count long, backoff_seconds long", "Append", "None")


# ---- O20 to O22

class _LiveList(StatefulProcessor):
    """State: the entries that are live or later than the watermark (time in microseconds, seq),
    newest first, what was last told, and the timer that is set."""

    def __init__(self, ttl: int, cap: int, limit: int):
        self.ttl, self.cap, self.limit = ttl, cap, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "ts long, seq long")
        self.told = handle.getValueState("told", "recent string, count long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(t), int(s)) for pdf in rows for t, s in zip(pdf["at"], pdf["seq"])]
        yield from self._tell(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield from self._tell(key, timerValues.getCurrentWatermarkInMs(), [])

    def _tell(self, key, watermark: int, new: list):
        as_of = max(watermark, 0) * 1000
        entries = sorted([tuple(e) for e in self.entries.get()] + new, reverse=True)
        later = [e for e in entries if e[0] > as_of]
        live, newer = [], as_of
        for e in entries[len(later):]:
            if newer > e[0] + self.ttl or len(live) == self.cap:
                break
            live.append(e)
            newer = e[0]
        keep = later + live
        if keep:
            self.entries.put(keep)
        else:
            self.entries.clear()
        # The list changes next when a later entry's time comes, or when it expires.
        change = later[-1][0] if later else live[0][0] + self.ttl + 1 if live else None
        self._set(None if change is None else _timer(change))
        recent = ",".join(str(s) for _, s in live[:self.limit])
        if (recent, len(live)) != (self.told.get() if self.told.exists() else ("", 0)):
            self.told.update((recent, len(live)))
            yield pd.DataFrame({"stream_id": [key[0]], "as_of": [as_of],
                                "error_count": [len(live)], "recent": [recent]})

    def _set(self, at) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def close(self) -> None:
        pass


def _micros(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * 1_000_000 * {"second": 1, "minute": 60, "hour": 3600,
                                      "day": 86400}[unit.rstrip("s").lower()]


def live_lists_stream(errors: DataFrame, delay: str, ttl: str = ERROR_TTL,
                      cap: int = ERROR_LIST_MAX, limit: int = RECENT_LIMIT,
                      key: str = "stream_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """O20 to O22 while the stream runs: one row for each change of a stream's live list as the
    watermark sees it: ``stream_id``, ``as_of`` (microseconds), ``error_count`` and ``recent``
    (seqs of the newest ``limit`` entries, comma-joined, newest first). The latest row of a
    stream equals ``error_count`` and ``recent_errors`` as of the watermark; a list that expires
    without further errors is told by a timer, with count 0.

    Errors may come in any order while they are at most ``delay`` older than the newest. Later
    ones don't enter: the query's progress counts them (numRowsDroppedByWatermark) and
    ``state.late_errors`` returns them. Errors without stream, time or seq take no part."""
    use_keyed_state(errors.sparkSession)
    src = (errors.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(seq).isNotNull())
           .select(F.col(key).cast("string").alias("stream_id"), F.col(seq).cast("long").alias("seq"),
                   event_time(ts).alias("event_time"))
           .withColumn("at", F.unix_micros("event_time")).withWatermark("event_time", delay))
    return src.groupBy("stream_id").transformWithStateInPandas(
        _LiveList(_micros(ttl), cap, limit),
        "stream_id string, as_of long, error_count long, recent string", "Append", "EventTime")


def latest_lists(told: DataFrame) -> DataFrame:
    """The live lists after the rows of ``live_lists_stream`` so far: one row per stream."""
    return (told.groupBy("stream_id").agg(F.max_by(F.struct("error_count", "recent"),
                                                   "as_of").alias("s"))
            .select("stream_id", "s.error_count", "s.recent"))


# ---- O31, O32

class _Leases(StatefulProcessor):
    """State: the channel's last lease with its number, times and calls (as an open lease)."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState(
            "held", "holder string, since long, until long, number long, calls long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, ["ts", "seq"])
        old = self.held.get() if self.held.exists() else None
        table = _with_state(pdf, "subreddit", key[0], {
            "instance_id": pa.string(), "seq": pa.int64(), "ts": pa.timestamp("us"),
            "action": pa.string()}, lease._NAMES, old and tuple(old)[:4])
        calls, states = lease._advance(self.ttl)(table, np.array([0]))
        out, state = self._leases(calls, old, states)
        self.held.update(state)
        if old and old[0] is not None and old[2] != state[2]:
            self.handle.deleteTimer(_timer(old[2]))
        if state[0] is not None:
            self.handle.registerTimer(_timer(state[2]))
        if out:
            yield self._rows(key[0], out)

    def _leases(self, calls: pa.Table, old, states: pa.Table):
        """Leases that the calls opened, kept or ended, and the state after them."""
        span = self.ttl * 1_000_000
        found: dict[int, SimpleNamespace] = {}
        if old and old[0] is not None:
            found[old[3]] = SimpleNamespace(who=old[0], since=old[1], until=old[2], calls=old[4],
                                            over=False)
        granted = calls.filter(calls.column("granted"))
        for no, who, what, at in zip(granted.column("lease_no").to_pylist(),
                                     granted.column("instance_id").to_pylist(),
                                     granted.column("action").to_pylist(),
                                     granted.column("ts").cast(pa.int64()).to_pylist()):
            one = found.setdefault(no, SimpleNamespace(who=who, since=at, until=0, calls=0, over=False))
            one.calls += 1
            one.over = what == lease.RELEASE
            one.until = at if one.over else at + span
        last = {c: states.column(c)[0].as_py() for c in lease._NAMES}
        number = last["stored_number"]
        calls_now = found[number].calls if number in found else 0
        return ([(no, x.who, x.since, x.until, x.calls, x.over or no < number)
                 for no, x in sorted(found.items())],
                (last["stored_holder"], last["stored_since"], last["stored_until"], number, calls_now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            who, since, until, number, calls = self.held.get()
            if who is not None and until <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.held.update((None, None, None, number, 0))
                yield self._rows(key[0], [(number, who, since, until, calls, True)])

    @staticmethod
    def _rows(channel: str, leases: list) -> pd.DataFrame:
        columns = list(zip(*leases))
        return pd.DataFrame({
            "subreddit": [channel] * len(leases), "lease_no": pd.array(columns[0], "int64"),
            "instance_id": list(columns[1]),
            "held_from": pd.to_datetime(pd.Series(columns[2], dtype="int64"), unit="us"),
            "held_until": pd.to_datetime(pd.Series(columns[3], dtype="int64"), unit="us"),
            "n_calls": pd.array(columns[4], "int64"), "ended": pd.array(columns[5], "bool")})

    def close(self) -> None:
        pass


def leases_stream(log: DataFrame, delay: str, ttl: int = lease.LEASE_TTL_SECONDS) -> DataFrame:
    """O31 on a streaming DataFrame of lock calls: for every micro-batch one row per lease that
    its calls opened, kept or ended (``subreddit``, ``lease_no``, ``instance_id``, ``held_from``,
    ``held_until``, ``n_calls``, ``ended``), and one with ``ended`` when the watermark (newest
    call less ``delay``) passes the end of a lease that no call ended. Calls that come more than
    ``delay`` late take no part, nor do calls without channel, instance or time."""
    use_keyed_state(log.sparkSession)
    src = (log.where("subreddit IS NOT NULL AND instance_id IS NOT NULL AND ts IS NOT NULL")
           .select("subreddit", "instance_id", F.col("seq").cast("long").alias("seq"), "ts", "action",
                   event_time("ts").alias("event_time")).withWatermark("event_time", delay))
    return src.groupBy("subreddit").transformWithStateInPandas(
        _Leases(ttl), "subreddit string, lease_no long, instance_id string, "
        "held_from timestamp_ntz, held_until timestamp_ntz, n_calls long, ended boolean",
        "Append", "EventTime")


def latest_leases(rows: DataFrame) -> DataFrame:
    """One row per lease, in its latest form, from the rows of ``leases_stream`` so far."""
    newest = F.struct("ended", "n_calls", "held_until")
    return (rows.groupBy("subreddit", "lease_no")
            .agg(F.max_by(F.struct("instance_id", "held_from", "held_until", "n_calls", "ended"),
                          newest).alias("s"))
            .select("subreddit", "lease_no", "s.*"))


def current_holders(rows: DataFrame, as_of) -> DataFrame:
    """O32 from the rows of ``leases_stream`` so far: who holds each channel at ``as_of``."""
    return latest_leases(rows).where((F.col("held_from") <= as_of) & (as_of < F.col("held_until")))


# ---- O24

class _Counter(StatefulProcessor):
    def __init__(self, every: int):
        self.every = every

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, ["arrival_ts", "comment_id"])
        seen = self.count.get()[0] if self.count.exists() else 0
        self.count.update((seen + len(pdf),))
        due = pdf.iloc[self.every - 1 - seen % self.every::self.every]
        if len(due):
            seq = seen + 1 + due.index.to_numpy()
            yield pd.DataFrame({"stream_id": [key[0]] * len(due), "seq": seq,
                                "updated_at": due["arrival_ts"].to_numpy(),
                                "last_comment_id": due["comment_id"].to_numpy()})

    def close(self) -> None:
        pass


def checkpoints_stream(messages: DataFrame, every: int) -> DataFrame:
    """O24 on a streaming DataFrame of messages (``stream_id``, ``comment_id``, ``arrival_ts``):
    every ``every``-th message of a stream, in the columns of the checkpoint log; ``seq`` is the
    stream's count of messages. The counts are keyed state: a micro-batch touches the streams it
    brings. Only ids and times go through the state operator, not the texts."""
    use_keyed_state(messages.sparkSession)
    rows = messages.where("stream_id IS NOT NULL AND arrival_ts IS NOT NULL").select(
        "stream_id", "comment_id", "arrival_ts")
    return rows.groupBy("stream_id").transformWithStateInPandas(
        _Counter(every), "stream_id string, seq long, updated_at timestamp_ntz, "
        "last_comment_id string", "Append", "None").select(
        "stream_id", "seq", "updated_at", "last_comment_id",
        iso_z(F.col("updated_at")).alias("last_processed_at"))
