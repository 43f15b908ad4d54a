"""Leases from a log of lock calls: outcomes and held intervals (O31), conflicts and holders
(O32). A lease is exclusive: a channel has at most one holder at any time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.functions.segments import array_of, first_at, segmented_pass

# Lease time-to-live, call names.
LEASE_TTL_SECONDS = 60
ACQUIRE, REFRESH, RELEASE = "acquire", "refresh", "release"
NEVER = -(1 << 60)  # until when a lease lives that there is not
_COLUMNS = ["subreddit", "instance_id", "seq", "ts", "action"]


# Lease state between two calls of a channel, times in epoch microseconds.
_STORED = "stored_holder string, stored_since long, stored_until long, stored_number long"
_NAMES = [c.split()[0] for c in _STORED.split(", ")]
_TABLE = "piece long, instance string, until long, kept boolean, " + _STORED


class Calls:
    """Calls of one or more runs of a channel, in order, and what each would lead to.

    A row that holds the lease (an acquire if it is granted, a refresh by the holder) goes on
    through the refreshes of the same instance, each less than the time to live after the one
    before, until a release or a gap; ``over`` tells when and ``release`` by which row (-1: it
    ran out). ``then`` is the next acquire that is granted after that, the run's end if none.
    A state row counts as the acquire that put the state there."""

    def __init__(self, table: pa.Table, starts: np.ndarray, span: int):
        n = len(table)
        self.end = np.append(starts[1:], n)
        self.group = np.repeat(np.arange(len(starts)), self.end - starts)
        self.stop = self.end[self.group] if n else np.zeros(0, dtype=np.int64)
        stored = table.column("stored_number").combine_chunks().is_valid().to_numpy(
            zero_copy_only=False)
        self.stored = stored
        held = array_of(table, "stored_until", NEVER)
        own = array_of(table, "ts", 0)
        self.t = np.where(stored, held - span, own)
        who = pc.if_else(pa.array(stored), table.column("stored_holder").combine_chunks(),
                         table.column("instance_id").combine_chunks()).dictionary_encode()
        self.names, self.who = who.dictionary, pc.fill_null(who.indices, -1).to_numpy()
        what = table.column("action").combine_chunks()
        self.acquire, self.refresh, self.released = (
            pc.fill_null(pc.equal(what, a), False).to_numpy(zero_copy_only=False)
            for a in (ACQUIRE, REFRESH, RELEASE))
        self.span = span

        # The next refresh or release of the same instance after each row.
        by = np.lexsort((np.arange(n), self.who, self.group))
        ender = self.refresh[by] | self.released[by]
        place = np.where(ender, np.arange(n), n)
        following = np.append(np.minimum.accumulate(place[::-1])[::-1][1:], n) if n else place
        own_next = np.append(by, n)[np.minimum(following, n)]
        nxt = np.full(n, n)
        nxt[by] = own_next
        j = np.minimum(nxt, n - 1)
        alike = (nxt < n) & (self.group[j] == self.group) & (self.who[j] == self.who) \
            & (self.t[j] < self.t + span)
        go_on = alike & self.refresh[j]
        # The last row of the chain that each row begins: the chains lie one behind the other
        # in the order of (run, instance, row) if acquires are left out.
        chain = by[self.refresh[by]]
        last = np.arange(n)
        if len(chain):
            ends = np.flatnonzero(~go_on[chain])
            last[chain] = chain[ends[np.searchsorted(ends, np.arange(len(chain)))]]
        self.last = np.where(self.refresh, last, np.where(go_on, last[j], np.arange(n)))
        k = self.last
        by_release = alike[k] & self.released[j[k]] if n else alike
        self.release = np.where(by_release, j[k], -1) if n else nxt
        self.over = np.where(by_release, self.t[j[k]], self.t[k] + span) if n else self.t
        self.acquires = np.flatnonzero(self.acquire)
        self.then = self.next_acquire(np.where(by_release, self.release + 1,
                                               first_at(self.t, np.arange(n) + 1, self.stop,
                                                        self.over)), self.stop)

    def next_acquire(self, at, stop):
        """First acquire from row ``at`` on, ``stop`` if there is none before it."""
        k = np.searchsorted(self.acquires, at)
        return np.minimum(np.append(self.acquires, len(self.t))[k], stop)


def _entries(calls: Calls, starts: np.ndarray) -> np.ndarray:
    """Each run's first row that holds the lease: its state row or its first granted acquire."""
    begins = calls.stored[starts] & (calls.who[starts] >= 0)
    free = calls.next_acquire(starts + calls.stored[starts], calls.end)
    return np.where(begins, starts, free)


def _advance(ttl: int):
    span = ttl * 1_000_000

    def advance(table: pa.Table, starts: np.ndarray):
        n = len(table)
        calls = Calls(table, starts, span)
        holds = np.zeros(n, dtype=bool)  # rows that open a lease
        at = _entries(calls, starts)
        at = at[at < calls.end]
        while len(at):
            holds[at] = True
            onward = calls.then[at]
            at = onward[onward < calls.stop[at]]
        rows = np.arange(n)
        lease = np.maximum.accumulate(np.where(holds, rows, -1))
        begin = starts[calls.group]
        known = lease >= begin
        i = np.maximum(lease, 0)
        live = known & (lease < rows) & np.where(
            calls.release[i] >= 0, rows <= calls.release[i], calls.t < calls.over[i])
        mine = live & (calls.who == calls.who[i])
        granted = holds | (mine & (calls.refresh | calls.released))
        touched = np.maximum.accumulate(np.where(holds | (mine & calls.refresh), rows, -1))
        before = np.append(-1, touched[:-1])  # the row that let the lease live, before each row
        number = table.column("stored_number").combine_chunks().take(pa.array(starts))
        number = pc.fill_null(number, 0).to_numpy()[calls.group]
        opened = np.cumsum(holds & ~calls.stored)
        opened = number + opened - (opened - (holds & ~calls.stored))[begin]
        since = np.where(calls.stored, array_of(table, "stored_since", 0), calls.t)

        def shown(values, where, kind):
            return pa.array(values, kind, mask=~where)

        stamp = pa.timestamp("us")
        columns = {c: table.column(c) for c in _COLUMNS}
        columns.update(
            granted=pa.array(granted), lease_no=shown(opened, granted, pa.int64()),
            holder_instance=calls.names.take(pa.array(
                np.where(live, calls.who[i], 0), mask=~live)).cast("string")
            if len(calls.names) else pa.nulls(n, pa.string()),
            held_since=shown(since[i], live, pa.int64()).cast(stamp),
            held_until=shown(calls.t[np.maximum(before, 0)] + span, live, pa.int64()).cast(stamp))
        return (pa.table(columns).filter(pa.array(~calls.stored)),
                _states(table, calls, starts, lease, since, opened))

    return advance


def _states(table, calls, starts, lease, since, opened) -> pa.Table:
    """State rows after the runs' last rows, in the schema of ``table``."""
    z = calls.end - 1
    i = np.maximum(lease[z], 0)
    held = (lease[z] >= starts) & (calls.release[i] < 0)
    own = table.select(["subreddit", "_seg", "_segs"]).take(pa.array(starts))
    columns = {c: own.column(c) for c in own.column_names}
    columns["stored_holder"] = calls.names.take(pa.array(
        np.where(held, calls.who[i], 0), mask=~held)).cast("string") \
        if len(calls.names) else pa.nulls(len(starts), pa.string())
    columns["stored_since"] = pa.array(since[i], pa.int64(), mask=~held)
    columns["stored_until"] = pa.array(calls.over[i], pa.int64(), mask=~held)
    columns["stored_number"] = pa.array(opened[z], pa.int64())
    return pa.table([columns.get(f.name, pa.nulls(len(starts), f.type)) for f in table.schema],
                    schema=table.schema)


def _table(ttl: int, kinds: pa.Schema):
    """Transition table of one segment. A state in front of it is no lease, or one of an
    instance until some time. That time decides which acquire is granted first (runs of
    acquires with the same result, told apart by their last one's time), unless the instance
    calls before: then the result is that instance's row of its own."""
    span = ttl * 1_000_000

    def table(rows: pa.Table, name: tuple) -> pa.Table:
        n = len(rows)
        no_state = [pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
        for c, values in zip(_NAMES, no_state):
            rows = rows.append_column(c, values)
        calls = Calls(rows, np.array([0]), span)
        # The last lease after each acquire that is granted, and how many follow it.
        final = np.append(np.arange(n), n)
        more = np.append(np.zeros(n, dtype=np.int64), 0)
        step = np.append(np.where(calls.then < n, calls.then, np.arange(n)), n)
        count = np.append((calls.then < n).astype(np.int64), 0)
        while (step[step] != step).any():
            count = count + count[step]
            step = step[step]
        final, more = step, count
        out = {c: [] for c in ("instance", "until", "kept", *_NAMES)}

        def add(instance, until, row, leases, kept=False):
            """The state that the lease of ``row`` leaves; ``kept``: it began before."""
            held = calls.release[row] < 0
            for c, v in zip(out, (instance, until, kept and held,
                                  calls.names[int(calls.who[row])].as_py() if held else None,
                                  int(calls.t[row]) if held and not kept else None,
                                  int(calls.over[row]) if held else None, leases)):
                out[c].append(v)

        # Without a lease, or with one that runs out: by the first acquire from then on.
        first = calls.acquires[calls.t[calls.acquires] <= calls.t[0] + span]
        if len(calls.acquires) > len(first):  # the next one, for a lease that outlasts these
            first = calls.acquires[:len(first) + 1]
        same = (np.diff(final[first]) == 0) & (np.diff(more[first]) == 0)
        run = np.flatnonzero(np.append(True, ~same))[:len(first)]
        for a, z in zip(run, np.append(run[1:], len(first))):
            add(None, int(calls.t[first[z - 1]]), final[first[a]], int(more[first[a]]) + 1)
        # With a lease of an instance that calls before it runs out.
        own = np.flatnonzero((calls.refresh | calls.released) & (calls.t < calls.t[0] + span))
        _, at = np.unique(calls.who[own], return_index=True)
        for row in own[at].tolist():
            who = calls.names[int(calls.who[row])].as_py()
            onward = int(calls.then[row] if calls.refresh[row]
                         else calls.next_acquire(row + 1, n))
            if onward < n:
                add(who, int(calls.t[row]), final[onward], int(more[onward]) + 1)
            elif calls.refresh[row]:
                add(who, int(calls.t[row]), row, 0, kept=True)
            else:
                for c, v in zip(out, (who, int(calls.t[row]), False, None, None, None, 0)):
                    out[c].append(v)
        m = len(out["until"])
        types = {"instance": pa.string(), "kept": pa.bool_(), "stored_holder": pa.string()}
        return pa.table({
            "subreddit": pa.array([name[0]] * m, kinds.field("subreddit").type),
            "_seg": pa.array([name[1]] * m, pa.int32()), "piece": pa.array(range(m), pa.int64()),
            **{c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()}})

    return table


def _lookup(state: dict | None, table: pd.DataFrame) -> dict:
    s = state or dict.fromkeys(_NAMES) | {"stored_number": 0}
    free = table["instance"].isna()
    row = table[free]
    if s["stored_holder"] is not None and not pd.isna(s["stored_holder"]):
        own = table[~free & (table["instance"] == s["stored_holder"])]
        if len(own) and own["until"].iat[0] < s["stored_until"]:
            row = own
        else:
            row = row[row["until"].astype("int64") >= s["stored_until"]]
    if not len(row):
        return s
    row = row.iloc[0]
    out = {c: row[c] for c in _NAMES}
    out["stored_number"] += s["stored_number"]
    if row["kept"]:
        out["stored_since"] = s["stored_since"]
    return out


def lease_calls(log: DataFrame, ttl: int = LEASE_TTL_SECONDS, parts: int | None = None,
                after: str | None = None) -> DataFrame:
    """Outcome of every call, in (ts, seq) order of its channel (calls of the action ``after``
    come last at their time). Adds ``granted``, ``lease_no``
    (the lease that the call opened, kept or ended; null if denied), ``holder_instance``,
    ``held_since`` and ``held_until`` (the live lease that the call met, null if none).

    An acquire is granted if no lease is live, even to its last holder; it lives ``ttl``
    seconds. A refresh is granted to the holder of the live lease and lets it live ``ttl``
    seconds from then; a release by that holder ends it. All other calls are denied and change
    nothing. Calls without channel, instance or time take no part. Which calls are granted
    depends on the calls before; a channel's calls are cut into segments by its share of all
    calls, which run beside each other (``functions.segments``)."""
    src = log.where("subreddit IS NOT NULL AND instance_id IS NOT NULL AND ts IS NOT NULL"
                    ).select(*_COLUMNS, (F.col("action").eqNullSafe(F.lit(after)) if after
                                         else F.lit(False)).alias("last"))
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in _COLUMNS)
    return segmented_pass(
        src, "subreddit", ["ts", "last", "seq"], schema=f"{kinds}, granted boolean, lease_no long, "
        "holder_instance string, held_since timestamp_ntz, held_until timestamp_ntz",
        advance=_advance(ttl), state_schema=_STORED, table_schema=_TABLE,
        table=_table(ttl, to_arrow_schema(src.schema)), lookup=_lookup, parts=parts)


def lease_intervals(calls: DataFrame, ttl: int = LEASE_TTL_SECONDS) -> DataFrame:
    """One row per lease, from the outcomes of ``lease_calls``: [held_from, held_until),
    ended by its release or ``ttl`` seconds after its last granted acquire or refresh."""
    last = F.max(F.when(F.col("action") != RELEASE, F.col("ts")))
    ended = F.max(F.when(F.col("action") == RELEASE, F.col("ts")))
    return (calls.where("granted").groupBy("subreddit", "lease_no")
            .agg(F.max(F.when(F.col("action") == ACQUIRE, F.col("instance_id"))).alias("instance_id"),
                 F.min("ts").alias("held_from"),
                 F.least(last + F.expr(f"INTERVAL {ttl} SECONDS"), ended).alias("held_until"),
                 F.count(F.lit(1)).alias("n_calls")))


def lease_conflicts(calls: DataFrame) -> DataFrame:
    """Calls that met a live lease of another instance; at most one row per call."""
    return calls.where(F.col("holder_instance") != F.col("instance_id")).select(
        "subreddit", "instance_id", "seq", "ts", "action", "holder_instance", "held_since",
        "held_until")


def holders(log: DataFrame, as_of: Column, ttl: int = LEASE_TTL_SECONDS) -> DataFrame:
    """Who holds each channel's lease at ``as_of`` (no row = free), at most one row per
    channel. Calls after ``as_of`` are not read: the filter reaches the scan."""
    past = lease_intervals(lease_calls(log.where(F.col("ts") <= as_of), ttl), ttl)
    return past.where((F.col("held_from") <= as_of) & (as_of < F.col("held_until")))
