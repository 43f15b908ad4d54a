"""Call-outcome analytics: failure streaks (O29) and the circuit-breaker timeline."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.functions.expr import BACKOFF_SECONDS, DEFAULT_BACKOFF_SECONDS, suggested_backoff
from rivulet.functions.scan import keyed_scan
from rivulet.functions.segments import array_of, segmented_pass

# Breaker defaults.
FAILURE_THRESHOLD = 5
RECOVERY_TIMEOUT = 60
SUCCESS_THRESHOLD = 2
BACKOFF_MULTIPLIER = 2.0
MAX_BACKOFF = 3600

CLOSED, OPEN, HALF_OPEN = MODES = "closed", "open", "half_open"
SUGGESTED = sorted({DEFAULT_BACKOFF_SECONDS, *BACKOFF_SECONDS.values()})
TABLE_NODES = 4_000_000  # calls x backoffs that the transition table of a segment is made of


def failure_streaks(attempts: DataFrame, threshold: int = FAILURE_THRESHOLD,
                    key: str = "stream_id", ts: str = "ts", seq: str = "attempt_id",
                    unit: str = "HOUR") -> DataFrame:
    """Maximal runs of failed attempts per stream (a success resets the count).
    One row per streak: first/last attempt and time, length, and the attempt whose failure
    reached ``threshold`` (null when the streak is shorter)."""
    ok = F.col("error_type").isNull()
    scanned = keyed_scan(attempts, [key], ts, [seq], unit=unit,
                         sums={"streak_no": ok.cast("long")},
                         last_where={"last_ok_rn": ok})
    fails = scanned.where(F.col("error_type").isNotNull()).withColumn(
        "pos", F.col("rn") - F.coalesce(F.col("last_ok_rn"), F.lit(0)))
    order = F.struct(F.col(ts), F.col(seq))
    return (fails.groupBy(key, "streak_no")
            .agg(F.min_by(seq, order).alias("first_attempt_id"),
                 F.max_by(seq, order).alias("last_attempt_id"),
                 F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                 F.count(F.lit(1)).alias("n_failures"),
                 F.max(F.when(F.col("pos") == threshold, F.col(seq))).alias("threshold_attempt_id"))
            .withColumn("reached_threshold", F.col("n_failures") >= threshold))


# Breaker state between two rows of a stream; ``opened`` is the time (epoch microseconds) of
# the failure that opened it.
STATE_FIELDS = ("state string, failure_count long, successes long, backoff_seconds long, "
                "opened long")
# The same in front of a stream's rows.
_STORED = ("stored_state string, stored_failures long, stored_good long, stored_backoff long, "
           "stored_opened long")
_NAMES = [c.split()[0] for c in _STORED.split(", ")]
_TABLE = "piece long, entry string, a long, b long, until long, added boolean, " + _STORED


class Rule:
    """The breaker's parameters and what follows from them alone."""

    def __init__(self, threshold, recovery, successes, mult, cap):
        self.threshold, self.recovery, self.successes = threshold, recovery, successes
        self.mult, self.cap = mult, cap

    def longer(self, backoff: int, suggested: int) -> int:
        return int(min(max(backoff * self.mult, suggested), self.cap))

    def backoffs(self, seeds=()) -> list[int]:
        """Every backoff that can be reached; whole seconds, so ``cap`` bounds them."""
        todo, seen = {self.recovery, *seeds}, set()
        while todo:
            seen |= todo
            todo = {self.longer(b, s) for b in todo for s in SUGGESTED} - seen
        return sorted(seen)


class Calls:
    """Calls of one or more runs, in order, with what every stay in a state is looked up from.
    ``begin``/``end`` delimit the runs' calls; rows between are state rows."""

    def __init__(self, table: pa.Table, begin: np.ndarray, end: np.ndarray, rule: Rule):
        n = len(table)
        self.t = array_of(table, "ts", 0)
        self.failed = array_of(table, "failed", False).astype(bool)
        self.suggested = array_of(table, "suggested", 0).astype(np.int64)
        at = np.arange(n)
        base = np.full(n, -1)
        for_run = np.repeat(np.arange(len(begin)), end - begin)
        inside = np.concatenate([np.arange(0)] + [at[a:b] for a, b in zip(begin, end)])
        base[inside] = begin[for_run] - 1
        good = np.maximum(np.maximum.accumulate(np.where(self.failed, -1, at)) if n else at, base)
        # Length of the run of failures that ends at each call, within its run of calls.
        self.run = np.where(self.failed, at - good, 0)
        self.next_failure = np.append(np.minimum.accumulate(
            np.where(self.failed, at, n)[::-1])[::-1] if n else at, n)
        self.trips = np.flatnonzero(self.run == rule.threshold)

    def next_trip(self, at):
        """First call at or after ``at`` that is the threshold's failure in a row."""
        k = np.searchsorted(self.trips, at)
        return np.append(self.trips, len(self.t))[k]


def _advance(rule: Rule):
    def advance(table: pa.Table, starts: np.ndarray):
        n = len(table)
        state_row = table.column("stored_state").combine_chunks().is_valid().to_numpy(
            zero_copy_only=False)
        begin = starts + state_row[starts]
        end = np.append(starts[1:], n)
        calls = Calls(table, begin, end, rule)
        first = table.take(pa.array(starts)).select(_NAMES)
        first = first.to_pydict()
        t, failed, suggested = calls.t.tolist(), calls.failed, calls.suggested.tolist()
        next_failure, trips = calls.next_failure.tolist(), calls.trips.tolist()
        failures = np.where(failed, calls.run, 0)
        stays, points, after = [], [], []  # (from, to, mode, failures, backoff), (call, ...)
        for g, (i, e) in enumerate(zip(begin.tolist(), end.tolist())):
            mode, fails, good, backoff, opened = (
                (first["stored_state"][g], first["stored_failures"][g], first["stored_good"][g],
                 first["stored_backoff"][g], first["stored_opened"][g])
                if state_row[starts[g]] else (CLOSED, 0, 0, rule.recovery, None))
            while i < e:  # one turn per stay in a state, not per call
                if mode == CLOSED:
                    k = bisect.bisect_left(trips, i)
                    j = trips[k] if k < len(trips) else n
                    if fails:  # goes on from failures before this run of calls
                        stop = i + _leading(calls.run, i, min(e, i + rule.threshold))
                        if i + rule.threshold - fails - 1 < stop:
                            j = i + rule.threshold - fails - 1
                        failures[i:min(stop, j)] += fails
                    j = min(j, e)
                    stays.append((i, j, CLOSED, -1, backoff))
                    if j < e:
                        backoff = rule.longer(backoff, suggested[j])
                        mode, fails, opened = OPEN, rule.threshold, t[j]
                        points.append((j, OPEN, fails, backoff))
                    else:
                        fails = int(failures[e - 1])
                    i = j + 1
                elif mode == OPEN:
                    j = bisect.bisect_left(t, opened + backoff * 1_000_000, i, e)
                    stays.append((i, j, OPEN, fails, backoff))
                    if j < e:
                        mode, good = HALF_OPEN, 0
                    i = j
                else:  # trial calls: enough successes in a row close, one failure opens again
                    f = next_failure[i]
                    j = min(i + rule.successes - good, f, e)
                    good += j - i
                    fails = 0 if j > i else fails
                    if good >= rule.successes:
                        stays.append((i, j - 1, HALF_OPEN, 0, backoff))
                        mode, fails, backoff = CLOSED, 0, rule.recovery
                        points.append((j - 1, CLOSED, 0, backoff))
                    else:
                        stays.append((i, j, HALF_OPEN, 0, backoff))
                        if j < e:
                            backoff = rule.longer(backoff, suggested[j])
                            mode, fails, good, opened = OPEN, fails + 1, 0, t[j]
                            points.append((j, OPEN, fails, backoff))
                            j += 1
                    i = j
            after.append((mode, fails, good, backoff, opened))
        modes = np.zeros(n, dtype=np.int8)
        backoffs, admitted = np.zeros(n, np.int64), np.ones(n, dtype=bool)
        for a, b, mode, fails, backoff in stays:
            modes[a:b], backoffs[a:b] = MODES.index(mode), backoff
            if fails >= 0:
                failures[a:b] = fails
            if mode == OPEN:
                admitted[a:b] = False
        for j, mode, fails, backoff in points:
            modes[j], failures[j], backoffs[j] = MODES.index(mode), fails, backoff
        keep = pa.array(~state_row)
        rows = pa.table({
            "stream_id": table.column("stream_id"), "attempt_id": table.column("attempt_id"),
            "state": pa.DictionaryArray.from_arrays(pa.array(modes), pa.array(MODES)).cast("string"),
            "admitted": pa.array(admitted), "failure_count": pa.array(failures.astype(np.int64)),
            "successes": pa.array(np.zeros(n, np.int64)), "backoff_seconds": pa.array(backoffs),
            "opened": pa.nulls(n, pa.int64())}).filter(keep)
        return rows, _state_rows(table, starts, after)

    return advance


def _leading(run: np.ndarray, i: int, stop: int) -> int:
    """How many calls from ``i`` on are failures in a row, up to ``stop``."""
    other = np.flatnonzero(run[i:stop] != np.arange(1, stop - i + 1))
    return int(other[0]) if len(other) else stop - i


def _state_rows(table: pa.Table, starts: np.ndarray, after: list) -> pa.Table:
    """State rows of the runs that begin at ``starts``, in the schema of ``table``."""
    own = table.select(["stream_id", "_seg", "_segs"]).take(pa.array(starts))
    columns = {**{c: own.column(c) for c in own.column_names},
               **{c: pa.array([s[i] for s in after], table.schema.field(c).type)
                  for i, c in enumerate(_NAMES)}}
    return pa.table([columns.get(f.name, pa.nulls(len(starts), f.type)) for f in table.schema],
                    schema=table.schema)


def _close(states: pa.Table) -> pa.Table:
    n = len(states)
    return pa.table({
        "stream_id": states.column("stream_id"),
        "attempt_id": pa.nulls(n, states.schema.field("attempt_id").type),
        "state": states.column("stored_state"), "admitted": pa.nulls(n, pa.bool_()),
        "failure_count": states.column("stored_failures"),
        "successes": states.column("stored_good"),
        "backoff_seconds": states.column("stored_backoff"),
        "opened": states.column("stored_opened")})


def _table(rule: Rule, backoffs: list[int], kinds: pa.Schema):
    """Transition table of one segment: to what state each possible state in front of it leads.

    A node is (call, backoff): the call is the first one after a backoff is over. What follows
    is a trial; it closes (then the next trip opens again) or fails (opens again): either way
    the next node, or a state that lasts to the segment's end. Doubling the steps gives every
    node's last state. An open state enters at the first call its backoff lets through, so its
    results are runs of calls, told apart by their last call's time."""
    longer = np.array([[backoffs.index(rule.longer(b, s)) for s in SUGGESTED] for b in backoffs])
    reset = np.array([backoffs.index(rule.longer(rule.recovery, s)) for s in SUGGESTED])
    seconds = np.array(backoffs, dtype=np.int64)

    def table(rows: pa.Table, name: tuple) -> pa.Table:
        n, width, need = len(rows), len(backoffs), rule.successes
        calls = Calls(rows, np.array([0]), np.array([n]), rule)
        t, kind = calls.t, np.searchsorted(SUGGESTED, calls.suggested)
        at = np.arange(n)
        # Where an open state of each call and backoff lets the next call through.
        through = np.stack([np.searchsorted(t, t + b * 1_000_000) for b in backoffs], axis=1)
        f = calls.next_failure[:n]
        closes = np.minimum(f, n) - at >= need
        trip = calls.next_trip(np.minimum(at + need, n))
        ends = ~closes & (f >= n)                   # the segment ends within the trial
        opens_at = np.where(closes, trip, f)        # the call that opens again, n if none
        again = opens_at < n
        j = np.minimum(opens_at, n - 1)
        b_next = np.where(closes[:, None], reset[kind[j]][:, None], longer[:, kind[j]].T)
        enter = through[j[:, None], b_next]
        # Nodes by number; last states after them: open at call j with backoff b (n * width of
        # them), closed, and trials of some successes.
        nodes = n * width
        last_open = nodes + j[:, None] * width + b_next
        step = np.where(enter < n, enter * width + b_next, last_open)
        closed_end, trial_end = 2 * nodes, 2 * nodes + 1
        trial = trial_end + (n - at)[:, None] * width + np.arange(width)
        step = np.where(again[:, None], step, np.where(ends[:, None], trial, closed_end))
        step = np.concatenate([step.ravel(), np.arange(nodes, trial_end + need * width)])
        # Failures: a failed first trial call adds one to those before, all else sets them.
        adds = np.repeat(~closes & again & (f == at), width)
        adds = np.concatenate([adds, np.ones(len(step) - nodes, dtype=bool)])
        fails = np.concatenate([
            np.repeat(np.where(closes & again, rule.threshold, np.where(again, 1, 0)), width),
            np.zeros(len(step) - nodes, dtype=np.int64)])
        while True:
            further = step[step]
            if (further == step).all():
                break
            fails = np.where(adds[step], fails + fails[step], fails[step])
            adds &= adds[step]
            step = further
        tail = int(calls.run[n - 1])  # failures in a row at the end of a closed segment

        out = {c: [] for c in ("entry", "a", "b", "until", "added", *_NAMES)}

        def add(way, last, fails, added):
            """``way``: entry, a, b, until; ``last``: number of the last state."""
            if last > closed_end:
                good, k = divmod(int(last) - trial_end, width)
                state = (HALF_OPEN, int(fails), good, backoffs[k], None)
            elif last == closed_end:
                state = (CLOSED, int(fails), 0, rule.recovery, None)
            else:
                call, k = divmod(int(last) - nodes, width)
                state = (OPEN, int(fails), 0, backoffs[k], int(t[call]))
            for c, v in zip(out, (*way, bool(added), *state)):
                out[c].append(v)

        def opened(way, call, k, count, added=False):
            """From an open state that began at ``call`` with backoff number ``k``."""
            x = through[call, k] * width + k
            if through[call, k] >= n:
                add(way, nodes + call * width + k, count, added)
            else:
                passed(way, x, count, added)

        def passed(way, x, count, added):
            """From node ``x``, entered with so many failures."""
            more, last = int(fails[x]), step[x]
            if last == closed_end:
                add(way, last, tail, False)
            else:
                add(way, last, count + more if adds[x] else more, added and adds[x])

        def closed(way, start, have=0):
            """From the closed state at call ``start``, after ``have`` failures in a row."""
            lead = _leading(calls.run, 0, n) if have else 0
            x = rule.threshold - have - 1
            x = x if x < lead else int(calls.next_trip(start))
            if x < n:
                opened(way, x, int(reset[kind[x]]), rule.threshold)
            else:
                add(way, closed_end, tail + (have if have and lead == n else 0), False)

        for have in range(rule.threshold):
            closed(("closed", have, None, None), 0, have)
        failure = int(calls.next_failure[0])
        for good in range(need):  # a trial under way, after so many successes
            for k, b in enumerate(backoffs):
                way = ("half", good, b, None)
                if min(failure, n) >= need - good:
                    closed(way, need - good)
                elif failure >= n:
                    add(way, trial_end + (good + n) * width + k, 0, False)
                else:
                    opened(way, failure, int(longer[k, kind[failure]]), 1, failure == 0)
        # Open: runs of calls with the same result, for each backoff. The longest backoff ends by
        # the cap after the first call; the next call may come later than that.
        final = min(int(np.searchsorted(t, t[0] + rule.cap * 1_000_000)), n - 1)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]) & (t <= t[final]))
        for k, b in enumerate(backoffs):
            x = first * width + k
            new = np.append(True, (np.diff(step[x]) != 0) | (np.diff(fails[x]) != 0)
                            | (adds[x][1:] != adds[x][:-1]))
            run = np.flatnonzero(new)
            for a, z in zip(run, np.append(run[1:], len(x))):
                passed(("open", None, b, int(t[first[z - 1]])), x[a], 0, True)
        rows_out = len(out["entry"])
        columns = {"stream_id": pa.array([name[0]] * rows_out, kinds.field("stream_id").type),
                   "_seg": pa.array([name[1]] * rows_out, pa.int32()),
                   "piece": pa.array(range(rows_out), pa.int64())}
        types = {"entry": pa.string(), "added": pa.bool_(), "stored_state": pa.string()}
        columns.update({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})
        return pa.table(columns)

    return table


def _lookup(rule: Rule):
    def lookup(state: dict | None, table: pd.DataFrame) -> dict:
        s = state or dict(zip(_NAMES, (CLOSED, 0, 0, rule.recovery, None)))
        if s["stored_state"] == CLOSED:
            row = table[(table["entry"] == "closed") & (table["a"] == s["stored_failures"])]
        elif s["stored_state"] == HALF_OPEN:
            row = table[(table["entry"] == "half") & (table["a"] == s["stored_good"])
                        & (table["b"] == s["stored_backoff"])]
        else:
            over = s["stored_opened"] + s["stored_backoff"] * 1_000_000
            row = table[(table["entry"] == "open") & (table["b"] == s["stored_backoff"])]
            row = row[row["until"].astype("int64") >= over]
            if not len(row):  # no call of the segment came after the backoff
                return s
        row = row.iloc[0]
        out = {c: row[c] for c in _NAMES}
        if row["added"]:
            out["stored_failures"] += s["stored_failures"]
        return out

    return lookup


def circuit_run(attempts: DataFrame, stored: DataFrame | None = None,
                threshold: int = FAILURE_THRESHOLD, recovery: int = RECOVERY_TIMEOUT,
                successes: int = SUCCESS_THRESHOLD, mult: float = BACKOFF_MULTIPLIER,
                cap: int = MAX_BACKOFF, parts: int | None = None) -> DataFrame:
    """O30 with states: one row per attempt (``attempt_id`` set), and one per stream
    (``attempt_id`` null, ``admitted`` null) with the state after its last attempt. ``stored``
    holds such state rows from an earlier run; streams without new attempts pass through.

    A stream's calls are cut into segments by its share of all calls, which run beside each
    other (``functions.segments``); ``parts`` is how many segments the whole input makes. Ids
    keep their type. Attempts without a stream, id or time take no part."""
    rule = Rule(threshold, recovery, successes, mult, cap)
    kinds = {c: attempts.schema[c].dataType.simpleString() for c in ("stream_id", "attempt_id")}
    src = (attempts.where("stream_id IS NOT NULL AND attempt_id IS NOT NULL AND ts IS NOT NULL")
           .select("stream_id", "attempt_id", "ts", F.col("error_type").isNotNull().alias("failed"),
                   suggested_backoff("error_type").cast("long").alias("suggested")))
    seeds = []
    if stored is not None:
        stored = stored.select(
            "stream_id", F.col("state").alias("stored_state"),
            F.col("failure_count").alias("stored_failures"), F.col("successes").alias("stored_good"),
            F.col("backoff_seconds").alias("stored_backoff"), F.col("opened").alias("stored_opened"))
        seeds = [r[0] for r in stored.select("stored_backoff").distinct().collect()]  # <= cap
    backoffs = rule.backoffs(seeds)
    schema = (f"stream_id {kinds['stream_id']}, attempt_id {kinds['attempt_id']}, state string, "
              "admitted boolean, failure_count long, successes long, backoff_seconds long, opened long")
    return segmented_pass(
        src, "stream_id", ["ts", "attempt_id"], schema=schema, advance=_advance(rule),
        state_schema=_STORED, table_schema=_TABLE,
        table=_table(rule, backoffs, to_arrow_schema(src.schema)), lookup=_lookup(rule),
        stored=stored, close=_close, parts=parts,
        segment_rows=max(1000, TABLE_NODES // len(backoffs)))


TIMELINE = ["stream_id", "attempt_id", "state", "admitted", "failure_count", "backoff_seconds"]


def circuit_timeline(attempts: DataFrame, **params) -> DataFrame:
    """Breaker state after every attempt of every stream. An attempt while open and
    inside the backoff is not admitted and changes nothing; the first opening already
    multiplies the backoff (floor: the error's suggested backoff; cap ``cap``)."""
    return circuit_run(attempts, **params).where(F.col("attempt_id").isNotNull()).select(*TIMELINE)
