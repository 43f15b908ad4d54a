"""Leases (O31, O32): an exclusive lock, its calls in order."""
import datetime as dt
import random

from rivulet.operators import lease
from rivulet.plans.fixtures import ntz

SCHEMA = "subreddit string, instance_id string, seq long, ts timestamp_ntz, action string"
T0 = dt.datetime(2024, 1, 1)


def s(x):
    return T0 + dt.timedelta(seconds=x)


def _log(spark, rows):
    return spark.createDataFrame([(c, i, n, s(t), a) for n, (c, i, t, a) in enumerate(rows)], SCHEMA)


def _outcomes(spark, rows):
    return [r.granted for r in lease.lease_calls(_log(spark, rows)).orderBy("seq").collect()]


def test_acquire_is_exclusive_and_refresh_needs_a_live_lease(spark):
    assert _outcomes(spark, [("p", "i1", 0, "acquire"), ("p", "i2", 10, "acquire"),
                             ("p", "i2", 20, "refresh"), ("p", "i1", 50, "refresh"),
                             ("p", "i1", 100, "acquire"),       # held, even by itself
                             ("p", "i1", 110, "refresh"),       # 60 s after 50: just expired
                             ("p", "i2", 110, "acquire"), ("p", "i1", 111, "release"),
                             ("p", "i2", 112, "release"), ("p", "i1", 112, "acquire")]) == [
        True, False, False, True, False, False, True, False, True, True]


def test_refresh_never_opens_a_lease(spark):
    assert _outcomes(spark, [("p", "i1", 0, "refresh"), ("p", "i1", 1, "release")]) == [False, False]


def test_intervals_conflicts_and_holders(spark):
    log = _log(spark, [("p", "i1", 0, "acquire"), ("p", "i2", 10, "refresh"), ("p", "i1", 30, "refresh"),
                       ("q", "i2", 20, "acquire"), ("q", "i2", 25, "release"), ("p", "i1", 95, "refresh"),
                       ("p", "i2", 200, "acquire")])
    calls = lease.lease_calls(log)
    got = sorted((r.subreddit, r.instance_id, r.held_from, r.held_until, r.n_calls)
                 for r in lease.lease_intervals(calls).collect())
    assert got == [("p", "i1", s(0), s(90), 2), ("p", "i2", s(200), s(260), 1), ("q", "i2", s(20), s(25), 2)]
    conf = [(r.instance_id, r.seq, r.holder_instance, r.held_until)
            for r in lease.lease_conflicts(calls).collect()]
    assert conf == [("i2", 1, "i1", s(60))]
    # At 00:00:20 the refresh at 30 s has not happened yet: the lease ends at 60 s.
    h = lease.holders(log, ntz("2024-01-01 00:00:20")).collect()
    assert sorted((r.subreddit, r.instance_id, r.held_until) for r in h) == [
        ("p", "i1", s(60)), ("q", "i2", s(80))]


def test_random_calls_equal_call_by_call(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for n in range(1500):
        t += rnd.choice([1, 10, 40, 70])
        rows.append((f"c{rnd.randint(0, 2)}", f"i{rnd.randint(0, 2)}", n, s(t),
                     rnd.choice(["acquire", "refresh", "refresh", "release"])))
    want, held = {}, {}
    for c, i, n, ts, a in rows:
        holder, until = held.get(c, (None, T0))
        live = holder is not None and ts < until
        want[n] = not live if a == "acquire" else live and holder == i
        if want[n]:
            held[c] = (i, ts if a == "release" else ts + dt.timedelta(seconds=60))
    calls = lease.lease_calls(spark.createDataFrame(rows, SCHEMA))
    assert {r.seq: r.granted for r in calls.collect()} == want
    iv = lease.lease_intervals(calls).collect()
    by = {}
    for r in sorted(iv, key=lambda r: r.held_from):
        if r.subreddit in by:
            assert by[r.subreddit] <= r.held_from     # one holder at a time
        by[r.subreddit] = r.held_until
    assert lease.lease_conflicts(calls).count() <= len(rows)


def call_by_call(rows, ttl):
    """(seq, granted, lease number, met holder, since, until) by the rules, one call at a time."""
    out, held = [], {}
    for c, i, n, ts, a in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        h = held.setdefault(c, {"who": None, "since": None, "until": T0, "no": 0})
        live = h["who"] is not None and ts < h["until"]
        met = (h["who"], h["since"], h["until"]) if live else (None, None, None)
        ok = not live if a == "acquire" else live and h["who"] == i and a in ("refresh", "release")
        if ok and a == "acquire":
            h.update(who=i, since=ts, no=h["no"] + 1)
        if ok:
            h["until"] = ts if a == "release" else ts + dt.timedelta(seconds=ttl)
        out.append((n, ok, h["no"] if ok else None, *met))
    return sorted(out)


def test_hot_channel_in_segments_equals_call_by_call(spark):
    cases = [(60, (0, 1, 5), 3, ["acquire", "refresh", "refresh", "release"]),
             (60, (0, 0, 1), 6, ["acquire"] * 3 + ["refresh", "other"]),
             (10, (1, 4, 30), 2, ["acquire", "refresh", "release"]),
             (3600, (1, 10), 4, ["acquire", "refresh", "refresh"]),
             (5, (0, 1), 200, ["acquire", "refresh", "release"])]
    for seed, (ttl, step, who, what) in enumerate(cases):
        rnd = random.Random(seed)
        rows, t = [], 0
        for n in range(900):
            t += rnd.choice(step)
            rows.append((rnd.choice(["hot"] * 6 + ["c1", f"x{n}"]), f"i{rnd.randrange(who)}", n, s(t),
                         rnd.choice(what)))
        log = spark.createDataFrame(rows, SCHEMA).cache()
        want = call_by_call(rows, ttl)
        for parts in (4, 9, 60):
            calls = lease.lease_calls(log, ttl, parts=parts)
            got = sorted((r.seq, r.granted, r.lease_no, r.holder_instance, r.held_since, r.held_until)
                         for r in calls.collect())
            assert got == want, (seed, parts)
        log.unpersist()


def test_leases_over_small_batches(spark):
    rnd = random.Random(12)
    rows = [("c", f"i{rnd.randrange(3)}", n, s(n * rnd.choice([1, 1, 2])),
             rnd.choice(["acquire", "refresh", "release"])) for n in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        calls = lease.lease_calls(spark.createDataFrame(rows, SCHEMA), 5, parts=3)
        got = sorted((r.seq, r.granted, r.lease_no, r.holder_instance, r.held_since, r.held_until)
                     for r in calls.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == call_by_call(rows, 5)
