"""Counts and holders at many instants (O21, O32) against the one-instant forms."""
import datetime as dt
import random

from pyspark.sql import functions as F

from rivulet.operators import asof, errors, lease

T0 = dt.datetime(2024, 1, 1)
PUSH = "stream_id string, seq long, ts timestamp_ntz"


def _pushes(seed, n=500):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 0, 20, 300, 4000])
        rows.append((rnd.choice(["hot"] * 5 + ["a", f"s{i % 40}"]), i, T0 + dt.timedelta(seconds=t)))
    return rows, t


def count_by_rule(rows, stream, at, ttl, cap):
    n, last = 0, None
    for s, _, ts in rows:  # rows are in time order
        if s == stream and ts <= at:
            n = n + 1 if last is not None and ts - last <= ttl else 1
            last = ts
    return min(n, cap) if last is not None and at - last <= ttl else 0


def test_counts_at_instants(spark):
    for seed, (hours, cap) in enumerate([(1, 100), (0.1, 3)]):
        rows, end = _pushes(seed)
        rnd = random.Random(seed)
        asked = [(rnd.choice(["hot", "a", "s3", "nobody"]),
                  T0 + dt.timedelta(seconds=rnd.randint(-50, end + 5000)), i) for i in range(300)]
        asked += [("hot", r[2], 1000 + r[1]) for r in rows[::7]] + [(None, T0, 5000), ("hot", None, 5001)]
        pushes = spark.createDataFrame(rows, PUSH)
        instants = spark.createDataFrame(asked, "stream_id string, at timestamp_ntz, id long")
        want = sorted((s, i, at, count_by_rule(rows, s, at, dt.timedelta(hours=hours), cap))
                      for s, at, i in asked if s and at)
        for parts in (1, 30):
            got = asof.error_count_at(pushes, instants, hours, cap, parts=parts).collect()
            assert sorted(map(tuple, got)) == want, parts


def test_counts_equal_the_one_instant_form(spark):
    rows, end = _pushes(9)
    pushes = spark.createDataFrame(rows, PUSH)
    at = T0 + dt.timedelta(seconds=end // 2)
    want = {r[0]: r[1] for r in errors.error_count(
        pushes, F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")).collect()}
    instants = spark.createDataFrame([(s, at, i) for i, s in enumerate(want)],
                                     "stream_id string, at timestamp_ntz, id long")
    got = {r.stream_id: r.error_count for r in asof.error_count_at(pushes, instants, parts=20).collect()}
    assert got == want


def test_holders_at_instants(spark):
    from tests.test_lease import SCHEMA
    rnd = random.Random(2)
    rows, t = [], 0
    for n in range(400):
        t += rnd.choice([0, 5, 30, 70])
        rows.append((rnd.choice(["p"] * 4 + ["q"]), f"i{rnd.randrange(2)}", n,
                     T0 + dt.timedelta(seconds=t), rnd.choice(["acquire", "refresh", "release"])))
    log = spark.createDataFrame(rows, SCHEMA).cache()
    points = [T0 + dt.timedelta(seconds=rnd.randint(-5, t + 100)) for _ in range(12)]
    points += [r[3] for r in rows[::60]]  # calls of the instant itself count
    instants = spark.createDataFrame(
        [(c, at, i * 10 + k) for i, at in enumerate(points) for k, c in enumerate(("p", "q", "free"))],
        "subreddit string, at timestamp_ntz, id long")
    got = {r.id: (r.instance_id, r.held_since, r.held_until)
           for r in asof.holders_at(log, instants, parts=25).collect()}
    assert len(got) == 3 * len(points)
    for i, at in enumerate(points):
        held = {r.subreddit: (r.instance_id, r.held_from, r.held_until) for r in lease.holders(
            log, F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")).collect()}
        for k, c in enumerate(("p", "q", "free")):
            assert got[i * 10 + k] == held.get(c, (None, None, None)), (at, c)
    log.unpersist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], PUSH)
    instants = spark.createDataFrame([("s", T0, 1)], "stream_id string, at timestamp_ntz, id long")
    assert [r.error_count for r in asof.error_count_at(none, instants).collect()] == [0]
    assert asof.error_count_at(none, instants.where("false")).collect() == []
