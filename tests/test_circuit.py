"""Breaker timeline and failure streaks (O29, O30), cases after the reference's tests."""
import datetime as dt

from rivulet.operators import circuit

SCHEMA = "stream_id string, attempt_id long, ts timestamp_ntz, error_type string"
T0 = dt.datetime(2024, 1, 1)


def _run(spark, steps, **kw):
    rows = [("s-1", i, T0 + dt.timedelta(seconds=s), e) for i, (s, e) in enumerate(steps)]
    out = circuit.circuit_timeline(spark.createDataFrame(rows, SCHEMA), **kw)
    return [(r.state, r.admitted, r.failure_count, r.backoff_seconds)
            for r in out.orderBy("attempt_id").collect()]


def test_opens_at_threshold(spark):
    got = _run(spark, [(0, "ConnectionError"), (1, "ConnectionError")], threshold=2)
    assert [g[0] for g in got] == ["closed", "open"]
    assert got[-1][2] == 2


def test_open_circuit_rejects_and_changes_nothing(spark):
    got = _run(spark, [(0, "ConnectionError"), (1, None), (2, "ConnectionError")], threshold=1)
    assert got[1] == ("open", False, 1, 120) and got[2] == ("open", False, 1, 120)


def test_half_open_failure_doubles_backoff(spark):
    # recovery 5 -> first opening 10; 11 s later half-open, failure -> 20
    got = _run(spark, [(0, "ConnectionError"), (11, "ConnectionError")], threshold=1, recovery=5)
    assert got == [("open", True, 1, 10), ("open", True, 2, 20)]


def test_rate_limit_floor_is_suggested_backoff(spark):
    got = _run(spark, [(0, "TooManyRequests")], threshold=1, recovery=10)
    assert got == [("open", True, 1, 60)]


def test_half_open_successes_close_and_reset_backoff(spark):
    got = _run(spark, [(0, "ConnectionError"), (200, None), (201, None), (202, "ConnectionError")],
               threshold=1)
    assert [g[0] for g in got] == ["open", "half_open", "closed", "open"]
    assert got[2][3] == 60 and got[3][3] == 120


def test_failure_streaks(spark):
    errs = ["E", "E", None, "E", "E", "E", "E", "E", "E", None, None, "E"]
    rows = [("s-7", i, T0 + dt.timedelta(minutes=i * 17), e) for i, e in enumerate(errs)]
    out = circuit.failure_streaks(spark.createDataFrame(rows, SCHEMA), threshold=5)
    got = sorted((r.first_attempt_id, r.n_failures, r.threshold_attempt_id, r.reached_threshold)
                 for r in out.collect())
    assert got == [(0, 2, None, False), (3, 6, 7, True), (11, 1, None, False)]


def _random_attempts(spark, n=4000, seed=11):
    import random
    rnd = random.Random(seed)
    rows, t = [], {}
    for i in range(n):
        sid = 0 if rnd.random() < 0.7 else rnd.randint(1, 3)      # stream 0 is hot
        t[sid] = t.get(sid, 0) + rnd.choice([1, 2, 5, 20, 90, 400])
        burst = (t[sid] // 3000) % 2 == 1                           # failure bursts
        fail = rnd.random() < (0.8 if burst else 0.2)
        rows.append((f"s-{sid}", i, T0 + dt.timedelta(seconds=t[sid]),
                     rnd.choice(["ConnectionError", "TooManyRequests"]) if fail else None))
    return spark.createDataFrame(rows, SCHEMA)


def one_by_one(rows, threshold=5, recovery=60, successes=2, mult=2.0, cap=3600):
    """The rules applied call by call."""
    floor = {"TooManyRequests": 60, "RateLimitError": 30}
    out, streams = [], {}
    for sid, aid, ts, err in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        b = streams.setdefault(sid, {"state": "closed", "fails": 0, "good": 0, "wait": recovery, "at": None})
        trial = b["state"] == "half_open"
        if b["state"] == "open" and (ts - b["at"]).total_seconds() >= b["wait"]:
            trial, b["good"], b["state"] = True, 0, "half_open"
        admitted = b["state"] != "open"
        if admitted and err is None:
            b["fails"], b["good"] = 0, b["good"] + trial
            if trial and b["good"] >= successes:
                b.update(state="closed", wait=recovery)
        elif admitted:
            b.update(fails=b["fails"] + 1, at=ts)
            if trial or b["fails"] >= threshold:
                b.update(state="open", wait=int(min(max(b["wait"] * mult, floor.get(err, 5)), cap)))
        out.append((sid, aid, b["state"], admitted, b["fails"], b["wait"]))
    return sorted(out)


def test_timeline_equals_the_rules_call_by_call(spark):
    df = _random_attempts(spark)
    rows = [tuple(r) for r in df.collect()]
    for kw in ({}, {"recovery": 10}, {"threshold": 1, "successes": 3}, {"cap": 100}):
        got = sorted(tuple(r) for r in circuit.circuit_timeline(df, **kw).collect())
        assert got == one_by_one(rows, **kw)


def test_open_segment_whose_next_call_comes_after_the_cap():
    """The backoff in front of a segment ends between two calls that are further apart than the
    cap: the later one is let through."""
    import pandas as pd
    import pyarrow as pa
    rule = circuit.Rule(5, 60, 2, 2.0, 100)
    table = circuit._table(rule, rule.backoffs(), pa.schema([("stream_id", pa.string())]))
    second = 1_000_000
    rows = pa.table({"ts": pa.array([10 * second, 900 * second], pa.timestamp("us")),
                     "failed": [False, False], "suggested": pa.array([5, 5], pa.int64())})
    pieces = table(rows, ("s", 1)).to_pandas(integer_object_nulls=True)
    before = {"stored_state": "open", "stored_failures": 5, "stored_good": 0,
              "stored_backoff": 100, "stored_opened": 9 * second}
    after = circuit._lookup(rule)(before, pieces)
    assert (after["stored_state"], after["stored_failures"], after["stored_good"]) == ("half_open", 0, 1)
    assert after["stored_backoff"] == 100 and pd.isna(after["stored_opened"])


def test_state_is_carried_over_batch_boundaries(spark):
    df = _random_attempts(spark, n=1500, seed=3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in circuit.circuit_timeline(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == one_by_one([tuple(r) for r in df.collect()])


def test_stored_states_continue_a_run(spark):
    from pyspark.sql import functions as F
    df = _random_attempts(spark, n=1200, seed=4)
    cut = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    one = circuit.circuit_run(df.where(F.col("ts") < cut))
    states = spark.createDataFrame(one.where("attempt_id IS NULL").collect(), one.schema)
    two = circuit.circuit_run(df.where(F.col("ts") >= cut), states)
    got = sorted(tuple(r) for part in (one, two)
                 for r in part.where("attempt_id IS NOT NULL").select(*circuit.TIMELINE).collect())
    assert got == one_by_one([tuple(r) for r in df.collect()])


def test_streaming_timeline_with_string_ids(spark):
    from pyspark.sql import functions as F

    from rivulet.schemas import ATTEMPTS
    from rivulet.session import new_work_dir
    from rivulet.streaming.state import read_timeline, run_circuit
    df = _random_attempts(spark, n=600, seed=8)
    work = new_work_dir(spark, "breaker-test")
    cut = F.lit("2024-01-01 20:00:00").cast("timestamp_ntz")
    for i, part in enumerate([df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)]):
        part.write.parquet(f"{work}/in/chunk={i}")
        q = run_circuit(spark.readStream.schema(ATTEMPTS).parquet(f"{work}/in/*"), f"{work}/out",
                        f"{work}/q")
        q.awaitTermination()
        assert q.exception() is None
    got = sorted(tuple(r) for r in read_timeline(spark, f"{work}/out").collect())
    assert got == one_by_one([tuple(r) for r in df.collect()])


def _dense_attempts(spark, n, seed, step, fail):
    """One stream holds most calls; several at one instant, failures in bursts or throughout."""
    import random
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice(step)
        err = rnd.random() < (fail if (t // 500) % 2 else fail / 3)
        rows.append((rnd.choice(["s-0"] * 6 + ["s-1", "s-2", f"x{i}"]), i,
                     T0 + dt.timedelta(seconds=t),
                     rnd.choice(["ConnectionError", "TooManyRequests", "RateLimitError"]) if err else None))
    return spark.createDataFrame(rows, SCHEMA)


def test_hot_stream_in_segments_equals_the_rules(spark):
    from rivulet.functions.segments import Cuts
    cases = [(dict(), (0, 1, 3), .5), (dict(threshold=1, successes=3, recovery=7), (0, 1), .9),
             (dict(recovery=10, cap=100), (1, 30, 200), .6),
             (dict(threshold=3, successes=1, mult=1.5), (0, 0, 1), 1.0),
             (dict(threshold=200), (1, 5), .95)]
    for seed, (kw, step, fail) in enumerate(cases):
        df = _dense_attempts(spark, 900, seed, step, fail).cache()
        want = one_by_one([tuple(r) for r in df.collect()], **kw)
        for parts in (9, 60):
            got = sorted(tuple(r) for r in circuit.circuit_timeline(df, parts=parts, **kw).collect())
            assert got == want, (kw, parts)
        cuts = Cuts(df, "stream_id", ["ts", "attempt_id"], 60)
        n = cuts.mark(df).where("stream_id = 's-0'").groupBy("_seg").count().collect()
        assert len(n) > 20 and max(r["count"] for r in n) < 60   # spread evenly
        df.unpersist()


def test_stored_states_before_segments(spark):
    from pyspark.sql import functions as F
    df = _dense_attempts(spark, 1200, 21, (0, 1, 20), .7).cache()
    cut = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    one = circuit.circuit_run(df.where(F.col("ts") < cut), parts=5)
    states = one.where("attempt_id IS NULL")
    assert states.count() == states.select("stream_id").distinct().count()
    two = circuit.circuit_run(df.where(F.col("ts") >= cut), states, parts=30)
    got = sorted(tuple(r) for part in (one, two)
                 for r in part.where("attempt_id IS NOT NULL").select(*circuit.TIMELINE).collect())
    assert got == one_by_one([tuple(r) for r in df.collect()])


def test_large_ids_and_empty_input(spark):
    big = (1 << 60) + 1
    rows = [("s", big + i, T0 + dt.timedelta(seconds=i), None) for i in range(3)]
    out = circuit.circuit_timeline(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.attempt_id for r in out) == [big, big + 1, big + 2]
    assert circuit.circuit_timeline(spark.createDataFrame([], SCHEMA)).collect() == []
