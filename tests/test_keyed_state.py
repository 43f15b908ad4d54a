"""Keyed state on streams: breaker, live error lists, leases; restarts and late rows."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import circuit, errors, lease
from rivulet.session import new_work_dir, stream_session
from rivulet.streaming import keyed
from rivulet.streaming.state import late_errors, read_timeline, run_circuit
from tests.test_circuit import _random_attempts, one_by_one

T0 = dt.datetime(2024, 1, 1)


def _ntz(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


class Feed:
    """A folder of input files and a query over it that is run once per added file."""

    def __init__(self, spark, schema, make, name):
        self.spark, self.schema, self.make = stream_session(spark), schema, make
        self.work = new_work_dir(spark, name)
        self.n = 0

    def add(self, df):
        df.coalesce(1).write.parquet(f"{self.work}/in/chunk={self.n}")
        self.n += 1

    def run(self):
        src = self.spark.readStream.schema(self.schema).parquet(f"{self.work}/in/*")
        q = (self.make(src).writeStream.format("parquet").option("path", f"{self.work}/out")
             .option("checkpointLocation", f"{self.work}/query").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
        return q

    def rows(self):
        return self.spark.read.parquet(f"{self.work}/out")

    def uncommit(self):
        """As if the process died after the last batch's writes, before its commit."""
        folder = f"{self.work}/query/commits".removeprefix("file:")
        last = max(int(f) for f in os.listdir(folder) if f.isdigit())
        for f in (str(last), f".{last}.crc"):
            if os.path.exists(f"{folder}/{f}"):
                os.remove(f"{folder}/{f}")


def _cut(df, hours):
    edges = [None, *[_ntz(T0 + dt.timedelta(hours=h)) for h in hours], None]
    for a, b in zip(edges, edges[1:]):
        part = df if a is None else df.where(F.col("ts") >= a)
        yield part if b is None else part.where(F.col("ts") < b)


def test_breaker_goes_on_after_a_kill(spark):
    df = _random_attempts(spark, n=900, seed=14)
    feed = Feed(spark, df.schema, keyed.breaker_stream, "breaker-keyed")
    for i, part in enumerate(_cut(df, (5, 12, 30))):
        feed.add(part)
        feed.run()
        if i % 2 == 0:
            feed.uncommit()
    feed.run()
    got = sorted(tuple(r) for r in feed.rows().select(*circuit.TIMELINE).collect())
    assert got == one_by_one([tuple(r) for r in df.collect()])


def test_breaker_state_is_touched_by_key(spark):
    rows = [(f"k{i}", i, T0, "ConnectionError") for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id string, attempt_id long, ts timestamp_ntz, error_type string")
    feed = Feed(spark, df.schema, keyed.breaker_stream, "breaker-touch")
    feed.add(df)
    feed.run()
    feed.add(df.limit(1).withColumn("attempt_id", F.lit(99).cast("long")))
    q = feed.run()
    state = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]][-1]
    assert state["numRowsTotal"] == 40 and state["numRowsUpdated"] <= 1


def _errors(seed, n=600):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 5, 40, 400])
        rows.append((rnd.choice(["hot"] * 4 + ["a", "b", f"s{i % 30}"]), i,
                     T0 + dt.timedelta(seconds=t, microseconds=rnd.choice([0, 1, 999, 1001])), "E", "m"))
    return rows


ERRORS = "stream_id string, seq long, ts timestamp_ntz, error_type string, error_message string"


@pytest.mark.parametrize("ttl,cap", [("10 minutes", 5), ("24 hours", 100)])
def test_live_list_equals_the_batch_form_at_every_watermark(spark, ttl, cap):
    rows = _errors(3)
    df = spark.createDataFrame(rows, ERRORS).cache()
    feed = Feed(spark, df.schema, lambda s: keyed.live_lists_stream(
        s, "5 minutes", ttl=ttl, cap=cap, limit=3), "live-keyed")
    newest = None
    for part in _cut(df, (1, 3, 3.2, 9)):
        # Out of order within the delay: the last rows come with the next file's.
        feed.add(part.orderBy(F.rand(5)))
        feed.run()
        newest = max(filter(None, (newest, part.agg(F.max("ts")).first()[0])))
        mark = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(minutes=5)
        seen = df.where(F.col("ts") <= _ntz(newest))
        count = {r[0]: r[1] for r in errors.error_count(seen, _ntz(mark), ttl, cap).collect() if r[1]}
        recent = {}
        for r in errors.recent_errors(seen, _ntz(mark), 3, ttl, cap).orderBy("position").collect():
            recent.setdefault(r.stream_id, []).append(str(r.seq))
        got = {r.stream_id: (r.error_count, r.recent)
               for r in keyed.latest_lists(feed.rows()).collect() if r.error_count}
        assert got == {k: (n, ",".join(recent[k])) for k, n in count.items()}
    df.unpersist()


def test_late_errors_are_counted_and_returned(spark):
    def one(seq, minutes):
        return ("s", seq, T0 + dt.timedelta(minutes=minutes), "E", "m")
    feed = Feed(spark, spark.createDataFrame([], ERRORS).schema,
                lambda s: keyed.live_lists_stream(s, "10 minutes"), "late-keyed")
    first = spark.createDataFrame([one(1, 0), one(2, 60)], ERRORS)
    second = spark.createDataFrame([one(3, 55), one(4, 30), one(5, 90)], ERRORS)
    feed.add(first)
    feed.run()
    feed.add(second)
    q = feed.run()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress) == 1
    late = late_errors(second, first.agg(F.max("ts").alias("newest")), "10 minutes")
    assert [r.seq for r in late.collect()] == [4]
    # As of 01:20 the list holds 3 (in time), 2 and 1; 5 is later than the watermark.
    assert [tuple(r) for r in keyed.latest_lists(feed.rows()).collect()] == [("s", 3, "2,3,1")]


LOG = "subreddit string, instance_id string, seq long, ts timestamp_ntz, action string"


def test_leases_equal_the_batch_form_and_end_by_timer(spark):
    rnd = random.Random(8)
    rows, t = [], 0
    for n in range(500):
        t += rnd.choice([1, 10, 40, 300])
        rows.append((rnd.choice(["p", "p", "q", f"c{n % 7}"]), f"i{rnd.randrange(3)}", n,
                     T0 + dt.timedelta(seconds=t), rnd.choice(["acquire", "refresh", "refresh", "release"])))
    log = spark.createDataFrame(rows, LOG).cache()
    feed = Feed(spark, log.schema, lambda s: keyed.leases_stream(s, "1 minute"), "lease-keyed")
    newest = None
    for i, part in enumerate(_cut(log, (2, 5, 5.1))):
        feed.add(part)
        feed.run()
        if i == 1:
            feed.uncommit()
        newest = max(filter(None, (newest, part.agg(F.max("ts")).first()[0])))
        seen = log.where(F.col("ts") <= _ntz(newest))
        want = {(r.subreddit, r.lease_no): (r.instance_id, r.held_from, r.held_until, r.n_calls)
                for r in lease.lease_intervals(lease.lease_calls(seen)).collect()}
        got = keyed.latest_leases(feed.rows()).collect()
        assert {(r.subreddit, r.lease_no): (r.instance_id, r.held_from, r.held_until, r.n_calls)
                for r in got} == want
        mark = newest - dt.timedelta(minutes=1)
        assert all(r.ended for r in got if r.held_until <= mark)
        holders = lambda df: sorted((r.subreddit, r.instance_id, r.held_until) for r in df.collect())
        assert holders(keyed.current_holders(feed.rows(), _ntz(newest))) == holders(
            lease.holders(seen, _ntz(newest)))
    assert any(r.ended for r in got)
    log.unpersist()


def test_lease_end_without_an_input_row_for_its_channel(spark):
    def one(channel, n, seconds):
        return (channel, "i1", n, T0 + dt.timedelta(seconds=seconds), "acquire")
    feed = Feed(spark, spark.createDataFrame([], LOG).schema,
                lambda s: keyed.leases_stream(s, "0 seconds"), "lease-timer")
    feed.add(spark.createDataFrame([one("p", 1, 0)], LOG))
    feed.run()
    feed.add(spark.createDataFrame([one("q", 2, 61)], LOG))
    feed.run()
    got = {(r.subreddit, r.ended) for r in keyed.latest_leases(feed.rows()).collect()}
    assert got == {("p", True), ("q", False)}
