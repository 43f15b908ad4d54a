"""Channel log source, publishing sink and keyed checkpoint counts."""
import datetime as dt
import json
import os

from pyspark.sql import functions as F

from rivulet.schemas import COMMENT
from rivulet.session import new_work_dir
from rivulet.sources.datasource import _ChannelReader, register
from rivulet.streaming import keyed
from rivulet.streaming.published import (published_errors, published_messages, read_channels,
                                         run_published)
from tests.test_keyed_state import Feed

T0 = dt.datetime(2024, 1, 1, 6)
START = "2024-01-01 05:00:00"


def _rows(spark, lo, hi, channels=("a", "b c/ü"), start=T0):
    return spark.createDataFrame(
        [(f"{i:04d}", channels[i % len(channels)], None if i % 5 == 0 else "u", "" if i % 7 == 3 else "text",
          start + dt.timedelta(seconds=i)) for i in range(lo, hi)], COMMENT)


class Log:
    def __init__(self, spark, name):
        self.spark, self.work = spark, new_work_dir(spark, name)
        self.n = 0
        self.streams = spark.createDataFrame([("s-a", "a", "active"), ("s-b", "b c/ü", "active")],
                                             "id string, subreddit string, status string")
        self.checkpoints = spark.createDataFrame([], "stream_id string, last_comment_id string")

    def append(self, df):
        df.write.partitionBy("subreddit").parquet(f"{self.work}/in/segment={self.n}")
        self.n += 1

    def run(self):
        q = run_published(self.spark, f"{self.work}/in", f"{self.work}/out", f"{self.work}/query",
                          self.streams, self.checkpoints, START)
        q.awaitTermination()
        assert q.exception() is None
        return q

    def local(self, name):
        return f"{self.work}/{name}".removeprefix("file:")


def test_a_replayed_batch_is_published_once(spark):
    log = Log(spark, "published-test")
    log.append(_rows(spark, 0, 20))
    log.run()
    log.append(_rows(spark, 20, 40))
    log.run()
    folder = log.local("query/commits")
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for f in (str(last), f".{last}.crc"):          # died after publishing, before the commit
        if os.path.exists(f"{folder}/{f}"):
            os.remove(f"{folder}/{f}")
    files = sum(len(x) for _, _, x in os.walk(log.local("out/data")))
    log.run()
    assert sum(len(x) for _, _, x in os.walk(log.local("out/data"))) == files
    log.append(_rows(spark, 40, 45))
    log.run()
    msgs = published_messages(log.spark, f"{log.work}/out").collect()
    good = [f"{i:04d}" for i in range(45) if i % 7 != 3]
    assert sorted(r.comment_id for r in msgs) == good
    assert {r.stream_id for r in msgs} == {"s-a", "s-b"} and {r.subreddit for r in msgs} == {"a", "b c/ü"}
    errors = published_errors(log.spark, f"{log.work}/out").collect()
    assert sorted(r.timestamp for r in errors) == [T0 + dt.timedelta(seconds=i) for i in range(45) if i % 7 == 3]
    assert {(r.error_type, r.error_message, r.retry_count, r.is_recoverable) for r in errors} == {
        ("CommentProcessingError", "invalid text", 0, 1)}
    assert len({r.id for r in errors}) == len(errors)
    # Error files lie in a folder per bucket; a file that no batch names is not read.
    assert all(x.isdigit() for x in os.listdir(log.local("out/data/errors")))


def test_published_equals_the_foreach_batch_ingest(spark):
    from rivulet.plans.fixtures import ntz
    from rivulet.streaming.ingest import make_batch_writer
    log = Log(spark, "published-same")
    out = new_work_dir(spark, "published-other")
    write = make_batch_writer(out, log.streams, log.checkpoints, ntz(START), every=4)
    for i in range(2):
        part = _rows(spark, 20 * i, 20 * i + 20)
        log.append(part)
        write(part, i)
    log.run()
    cols = ["stream_id", "comment_id", "subreddit", "author_id", "text", "timestamp"]
    mine, theirs = (sorted(map(tuple, df.select(*cols).collect())) for df in (
        published_messages(log.spark, f"{log.work}/out"), spark.read.parquet(f"{out}/messages")))
    assert mine == theirs and mine


def _reader(log, **options):
    return _ChannelReader(COMMENT, {"path": f"{log.work}/in", **options})


def test_offsets_are_kept_by_channel(spark):
    log = Log(spark, "offsets")
    day = dt.timedelta(days=1)
    log.append(_rows(spark, 0, 4, ("a", "b"), T0 - 2 * day))
    log.append(_rows(spark, 0, 4, ("a",), T0 - day))
    log.append(_rows(spark, 0, 4, ("a", "c"), T0))
    assert _reader(log).initialOffset() == {"next": {}}
    assert _reader(log).latestOffset() == {"next": {"a": 3, "b": 1, "c": 3}}
    # O2: a has two segments before the session, b has nothing else, c is new, d resumes.
    start = _reader(log, session_start=START).initialOffset()
    assert start == {"next": {"a": 2, "b": 1}}
    assert _reader(log, session_start=START, resume=json.dumps(["a"])).initialOffset() == {"next": {"b": 1}}
    parts = _reader(log).partitions(start, {"next": {"a": 3, "b": 1, "c": 3}})
    assert {p.channel for p in parts} == {"a", "c"} and all("segment=2" in p.file for p in parts)
    assert _reader(log).partitions(start, start) == []


def test_resumed_channels_replay_and_others_start_at_the_session(spark):
    log = Log(spark, "resume")
    log.checkpoints = spark.createDataFrame([("s-a", "0000")], "stream_id string, last_comment_id string")
    log.streams = spark.createDataFrame([("s-a", "s-a", "active"), ("b", "b", "active")],
                                        "id string, subreddit string, status string")
    day = dt.timedelta(days=1)
    log.append(_rows(spark, 0, 6, ("s-a", "b"), T0 - day))
    log.append(_rows(spark, 6, 12, ("s-a", "b")))
    log.run()
    got = sorted(r.comment_id for r in published_messages(log.spark, f"{log.work}/out").collect())
    # s-a from its first segment on (0000 is its checkpoint; 0010 has no text), b from the session.
    assert got == ["0002", "0004", "0006", "0007", "0008", "0009", "0011"]


def test_only_asked_columns_are_read(spark):
    log = Log(spark, "columns")
    log.append(_rows(spark, 0, 4))
    batch = next(iter(_ChannelReader(
        type(COMMENT)([COMMENT["comment_id"], COMMENT["subreddit"]]),
        {"path": f"{log.work}/in"}).read(_reader(log).partitions(
            {"next": {}}, {"next": {"a": 1}})[0])))
    assert batch.schema.names == ["comment_id", "subreddit"]
    df = read_channels(log.spark, f"{log.work}/in", columns=["comment_id", "subreddit"])
    assert df.columns == ["comment_id", "subreddit"] and df.isStreaming


def test_registering_twice_is_harmless(spark):
    register(spark)
    register(spark)


def test_keyed_checkpoints_count_across_batches_and_kills(spark):
    df = spark.createDataFrame(
        [("s-a" if i % 3 else "s-b", f"{i:04d}", T0 + dt.timedelta(seconds=i)) for i in range(50)],
        "stream_id string, comment_id string, arrival_ts timestamp_ntz")
    feed = Feed(spark, df.schema, lambda s: keyed.checkpoints_stream(s, 4), "counter-keyed")
    for i, (lo, hi) in enumerate([(0, 13), (13, 14), (14, 50)]):
        feed.add(df.where(F.col("comment_id").between(f"{lo:04d}", f"{hi - 1:04d}")))
        feed.run()
        if i == 1:
            feed.uncommit()
    want = []
    for s in ("s-a", "s-b"):
        own = [i for i in range(50) if (s == "s-a") == bool(i % 3)]
        want += [(s, n, f"{own[n - 1]:04d}") for n in range(4, len(own) + 1, 4)]
    got = [(r.stream_id, r.seq, r.last_comment_id) for r in feed.rows().collect()]
    assert sorted(got) == sorted(want)
    assert feed.rows().where("NOT endswith(last_processed_at, 'Z')").count() == 0
