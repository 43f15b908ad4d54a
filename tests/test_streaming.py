"""Streaming ingest: replay idempotence and the counter carried across micro-batches."""
import datetime as dt

from pyspark.sql import functions as F

from rivulet.plans.fixtures import ntz
from rivulet.session import new_work_dir
from rivulet.streaming.ingest import make_batch_writer

COMMENT = ("comment_id string, subreddit string, author string, body string,"
           " arrival_ts timestamp_ntz")
T0 = dt.datetime(2024, 1, 1, 6)


def _setup(spark):
    streams = spark.createDataFrame([("s-a", "a", "active")], "id string, subreddit string, status string")
    cks = spark.createDataFrame([], "stream_id string, last_comment_id string")
    return streams, cks


def _batch(spark, lo, hi):
    return spark.createDataFrame(
        [(f"{i:04d}", "a", None if i % 5 == 0 else "u", "" if i == 7 else "text",
          T0 + dt.timedelta(seconds=i)) for i in range(lo, hi)] +
        [("x1", "unregistered", "u", "t", T0)], COMMENT)


def test_replayed_batch_writes_no_duplicates_and_counter_carries(spark):
    out = new_work_dir(spark, "ingest-test")
    streams, cks = _setup(spark)
    write = make_batch_writer(out, streams, cks, ntz("2024-01-01 05:00:00"), every=4)
    b0, b1 = _batch(spark, 0, 10), _batch(spark, 10, 20)
    write(b0, 0)
    write(b1, 1)
    write(b1, 1)                                   # replay after a failure
    msgs = spark.read.parquet(f"{out}/messages")
    assert msgs.count() == 19                      # 20 comments, one empty body
    assert msgs.where(F.col("subreddit") == "unregistered").count() == 0
    assert msgs.select("comment_id").distinct().count() == 19
    errs = spark.read.parquet(f"{out}/errors").collect()
    assert [(e.stream_id, e.error_message, e.retry_count) for e in errs] == [
        ("s-a", "invalid text", 0)]
    got = sorted((r.last_comment_id, r.seq)
                 for r in spark.read.parquet(f"{out}/checkpoints").collect())
    # successes 0..19 without 7: the 4th, 8th, ... across both batches
    assert got == [("0003", 4), ("0008", 8), ("0012", 12), ("0016", 16)]
    assert spark.read.parquet(f"{out}/messages").where(F.col("author_id") == "[deleted]").count() == 4
    from rivulet.operators.registry import current_streams
    status = current_streams(spark.read.parquet(f"{out}/status").drop("batch_id")).collect()
    assert [(r.stream_id, r.status, r.instance_id) for r in status] == [("s-a", "active", "spark")]


def test_error_lists_stream_emits_closed_lists_like_batch(spark):
    from rivulet.operators.errors import error_lists
    from rivulet.streaming.state import error_lists_stream
    schema = "stream_id string, seq long, ts timestamp_ntz, error_type string, error_message string"
    h = dt.timedelta(hours=1)
    base = dt.datetime(2024, 1, 1)
    offs = {"a": [0, 1, 30, 54, 100, 101], "b": [0, 24, 48, 73, 200]}  # hours; b: exact 24 h gaps
    rows = [(k, i * 10 + j, base + o * h, "TimeoutError", "x")
            for i, (k, os_) in enumerate(offs.items()) for j, o in enumerate(os_)]
    df = spark.createDataFrame(rows, schema)
    work = new_work_dir(spark, "lists-stream")
    cut = base + 90 * h
    for i, part in enumerate([df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)]):
        part.write.parquet(f"{work}/in/chunk={i}")
        src = spark.readStream.schema(schema).parquet(f"{work}/in/*")
        q = (error_lists_stream(src, "0 seconds").writeStream.format("parquet").option("path", f"{work}/out")
             .option("checkpointLocation", f"{work}/q").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted((r.stream_id, r.list_start, r.n_pushed)
                 for r in spark.read.parquet(f"{work}/out").collect())
    watermark = base + 200 * h
    want = sorted((r.stream_id, r.list_start, r.n_pushed) for r in error_lists(df).collect()
                  if r.expires_at < watermark)
    assert got == want and len(want) >= 4


def test_crash_after_write_before_commit_replays_exactly_once(spark):
    """The query dies after batch 1's outputs are written but before Spark commits the
    batch; the restarted query replays batch 1 from its checkpoint and the outputs are
    the same as one clean run (no loss, no duplicates, counters not double-counted)."""
    from rivulet.schemas import COMMENT as COMMENT_SCHEMA
    from rivulet.sources.io import read_comments
    work = new_work_dir(spark, "crash")
    streams, cks = _setup(spark)
    write = make_batch_writer(f"{work}/out", streams, cks, ntz("2024-01-01 05:00:00"), every=4)
    crashed = {"done": False}

    def flaky(df, batch_id):
        write(df, batch_id)
        if batch_id == 1 and not crashed["done"]:
            crashed["done"] = True
            raise RuntimeError("simulated executor loss before commit")

    def run():
        src = read_comments(spark, f"{work}/in/*", streaming=True)
        q = (src.writeStream.foreachBatch(flaky).option("checkpointLocation", f"{work}/q")
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        except Exception:
            pass
        return q

    _batch(spark, 0, 10).select(*COMMENT_SCHEMA.fieldNames()).write.parquet(f"{work}/in/c=0")
    run()
    _batch(spark, 10, 20).select(*COMMENT_SCHEMA.fieldNames()).write.parquet(f"{work}/in/c=1")
    assert run().exception() is not None and crashed["done"]
    run()                                            # restart: batch 1 is replayed
    msgs = spark.read.parquet(f"{work}/out/messages")
    assert msgs.count() == 19 and msgs.select("comment_id").distinct().count() == 19
    got = sorted((r.last_comment_id, r.seq)
                 for r in spark.read.parquet(f"{work}/out/checkpoints").collect())
    assert got == [("0003", 4), ("0008", 8), ("0012", 12), ("0016", 16)]
    counters = {r.stream_id: r.n_processed
                for r in spark.read.parquet(f"{work}/out/counters/batch_id=1").collect()}
    assert counters == {"s-a": 19}


def test_status_log_lifecycle_read_by_current_streams(spark):
    from rivulet.operators.registry import current_streams
    from rivulet.schemas import COMMENT as COMMENT_SCHEMA
    from rivulet.streaming.ingest import finish_ingest, run_ingest
    work = new_work_dir(spark, "life")
    streams, cks = _setup(spark)
    _batch(spark, 0, 5).select(*COMMENT_SCHEMA.fieldNames()).write.parquet(f"{work}/in/c=0")
    q = run_ingest(spark, f"{work}/in/*", f"{work}/out", f"{work}/q", streams, cks,
                   ntz("2024-01-01 05:00:00"), instance_id="i1")
    q.awaitTermination()
    log = spark.read.parquet(f"{work}/out/status").select(
        "stream_id", "seq", "ts", "status", "instance_id")
    assert [r.status for r in current_streams(log).collect()] == ["active"]
    assert finish_ingest(q, f"{work}/out", streams, "i1") == "stopped"
    log = spark.read.parquet(f"{work}/out/status").select(
        "stream_id", "seq", "ts", "status", "instance_id")
    got = [(r.stream_id, r.status, r.instance_id) for r in current_streams(log).collect()]
    assert got == [("s-a", "stopped", "i1")]
    assert sorted(r.status for r in log.collect()) == ["active", "starting", "stopped"]


def test_prepare_fills_missing_arrival_time(spark):
    from rivulet.streaming.ingest import prepare
    streams, cks = _setup(spark)
    df = spark.createDataFrame([("c1", "a", "u", "text", None)], COMMENT)
    r = prepare(df, streams, cks, ntz("2000-01-01 00:00:00")).first()
    assert r.arrival_ts is not None and r.is_valid and r.timestamp.endswith("Z")


def test_records_that_do_not_parse_become_error_rows(spark):
    from rivulet.sources.io import parse_records
    out = new_work_dir(spark, "bad-records")
    streams, cks = _setup(spark)
    records = spark.createDataFrame(
        [('{"comment_id": "c1", "subreddit": "a", "author": "u", "body": "t"}', T0, "record-t-0-1"),
         ("not json", T0, "record-t-0-2"), ('{"subreddit": "a"}', T0, "record-t-0-3")],
        "value string, record_ts timestamp_ntz, record_id string")
    comments = parse_records(records)
    make_batch_writer(out, streams, cks, ntz("2024-01-01 05:00:00"))(comments, 0)
    assert spark.read.parquet(f"{out}/messages").count() == 1
    errs = spark.read.parquet(f"{out}/errors").collect()
    assert [(e.stream_id, e.error_message) for e in errs] == [("unparsed", "invalid subreddit")] * 2
    assert len({e.id for e in errs}) == 2


def test_messages_are_written_encoded_and_registry_is_read_per_batch(spark):
    from rivulet.sources.io import decode_message
    out = new_work_dir(spark, "ingest-encoded")
    streams, cks = _setup(spark)
    late = streams.unionByName(spark.createDataFrame([("s-b", "unregistered", "active")], streams.schema))
    seen = []
    write = make_batch_writer(out, streams, cks, ntz("2024-01-01 05:00:00"), value_format="json",
                              streams_fn=lambda s: late if seen else (seen.append(1) or streams))
    write(_batch(spark, 0, 5), 0)
    write(_batch(spark, 5, 7), 1)
    rows = spark.read.parquet(f"{out}/messages")
    assert {"value", "stream_id", "comment_id"} <= set(rows.columns)
    back = decode_message(rows, keep=["comment_id"]).collect()
    assert len(back) == 8 and {r.subreddit for r in back} == {"a", "unregistered"}


LOG = "stream_id string, seq long, updated_at timestamp_ntz, last_comment_id string, last_processed_at string"


def test_flush_keeps_the_newest_write_of_each_field(spark):
    """Updates that arrive late change only the fields they are the newest for."""
    from rivulet.operators.checkpoints import flush_rows, merge_checkpoints
    from rivulet.streaming.flush import durable_table, make_flush_writer
    table = new_work_dir(spark, "flush-late") + "/t"
    m = lambda k: T0 + dt.timedelta(minutes=k)
    b = [[("s", 1, m(5), None, "2024-01-01T00:05:00Z"), ("s", 2, m(10), "c10", None)],
         [("s", 3, m(7), "c7", "2024-01-01T00:07:00Z"), ("u", 4, m(1), "x", None)],
         [("u", 5, m(2), None, "bad")], [("s", 6, m(7), None, "2024-01-01T00:09:00Z")]]
    now = ntz("2024-02-01 00:00:00")
    write = make_flush_writer(table, lambda _: now, compact=2)
    for i, rows in enumerate(b):
        write(spark.createDataFrame(rows, LOG), i)
        write(spark.createDataFrame(rows, LOG), i)       # a replay changes nothing
    cols = ["id", "stream_id", "last_comment_id", "last_processed_at", "updated_at"]
    got = sorted(tuple(r) for r in durable_table(spark, table).select(*cols).collect())
    log = spark.createDataFrame([r for rows in b for r in rows], LOG)
    want = {r["stream_id"]: tuple(r) for r in flush_rows(merge_checkpoints(log), now).select(*cols).collect()}
    assert got[0] == want["s"] and got[0][2:4] == ("c10", dt.datetime(2024, 1, 1, 0, 9))
    # The stamp of u stopped parsing: its row stays as last flushed.
    assert got[1][:4] == ("u", "u", "x", None)


def test_ingest_log_feeds_the_flush(spark):
    from rivulet.streaming.flush import durable_table, run_flush
    work = new_work_dir(spark, "chain")
    streams, cks = _setup(spark)
    write = make_batch_writer(f"{work}/out", streams, cks, ntz("2024-01-01 05:00:00"), every=4)
    write(_batch(spark, 0, 10), 0)
    write(_batch(spark, 10, 20), 1)
    q = run_flush(spark, f"{work}/out/checkpoints/*", f"{work}/table", f"{work}/q")
    q.awaitTermination()
    assert q.exception() is None
    r = durable_table(spark, f"{work}/table").collect()
    assert [(x.stream_id, x.last_comment_id, x.last_processed_at) for x in r] == [
        ("s-a", "0016", T0 + dt.timedelta(seconds=16))]


def test_late_errors_are_the_side_output(spark):
    from rivulet.streaming.state import late_errors
    h = dt.timedelta(hours=1)
    errs = spark.createDataFrame([("s", i, T0 + i * h) for i in range(6)],
                                 "stream_id string, seq long, ts timestamp_ntz")
    newest = spark.createDataFrame([(T0 + 4 * h,)], "newest timestamp_ntz")
    assert sorted(r.seq for r in late_errors(errs, newest, "2 hours").collect()) == [0, 1]


def test_no_private_work_folder_on_a_cluster():
    import pytest

    from rivulet.session import work_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        work_root(Session())
