"""Checkpoint operators."""
import datetime as dt

from pyspark.sql import functions as F

from rivulet.operators import checkpoints as ck
from rivulet.plans.fixtures import ntz

LOG = ("stream_id string, seq long, updated_at timestamp_ntz, last_comment_id string,"
       " last_processed_at string")
T0 = dt.datetime(2026, 5, 5)


def _now():
    return ntz("2026-06-01 00:00:00")


def _table(spark, rows=()):
    return spark.createDataFrame(list(rows), "id string, stream_id string, last_comment_id string,"
                                             " last_processed_at timestamp_ntz, updated_at timestamp_ntz")


def test_merge_partial_updates_last_write_wins_per_field(spark):
    log = spark.createDataFrame([
        ("stream-1", 1, T0, "a", "2026-05-05T10:00:00Z"),
        ("stream-1", 2, T0 + dt.timedelta(seconds=1), "b", None),
        ("stream-1", 3, T0 + dt.timedelta(seconds=2), None, None),   # sets nothing
        ("stream-2", 4, T0, None, None)], LOG)
    rows = ck.merge_checkpoints(log).collect()
    assert [(r.stream_id, r.last_comment_id, r.last_processed_at, r.updated_at) for r in rows] == [
        ("stream-1", "b", "2026-05-05T10:00:00Z", T0 + dt.timedelta(seconds=1))]


def test_flush_empty_is_noop_and_single_checkpoint_upserted(spark):
    empty = spark.createDataFrame([], LOG)
    assert ck.flush_checkpoints(empty, _table(spark), _now()).count() == 0
    log = spark.createDataFrame([("stream-1", 1, T0, "abc123", "2026-05-05T10:00:00Z")], LOG)
    rows = ck.flush_checkpoints(log, _table(spark), _now()).collect()
    assert [(r.id, r.stream_id, r.last_comment_id, r.last_processed_at, r.change) for r in rows] == [
        ("stream-1", "stream-1", "abc123", dt.datetime(2026, 5, 5, 10), "inserted")]
    assert rows[0].updated_at == dt.datetime(2026, 6, 1)


def test_flush_offset_becomes_naive_and_bad_rows_skipped(spark):
    log = spark.createDataFrame([
        ("s1", 1, T0, "x", "2026-05-05T10:00:00+00:00"),
        ("s2", 2, T0, "y", "bad"),
        ("s3", 3, T0, "z", None)], LOG)
    rows = {r.stream_id: r for r in ck.flush_rows(ck.merge_checkpoints(log), _now()).collect()}
    assert rows["s1"].last_processed_at == dt.datetime(2026, 5, 5, 10)
    assert "s2" not in rows
    assert rows["s3"].last_processed_at is None and rows["s3"].last_comment_id == "z"


def test_upsert_insert_update_unchanged(spark):
    old = dt.datetime(2023, 12, 31)
    table = _table(spark, [("keep", "s1", "old", old, old), ("k2", "s2", "old", old, old)])
    upd = spark.createDataFrame([("s2", "s2", None, None), ("s3", "s3", "n", None)],
                                "id string, stream_id string, last_comment_id string,"
                                " last_processed_at timestamp_ntz")
    rows = {r.stream_id: r for r in ck.upsert_checkpoints(table, upd, _now()).collect()}
    assert rows["s1"].change == "unchanged" and rows["s1"].updated_at == old
    assert rows["s2"].change == "updated" and rows["s2"].id == "k2"
    assert rows["s2"].last_comment_id is None              # nulls overwrite too
    assert rows["s3"].change == "inserted" and rows["s3"].updated_at == dt.datetime(2026, 6, 1)


def test_checkpoint_every_n_only_full_multiples(spark):
    rows = [("a", i, T0 + dt.timedelta(minutes=37 * i)) for i in range(1, 251)]
    rows += [("b", 1000 + i, T0 + dt.timedelta(minutes=i)) for i in range(1, 100)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, ts timestamp_ntz")
    got = [(r.stream_id, r.last_comment_id, r.n_processed)
           for r in ck.checkpoint_every(df, n=100).orderBy("n_processed").collect()]
    assert got == [("a", "100", 100), ("a", "200", 200)]


def test_start_position_and_skip_processed(spark):
    comments = spark.createDataFrame([
        ("1", "a", dt.datetime(2024, 1, 1, 1)), ("2", "a", dt.datetime(2024, 1, 1, 6)),
        ("3", "b", dt.datetime(2024, 1, 1, 1)), ("4", "b", dt.datetime(2024, 1, 1, 6)),
        ("5", "b", dt.datetime(2024, 1, 1, 7))],
        "comment_id string, subreddit string, arrival_ts timestamp_ntz")
    cks = spark.createDataFrame([("b", "4"), ("a", None)], "stream_id string, last_comment_id string")
    sp = ck.start_position(comments, cks, ntz("2024-01-01 05:00:00"))
    assert sorted(r.comment_id for r in sp.collect()) == ["2", "3", "4", "5"]
    sk = ck.skip_processed(comments, cks)
    # equality only: "3" < "4" stays, only "4" is dropped
    assert sorted(r.comment_id for r in sk.collect()) == ["1", "2", "3", "5"]


def test_flush_single_stream_on_stop(spark):
    old = dt.datetime(2023, 12, 31)
    table = _table(spark, [("s1", "s1", "old", old, old), ("s2", "s2", "old", old, old)])
    log = spark.createDataFrame([("s1", 1, T0, "new1", "2026-05-05T10:00:00Z"),
                                 ("s2", 2, T0, "new2", "2026-05-05T10:00:00Z")], LOG)
    rows = {r.stream_id: r for r in ck.flush_checkpoint(log, table, _now(), "s2").collect()}
    assert rows["s2"].last_comment_id == "new2" and rows["s2"].change == "updated"
    assert rows["s1"].last_comment_id == "old" and rows["s1"].change == "unchanged"
