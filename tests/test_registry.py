"""Registry operators."""
import datetime as dt

from rivulet.operators import registry

STREAMS = ("id string, subreddit string, status string, config string")
CK = ("id string, stream_id string, last_comment_id string, last_processed_at timestamp_ntz,"
      " updated_at timestamp_ntz")
REQ = ("id string, subreddit string, requested_at timestamp_ntz, instance_id string,"
       " config string")
T0 = dt.datetime(2024, 1, 1)


def _streams(spark, rows):
    return spark.createDataFrame(rows, STREAMS)


def test_create_new_stream_is_starting_with_config(spark):
    reg = _streams(spark, [("s0", "java", "active", "{}")])
    req = spark.createDataFrame([("st1", "python", T0, "instance-1", '{"limit": 100}'),
                                 ("st2", None, T0, "instance-1", None)], REQ)
    created, conflicts = registry.create_streams(reg, req)
    row = created.collect()[0]
    assert (row.id, row.subreddit, row.status, row.instance_id, row.config) == (
        "st1", "python", "starting", "instance-1", '{"limit": 100}')
    assert created.count() == 1
    assert conflicts.count() == 0


def test_duplicate_create_conflicts_and_first_request_wins(spark):
    reg = _streams(spark, [("s0", "python", "active", "{}")])
    req = spark.createDataFrame([
        ("st1", "python", T0, None, None),
        ("st3", "rust", T0 + dt.timedelta(seconds=5), "i3", None),
        ("st2", "rust", T0, "i2", None),
        ("st4", "rust", T0, "i4", None)], REQ)
    created, conflicts = registry.create_streams(reg, req)
    assert [(r.id, r.subreddit, r.instance_id, r.config) for r in created.collect()] == [
        ("st2", "rust", "i2", "{}")]
    got = sorted((r.id, r.holder_id) for r in conflicts.collect())
    assert got == [("st1", "s0"), ("st3", "st2"), ("st4", "st2")]


def test_get_and_list_parse_config(spark):
    reg = _streams(spark, [("s1", "python", "active", '{"limit": 100}'),
                           ("s2", "rust", "active", "{bad"), ("s3", "go", "active", "")])
    got = {r.id: (r.config, r.config_limit) for r in registry.list_streams(reg).collect()}
    assert got == {"s1": ('{"limit": 100}', 100), "s2": ("{}", None), "s3": ("", None)}
    assert registry.get_stream(reg, "s1").count() == 1
    assert registry.get_stream(reg, "missing").count() == 0


def test_lookup_by_channel(spark):
    reg = _streams(spark, [("s1", "python", "active", "{}")])
    df = spark.createDataFrame([("c1", "python"), ("c2", "nope")], "comment_id string, subreddit string")
    got = {r.comment_id: r.stream_id for r in registry.lookup(df, reg).collect()}
    assert got == {"c1": "s1", "c2": None}


def test_delete_cascade_and_unknown_id(spark):
    reg = _streams(spark, [("stream-1", "python", "active", "{}"),
                           ("stream-2", "rust", "active", "{}")])
    ck = spark.createDataFrame([("stream-1", "stream-1", "abc", T0, T0),
                                ("stream-2", "stream-2", "def", T0, T0),
                                ("ghost", "ghost", "ghi", T0, T0)], CK)
    held = spark.createDataFrame([("python", "i1"), ("rust", "i2")], "subreddit string, instance_id string")
    ids = spark.createDataFrame([("stream-1",), ("unknown",), ("ghost",)], "id string")
    s, c, leases = registry.delete_streams(reg, ck, ids, held)
    assert [r.id for r in s.collect()] == ["stream-2"]
    assert sorted(r.stream_id for r in c.collect()) == ["ghost", "stream-2"]   # unknown id: no-op
    assert [r.subreddit for r in leases.collect()] == ["rust"]


def test_current_status_keeps_instance_when_not_supplied(spark):
    log = spark.createDataFrame([
        ("stream-1", 1, T0, "starting", "instance-1"),
        ("stream-1", 2, T0 + dt.timedelta(seconds=1), "running", None),
        ("stream-2", 3, T0, "active", "i0"),
        ("stream-2", 4, T0 + dt.timedelta(seconds=1), "deleted", None)],
        "stream_id string, seq long, ts timestamp_ntz, status string, instance_id string")
    rows = registry.current_streams(log).collect()
    assert [(r.stream_id, r.status, r.instance_id) for r in rows] == [
        ("stream-1", "running", "instance-1")]


def test_sweep_removes_dead_streams(spark):
    reg = _streams(spark, [(f"s{i}", f"c{i}", st, "{}") for i, st in enumerate(
        ["inactive", "starting", "active", "paused", "stopped", "error"])])
    ck = spark.createDataFrame([(f"s{i}", f"s{i}", "x", T0, T0) for i in range(6)], CK)
    held = spark.createDataFrame([(f"c{i}", "i") for i in range(6)], "subreddit string, instance_id string")
    swept, s, c, leases = registry.sweep_dead(reg, ck, held)
    assert sorted(r.subreddit for r in leases.collect()) == ["c1", "c2", "c3"]
    assert sorted(r.id for r in swept.collect()) == ["s0", "s4", "s5"]
    assert sorted(r.id for r in s.collect()) == ["s1", "s2", "s3"]
    assert sorted(r.stream_id for r in c.collect()) == ["s1", "s2", "s3"]
