"""Bucketed catalog tables: contents, and no Exchange on the table's side."""
import datetime as dt
import re
import uuid

import pytest

from rivulet.plans.fixtures import ntz
from rivulet.session import new_work_dir
from rivulet.sources.bucketed import Tables

T0 = dt.datetime(2024, 1, 1)
POINTS = "id string, stream_id string, last_comment_id string, last_processed_at timestamp_ntz"


@pytest.fixture
def tables(spark):
    t = Tables(spark, f"bucketed_{uuid.uuid4().hex[:8]}", 5, new_work_dir(spark, "bucketed"))
    yield t
    spark.sql(f"DROP DATABASE {t.db} CASCADE")


def _streams(spark, n):
    status = ["active", "stopped", "error"]
    return spark.createDataFrame([(f"s{i}", f"c{i}", status[i % 3]) for i in range(n)],
                                 "id string, subreddit string, status string")


def _table_sides(df):
    """The plan from each join's table side down to the scan of a bucketed table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert scans, plan
    out = []
    for i in scans:
        depth = re.search(r"[A-Za-z*]", lines[i]).start()
        up = []
        for line in reversed(lines[:i]):
            at = re.search(r"[A-Za-z*]", line)
            if at and at.start() < depth:
                depth = at.start()
                up.append(line)
                if "Join" in line:
                    break
        out.append("\n".join(up))
    return out


def test_no_exchange_on_the_table_side(spark, tables):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables.append("streams", _streams(spark, 50))
        tables.append("stream_checkpoints", spark.createDataFrame(
            [(f"s{i}", f"s{i}", str(i), T0) for i in range(50)], POINTS))
        asked = spark.createDataFrame([("x", "c1")], "id string, subreddit string")
        comments = spark.createDataFrame([("s1", "1"), ("s1", "2")], "stream_id string, comment_id string")
        updates = spark.createDataFrame([("s1", "s1", "9", T0)], POINTS)
        for df in (tables.lookup(asked), tables.skip(comments), tables.upserted(updates, ntz("2024-02-01 00:00:00"))):
            for side in _table_sides(df):
                assert "Exchange" not in side and "Join" in side, side
            df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = spark.sql(f"DESCRIBE EXTENDED {tables.db}.streams").collect()
    told = {r.col_name: r.data_type for r in rows}
    assert told["Num Buckets"] == "5" and "subreddit" in told["Bucket Columns"]


def test_upsert_and_sweep_are_durable(spark, tables):
    tables.append("streams", _streams(spark, 9))
    tables.append("stream_checkpoints", spark.createDataFrame(
        [(f"s{i}", f"s{i}", str(i), T0) for i in range(9)], POINTS))
    tables.upsert(spark.createDataFrame([("s1", "s1", "new", None), ("t", "t", "x", T0)], POINTS),
                  ntz("2024-02-01 00:00:00"))
    got = {r.stream_id: (r.last_comment_id, r.last_processed_at) for r in
           tables.read("stream_checkpoints").collect()}
    assert len(got) == 10 and got["s1"] == ("new", None) and got["t"] == ("x", T0)
    swept = sorted(r.id for r in tables.sweep().collect())
    assert swept == ["s1", "s2", "s4", "s5", "s7", "s8"]
    assert sorted(r.id for r in tables.read("streams").collect()) == ["s0", "s3", "s6"]
    assert sorted(r.stream_id for r in tables.read("stream_checkpoints").collect()) == ["s0", "s3", "s6", "t"]
    assert tables.sweep().count() == 0
    told = {r.col_name: r.data_type for r in spark.sql(
        f"DESCRIBE EXTENDED {tables.db}.stream_checkpoints").collect()}
    assert told["Num Buckets"] == "5"      # the next version is bucketed like the one before


def test_claims_are_durable_and_exclusive(spark, tables):
    req = "id string, subreddit string, requested_at timestamp_ntz, instance_id string, config string"
    one = spark.createDataFrame([("a", "c", T0, "i1", None), ("b", "c", T0 + dt.timedelta(1), "i2", "{}")], req)
    created, conflicts = tables.create(one)
    assert [r.id for r in created.collect()] == ["a"] and [r.id for r in conflicts.collect()] == ["b"]
    created, conflicts = tables.create(one.where("id = 'b'"))
    assert created.count() == 0 and [(r.id, r.holder_id) for r in conflicts.collect()] == [("b", "a")]
    row = tables.read("streams").collect()
    assert [(r.id, r.subreddit, r.status, r.config) for r in row] == [("a", "c", "starting", "{}")]


def test_errors_are_appended_with_defaults(spark, tables):
    rows = spark.createDataFrame([("e1", "s1", "E", "m", T0)],
                                 "id string, stream_id string, error_type string, error_message string, timestamp timestamp_ntz")
    tables.append_errors(rows)
    tables.append_errors(rows.selectExpr("'e2' AS id", "stream_id", "error_type", "error_message", "timestamp"))
    got = sorted((r.id, r.retry_count, r.is_recoverable) for r in tables.read("stream_errors").collect())
    assert got == [("e1", 0, 1), ("e2", 0, 1)]
