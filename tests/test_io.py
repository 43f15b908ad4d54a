"""Sources, sinks, encoding and table definitions."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from rivulet import schemas
from rivulet.session import new_work_dir
from rivulet.sources import io


def _comments(spark):
    return spark.createDataFrame([("c1", "python", "a", "t", dt.datetime(2024, 1, 1)),
                                  (None, "python", "a", "t", dt.datetime(2024, 1, 1))],
                                 schemas.COMMENT)


def test_read_comments_drops_null_items_batch_and_stream(spark):
    d = new_work_dir(spark, "src")
    _comments(spark).write.parquet(f"{d}/in")
    assert io.read_comments(spark, f"{d}/in", streaming=False).count() == 1
    s = io.read_comments(spark, f"{d}/in", streaming=True)
    assert s.isStreaming
    q = s.writeStream.format("memory").queryName("src_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("src_test").count() == 1


def test_json_encode_decode_round_trip(spark):
    msg = spark.createDataFrame([("python", "john_doe", 'text "quoted" ü', "2026-05-09T14:30:45.123456Z")],
                                "subreddit string, author_id string, text string, timestamp string")
    enc = io.encode_message(msg)
    assert enc.columns == ["value"]
    back = io.decode_message(enc).collect()[0]
    assert tuple(back) == ("python", "john_doe", 'text "quoted" ü', "2026-05-09T14:30:45.123456Z")


def avro_reference(fields):
    """Avro's binary encoding of a record of strings, byte by byte."""
    out = bytearray()
    for f in fields:
        raw = f.encode()
        n = len(raw) << 1
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        out += raw
    return bytes(out)


FIELDS = "subreddit string, author_id string, text string, timestamp string"


def test_avro_bytes_and_round_trip(spark):
    rows = [("p", "a", "t", "x"), ("", "", "", ""), ("é中", "\U0001f389", "q\"\n\0", "z"),
            *[("s", "u", "y" * n, "2024Z") for n in (63, 64, 8191, 8192, 1 << 20, (1 << 20) + 1)]]
    enc = io.encode_message(spark.createDataFrame(rows, FIELDS), fmt="avro")
    assert [bytes(r.value) for r in enc.collect()] == [avro_reference(r) for r in rows]
    back = io.decode_message(enc, fmt="avro", reasons=True).collect()
    assert [tuple(r) for r in back] == [(*r, None) for r in rows]
    none = spark.createDataFrame([("p", None, "t", "x")], FIELDS)
    assert io.encode_message(none, fmt="avro").first().value is None


def test_avro_decoder_is_strict(spark):
    good = avro_reference(("p", "a", "t", "x"))
    cases = [(good, None), (None, "no value"), (b"", "length cut off"), (good[:-1], "text cut off"),
             (good + b"\0", "bytes after the record"), (b"\x80" * 4, "length cut off"),
             (b"\x80" * 5 + good, "length too long"), (b"\x01" + good, "negative length"),
             (good[:-1] + b"\xff", "text is not UTF-8"), (good[:4], "length cut off"),
             (b"\xfe\xff\xff\xff\x0f", "text cut off")]
    df = spark.createDataFrame([(i, v, r) for i, (v, r) in enumerate(cases)],
                               "id int, value binary, want string")
    for r in io.decode_message(df, fmt="avro", keep=["id", "want"], reasons=True).collect():
        assert r.reason == r.want, r
        assert (r.text is None) == (r.reason is not None)


def test_kafka_options():
    o = io.kafka_options("b:9092", "comments")
    assert o == {"kafka.bootstrap.servers": "b:9092", "topic": "comments"}
    o = io.kafka_options("b:9092", "t", "SASL_SSL", "SCRAM-SHA-512", "u", "p", "/ts.jks", "pw")
    assert o["kafka.security.protocol"] == "SASL_SSL"
    assert o["kafka.sasl.mechanism"] == "SCRAM-SHA-512" and "username=\"u\"" in o["kafka.sasl.jaas.config"]
    assert o["kafka.ssl.truststore.location"] == "/ts.jks"
    assert "kafka.sasl.mechanism" not in io.kafka_options("b", "t", "SSL", username="u")


def test_create_tables_is_idempotent(spark):
    db = "rivulet_ddl_test"
    names = schemas.create_tables(spark, db)
    assert schemas.create_tables(spark, db) == names
    cols = [c.name for c in spark.catalog.listColumns(f"{db}.stream_checkpoints")]
    assert cols == ["id", "stream_id", "last_comment_id", "last_processed_at", "updated_at"]
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_keyed_table_overwrites_only_touched_buckets(spark):
    from rivulet.sources.tables import overwrite_buckets, read_table
    d = new_work_dir(spark, "tbl")
    rows = [(f"s{i}", f"s{i}", "x", None, dt.datetime(2024, 1, 1)) for i in range(50)]
    t = spark.createDataFrame(rows, schemas.CHECKPOINTS)
    overwrite_buckets(t, f"{d}/t", "stream_id")
    upd = spark.createDataFrame([("s1", "s1", "y", None, dt.datetime(2024, 1, 2))], schemas.CHECKPOINTS)
    from rivulet.sources.tables import touched
    cur = touched(spark, f"{d}/t", schemas.CHECKPOINTS, upd, "stream_id").drop("bucket")
    new = cur.join(upd.select("stream_id"), "stream_id", "left_anti").unionByName(upd)
    overwrite_buckets(new, f"{d}/t", "stream_id")
    got = {r.stream_id: r.last_comment_id for r in read_table(spark, f"{d}/t", schemas.CHECKPOINTS).collect()}
    assert len(got) == 50 and got["s1"] == "y" and got["s2"] == "x"


def test_delete_keys_can_empty_a_bucket(spark):
    from rivulet.sources.tables import delete_keys, overwrite_buckets, read_table
    d = new_work_dir(spark, "tbl-del") + "/t"
    rows = [(f"s{i}", f"s{i}", "x", None, dt.datetime(2024, 1, 1)) for i in range(30)]
    t = spark.createDataFrame(rows, schemas.CHECKPOINTS)
    overwrite_buckets(t, d, "stream_id")
    gone = spark.createDataFrame([(f"s{i}",) for i in range(30) if i != 7] + [("nobody",)], "stream_id string")
    delete_keys(spark, d, schemas.CHECKPOINTS, gone, "stream_id")
    delete_keys(spark, d, schemas.CHECKPOINTS, gone, "stream_id")      # again: a no-op
    assert [r.stream_id for r in read_table(spark, d, schemas.CHECKPOINTS).collect()] == ["s7"]


def test_staging_tables_are_removed_after_overwrite(spark):
    import os
    from rivulet.session import work_root
    from rivulet.sources.tables import overwrite_buckets
    root = work_root(spark).replace("file:", "")
    before = {n for n in os.listdir(root) if n.startswith("stage-")}
    d = new_work_dir(spark, "tbl2")
    t = spark.createDataFrame([("s1", "s1", "x", None, dt.datetime(2024, 1, 1))], schemas.CHECKPOINTS)
    overwrite_buckets(t, f"{d}/t", "stream_id")
    after = {n for n in os.listdir(root) if n.startswith("stage-")}
    assert after == before


def test_append_errors_appends_with_table_defaults(spark):
    from pyspark.sql import functions as F
    from rivulet.operators.errors import with_error_defaults
    d = new_work_dir(spark, "err")
    rows = spark.createDataFrame(
        [("e1", "stream-1", "ConnectionError", "Connection timeout", dt.datetime(2024, 1, 1))],
        "id string, stream_id string, error_type string, error_message string,"
        " timestamp timestamp_ntz")
    shaped = with_error_defaults(rows)
    io.append_errors(shaped, f"{d}/errors")
    io.append_errors(shaped, f"{d}/errors")
    back = spark.read.parquet(f"{d}/errors")
    assert back.count() == 2
    r = back.first()
    assert (r.retry_count, r.is_recoverable) == (0, 1)
    assert back.where(F.col("bucket") == r.bucket).count() == 2
