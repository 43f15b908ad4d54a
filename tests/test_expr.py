"""Shaping, validation, ISO parsing and error classification."""
import datetime as dt

from pyspark.sql import functions as F

from rivulet.functions import expr


def _one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_parse_naive_utc_strips_z_and_drops_offsets(spark):
    got = _one(spark, expr.parse_naive_utc("x"), [
        "2026-05-05T10:00:00Z", "2026-05-05T10:00:00+00:00", "2024-01-05T10:00:00+02:00",
        "2024-01-05T10:00:00.5", "2024-01-05", "2024-01-05 10", "2024-01-05T10:00ZZ",
        "bad", "2024-1-5", "2024", "2024-13-01", "2024-02-30", "2024-01-05T24:00:00", None, ""])
    assert got == [dt.datetime(2026, 5, 5, 10), dt.datetime(2026, 5, 5, 10),
                   dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 1, 5, 10, 0, 0, 500000),
                   dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 10),
                   dt.datetime(2024, 1, 5, 10), None, None, None, None, None, None, None, None]


def test_iso_z_format_round_trips(spark):
    got = _one(spark, expr.iso_z("x"), [dt.datetime(2026, 5, 9, 14, 30, 45, 123456)],
               "x timestamp_ntz")
    assert got == ["2026-05-09T14:30:45.123456Z"]
    back = _one(spark, expr.parse_naive_utc("x"), got)
    assert back == [dt.datetime(2026, 5, 9, 14, 30, 45, 123456)]


def test_normalize_deleted_author_and_text(spark):
    df = spark.createDataFrame([("c1", "python", None, "hi", dt.datetime(2024, 1, 1)),
                                ("c2", "python", "john_doe", "yo", dt.datetime(2024, 1, 1))],
                               "comment_id string, subreddit string, author string, body string,"
                               " arrival_ts timestamp_ntz")
    rows = expr.normalize(df, ts_col="arrival_ts").orderBy("comment_id").collect()
    assert [r.author_id for r in rows] == ["[deleted]", "john_doe"]
    assert [r.text for r in rows] == ["hi", "yo"]
    assert rows[0].timestamp == "2024-01-01T00:00:00.000000Z"
    live = expr.normalize(df).select("timestamp").first()[0]
    assert live.endswith("Z") and "T" in live and "+" not in live
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stamped = dt.datetime.fromisoformat(live.rstrip("Z"))
    assert abs((stamped - now).total_seconds()) < 120          # naive UTC, not local time


def test_utc_now_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = spark.range(1).select(expr.utc_now()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert abs((got - now).total_seconds()) < 120


def test_validate_edge_cases(spark):
    ok = "2026-05-09T14:30:45.123456Z"
    rows = [("python", "john_doe", "text", ok),            # sample message: valid
            ("", "a", "t", ok), ("s" * 256, "a", "t", ok), ("s" * 255, "a", "t", ok),
            ("p", "", "t", ok), ("p", "a" * 256, "t", ok),
            ("p", "a", "", ok), ("p", "a", "   ", ok),     # whitespace-only text is valid
            ("p", "a", "t", "2026-05-09T14:30:45"), ("p", "a", "t", "not-a-dateZ"),
            (None, "a", "t", ok), ("p", None, "t", ok), ("p", "a", None, ok), ("p", "a", "t", None)]
    df = spark.createDataFrame(rows, "subreddit string, author_id string, text string,"
                                     " timestamp string")
    got = [r.is_valid for r in expr.validate(df).collect()]
    assert got == [True, False, False, True, False, False, False, True, False, False,
                   False, False, False, False]
    reasons = expr.validate(df.limit(3)).select("reasons").collect()
    assert reasons[1][0] == "invalid subreddit"


def test_classify_decisions(spark):
    df = spark.createDataFrame([(t,) for t in ["ConnectionError", "TooManyRequests", "NotFound",
                                               "RateLimitError", "KeyError", "ValueError"]],
                               "error_type string")
    rows = {r.error_type: r for r in expr.classify(df).collect()}
    assert rows["ConnectionError"].action == "immediate"
    assert rows["TooManyRequests"].action == "backoff"
    assert rows["TooManyRequests"].backoff_seconds == 60
    assert rows["NotFound"].action == "abandon"
    assert rows["RateLimitError"].action == "backoff" and rows["RateLimitError"].is_recoverable == 0
    assert rows["RateLimitError"].backoff_seconds == 30
    assert rows["KeyError"].action == "unhandled" and rows["KeyError"].backoff_seconds == 5
    assert rows["ValueError"].action == "abandon"
