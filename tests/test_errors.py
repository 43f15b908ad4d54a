"""Error list operators."""
import datetime as dt

from rivulet.operators import errors
from rivulet.plans.fixtures import ntz

SCHEMA = "stream_id string, seq long, ts timestamp_ntz, error_type string, error_message string"
T0 = dt.datetime(2024, 1, 1)


def _errs(spark, offsets, stream="stream-1"):
    return spark.createDataFrame([(stream, i, T0 + d, "ConnectionError", "Connection timeout")
                                  for i, d in enumerate(offsets)], SCHEMA)


def test_keep_last_100_newest_first(spark):
    df = _errs(spark, [dt.timedelta(seconds=i) for i in range(150)])
    kept = errors.keep_last(df).collect()
    assert len(kept) == 100
    assert min(r.seq for r in kept) == 50
    assert [r.seq for r in kept if r.position == 1] == [149]


def test_lists_slide_and_exact_ttl_gap_keeps_list(spark):
    day = dt.timedelta(hours=24)
    df = _errs(spark, [dt.timedelta(0), day, 2 * day + dt.timedelta(seconds=1)])
    lists = errors.error_lists(df).orderBy("list_no").collect()
    assert [(r.list_no, r.n_pushed) for r in lists] == [(1, 2), (2, 1)]


def test_count_capped_and_zero_after_expiry(spark):
    df = _errs(spark, [dt.timedelta(seconds=i) for i in range(120)])
    live = errors.error_count(df, ntz("2024-01-01 12:00:00")).collect()
    assert live[0].error_count == 100
    gone = errors.error_count(df, ntz("2024-01-03 00:00:00")).collect()
    assert gone[0].error_count == 0


def test_count_three(spark):
    df = _errs(spark, [dt.timedelta(seconds=i) for i in range(3)])
    assert errors.error_count(df, ntz("2024-01-01 01:00:00")).first().error_count == 3


def test_recent_and_clear(spark):
    df = _errs(spark, [dt.timedelta(minutes=i) for i in range(30)])
    recent = errors.recent_errors(df, ntz("2024-01-01 01:00:00"), limit=10).collect()
    assert sorted(r.seq for r in recent) == list(range(20, 30))
    clears = spark.createDataFrame([("stream-1", T0 + dt.timedelta(minutes=25))],
                                   "stream_id string, clear_ts timestamp_ntz")
    after = errors.clear_errors(df, clears).collect()
    assert sorted(r.seq for r in after) == [26, 27, 28, 29]


def test_recent_never_returns_more_than_the_list_holds(spark):
    df = _errs(spark, [dt.timedelta(seconds=i) for i in range(150)])
    assert errors.recent_errors(df, ntz("2024-01-01 01:00:00"), limit=200).count() == 100


def test_live_list_ends_at_the_first_gap(spark):
    day = dt.timedelta(hours=24)
    df = _errs(spark, [dt.timedelta(0), day + dt.timedelta(seconds=1), 2 * day, 2 * day])
    as_of = ntz("2024-01-03 12:00:00")
    assert errors.error_count(df, as_of).first().error_count == 3
    assert sorted(r.seq for r in errors.recent_errors(df, as_of, limit=2).collect()) == [2, 3]


def test_split_quarantines_invalid_rows(spark):
    from rivulet.functions.expr import validate
    df = spark.createDataFrame([("1", "python", "a", "", "2024-01-01T00:00:00Z", T0),
                                ("2", "python", "a", "t", "2024-01-01T00:00:00Z", T0)],
                               "comment_id string, subreddit string, author_id string, text string,"
                               " timestamp string, arrival_ts timestamp_ntz")
    good, bad = errors.split(validate(df))
    assert [r.comment_id for r in good.collect()] == ["2"]
    b = bad.collect()[0]
    assert (b.error_type, b.error_message, b.is_recoverable, b.retry_count) == (
        "CommentProcessingError", "invalid text", 1, 0)
    assert len(b.id) == 36
