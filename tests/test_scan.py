"""The bucketed per-key scan must equal a single ordered pass per key."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions.scan import keyed_scan


def _data(n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}"
        t = base + dt.timedelta(minutes=rnd.choice([rnd.randint(0, 60 * 24 * 5), 0, 30]))
        rows.append((k, i, t, rnd.random() < 0.3))
    return rows


import pytest


@pytest.mark.parametrize("unit", ["MINUTE", "HOUR", "DAY"])
def test_keyed_scan_matches_plain_window(spark, unit):
    df = spark.createDataFrame(_data(), "k string, seq long, ts timestamp_ntz, flag boolean")
    got = keyed_scan(df, ["k"], "ts", ["seq"], unit=unit,
                     sums={"cum": F.col("flag").cast("long")},
                     maxes={"mx": F.col("seq")}, gap="90 minutes",
                     last_where={"last_flag": F.col("flag")})
    w = Window.partitionBy("k").orderBy("ts", "seq")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = (df.withColumn("rn", F.row_number().over(w))
           .withColumn("cum", F.sum(F.col("flag").cast("long")).over(cum))
           .withColumn("mx", F.max("seq").over(cum))
           .withColumn("prev_ts", F.lag("ts").over(w))
           .withColumn("brk", F.when(F.col("prev_ts").isNull() | (
               F.col("ts") > F.col("prev_ts") + F.expr("INTERVAL 90 minutes")), 1).otherwise(0))
           .withColumn("island", F.sum("brk").over(cum))
           .withColumn("last_flag", F.max(F.when(F.col("flag"), F.col("rn"))).over(cum)))
    cols = ["k", "seq", "rn", "cum", "mx", "prev_ts", "brk", "island", "last_flag"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in ref.select(*cols).collect())
    assert len(a) == 3000 and a == b


def test_keyed_scan_plan_spreads_hot_key(spark):
    df = spark.createDataFrame(_data(200), "k string, seq long, ts timestamp_ntz, flag boolean")
    plan = keyed_scan(df, ["k"], "ts", ["seq"])._jdf.queryExecution().executedPlan().toString()
    # the big side is exchanged on (key, bucket), never on the key alone
    assert "hashpartitioning(k#" in plan and "_b#" in plan


def test_rows_without_time_or_key_are_not_counted(spark):
    import datetime as dt

    from rivulet.operators.checkpoints import checkpoint_every
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", 1, t), ("s", 2, None), (None, 3, t)],
                               "stream_id string, seq long, ts timestamp_ntz")
    got = [(r.last_comment_id, r.n_processed) for r in checkpoint_every(df, n=1).collect()]
    assert got == [("1", 1)]


def test_a_hot_hour_is_cut_by_its_measured_count(spark):
    """90 % of the rows in one key and one hour: the scan stays exact and no (key, bucket)
    holds more than twice the limit."""
    import datetime as dt
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from rivulet.functions.scan import _split_buckets, keyed_scan
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1, 7)
    rows = [("hot", i, t0 + dt.timedelta(microseconds=rnd.randrange(3_600_000_000)), rnd.random() < 0.3)
            for i in range(1800)]
    rows += [(f"k{i % 5}", 5000 + i, t0 + dt.timedelta(minutes=rnd.randrange(3000)), rnd.random() < 0.3)
             for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, ts timestamp_ntz, ok boolean")
    sizes = [r["count"] for r in _split_buckets(df, ["k"], "ts", "HOUR", 100).groupBy("k", "_b").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 2000
    got = keyed_scan(df, ["k"], "ts", ["seq"], sums={"oks": F.col("ok").cast("long")}, gap="2 seconds",
                     last_where={"last_ok": F.col("ok")}, split_over=100)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = (df.withColumn("rn", F.row_number().over(w)).withColumn("oks", F.sum(F.col("ok").cast("long")).over(cum))
            .withColumn("last_ok", F.max(F.when(F.col("ok"), F.col("rn"))).over(cum))
            .withColumn("prev_ts", F.lag("ts").over(w))
            .withColumn("brk", F.coalesce(F.col("ts") > F.col("prev_ts") + F.expr("INTERVAL 2 SECONDS"),
                                          F.lit(True)).cast("long"))
            .withColumn("island", F.sum("brk").over(cum)))
    cols = ["k", "seq", "rn", "oks", "last_ok", "prev_ts", "brk", "island"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(
        map(tuple, want.select(*cols).collect()), key=str)
