"""Ordered per-key scans that do not funnel a hot key through one task.

Many operators need "position of this row in its key's order": the every-N checkpoint
counter, failure streaks, error lists (sessions), lease epochs. A plain
``Window.partitionBy(key).orderBy(ts)`` sends all rows of a key to one task, and one stream
may hold a third of all rows. Instead each key is cut into buckets that are contiguous in
its order (a truncated time, cut finer where a measured count says so), and the scan runs in
three steps:

1. a window over ``(key, bucket)``, in parallel for every bucket (one shuffle of the data);
2. a per-bucket summary (count, sums, max, first/last time), an aggregate over the same
   partitioning (no second shuffle), then a window over each key's few bucket rows;
3. the summary's exclusive prefixes are joined back on ``(key, bucket)``; the big side is
   already partitioned that way, only the small summary moves.

The result is exact: row numbers, running sums and maxima, the previous row's time and
gap-based island numbers equal those of a single ordered pass per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import materialize

UNIT_SECONDS = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60}
SPLIT_OVER = 1_000_000   # rows of a (key, bucket) beyond which it is cut finer
MAX_SPLITS = 1 << 20     # spans that one bucket is cut into at most


def time_bucket(ts, unit: str = "HOUR") -> Column:
    """Nondecreasing integer bucket of a timestamp (DAY, HOUR or MINUTE).

    Computed without the session time zone: for TIMESTAMP_NTZ from the wall-clock date and
    hour/minute fields, for TIMESTAMP from epoch microseconds. (``date_trunc`` on an NTZ
    value casts it to the session zone first, which is not monotonic across a DST gap.)"""
    c = F.col(ts) if isinstance(ts, str) else ts
    unit = unit.upper()
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    if unit == "DAY":
        return days
    hours = days * 24 + F.hour(c)
    if unit == "HOUR":
        return hours
    if unit == "MINUTE":
        return hours * 60 + F.minute(c)
    raise ValueError(f"unsupported bucket unit {unit}")


def _bucket(df: DataFrame, ts: str, unit: str) -> Column:
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.floor(F.unix_micros(F.col(ts)) / (UNIT_SECONDS[unit.upper()] * 1_000_000))
    return time_bucket(ts, unit)


def _within(df: DataFrame, ts: str, unit: str) -> Column:
    """Microseconds since the start of the row's bucket, without the session time zone."""
    size = UNIT_SECONDS[unit.upper()] * 1_000_000
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.pmod(F.unix_micros(F.col(ts)), F.lit(size))
    of_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (
        F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")
    return F.pmod(of_day, F.lit(size))


def _split_buckets(df: DataFrame, keys: list[str], ts: str, unit: str, split_over: int) -> DataFrame:
    """``df`` with ``_b``. A (key, bucket) of more than ``split_over`` rows is cut into equal
    spans, as many as its count asks for. Where no bucket holds that many rows of all keys
    together (a count by bucket alone, which moves one row per bucket and task) there is nothing
    to cut. Otherwise the counts over the limit, at most rows / split_over, are written as a
    table whose size decides how it is joined."""
    raw = df.withColumn("_b", _bucket(df, ts, unit))
    spans = F.lit(1)
    if not raw.groupBy("_b").count().where(F.col("count") > split_over).isEmpty():
        hot = materialize(
            raw.groupBy(*[F.col(k).alias(f"_h_{i}") for i, k in enumerate(keys)],
                        F.col("_b").alias("_hb")).agg(F.count(F.lit(1)).alias("_hn"))
            .where(F.col("_hn") > split_over)
            .withColumn("_hn", F.least(F.ceil(F.col("_hn") / split_over), F.lit(MAX_SPLITS))),
            "hot-buckets")
        cond = [F.col(k) == F.col(f"_h_{i}") for i, k in enumerate(keys)]
        raw = raw.join(hot, cond + [F.col("_b") == F.col("_hb")], "left")
        spans = F.coalesce("_hn", F.lit(1))
    part = F.floor(_within(df, ts, unit) * spans / (UNIT_SECONDS[unit.upper()] * 1_000_000))
    return raw.select(*df.columns, (F.col("_b") * MAX_SPLITS + part).alias("_b"))


def keyed_scan(df: DataFrame, keys: list[str], ts: str, tiebreak: list[str],
               *, unit: str = "HOUR", sums: dict[str, Column] | None = None,
               maxes: dict[str, Column] | None = None, gap: str | None = None,
               last_where: dict[str, Column] | None = None, rn: str = "rn",
               split_over: int = SPLIT_OVER) -> DataFrame:
    """Scan each key's rows in ``(ts, *tiebreak)`` order.

    Adds ``rn`` (1-based position), one inclusive running sum per ``sums`` entry, one
    inclusive running max per ``maxes`` entry, per ``last_where`` entry the ``rn`` of the
    latest row so far (inclusive) where the condition holds (null if none), and when ``gap`` (an interval string such as
    ``"24 hours"``) is given: ``prev_ts`` (time of the previous row of the key), ``brk``
    (1 when the row starts a new island: first row or more than ``gap`` after the previous)
    and ``island`` (1-based island number). Rows with a null key or time have no place in
    the order and are dropped before they are counted: the join back uses plain equality so
    that it keeps the ``(key, bucket)`` partitioning of the big side.
    """
    sums = sums or {}
    maxes = maxes or {}
    last_where = last_where or {}
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    df = df.dropna(subset=[*keys, ts])
    b = _split_buckets(df, keys, ts, unit, split_over)
    for name, c in sums.items():
        b = b.withColumn(f"_sv_{name}", c)
    for name, c in maxes.items():
        b = b.withColumn(f"_mv_{name}", c)
    for name, c in last_where.items():
        b = b.withColumn(f"_wv_{name}", F.coalesce(c, F.lit(False)))

    wl = Window.partitionBy(*keys, "_b").orderBy(*order)
    wcum = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumn("_lrn", F.row_number().over(wl))
    for name in sums:
        local = local.withColumn(f"_ls_{name}", F.sum(f"_sv_{name}").over(wcum))
    for name in maxes:
        local = local.withColumn(f"_lm_{name}", F.max(f"_mv_{name}").over(wcum))
    for name in last_where:
        local = local.withColumn(f"_lw_{name}", F.max(
            F.when(F.col(f"_wv_{name}"), F.col("_lrn"))).over(wcum))
    if gap:
        local = (local.withColumn("_lprev", F.lag(ts).over(wl))
                 .withColumn("_lbrk", F.coalesce(
                     (F.col(ts) > F.col("_lprev") + F.expr(f"INTERVAL {gap}")).cast("long"),
                     F.lit(0).cast("long")))
                 .withColumn("_lcb", F.sum("_lbrk").over(wcum)))

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_sv_{n}").alias(f"_bs_{n}") for n in sums]
    aggs += [F.max(f"_mv_{n}").alias(f"_bm_{n}") for n in maxes]
    aggs += [F.max(F.when(F.col(f"_wv_{n}"), F.col("_lrn"))).alias(f"_bw_{n}")
             for n in last_where]
    if gap:
        aggs += [F.min(ts).alias("_bmin"), F.max(ts).alias("_bmax"),
                 F.sum("_lbrk").alias("_bbrk")]
    summary = local.groupBy(*keys, "_b").agg(*aggs)

    ws = Window.partitionBy(*keys).orderBy("_b")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_rn0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    for n in last_where:
        summary = summary.withColumn(f"_w0_{n}", F.max(F.col("_rn0") + F.col(f"_bw_{n}"))
                                     .over(before))
    cols = [F.col("_rn0")] + [F.col(f"_w0_{n}") for n in last_where]
    cols += [F.sum(f"_bs_{n}").over(before).alias(f"_s0_{n}") for n in sums]
    cols += [F.max(f"_bm_{n}").over(before).alias(f"_m0_{n}") for n in maxes]
    if gap:
        summary = (summary.withColumn("_pmax", F.lag("_bmax").over(ws))
                   .withColumn("_fbrk", F.when(F.col("_pmax").isNull() | (
                       F.col("_bmin") > F.col("_pmax") + F.expr(f"INTERVAL {gap}")), 1)
                       .otherwise(0).cast("long")))
        cols += [F.col("_pmax"), F.col("_fbrk"),
                 F.coalesce(F.sum(F.col("_bbrk") + F.col("_fbrk")).over(before),
                            F.lit(0)).alias("_brk0")]
    # Key columns are renamed so the join back is not a self-join on shared attributes.
    summary = summary.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
                             F.col("_b").alias("_kb"), *cols)

    cond = [F.col(k) == F.col(f"_k_{i}") for i, k in enumerate(keys)]
    # Every row has its bucket's summary row, so a left join equals an inner one; it keeps
    # the two branches identical (no inferred filter), letting Spark reuse the shuffle.
    joined = local.join(summary, cond + [F.col("_b") == F.col("_kb")], "left")
    out_cols = [F.col(c) for c in df.columns]
    out_cols.append((F.col("_rn0") + F.col("_lrn")).alias(rn))
    for name in sums:
        out_cols.append((F.coalesce(F.col(f"_s0_{name}"), F.lit(0))
                         + F.col(f"_ls_{name}")).alias(name))
    for name in maxes:
        out_cols.append(F.greatest(F.col(f"_m0_{name}"), F.col(f"_lm_{name}")).alias(name))
    for name in last_where:
        out_cols.append(F.when(F.col(f"_lw_{name}").isNotNull(),
                               F.col("_rn0") + F.col(f"_lw_{name}"))
                        .otherwise(F.col(f"_w0_{name}")).alias(name))
    if gap:
        out_cols.append(F.coalesce(F.col("_lprev"), F.col("_pmax")).alias("prev_ts"))
        out_cols.append(F.when(F.col("_lrn") == 1, F.col("_fbrk"))
                        .otherwise(F.col("_lbrk")).alias("brk"))
        out_cols.append((F.col("_brk0") + F.col("_fbrk") + F.col("_lcb")).alias("island"))
    return joined.select(*out_cols)
