"""The periodic checkpoint flush as a streaming query over the checkpoint log.

Each micro-batch (one flush interval) merges the new partial updates into the keyed
"latest checkpoint" state (O25, last write wins per field), parses the touched rows (O10),
skips the ones whose stamp does not parse and upserts the rest into the durable columns
(O17). The state keeps the (time, seq) of each field's last write, so an update that arrives
late changes only the fields it is the newest for, as in the batch form.

The table is a log of versions: batch N appends its touched rows under ``batch_id=N`` and
reads only what came before, so a replayed batch writes the same files again and readers
never see half a rewrite. Every ``COMPACT`` batches the newest versions are also written as
``snapshot_id=N``, from which readers start; versions before the previous snapshot go.
``trigger(processingTime="10 seconds")`` is the periodic form; one ``availableNow`` run is the
final flush on shutdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.expr import utc_now
from rivulet.operators.checkpoints import flush_rows
from rivulet.schemas import CHECKPOINT_LOG, CHECKPOINTS
from rivulet.session import delete_path, list_names

FIELDS = ("last_comment_id", "last_processed_at")
DURABLE = [f.name for f in CHECKPOINTS.fields]
STATE = [f"{f}_{part}" for f in FIELDS for part in ("raw", "ts", "seq")]
TABLE_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType) for f in CHECKPOINTS.fields]
    + [T.StructField(n, {"raw": T.StringType(), "ts": T.TimestampNTZType(),
                         "seq": T.LongType()}[n.rsplit("_", 1)[1]]) for n in STATE])
COMPACT = 32


def seed_table(durable: DataFrame, table_path: str) -> None:
    """Start the table from existing durable rows (no latest state yet)."""
    blank = [F.lit(None).cast(TABLE_SCHEMA[n].dataType).alias(n) for n in STATE]
    durable.select(*DURABLE, *blank).write.mode("overwrite").parquet(
        f"{table_path}/snapshot_id=-1")


def _numbers(spark: SparkSession, table_path: str, kind: str) -> list[int]:
    prefix = f"{kind}_id="
    return sorted(int(n[len(prefix):]) for n in list_names(spark, table_path)
                  if n.startswith(prefix))


def read_state(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame:
    """The newest version of every row, as of the batches before ``before`` (all if None)."""
    def early(n):
        return before is None or n < before
    snapshot = max((n for n in _numbers(spark, table_path, "snapshot") if early(n)), default=None)
    parts = [] if snapshot is None else [(snapshot, f"{table_path}/snapshot_id={snapshot}")]
    parts += [(n, f"{table_path}/batch_id={n}") for n in _numbers(spark, table_path, "batch")
              if early(n) and (snapshot is None or n > snapshot)]
    if not parts:
        return spark.createDataFrame([], TABLE_SCHEMA)
    rows = None
    for n, path in parts:
        one = spark.read.schema(TABLE_SCHEMA).parquet(path).withColumn("_n", F.lit(n).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    cols = [c for c in TABLE_SCHEMA.fieldNames() if c != "stream_id"]
    return (rows.groupBy("stream_id").agg(F.max_by(F.struct(*cols), "_n").alias("r"))
            .select(*[F.col("stream_id") if c == "stream_id" else F.col(f"r.{c}").alias(c)
                      for c in TABLE_SCHEMA.fieldNames()]))


def durable_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The durable checkpoint rows (streams flushed at least once)."""
    return read_state(spark, table_path).where(F.col("id").isNotNull()).select(*DURABLE)


def _merge(current: DataFrame, log: DataFrame) -> DataFrame:
    """Latest raw value of each field with its (time, seq): stored ones and new updates."""
    updates = log.select("stream_id", *[
        F.when(F.col(f).isNotNull(), F.struct(F.col("updated_at").alias("ts"), F.col("seq"),
                                              F.col(f).alias("raw"))).alias(f) for f in FIELDS])
    stored = current.select("stream_id", *[
        F.when(F.col(f"{f}_raw").isNotNull(), F.struct(F.col(f"{f}_ts").alias("ts"), F.col(
            f"{f}_seq").alias("seq"), F.col(f"{f}_raw").alias("raw"))).alias(f) for f in FIELDS])
    best = (updates.unionByName(stored).groupBy("stream_id")
            .agg(*[F.max(f).alias(f) for f in FIELDS]))
    return best.select("stream_id", *[F.col(f"{f}.{p}").alias(f"{f}_{p}")
                                      for f in FIELDS for p in ("raw", "ts", "seq")])


def make_flush_writer(table_path: str, now_fn: Callable[[int], Column],
                      compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = batch.select(*CHECKPOINT_LOG.fieldNames())
        keys = log.select("stream_id").distinct()
        cur = read_state(spark, table_path, batch_id).join(keys, "stream_id", "left_semi")
        merged = _merge(cur, log)
        flushed = flush_rows(merged.where(" OR ".join(f"{f}_raw IS NOT NULL" for f in FIELDS))
                             .select("stream_id", *[F.col(f"{f}_raw").alias(f) for f in FIELDS]),
                             now_fn(batch_id))
        new = flushed.select(F.col("stream_id").alias("_sid"),
                             *[F.col(c).alias(f"_{c}") for c in DURABLE if c != "stream_id"])
        old = cur.select(F.col("stream_id").alias("_oid"),
                         *[F.col(c).alias(f"_o_{c}") for c in DURABLE if c != "stream_id"])
        j = (merged.join(new, merged["stream_id"] == new["_sid"], "left")
             .join(old, merged["stream_id"] == old["_oid"], "left"))
        hit = F.col("_sid").isNotNull()
        out = j.select(
            F.when(hit, F.coalesce("_o_id", "_id")).otherwise(F.col("_o_id")).alias("id"),
            "stream_id",
            *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
              for c in ("last_comment_id", "last_processed_at", "updated_at")], *STATE)
        out.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
        if (batch_id + 1) % compact == 0:
            read_state(spark, table_path, batch_id + 1).write.mode("overwrite").parquet(
                f"{table_path}/snapshot_id={batch_id}")
            for kind in ("snapshot", "batch"):  # a replay needs the previous snapshot on
                for n in _numbers(spark, table_path, kind):
                    if n < batch_id - compact or (kind == "batch" and n <= batch_id - compact):
                        delete_path(spark, f"{table_path}/{kind}_id={n}")
    return write


def run_flush(spark: SparkSession, log_source: str, table_path: str, checkpoint_dir: str,
              now_fn: Callable[[int], Column] | None = None, trigger: dict | None = None,
              fmt: str = "parquet"):
    log = spark.readStream.schema(CHECKPOINT_LOG).format(fmt).load(log_source)
    writer = make_flush_writer(table_path, now_fn or (lambda _bid: utc_now()))
    return (log.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint_dir)
            .trigger(**(trigger or {"availableNow": True})).start())
