"""The three durable tables (O6) as bucketed catalog tables, and the keyed operators on them.

Rows lie in as many files as the caller chose buckets, by the hash of the column that they are
looked up by (streams: channel, checkpoints and errors: stream). The other side of a lookup
(O15), skip (O16), claim (O14) or upsert (O17) is dealt out into the same buckets, so the table
itself is read where it lies: no Exchange on its side. A keyed write replaces a table by its
next version: the new files are complete before the name changes over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import checkpoints as ck
from rivulet.operators import registry
from rivulet.operators.errors import with_error_defaults
from rivulet.schemas import BUCKETED, create_tables


class Tables:
    """The tables of one database. ``location`` puts their files below a folder (else the
    warehouse's); ``buckets`` holds for tables that are created here."""

    def __init__(self, spark: SparkSession, db: str, buckets: int, location: str | None = None):
        self.spark, self.db, self.buckets, self.location = spark, db, buckets, location
        create_tables(spark, db, buckets, location)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.db}.{name}")

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` in the tables' buckets, by ``key``."""
        return df.repartition(self.buckets, F.col(key))

    def _writer(self, df: DataFrame, name: str, mode: str, version: str | None = None):
        fields = [f.name for f in self.read(name).schema.fields]
        for f in fields:
            if f not in df.columns:
                df = df.withColumn(f, F.lit(None).cast(self.read(name).schema[f].dataType))
        key = BUCKETED[name]
        writer = (self.dealt(df, key).select(*fields).write.mode(mode).format("parquet")
                  .bucketBy(self.buckets, key).sortBy(key))
        if self.location and version:
            writer = writer.option("path", f"{self.location}/{name}-{version}")
        return writer

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows, in the table's columns by name; columns that ``df`` lacks are null."""
        self._writer(df, name, "append").saveAsTable(f"{self.db}.{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Write ``df`` as the table's next version, which may read the table itself."""
        from uuid import uuid4
        version = uuid4().hex[:8]
        self._writer(df, name, "errorifexists", version).saveAsTable(f"{self.db}.{name}_{version}")
        self.spark.sql(f"DROP TABLE {self.db}.{name}")
        self.spark.sql(f"ALTER TABLE {self.db}.{name}_{version} RENAME TO {self.db}.{name}")

    def lookup(self, df: DataFrame, key: str = "subreddit") -> DataFrame:
        """O15."""
        return registry.lookup(self.dealt(df, key), self.read("streams"))

    def create(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """O14 as a durable step: claims channels in the registry; what was created and what
        was in conflict, judged against the registry as it was."""
        from rivulet.session import materialize
        created, conflicts = (materialize(df, "claims") for df in registry.create_streams(
            self.read("streams"), self.dealt(requests, "subreddit")))
        self.append("streams", created)
        return created, conflicts

    def skip(self, comments: DataFrame, channel: str = "stream_id") -> DataFrame:
        """O16. The table has one row per stream, so a lookup by stream and a comparison do; an
        anti join on both columns would not meet the table's buckets."""
        points = self.read("stream_checkpoints").where("last_comment_id IS NOT NULL").select(
            F.col("stream_id").alias("_stream"), F.col("last_comment_id").alias("_last"))
        dealt = self.dealt(comments, channel)
        return (dealt.join(points, dealt[channel] == F.col("_stream"), "left")
                .where(~F.coalesce(F.col("comment_id") == F.col("_last"), F.lit(False)))
                .drop("_stream", "_last"))

    def upserted(self, updates: DataFrame, now: Column) -> DataFrame:
        """The checkpoint table as it would be after ``updates``, with ``change``."""
        return ck.upsert_checkpoints(self.read("stream_checkpoints"),
                                     self.dealt(updates, "stream_id"), now)

    def upsert(self, updates: DataFrame, now: Column) -> None:
        """O17, written."""
        self.replace("stream_checkpoints", self.upserted(updates, now).drop("change"))

    def append_errors(self, errors: DataFrame) -> None:
        """O4, with the table's defaults."""
        self.append("stream_errors", with_error_defaults(errors))

    def delete(self, ids: DataFrame) -> DataFrame:
        """O18 as one call: removes the streams of ``ids`` (column ``id``) with their
        checkpoints, and gives what was removed from the registry."""
        from rivulet.session import materialize
        streams, points = self.read("streams"), self.read("stream_checkpoints")
        gone = materialize(streams.join(ids.select("id").distinct(), "id", "left_semi"), "deleted")
        names = gone.select("subreddit").distinct()
        self.replace("streams", streams.join(self.dealt(names, "subreddit"), "subreddit", "left_anti"))
        keys = self.dealt(gone.select(F.col("id").alias("stream_id")), "stream_id")
        self.replace("stream_checkpoints", points.join(keys, "stream_id", "left_anti"))
        return gone

    def sweep(self) -> DataFrame:
        """O33 as one call: deletes the dead streams and gives them."""
        dead = self.read("streams").where(F.col("status").isin(registry.DEAD_STATUSES))
        return self.delete(dead)
