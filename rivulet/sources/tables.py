"""Keyed tables stored as parquet partitioned by a hash bucket of the key.

Plain parquet has no MERGE, so a keyed write replaces only the buckets it touches
(dynamic partition overwrite). The new contents are first written as a staging table in
the shared work folder (``spark.checkpoint.dir``) and read back, so a plan never reads and
overwrites the same files. Re-running a write with the same input gives the
same table, which is what a replayed micro-batch needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rivulet.functions.expr import bucket_of
from rivulet.schemas import TABLE_BUCKETS
from rivulet.session import delete_path, materialize

BUCKET = "bucket"


def with_bucket(df: DataFrame, key: str, buckets: int = TABLE_BUCKETS) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(key, buckets))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole table, or an empty one with ``schema`` when nothing was written yet."""
    fields = [f for f in schema.fields if f.name != BUCKET]
    full = T.StructType(fields + [T.StructField(BUCKET, T.IntegerType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a table never written is empty
            raise
        return spark.createDataFrame([], full)


def touched(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, key: str,
            buckets: int = TABLE_BUCKETS) -> DataFrame:
    """Rows of the buckets that ``keys`` fall into (partition pruning via a semi-join on
    the bucket column; the bucket list is at most ``buckets`` values)."""
    tb = with_bucket(keys.select(key), key, buckets).select(BUCKET).distinct()
    return read_table(spark, path, schema).join(tb, BUCKET, "left_semi")


def overwrite_buckets(df: DataFrame, path: str, key: str, buckets: int = TABLE_BUCKETS,
                      stage: bool = True) -> None:
    """Replace exactly the buckets present in ``df`` (dynamic partition overwrite).
    ``stage=False`` only when ``df`` does not read the table being written."""
    data = df if BUCKET in df.columns else with_bucket(df, key, buckets)
    staged = None
    try:
        if stage:
            data, staged = materialize(data, "stage", with_path=True)
        (data.repartition(BUCKET).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    finally:
        if staged:
            delete_path(df.sparkSession, staged)


def delete_keys(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, key: str,
                buckets: int = TABLE_BUCKETS) -> None:
    """Delete the rows of ``keys`` from the table. Touched buckets are rewritten without them;
    a bucket that loses its last row loses its folder, which an overwrite cannot express.
    Keys that the table does not hold are a no-op."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    rows, staged = materialize(touched(spark, path, schema, keys, key, buckets)
                               .join(gone, F.col(key) == F.col("_gone"), "left"), "delete",
                               with_path=True)
    try:
        overwrite_buckets(rows.where("_gone IS NULL").drop("_gone"), path, key, buckets, stage=False)
        left = rows.groupBy(BUCKET).agg(F.count_if(F.col("_gone").isNull()).alias("n"))
        for r in left.where("n = 0").collect():  # at most ``buckets`` rows
            delete_path(spark, f"{path}/{BUCKET}={r[BUCKET]}")
    finally:
        delete_path(spark, staged)
