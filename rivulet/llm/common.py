"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import session

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Spark deletes an execution's shuffle files when that execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster ``lower``, which is equal there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


def fold(id_col, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within the block, finished executions drop their shuffle files. Only for executions
    whose result is written out, as a later job could not reuse those files."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def materialize(df: DataFrame, name: str, with_path: bool = False):
    """Write ``df`` to the shared work folder and read it back: lineage ends there, lost
    executors don't matter, and the shuffle files that made it are freed. ``with_path`` also
    gives the folder, for a table that can go before the result is read."""
    with shuffle_cleanup(df.sparkSession):
        return session.materialize(df, name, with_path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (one scan, one number to the driver)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def binary_text(text_col: str = "text") -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def row_key(id_col: str, digest: Column) -> Column:
    """A row's id and the digest of its text as one string; a null id differs from all others."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("")),
                    F.lit(":"), digest)


def drop_rows(docs: DataFrame, key: Column, fate: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. ``fate`` holds (``__key``, ``kept``) of the
    rows that go and, with ``kept``, of those that several rows have in common: one of them
    stays. It is a written table and is read more than once."""
    name = "__key"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    fate = fate.withColumnRenamed("__key", name)
    marked = docs.withColumn(name, key)
    stay = marked.join(fate.select(name), name, "left_anti").select(*docs.columns)
    again = fate.where("kept").select(name)
    if again.isEmpty():
        return stay
    order = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    one = marked.join(again, name, "left_semi").groupBy(name).agg(
        F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("s"))
    return stay.unionByName(one.select(*(F.col("s")[c].alias(c) for c in docs.columns)))


def slices(texts, max_bytes: int):
    """(start, end) index ranges of consecutive texts of about ``max_bytes`` together; a
    longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def free_memory() -> None:
    """Give memory that a task no longer uses back to the system: a Python worker lives on for
    later stages and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
