"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

DataFrame operations only. Rows are first counted by their hash (MD5), which moves no text and
combines map-side. Only rows whose hash occurs twice or more are then grouped on (MD5, SHA-256,
bytes): the hash values deal rows out, the bytes as the last grouping key make equal texts meet
and differing texts part even if a hash collides. Copies combine map-side here too, so a group
that holds a third of all rows sends one row per input partition. Rows then look up their group
by the two hashes, where they have one; that join carries no text and its hot keys are
splittable by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower, drop_rows, materialize, row_key


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "min") -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with
    the smallest (``keep="min"``) or largest (``"max"``) id of its group stays. Rows that
    repeat an id are kept or dropped alike; a null id stays only in a group without other ids.
    Other columns are not read. An empty table gives an empty result.
    """
    return _rows(docs, id_col, text_col, keep).withColumnRenamed("__id", id_col)


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("__id"), _norm(text_col).alias("__text")).select(
        "__id", "__text", F.unhex(F.md5("__text")).alias("__h128"),
        F.sha2("__text", 256).alias("text_sha256"))
    # Written, so that its size is known: while it is small, texts are filtered in place.
    again = materialize(rows.groupBy("__h128").agg(F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("__h128"), "exact-again")
    groups = (rows.join(again, "__h128", "left_semi").groupBy("__h128", "text_sha256", "__text")
              .agg(F.count(F.lit(1)).alias("group_size"), pick("__id").alias("keep_id"))
              .drop("__text"))
    return (rows.select("__id", "__h128", "text_sha256")
            .join(groups, ["__h128", "text_sha256"], "left")
            .select("__id", F.when(F.col("group_size").isNull(), F.col("__id"))
                    .otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    "text_sha256")
            .select("__id", "keep_id", "group_size",
                    F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _norm(text_col: str):
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, all columns: one with the smallest (largest) id,
    a row without id only where no row has one. Rows are judged by id and text, so rows that
    share an id or have none stay where their texts are the only ones of their kind."""
    rows = _rows(docs, id_col, text_col, keep)
    fate = materialize(
        rows.groupBy(row_key("__id", F.col("text_sha256")).alias("__key"))
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("not kept or n > 1").select("__key", "kept"), "exact-fate")
    return drop_rows(docs, row_key(id_col, F.sha2(_norm(text_col), 256)), fate)
