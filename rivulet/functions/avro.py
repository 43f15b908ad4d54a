"""Avro binary form of a record of strings (O5) as column expressions: no package needed.

Such a record is, for each field in order, the number of UTF-8 bytes as a zigzag varint (seven
bits a byte, lowest first, the high bit set on all but the last) and then the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARINT_BYTES = 5  # a text of up to 2 GB
# Why a value is not a record.
NO_VALUE, SHORT_LENGTH, LONG_LENGTH = "no value", "length cut off", "length too long"
NEGATIVE, SHORT_TEXT, NOT_UTF8 = "negative length", "text cut off", "text is not UTF-8"
TRAILING = "bytes after the record"


def _hex_byte(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("long")), 2, "0")


def varint(n: Column) -> Column:
    """Zigzag varint of a number that is not negative, as binary."""
    v = n.cast("long") * 2

    def byte(i: int, more: bool) -> Column:
        low = F.shiftright(v, 7 * i).bitwiseAND(F.lit(127))
        return _hex_byte(low + 128 if more else low)

    out = None
    for size in range(1, VARINT_BYTES + 1):
        text = F.concat(*(byte(i, i < size - 1) for i in range(size)))
        fits = v < F.lit(1 << (7 * size))
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.unhex(out)


def encode_record(fields: list[Column]) -> Column:
    """The record of these string columns; null if one of them is."""
    return F.concat(*(part for c in fields for part in (varint(F.octet_length(c)),
                                                        c.cast("binary"))))


def decode_record(df: DataFrame, value: str, fields: list[str]) -> DataFrame:
    """``df`` with one string column per field and ``reason``: null for a record, else what is
    wrong first (all fields are then null). Nothing but a whole record is accepted."""
    names = [f"__f{i}" for i in range(len(fields))]
    out = df.select("*", F.lit(1).alias("__at"), F.octet_length(value).alias("__size"),
                    F.when(F.col(value).isNull(), NO_VALUE).alias("__bad"))
    for name in names:
        bytes_ = [F.conv(F.hex(F.substring(F.col(value), F.col("__at") + i, F.lit(1))), 16, 10)
                  .cast("long") for i in range(VARINT_BYTES)]
        out = out.select("*", *(b.alias(f"__b{i}") for i, b in enumerate(bytes_)))
        used, total = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i in reversed(range(VARINT_BYTES)):
            last = (F.col(f"__b{i}") < 128) & (F.col("__at") + i <= F.col("__size"))
            so_far = F.lit(0).cast("long")
            for k in range(i + 1):
                so_far = so_far + F.shiftleft(F.col(f"__b{k}").bitwiseAND(F.lit(127)), 7 * k)
            used, total = F.when(last, i + 1).otherwise(used), F.when(last, so_far).otherwise(total)
        out = out.select("*", used.alias("__used"), total.alias("__zigzag"))
        left = F.col("__size") - F.col("__at") + 1
        length = F.shiftright("__zigzag", 1)
        text = F.substring(F.col(value), F.col("__at") + F.col("__used"), length.cast("int"))
        wrong = (F.when(F.col("__used").isNull() & (left < VARINT_BYTES), SHORT_LENGTH)
                 .when(F.col("__used").isNull(), LONG_LENGTH)
                 .when(F.col("__zigzag") % 2 != 0, NEGATIVE)
                 .when(F.col("__used") + length > left, SHORT_TEXT)
                 .when(~F.is_valid_utf8(text.cast("string")), NOT_UTF8))
        out = out.select("*", F.coalesce("__bad", wrong).alias("__bad2"), text.alias(name)).select(
            *(c for c in out.columns if c not in ("__bad", "__at")
              and not c.startswith("__b") and c not in ("__used", "__zigzag")),
            name, F.col("__bad2").alias("__bad"),
            F.when(F.col("__bad2").isNull(), F.col("__at") + F.col("__used") + length.cast("int"))
            .otherwise(F.col("__at")).alias("__at"))
    reason = F.coalesce("__bad", F.when(F.col("__at") <= F.col("__size"), TRAILING))
    return out.withColumn("reason", reason).select(
        *(F.col(c) for c in df.columns),
        *(F.when(F.col("reason").isNull(), F.col(n).cast("string")).alias(f)
          for n, f in zip(names, fields)), "reason")
