"""Pure column expressions: shaping (O7), validation (O8), naive-UTC parsing (O10),
error classification (O11) and recovery action (O12). All stay JVM-side (codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# ---------------------------------------------------------------------------------------
DELETED_AUTHOR = "[deleted]"
MAX_NAME_CHARS = 255
RETRYABLE_TYPES = ["ConnectionError", "TimeoutError", "TooManyRequests", "RequestException",
                   "SuspiciousActivity", "ResponseException"]
BACKOFF_TYPES = ["TooManyRequests", "RateLimitError"]
ABANDON_TYPES = ["NotFound", "BadRequest", "Forbidden", "InvalidCredentials", "ValueError"]
BACKOFF_SECONDS = {"TooManyRequests": 60, "RateLimitError": 30}
DEFAULT_BACKOFF_SECONDS = 5
COMMENT_ERROR_TYPE = "CommentProcessingError"
# ---------------------------------------------------------------------------------------

# Text form of a processing-time stamp: naive UTC, microseconds, trailing Z.
ISO_Z_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

# Accepted ISO-8601 grammar (as Python's ``fromisoformat`` for calendar dates): date
# YYYY-MM-DD or YYYYMMDD, then optionally any single separator character and a time
# HH[:MM[:SS]] or HH[MM[SS]] with an optional fraction ([.,]digits, of a second) after the
# last part, then an optional UTC offset written the same way. Colons are used throughout
# a time (or offset) or not at all. Week dates are not accepted.
# Basic forms are first rewritten to the extended form (the character after HHMM is kept
# in the match, so a following colon stops the rewrite); ISO_PATTERN then reads groups
# 1-3 (date) and 4-7 (hour, minute, second, fraction).
BASIC_DATE = (r"^(\d{4})(\d{2})(\d{2})", "{1}-{2}-{3}")
BASIC_HMS = (r"^(\d{4}-\d{2}-\d{2}.)(\d{2})(\d{2})(\d{2})", "{1}{2}:{3}:{4}")
BASIC_HM = (r"^(\d{4}-\d{2}-\d{2}.)(\d{2})(\d{2})([^:\d]|$)", "{1}{2}:{3}{4}")
_HH, _MS = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_OFFSET = rf"(?:[+-]{_HH}(?::{_MS}(?::{_MS})?|{_MS}(?:{_MS})?)?(?:[.,]\d+)?)"
ISO_PATTERN = (r"^(\d{4})-(\d{2})-(\d{2})"
               rf"(?:.({_HH[3:-1]})(?::({_MS})(?::({_MS}))?)?(?:[.,](\d{{1,6}})\d*)?"
               rf"{_OFFSET}?)?$")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_z(ts) -> Column:
    """Timestamp -> 'YYYY-MM-DDTHH:MM:SS.ffffffZ' (naive UTC text)."""
    return F.date_format(_col(ts), ISO_Z_FORMAT)


def utc_now() -> Column:
    """Processing time as naive UTC (wall clock in UTC, whatever the session zone)."""
    return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def parse_naive_utc(text) -> Column:
    """Strip trailing 'Z's, parse ISO-8601, drop (not convert) any offset; null when
    the text does not parse. The canonical text is cast straight to TIMESTAMP_NTZ, so the
    session zone plays no part."""
    s = F.regexp_replace(_col(text), "Z+$", "")
    for pattern, repl in (BASIC_DATE, BASIC_HMS, BASIC_HM):
        s = F.regexp_replace(s, pattern, repl.replace("{", "$").replace("}", ""))
    g = [F.regexp_extract(s, ISO_PATTERN, i) for i in range(1, 8)]
    part = [F.when(x == "", None).otherwise(x) for x in g]
    canonical = F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit(" "),
                         F.coalesce(part[3], F.lit("00")), F.lit(":"),
                         F.coalesce(part[4], F.lit("00")), F.lit(":"),
                         F.coalesce(part[5], F.lit("00")), F.lit("."),
                         F.rpad(F.coalesce(part[6], F.lit("")), 6, "0"))
    return F.when(s.rlike(ISO_PATTERN), canonical.try_cast("timestamp_ntz"))


def normalize(comments, ts_col=None):
    """Comment -> message. Deleted author -> '[deleted]', body -> text, stamp = naive
    UTC ISO text with 'Z' (processing time unless a time column is given)."""
    stamp = iso_z(ts_col) if ts_col is not None else iso_z(utc_now())
    return comments.select(
        "*",
        F.coalesce(F.col("author"), F.lit(DELETED_AUTHOR)).alias("author_id"),
        F.col("body").alias("text"),
        stamp.alias("timestamp"),
    )


def validation_flags() -> dict[str, Column]:
    """O8 rule columns over (subreddit, author_id, text, timestamp); null counts as bad."""
    def name_bad(c):
        n = F.char_length(F.col(c))
        return F.col(c).isNull() | (n == 0) | (n > MAX_NAME_CHARS)

    ts = F.col("timestamp")
    return {
        "bad_subreddit": name_bad("subreddit"),
        "bad_author": name_bad("author_id"),
        "bad_text": F.col("text").isNull() | (F.char_length(F.col("text")) < 1),
        "bad_timestamp": ts.isNull() | ~ts.endswith("Z") | parse_naive_utc(ts).isNull(),
    }


# Reason text per rule, joined in this order into the quarantine error message.
REASONS = [("bad_subreddit", "subreddit"), ("bad_author", "author_id"), ("bad_text", "text"),
           ("bad_timestamp", "timestamp")]


def validate(messages):
    """Add bad_* flags, is_valid and the joined reason list."""
    flags = validation_flags()
    out = messages.select("*", *[c.alias(n) for n, c in flags.items()])
    reasons = F.concat_ws("; ", *[F.when(F.col(n), F.lit(f"invalid {field}"))
                                  for n, field in REASONS])
    return out.select("*", (~(F.col("bad_subreddit") | F.col("bad_author") | F.col("bad_text")
                              | F.col("bad_timestamp"))).alias("is_valid"),
                      reasons.alias("reasons"))


def classify(df, type_col="error_type"):
    """O11 + O12: is_retryable, needs_backoff, backoff_seconds, action, is_recoverable.

    Action is the first match of abandon -> backoff -> immediate -> unhandled; class names
    are compared exactly."""
    t = F.col(type_col)
    retry = t.isin(RETRYABLE_TYPES)
    backoff = t.isin(BACKOFF_TYPES)
    secs = F.lit(DEFAULT_BACKOFF_SECONDS)
    for name, s in BACKOFF_SECONDS.items():
        secs = F.when(t == name, F.lit(s)).otherwise(secs)
    action = (F.when(t.isin(ABANDON_TYPES), "abandon")
              .when(backoff, "backoff")
              .when(retry & ~backoff, "immediate")
              .otherwise("unhandled"))
    return df.select("*",
                     F.coalesce(retry, F.lit(False)).alias("is_retryable"),
                     F.coalesce(backoff, F.lit(False)).alias("needs_backoff"),
                     secs.cast("int").alias("backoff_seconds"),
                     action.alias("action"),
                     F.coalesce(retry, F.lit(False)).cast("int").alias("is_recoverable"))


def suggested_backoff(type_col="error_type") -> Column:
    t = F.col(type_col) if isinstance(type_col, str) else type_col
    secs = F.lit(DEFAULT_BACKOFF_SECONDS)
    for name, s in BACKOFF_SECONDS.items():
        secs = F.when(t == name, F.lit(s)).otherwise(secs)
    return secs.cast("long")


def bucket_of(key, buckets: int) -> Column:
    """Hash bucket of a key, the partition column of the keyed tables."""
    return F.pmod(F.hash(_col(key)), F.lit(buckets)).cast("int")
