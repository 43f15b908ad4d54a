"""Sources and sinks: comment source (O1), message sink (O3), error sink (O4) and the
message encoding (O5).

Files (parquet/json) are the tested path. Kafka needs the ``spark-sql-kafka`` package on the
cluster. Avro values are written and read by column expressions (``functions.avro``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.avro import decode_record, encode_record
from rivulet.schemas import COMMENT, MESSAGE

MESSAGE_FIELDS = [f.name for f in MESSAGE.fields]


def read_comments(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                  streaming: bool = True, options: dict | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """O1: all channels as one (streaming) DataFrame with a ``subreddit`` column. Null items
    (no id) of a file source are dropped, as the reader of a channel skips them.
    ``fmt='kafka'`` expects JSON comment values on a topic; a value that is not one comes out
    as a comment whose id is its topic position, without channel and author, so that it
    fails validation and is quarantined like any bad record."""
    reader = spark.readStream if streaming else spark.read
    opts = dict(options or {})
    if fmt == "kafka":
        # O2 in Kafka form: a new query starts at the end of the topic (skip what existed
        # before the session); a restarted query resumes from its own checkpoint.
        opts.setdefault("startingOffsets", "latest")
        if not streaming:
            opts["startingOffsets"] = options.get("startingOffsets", "earliest") \
                if options else "earliest"
        df = reader.format("kafka").options(**opts).load()
        # A comment without its own arrival time gets the record's time, as naive UTC.
        kts = F.convert_timezone(None, F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz"))
        return parse_records(df.select(
            F.col("value").cast("string").alias("value"), kts.alias("record_ts"),
            F.concat_ws("-", F.lit("record"), "topic", "partition", "offset").alias("record_id")))
    else:
        reader = reader.schema(COMMENT).format(fmt).options(**opts)
        if streaming and max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        df = reader.load(path)
    return df.where(F.col("comment_id").isNotNull())


def parse_records(records: DataFrame) -> DataFrame:
    """JSON comment records (``value``, ``record_ts``, ``record_id``) as comments. A record
    that does not parse, or has no id, keeps its record id and its text as the body."""
    c = F.from_json(F.col("value"), COMMENT)
    bad = F.col("c.comment_id").isNull()
    return records.select("*", c.alias("c")).select(
        F.coalesce("c.comment_id", "record_id").alias("comment_id"),
        F.when(~bad, F.col("c.subreddit")).alias("subreddit"),
        F.when(~bad, F.col("c.author")).alias("author"),
        F.when(bad, F.col("value")).otherwise(F.col("c.body")).alias("body"),
        F.coalesce("c.arrival_ts", "record_ts").alias("arrival_ts"))


def encode_message(df: DataFrame, fmt: str = "json", keep: list[str] | None = None) -> DataFrame:
    """The four message fields -> one ``value`` column (JSON text, or with ``avro`` the
    binary record of the declared schema)."""
    fields = [F.col(c) for c in MESSAGE_FIELDS]
    value = encode_record(fields) if fmt == "avro" else F.to_json(F.struct(*fields))
    return df.select(*(keep or []), value.alias("value"))


def decode_message(df: DataFrame, fmt: str = "json", keep: list[str] | None = None,
                   reasons: bool = False) -> DataFrame:
    """O5 inverse: ``value`` -> the four message fields, null where a value is no message. For
    ``avro``, ``reasons`` adds the column ``reason``: what is wrong with such a value."""
    if fmt == "avro":
        out = decode_record(df.select(*(keep or []), "value"), "value", MESSAGE_FIELDS)
        return out.select(*(keep or []), *MESSAGE_FIELDS, *(["reason"] if reasons else []))
    rec = F.from_json(F.col("value").cast("string"), MESSAGE)
    return df.select(*(keep or []), rec.alias("m")).select(*(keep or []), "m.*")


def kafka_options(bootstrap: str, topic: str, security_protocol: str = "PLAINTEXT",
                  sasl_mechanism: str | None = None, username: str | None = None,
                  password: str | None = None, truststore: str | None = None,
                  truststore_password: str | None = None) -> dict:
    """Producer options for the topic sink: the protocol is left out when plaintext and
    SASL settings are set only when both user and password are given."""
    o = {"kafka.bootstrap.servers": bootstrap, "topic": topic}
    if security_protocol and security_protocol != "PLAINTEXT":
        o["kafka.security.protocol"] = security_protocol
    if username and password:
        mech = sasl_mechanism or "PLAIN"
        o["kafka.sasl.mechanism"] = mech
        module = ("org.apache.kafka.common.security.scram.ScramLoginModule"
                  if mech.startswith("SCRAM") else
                  "org.apache.kafka.common.security.plain.PlainLoginModule")
        o["kafka.sasl.jaas.config"] = (f'{module} required username="{username}" '
                                       f'password="{password}";')
    if truststore:
        o["kafka.ssl.truststore.location"] = truststore
        if truststore_password:
            o["kafka.ssl.truststore.password"] = truststore_password
    return o


def write_messages(batch: DataFrame, target: str, fmt: str = "json",
                   options: dict | None = None, value_format: str | None = None,
                   keep: list[str] | None = None) -> None:
    """O3 for one micro-batch: value-only records to a topic (no key, no headers, so the
    broker spreads them over partitions) or files. Files hold the message rows, or with
    ``value_format`` the encoded ``value`` next to the ``keep`` columns. Called from
    ``foreachBatch``; file targets are written under a per-batch folder so a replayed
    batch overwrites instead of duplicating (a topic gets at-least-once delivery)."""
    if fmt == "kafka":
        (encode_message(batch, value_format or "json").write.format("kafka")
         .options(**(options or {})).save())
    elif value_format:
        (encode_message(batch, value_format, keep).write.mode("overwrite").format(fmt)
         .options(**(options or {})).save(target))
    else:
        batch.write.mode("overwrite").format(fmt).options(**(options or {})).save(target)


def append_errors(errors: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append error rows to the error table, partitioned like its DDL by the hash
    bucket of ``stream_id`` (reads of one stream prune to one bucket)."""
    from rivulet.sources.tables import BUCKET, with_bucket
    rows = errors if BUCKET in errors.columns else with_bucket(errors, "stream_id")
    rows.write.mode("append").format(fmt).partitionBy(BUCKET).save(path)
