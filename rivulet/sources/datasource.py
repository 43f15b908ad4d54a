"""Comment source (O1, O2) and ingest sink (O3, O4) as Python data sources.

``channel_log`` streams a folder of Parquet files, ``segment=<n>/subreddit=<channel>/*.parquet``,
as Spark writes it with ``partitionBy``; segments are appended in ascending order. It keeps an
offset for every channel: how many of its segments have been read. A new query starts where O2
says: a channel with a checkpoint from its first segment, any other after the segments that end
before the session. Only the columns of the schema it is loaded with are read.

``published`` writes rows of several kinds, one Parquet file per task and kind (and bucket), and
publishes a micro-batch at once: its commit writes one small file that names them. A batch that
is run again finds that file and publishes nothing, so every row appears once. Readers go by
those files (``read_published``).

Files are opened through pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

CHANNEL, ARRIVAL = "subreddit", "arrival_ts"


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _folders(store, path: str, prefix: str) -> dict[str, str]:
    from pyarrow import fs
    listed = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name.removeprefix(prefix): f.path for f in listed
            if f.type == fs.FileType.Directory and f.base_name.startswith(prefix)}


def _files(store, path: str) -> list[str]:
    from pyarrow import fs
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(path))
                  if f.base_name.endswith(".parquet") and f.size)


def _latest(store, file: str) -> dt.datetime | None:
    """Newest arrival in a file, from its footer."""
    from pyarrow import parquet as pq
    with store.open_input_file(file) as f:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index(ARRIVAL)
        found = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
    if any(s is None or not s.has_min_max for s in found):
        return None if not found else dt.datetime.max  # no statistics: not known to be old
    return max((s.max for s in found), default=None)


@dataclass
class _Part(InputPartition):
    channel: str
    file: str


class _ChannelReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.schema, self.root = schema, options["path"]
        self.resumed = set(json.loads(options.get("resume", "[]")))
        start = options.get("session_start")
        self.session_start = dt.datetime.fromisoformat(start) if start else None

    def _segments(self) -> list[tuple[int, dict[str, str]]]:
        """(number, channel folders) of every segment, ascending."""
        from urllib.parse import unquote
        store, root = _store(self.root)
        found = sorted((int(n), p) for n, p in _folders(store, root, "segment=").items())
        return [(n, {unquote(c): q for c, q in _folders(store, p, f"{CHANNEL}=").items()})
                for n, p in found]

    def initialOffset(self) -> dict:
        """Segments before the first one that O2 lets in, by channel. Channels that appear
        later start at 0 (everything of theirs is new)."""
        store, _ = _store(self.root)
        skipped: dict[str, int] = {}
        done: set[str] = set()
        for n, channels in self._segments():
            for c, folder in channels.items():
                if c in done or c in self.resumed or self.session_start is None:
                    continue
                newest = [t for t in (_latest(store, f) for f in _files(store, folder)) if t]
                if newest and max(newest) >= self.session_start:
                    done.add(c)
                else:
                    skipped[c] = n + 1
        return {"next": skipped}

    def latestOffset(self) -> dict:
        out: dict[str, int] = {}
        for n, channels in self._segments():
            out.update(dict.fromkeys(channels, n + 1))
        return {"next": out}

    def partitions(self, start: dict, end: dict):
        store, _ = _store(self.root)
        return [_Part(c, f) for n, channels in self._segments() for c, folder in channels.items()
                if start["next"].get(c, 0) <= n < end["next"].get(c, 0)
                for f in _files(store, folder)]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        want = to_arrow_schema(self.schema)
        # A file's own path carries no scheme; the root's file system opens it.
        store, _ = _store(self.root)
        with store.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(
                    columns=[c for c in want.names if c != CHANNEL]):
                columns = [pa.array([partition.channel] * len(batch), pa.string())
                           if c == CHANNEL else batch.column(c).cast(want.field(c).type)
                           for c in want.names]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


class ChannelLog(DataSource):
    """Options: ``path``; ``session_start`` (ISO, naive UTC) and ``resume`` (JSON list of the
    channels that have a checkpoint) for O2."""

    @classmethod
    def name(cls) -> str:
        return "channel_log"

    def schema(self):
        from rivulet.schemas import COMMENT
        return COMMENT

    def streamReader(self, schema):
        return _ChannelReader(schema, self.options)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Publisher(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.root, self.by = options["path"], options.get("kind", "kind")
        self.bucket = options.get("bucket")

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import parquet as pq
        store, root = _store(self.root)
        writers: dict[str, tuple] = {}
        for batch in iterator:
            kinds = batch.column(self.by)
            if self.bucket:
                kinds = pc.binary_join_element_wise(
                    kinds, pc.fill_null(pc.cast(batch.column(self.bucket), "string"), ""), "/")
            for kind in pc.unique(kinds).to_pylist():
                if kind not in writers:
                    path = f"{root}/data/{kind.rstrip('/')}/{uuid.uuid4().hex}.parquet"
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path)
                    writers[kind] = (path, out, pq.ParquetWriter(out, batch.schema))
                rows = batch.filter(pc.equal(kinds, kind))
                writers[kind][2].write_table(pa.Table.from_batches([rows]))
        for path, out, writer in writers.values():
            writer.close()
            out.close()
        return _Written([w[0].removeprefix(f"{root}/data/") for w in writers.values()])

    def commit(self, messages, batchId):
        from pyarrow import fs
        store, root = _store(self.root)
        store.create_dir(f"{root}/batches", recursive=True)
        name = f"{root}/batches/{batchId:012d}.json"
        if store.get_file_info(name).type == fs.FileType.File:
            return self.abort(messages, batchId)  # published before a restart
        with store.open_output_stream(name + ".tmp") as f:
            f.write(json.dumps({"batch_id": batchId, "files": [
                x for m in messages if m for x in m.files]}).encode())
        store.move(name + ".tmp", name)

    def abort(self, messages, batchId):
        store, root = _store(self.root)
        for m in messages:
            for x in (m.files if m else ()):
                store.delete_file(f"{root}/data/{x}")


class Published(DataSource):
    """Options: ``path``; ``kind`` (column that tells the kinds apart) and ``bucket`` (column of
    the bucket within a kind)."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def streamWriter(self, schema, overwrite):
        return _Publisher(self.options)


def register(spark: SparkSession) -> None:
    """Make both known by name, in the session that runs the query and in the active one: a
    writer's name is looked up there. Use one session of a context for them; Spark takes a name
    that the active session knows for taken in all others."""
    for session in (spark, SparkSession.getActiveSession() or spark):
        for source in (ChannelLog, Published):
            try:
                session.dataSource.register(source)
            except AnalysisException as e:
                if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                    raise


def read_published(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """The rows of one kind that were published so far (names of files come to the driver). A
    file that a dead task left behind is in no batch and is not read."""
    listed = spark.read.schema("batch_id long, files array<string>").json(f"{path}/batches")
    files = [f"{path}/data/{r.file}" for r in listed.select(F.explode("files").alias("file"))
             .where(F.col("file").startswith(f"{kind}/")).collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
