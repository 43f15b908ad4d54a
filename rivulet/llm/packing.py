"""Packing of tokenised documents into fixed windows, bounded-space and online.

Each task reads its documents once, in order. Full windows are cut off a document at once;
the rest goes into the open window where it fits best. A task keeps a fixed number of windows
open and emits the fullest when nothing fits. What is open at its end is written with the
rest and merged with the open windows of neighbouring tasks, whole window into whole window.
Texts never move: only the pieces (some fifty bytes each) are written, and only the pieces of
open windows are joined to their new place.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import encoder, read_vocab
from rivulet.llm.common import binary_text, materialize

OPEN = 128         # windows that a task keeps open
MERGE_TASKS = 64   # tasks whose open windows are merged together
_PIECES = ("{id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
           "window long, offset long, fill long, task long")


class BestFit:
    """Open windows by their free room. ``put`` gives (window, offset, closed windows)."""

    def __init__(self, size: int, limit: int, first: int = 0):
        self.size, self.limit, self.next = size, limit, first
        self.free: list[tuple[int, int]] = []  # (room, window), sorted

    def put(self, length: int) -> tuple[int, int, list[tuple[int, int]]]:
        closed = []
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                room, window = self.free.pop(0)
                closed.append((window, self.size - room))
            room, window = self.size, self.next
            self.next += 1
        offset, room = self.size - room, room - length
        if room:
            bisect.insort(self.free, (room, window))
        else:
            closed.append((window, self.size))
        return window, offset, closed


def tokenize(texts: list[bytes], enc, special: dict[str, int], vocabulary: bytes):
    """Ids of each text as the vocabulary's own library gives them. A text that spells a
    special token is left to that library, which reads it as the token."""
    marks = [m.encode() for m in special]
    odd = [i for i, t in enumerate(texts) if any(m in t for m in marks)]
    own = {}
    if odd:
        from tokenizers import Tokenizer
        lib = Tokenizer.from_buffer(vocabulary)
        for i in odd:
            text = texts[i].decode("utf-8", "replace")
            own[i] = np.array(lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    plain = [b"" if i in own else t for i, t in enumerate(texts)]
    for i, ids in enumerate(enc.encode(plain)):
        yield own.get(i, ids)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", open_windows: int = OPEN) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    A document is its ids by the byte-level BPE ``vocabulary`` (path of a ``.json`` file, read
    on the driver) followed by ``end_id``, so that null and empty texts are one id long. It is
    cut every ``size`` ids from its start; every id lies in exactly one piece and a sequence
    holds at most ``size`` ids without gaps. Long texts are handled whole. Repeated rows and
    null ids are packed like any other row; an empty table gives no pieces; other columns are
    not read. Sequence ids are unique, not dense.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one file, whatever the input
    src = docs.select(id_col, binary_text(text_col).alias("t"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces, special = read_vocab(shared.value)
        enc = encoder(pieces, vocabulary)
        task = TaskContext.get().partitionId()
        fit = BestFit(size, open_windows, task << 40)
        held: dict[int, list] = {}
        out: list[list] = []

        def close(windows, task=-1):
            for window, fill in windows:
                out.extend(r + [fill, task] for r in held.pop(window))

        def frame():
            names = ["start", "length", "crc", "tokens", "window", "offset", "fill", "task"]
            cols = list(zip(*out)) if out else [()] * 9
            batch = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=id_type)] + [pa.array(c, type=pa.int64()) for c in cols[1:]],
                names=[id_col, *names])
            out.clear()
            return batch

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids_of = tokenize(batch.column(1).to_pylist(), enc, special, shared.value)
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of):
                ids = np.append(ids, end_id).astype("<u4")
                total = len(ids)
                for start in range(0, total, size):
                    part = ids[start:start + size]
                    row = [doc, start, len(part), zlib.crc32(part.tobytes()), total]
                    window, offset, closed = fit.put(len(part))
                    held.setdefault(window, []).append([*row, window, offset])
                    close(closed)
                if len(out) >= 20_000:
                    yield frame()
        close([(window, size - room) for room, window in fit.free], task)
        yield frame()

    placed = materialize(src.mapInArrow(run, _PIECES.format(id=f"`{id_col}`", kind=kind)),
                         "pack-pieces")
    closed = placed.where("task < 0")
    left = placed.where("task >= 0")
    near = F.floor(F.col("task") / MERGE_TASKS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole open windows, the fullest first, into windows again."""
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
        fit = BestFit(size, len(pdf) + 1)
        spot = [fit.put(n)[:2] for n in pdf["fill"].tolist()]
        names = pdf["window"].to_numpy()
        first = {}
        for name, (bin_no, _) in zip(names, spot):
            first.setdefault(bin_no, name)
        return pd.DataFrame({"window": names, "sequence_id": [first[b] for b, _ in spot],
                             "base": [o for _, o in spot]})

    moved = (left.groupBy("window").agg(F.first("fill").alias("fill"), F.first("task").alias("task"))
             .groupBy(near.alias("near")).applyInPandas(
                 merge, "window long, sequence_id long, base long"))
    cols = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    return closed.select(*cols, F.col("window").alias("sequence_id"), "offset").unionByName(
        left.join(moved, "window").select(*cols, "sequence_id",
                                          (F.col("offset") + F.col("base")).alias("offset")))
